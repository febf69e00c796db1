"""N-gram Jaccard join with token-combination prefixes.

A text's set holds its distinct 5-word shingles. Two sets of Jaccard
similarity 3/4 differ in at most floor(n / 4) of either's n shingles, so a
prefix in a global order (rare first) that cannot lose all of its signatures
with that many shingles must share one with every partner. Shingles that no
other text holds count toward the prefix and need no signature. Rare shingles
are indexed singly. Frequent ones fall into m hashed classes, and pairs within
a class are indexed: c shingles of a class keep a pair unless c - 1 of them are
lost, so the prefix is extended until rare + sum(c - 1) exceeds the budget.
m follows the set's size level (n/8 to n/4), and a set emits at its own level
and, when a partner a third larger may reach it, at the next, so that partners
always meet at one level. Below 8 shingles frequent ones are indexed singly.

A shingle is known by 40 bits of its hash and by its part; with p parts two sets
of n shingles share one falsely with a probability of n^2 / (p 2^40).

Texts that share a signature are first compared with one member of it, the one
whose shingles are the most widespread: for copies with edits that is the
original or the one closest to it. Of what then lies in different components,
only pairs that can still reach the similarity are compared: they share no more
than the lesser number of their shingles that other texts hold, and no more
than their common part with that member plus what each shares besides. So
groups of copies cost about a linear number of comparisons, and no link between
components is lost. A signature with many texts left is dealt in squares of
SQUARE by SQUARE texts, so that no task gets all of them. Comparisons intersect
whole sets.

Empty or null texts have empty sets and link with nothing; equal texts with
words always link; ids may repeat or be null (a null never becomes a
component's id unless it has no other); extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sieveline.llm.common import U64, WordHashes, components, cut, grams, mix, node_of, partitions, scratch, small, table, text_or_empty
from sieveline.llm.postings import heavy_tokens, measured, shared_tokens

SHINGLE = 5
#: Similarity as a fraction: 75 / 100.
PART, WHOLE = 75, 100
#: 4 log2 of the number of texts up to which a shingle is rare (32 texts).
RARE_CLASS = 20
#: Texts of one signature on a side of what one task compares.
SQUARE = 512
#: Rows of a few numbers that may be broadcast; they are counted first.
BROADCAST_ROWS = 200_000
_LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
_SCHEMA = pa.schema([("node", pa.int64()), ("n", pa.int64()), ("spread", pa.int64()), ("tokens", pa.list_(pa.int64())), ("sigs", pa.list_(pa.int64()))])


def shingles(texts: list) -> tuple[list, list]:
    """Distinct shingle hashes of each text."""
    hashes, out = WordHashes(), []
    for text in texts:
        words = text.encode("utf-8", "surrogatepass").translate(_LOWER).split()
        h = hashes.of(words)
        if len(h) >= SHINGLE:
            out.append(np.unique(grams(h, SHINGLE)))
        else:
            out.append(mix(grams(h, len(h)) + U64(len(h))) if len(h) else np.empty(0, U64))
    return out, [len(x) for x in out]


def _pairs(tokens: np.ndarray, group: np.ndarray, level: int) -> np.ndarray:
    """A signature for every two tokens of one group."""
    order = np.lexsort((tokens, group))
    tokens, group = tokens[order], group[order]
    out = []
    with np.errstate(over="ignore"):
        for d in range(1, len(tokens)):
            same = group[d:] == group[:-d]
            if not same.any():
                break
            out.append(mix(mix(tokens[:-d][same]) * U64(3) + tokens[d:][same] + U64(level << 56)))
    return np.concatenate(out) if out else np.empty(0, U64)


def signatures(n: int, tokens: np.ndarray, classes: np.ndarray) -> np.ndarray | None:
    """Signatures of a set of n shingles, of which these are shared; None when no partner is possible."""
    need = n - -(-PART * n // WHOLE) + 1 - (n - len(tokens))
    if need <= 0 or n == 0:
        return None
    order = np.lexsort((tokens, classes))
    tokens, rare = tokens[order], int((classes <= RARE_CLASS).sum())
    out = [mix(tokens[: min(rare, need)])]
    if rare < need:
        frequent, need = tokens[rare:], need - rare
        for level in sorted({n.bit_length() - 1, (WHOLE * n // PART).bit_length() - 1}):
            if level < 3:
                out.append(mix(frequent[:need] + U64((level + 1) << 56)))
                continue
            group = mix(frequent ^ U64(level << 56)) % U64(1 << (level - 2))
            again = np.ones(len(frequent), np.int64)
            again[np.unique(group, return_index=True)[1]] = 0
            reach = int(np.searchsorted(np.cumsum(again), need)) + 1
            out.append(_pairs(frequent[:reach], group[:reach], level))
    return np.unique(np.concatenate(out))


def _finish(node: int, n: int, tokens: np.ndarray, classes: np.ndarray) -> tuple:
    sigs = signatures(n, tokens, classes)
    if sigs is None:
        return node, n, None, None, None
    return node, n, int(classes.astype(np.int64).sum()) * 1000 // n, np.sort(tokens).view(np.int64), sigs.view(np.int64)


def _enough(common: Column, na: str, nb: str) -> Column:
    """WHOLE * common >= PART * union."""
    return common * (WHOLE + PART) >= (F.col(na) + F.col(nb)) * PART


def _compared(pairs: DataFrame, live: DataFrame) -> DataFrame:
    """(a, na, b, nb, common) of distinct pairs (a, b) of nodes."""
    left = live.select(F.col("node").alias("a"), F.col("n").alias("na"), F.col("tokens").alias("ta"))
    right = live.select(F.col("node").alias("b"), F.col("n").alias("nb"), F.col("tokens").alias("tb"))
    return pairs.join(right, "b").join(left, "a").select("a", "na", "b", "nb", F.size(F.array_intersect("ta", "tb")).cast("long").alias("common"))


def _possible(pairs: DataFrame, live: DataFrame) -> DataFrame:
    """The pairs whose sets, by 31 bits of each shingle, share enough: half of what travels for a comparison of whole shingles, which follows for these. Shingles of one set that look alike count as shared."""
    brief = live.select("node", "n", "m", F.array_distinct(F.transform("tokens", lambda t: t.bitwiseAND(0x7FFFFFFF).cast("int"))).alias("t"))
    left, right = (brief.select(F.col("node").alias(k), F.col("n").alias("n" + k), (F.col("m") - F.size("t")).alias("m" + k), F.col("t").alias("t" + k)) for k in "ab")
    common = F.size(F.array_intersect("ta", "tb")) + F.col("ma") + F.col("mb")
    return pairs.join(right, "b").join(left, "a").where(_enough(common, "na", "nb")).select("a", "b")


def _left_over(rest: DataFrame) -> DataFrame:
    """Distinct pairs (a, b) of texts of one signature in different components that can still reach the similarity; what is held of a text does not grow with the square of its signatures."""
    plain = F.least("ma", "mb")
    through = F.least("commona", "commonb") + F.least(F.col("ma") - F.col("commona"), F.col("mb") - F.col("commonb"))
    able = (F.col("labela") < F.col("labelb")) & _enough(F.least(plain, F.coalesce(through, plain)), "na", "nb")

    def met(one: DataFrame, other: DataFrame, *keys: str) -> DataFrame:
        x, y = (side.select(*keys, *(F.col(c).alias(c + k) for c in ("node", "n", "m", "label", "common"))) for k, side in (("a", one), ("b", other)))
        return x.join(y, list(keys)).where(able).select(F.col("nodea").alias("a"), F.col("nodeb").alias("b"))

    many = cut(rest.groupBy("sig").agg(F.count(F.lit(1)).alias("texts")).where(F.col("texts") > SQUARE))
    if not many.limit(1).count():
        return met(rest, rest, "sig").distinct()
    many = small(many, BROADCAST_ROWS)
    few = rest.join(many, "sig", "left_anti")
    rows = rest.join(many, "sig").withColumn("side", F.ceil(F.col("texts") / SQUARE).cast("int")).withColumn("own", F.pmod(F.xxhash64("node", F.lit(11)), F.col("side")).cast("int"))
    every = F.explode(F.sequence(F.lit(0), F.col("side") - 1))
    return met(few, few, "sig").union(met(rows.withColumn("i", F.col("own")).withColumn("j", every), rows.withColumn("j", F.col("own")).withColumn("i", every), "sig", "i", "j")).distinct()


def classes_of(documents: DataFrame, text: str = "text") -> tuple[DataFrame, DataFrame]:
    """(nodes: node, n; labels: node, label for the nodes that have links to other texts)."""
    docs = documents.select(node_of(text).alias("node"), text_or_empty(text).alias("text"))
    deal = partitions(docs.sparkSession)
    total, parts = measured(docs)
    sets = cut(shared_tokens(docs, shingles, _finish, _SCHEMA, parts, heavy_tokens(docs, shingles, total, parts)))
    live = sets.where("sigs is not null").withColumn("m", F.size("tokens").cast("long"))
    index = live.select(F.explode("sigs").alias("sig"), "node", "n", "m", "spread")
    # what an aggregate makes is dealt anew before it meets rows, so that adaptive execution can split a signature of very many texts
    hubs = index.groupBy("sig").agg(F.max(F.struct("spread", "node", "n", "m")).alias("hub"), F.min("node").alias("lo"), F.max("node").alias("hi")).where("lo <> hi").repartition(deal)
    met = cut(index.drop("spread").join(hubs.select("sig", F.col("hub.node").alias("hub"), F.col("hub.n").alias("hub_n"), F.col("hub.m").alias("hub_m")), "sig"))
    stars = met.where("node <> hub").where(_enough(F.least("m", "hub_m"), "n", "hub_n")).select(F.col("hub").alias("a"), F.col("node").alias("b")).distinct()
    tested = cut(_compared(stars, live.select("node", "n", "tokens")))
    found = tested.where(_enough(F.col("common"), "na", "nb")).select("a", "b")
    labels = components(found)
    known = met.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    split = known.groupBy("sig").agg(F.min("label").alias("l0"), F.max("label").alias("l1")).where("l0 < l1").select("sig").repartition(deal)
    rest = known.where("node <> hub").join(split, "sig").join(tested.select(F.col("a").alias("hub"), F.col("b").alias("node"), "common"), ["hub", "node"], "left")
    # without a test the hub was out of reach: nothing is known of what they share
    rest = cut(rest.select("sig", "node", "n", "m", "label", "common"))
    possible = cut(_possible(_left_over(rest), live))
    more = cut(_compared(possible, live.select("node", "n", "tokens")))
    more = more.where(_enough(F.col("common"), "na", "nb")).select("a", "b")
    if more.limit(1).count():
        labels = components(found.union(more))
    return sets.select("node", "n"), labels


def labelled(documents: DataFrame, *columns: str) -> DataFrame:
    """These columns of every document row, n (shingles) and label (a node of its component)."""
    nodes, labels = classes_of(documents)
    node, n, label = scratch(documents.select(*columns), "node", "n", "label")
    # dealt anew, so that adaptive execution can split the rows of one text
    known = nodes.join(labels, "node", "left").select(F.col("node").alias(node), F.col("n").alias(n), F.coalesce("label", "node").alias(label)).repartition(partitions(documents.sparkSession))
    rows = documents.select(*columns, node_of().alias(node)).join(known, node)
    return rows.select(*columns, F.col(n).alias("n"), F.col(label).alias("label"))


def near_duplicates(documents: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id: the least id of a document's component."""
    rows = cut(labelled(documents, "doc_id"))
    least = rows.where("n > 0").groupBy("label").agg(F.min("doc_id").alias("least")).repartition(partitions(documents.sparkSession))
    return rows.join(least, "label", "left").select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") == 0, F.col("doc_id")).otherwise(F.col("least")).alias("component_id"))


def one_of_each(documents: DataFrame) -> DataFrame:
    """Documents without all but one of each component: the least id stays (null last), of equal ids one text, of its rows one. Texts without words all stay.

    Decided by id and text only, never by a row's place, so that another split of the files or a lost executor changes nothing.
    """
    node, first, own_id, stays, again, other = scratch(documents, "node", "first", "id", "stays", "rows", "other")
    rows = documents.withColumn(node, node_of())
    nodes, labels = classes_of(documents)
    keys = rows.groupBy(node, "doc_id").agg(F.count(F.lit(1)).alias(again))
    known = nodes.where("n > 0").join(labels, "node", "left").select(F.col("node").alias(node), F.coalesce("label", "node").alias(first))
    deal = partitions(documents.sparkSession)
    keys = cut(keys.repartition(deal).join(known.repartition(deal), node))
    least = keys.groupBy(first).agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", node)).alias(other)).repartition(deal)
    kept = (F.col(node) == F.col(f"{other}.{node}")) & F.col("doc_id").eqNullSafe(F.col(f"{other}.doc_id"))
    judged = keys.join(least, first).select(F.col(node).alias(other), F.col("doc_id").alias(own_id), kept.alias(stays), again)
    taken = cut(judged.where(~F.col(stays) | (F.col(again) > 1)).drop(again))
    own = (F.col(node) == F.col(other)) & F.col("doc_id").eqNullSafe(F.col(own_id))
    out = rows.join(small(taken, BROADCAST_ROWS), own, "left_anti").select(*documents.columns)
    repeated = taken.where(F.col(stays))
    if repeated.limit(1).count():
        row = F.min_by(F.struct(*documents.columns), F.xxhash64(*documents.columns))
        out = out.union(rows.join(small(repeated, BROADCAST_ROWS), own, "left_semi").groupBy(node, "doc_id").agg(row.alias(other)).select(f"{other}.*"))
    return out


def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


OP7_SQL = r"""
with recursive w as (
  select doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') as ws from documents),
s as (
  select distinct doc_id, array_to_string(ws[i:i + 4], ' ') as g
  from (select doc_id, ws, unnest(range(1, greatest(len(ws) - 4, 1) + 1)) as i from w where len(ws) > 0)),
n as (select doc_id, count(*) as n from s group by doc_id),
p as (select a.doc_id as a, b.doc_id as b, count(*) as c from s a join s b on a.g = b.g and a.doc_id < b.doc_id group by 1, 2),
e as (select p.a, p.b from p join n na on na.doc_id = p.a join n nb on nb.doc_id = p.b where 100 * c >= 75 * (na.n + nb.n - c)),
l as (select a as x, b as y from e union all select b, a from e),
r as (select doc_id as x, doc_id as y from w union select r.x, l.y from r join l on r.y = l.x)
select w.doc_id, coalesce(n.n, 0)::bigint as n_shingles, m.c as component_id
from w left join n using (doc_id) join (select x, min(y) as c from r group by x) m on m.x = w.doc_id
"""
