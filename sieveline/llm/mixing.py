"""Mixing sources to target weights by hierarchical budgeting.

Leaves are the paths domain / language / source. The budget of tokens goes down
the tree: a node's budget is split among its children in proportion to their
weights, but no child gets more than its capacity (``epochs`` times the tokens
below it); what a child can't use goes to its siblings first, in proportion to
their weights, and only what a whole family can't use was never given to it,
because its parent split by capacities in the same way. Splits are whole
numbers, rounded down.

A leaf with budget b and a tokens takes b div a whole epochs and, of the next
one, the longest prefix of its documents in a seeded order that fits the rest.
The order is that of md5(seed, epoch, id), then id, then tokens. Tokens are
counted once; what is then kept of a document is its id, path and count. A leaf's
prefix is found as the place where it ends: tokens are summed by leaf and the
first three digits of the digest, and only the group of digits where the prefix
ends is put in order. Documents are selected by comparing them with that place,
so texts are never dealt by leaf.

Nulls in the path are ``unknown``; nodes without a weight have 1; documents
without tokens are not selected; equal rows are counted each, ids may be null.
Of rows that are alike in id and count at the end of a prefix as many are taken
as fit. ``mix_documents`` adds ``copies`` (``copies_`` where the table has that
column already).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sieveline.llm.common import cut, scratch, small, table, text_or_empty

SEED, EPOCHS = "mix-1", 4
#: Budget as a fraction of the input's tokens.
BUDGET = (1, 2)
WEIGHTS = {"domain": {"d0": 4, "d1": 3, "d2": 2, "d3": 1}, "language": {"en": 3, "de": 2, "fr": 2, "es": 2}, "source": {"src0": 2}}
LEVELS = ("domain", "language", "source")
_PREFIX = 3
#: Leaves (rows of a few values) that may be broadcast; they are counted first.
BROADCAST_ROWS = 200_000


def weight_of(level: str, weights: dict) -> Column:
    out = F.lit(1).cast("long")
    for name, w in weights.get(level, {}).items():
        out = F.when(F.col(level) == name, F.lit(w).cast("long")).otherwise(out)
    return out


def _big(c: Column) -> Column:
    return c.cast("decimal(19,0)")


def split_budget(children: DataFrame, parent: list[str], child: str) -> DataFrame:
    """Adds budget to children (parent keys, child, weight, capacity, given): water-filling among siblings."""
    order = Window.partitionBy(*parent).orderBy(F.col("capacity").cast("double") / F.col("weight"), child)
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    after = order.rowsBetween(0, Window.unboundedFollowing)
    family = Window.partitionBy(*parent)
    rows = children.withColumns({"used": F.coalesce(F.sum("capacity").over(before), F.lit(0)), "open": F.sum("weight").over(after)})
    rows = rows.withColumn("full", _big(F.col("capacity")) * _big(F.col("open")) <= _big(F.col("weight")) * _big(F.col("given") - F.col("used")))
    rows = rows.withColumns({
        "rest": F.col("given") - F.sum(F.when(F.col("full"), F.col("capacity")).otherwise(0)).over(family),
        "shares": F.sum(F.when(F.col("full"), 0).otherwise(F.col("weight"))).over(family),
    })
    part = F.expr("cast(weight as decimal(19,0)) * cast(rest as decimal(19,0)) div greatest(shares, 1)")
    return rows.withColumn("budget", F.when(F.col("full"), F.col("capacity")).otherwise(part)).drop("used", "open", "full", "rest", "shares", "given", "weight")


def leaf_budgets(leaves: DataFrame, total: int | Column, weights: dict = WEIGHTS, epochs: int = EPOCHS) -> DataFrame:
    """(domain, language, source, tokens, budget) from (domain, language, source, tokens)."""
    leaves = leaves.withColumn("capacity", F.col("tokens") * epochs)
    languages = leaves.groupBy("domain", "language").agg(F.sum("capacity").alias("capacity"))
    domains = languages.groupBy("domain").agg(F.sum("capacity").alias("capacity"))
    root = domains.withColumns({"root": F.lit(1), "weight": weight_of("domain", weights), "given": F.lit(total).cast("long") if isinstance(total, int) else total})
    domains = split_budget(root, ["root"], "domain").select("domain", F.col("budget").alias("given"))
    languages = split_budget(languages.withColumn("weight", weight_of("language", weights)).join(domains, "domain"), ["domain"], "language").select("domain", "language", F.col("budget").alias("given"))
    return split_budget(leaves.withColumn("weight", weight_of("source", weights)).join(languages, ["domain", "language"]), ["domain", "language"], "source").select(*LEVELS, "tokens", "budget")


def n_tokens(column: str = "text") -> Column:
    return F.size(F.array_remove(F.split(text_or_empty(column), r"[\x20\x09-\x0D]+"), "")).cast("long")


def path_of() -> dict[str, Column]:
    """Domain (the source's number modulo 4), language and source of a row of documents."""
    number = F.regexp_extract(F.coalesce("source", F.lit("")), r"([0-9]{1,9})$", 1)
    return {
        "domain": F.when(number == "", F.lit("unknown")).otherwise(F.concat(F.lit("d"), F.expr("try_cast(regexp_extract(coalesce(source, ''), '([0-9]{1,9})$', 1) as int) % 4").cast("string"))),
        "language": F.coalesce("lang", F.lit("unknown")), "source": F.coalesce("source", F.lit("unknown")),
    }


def _ordered(rows: DataFrame, plan: DataFrame, seed: str) -> DataFrame:
    """Rows with their leaf's plan and their place in its order."""
    marked = rows.join(small(plan, BROADCAST_ROWS), list(LEVELS))
    digest = F.md5(F.concat_ws(":", F.lit(seed), F.col("whole").cast("string"), F.coalesce(F.col("id").cast("string"), F.lit(""))).cast("binary"))
    return marked.withColumn("at", F.struct(digest.alias("digest"), "id", "n_tokens"))


def leaf_ends(rows: DataFrame, weights: dict = WEIGHTS, budget: tuple[int, int] = BUDGET, epochs: int = EPOCHS, seed: str = SEED) -> DataFrame:
    """For each leaf of rows (id, domain, language, source, n_tokens): whole epochs, the place where the prefix ends (the first that does not fit), and how many rows of that very place still fit."""
    leaves = cut(rows.groupBy(*LEVELS).agg(F.sum("n_tokens").alias("tokens")))
    total = leaves.agg(F.sum("tokens")).first()[0] or 0
    plan = leaf_budgets(leaves, total * budget[0] // budget[1], weights, epochs)
    plan = cut(plan.select(*LEVELS, F.expr("case when tokens > 0 then budget div tokens else 0 end").alias("whole"), (F.col("budget") % F.greatest("tokens", F.lit(1))).alias("rest")))
    marked = _ordered(rows, plan, seed).withColumn("digits", F.substring("at.digest", 1, _PREFIX))
    sums = marked.groupBy(*LEVELS, "digits").agg(F.sum("n_tokens").alias("sum"), F.first("rest").alias("rest"))
    running = Window.partitionBy(*LEVELS).orderBy("digits")
    group = sums.withColumn("through", F.sum("sum").over(running)).where("through > rest").groupBy(*LEVELS).agg(F.min("digits").alias("digits"), F.min_by(F.col("through") - F.col("sum"), "digits").alias("taken"))
    inside = marked.join(small(cut(group), BROADCAST_ROWS), [*LEVELS, "digits"]).groupBy(*LEVELS, "at", "n_tokens").agg(F.count(F.lit(1)).alias("alike"), F.first("rest").alias("rest"), F.first("taken").alias("taken"))
    own = F.col("alike") * F.col("n_tokens")
    left = F.col("rest") - F.col("taken") - F.sum(own).over(Window.partitionBy(*LEVELS).orderBy("at")) + own
    ends = inside.withColumns({"left": left, "own": own}).where("own > left").groupBy(*LEVELS).agg(F.min("at").alias("end"), F.min_by(F.expr("left div n_tokens"), "at").alias("some"))
    return cut(plan.select(*LEVELS, "whole").join(ends, list(LEVELS), "left"))


def taken(rows: DataFrame, ends: DataFrame, seed: str = SEED) -> DataFrame:
    """Adds copies to rows (id, domain, language, source, n_tokens, ...): how often each is to be read."""
    marked = _ordered(rows, ends, seed)
    copies = lambda extra: F.when(F.col("n_tokens") > 0, F.col("whole") + extra.cast("long")).otherwise(0).cast("long")
    before = F.coalesce(F.col("at") < F.col("end"), F.lit(True))
    tie = F.coalesce((F.col("at") == F.col("end")) & (F.col("some") > 0), F.lit(False))
    out = marked.withColumn("copies", copies(before)).select(*rows.columns, "copies")
    if ends.where("some > 0").limit(1).count():  # equal ids with equal counts at the end of a prefix
        place = F.row_number().over(Window.partitionBy(*LEVELS).orderBy(F.xxhash64(*rows.columns)))
        at_end = marked.where(tie).withColumn("copies", copies(place <= F.col("some"))).select(*rows.columns, "copies")
        out = marked.where(~tie).withColumn("copies", copies(before)).select(*rows.columns, "copies").union(at_end)
    return out


def counted(documents: DataFrame, *more: Column) -> DataFrame:
    """(id, domain, language, source, n_tokens, more...) of documents."""
    return documents.select(F.col("doc_id").alias("id"), n_tokens().alias("n_tokens"), *(c.alias(k) for k, c in path_of().items()), *more)


def select_tokens(rows: DataFrame, weights: dict = WEIGHTS, budget: tuple[int, int] = BUDGET, epochs: int = EPOCHS, seed: str = SEED) -> DataFrame:
    """Adds copies to narrow rows (id, domain, language, source, n_tokens)."""
    rows = cut(rows)
    return taken(rows, leaf_ends(rows, weights, budget, epochs, seed), seed)


def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return select_tokens(counted(table(spark, sf_dir, "documents"))).select(F.col("id").alias("doc_id"), *LEVELS, "n_tokens", "copies")


def mix_documents(docs: DataFrame) -> DataFrame:
    """The selected documents with all their columns and copies."""
    ends = leaf_ends(cut(counted(docs)))
    name = scratch(docs, "copies")[0]
    return taken(counted(docs, F.struct(*docs.columns).alias("row")), ends).where("copies > 0").select("row.*", F.col("copies").alias(name))


OP10_SQL = r"""
with r as (
  select doc_id, coalesce(lang, 'unknown') as language, coalesce(source, 'unknown') as source,
         case when regexp_extract(coalesce(source, ''), '([0-9]{1,9})$', 1) = '' then 'unknown' else 'd' || (regexp_extract(coalesce(source, ''), '([0-9]{1,9})$', 1)::int % 4)::varchar end as domain,
         len(list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> ''))::bigint as n_tokens
  from documents),
leaf as (select domain, language, source, sum(n_tokens)::hugeint as tokens, 4 * sum(n_tokens)::hugeint as cap, case source when 'src0' then 2 else 1 end as w from r group by all),
lan as (select domain, language, sum(cap)::hugeint as cap, case language when 'en' then 3 when 'de' then 2 when 'fr' then 2 when 'es' then 2 else 1 end as w from leaf group by all),
dom as (select domain, sum(cap)::hugeint as cap, case domain when 'd0' then 4 when 'd1' then 3 when 'd2' then 2 else 1 end as w, (select sum(tokens)::hugeint // 2 from leaf) as given from lan group by domain),
d1 as (select *, coalesce(sum(cap) over (order by cap::double / w, domain rows between unbounded preceding and 1 preceding), 0)::hugeint as used, sum(w) over (order by cap::double / w, domain rows between current row and unbounded following)::hugeint as opn from dom),
d2 as (select *, cap * opn <= w * (given - used) as f from d1),
d3 as (select domain, case when f then cap else w * (given - sum(case when f then cap else 0 end) over ())::hugeint // greatest(sum(case when f then 0 else w end) over (), 1)::hugeint end as given from d2),
l1 as (select lan.*, given, coalesce(sum(cap) over (partition by domain order by cap::double / w, language rows between unbounded preceding and 1 preceding), 0)::hugeint as used, sum(w) over (partition by domain order by cap::double / w, language rows between current row and unbounded following)::hugeint as opn from lan join d3 using (domain)),
l2 as (select *, cap * opn <= w * (given - used) as f from l1),
l3 as (select domain, language, case when f then cap else w * (given - sum(case when f then cap else 0 end) over (partition by domain))::hugeint // greatest(sum(case when f then 0 else w end) over (partition by domain), 1)::hugeint end as given from l2),
s1 as (select leaf.*, given, coalesce(sum(cap) over (partition by domain, language order by cap::double / w, source rows between unbounded preceding and 1 preceding), 0)::hugeint as used, sum(w) over (partition by domain, language order by cap::double / w, source rows between current row and unbounded following)::hugeint as opn from leaf join l3 using (domain, language)),
s2 as (select *, cap * opn <= w * (given - used) as f from s1),
s3 as (select domain, language, source, tokens, case when f then cap else w * (given - sum(case when f then cap else 0 end) over (partition by domain, language))::hugeint // greatest(sum(case when f then 0 else w end) over (partition by domain, language), 1)::hugeint end as budget from s2),
p as (select domain, language, source, case when tokens > 0 then budget // tokens else 0 end as whole, budget % greatest(tokens, 1) as rest from s3),
m as (select r.*, whole, rest, md5('mix-1:' || whole::varchar || ':' || coalesce(doc_id::varchar, '')) as digest from r join p using (domain, language, source)),
c as (select *, sum(n_tokens) over (partition by domain, language, source order by digest, doc_id, n_tokens rows between unbounded preceding and current row) as through from m)
select doc_id, domain, language, source, n_tokens, (case when n_tokens > 0 then whole + case when through <= rest then 1 else 0 end else 0 end)::bigint as copies from c
"""
