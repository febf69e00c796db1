"""Benchmark decontamination by winnowing, in DataFrame functions only.

Every window of ``span`` words holds ``span - k + 1`` k-grams; the one with
the least hash is its fingerprint. Equal windows have equal fingerprints, so a
join of the distinct fingerprints of documents and benchmark finds every
document that shares a window. Those hits are then extended: the documents that
have any are taken apart into k-grams once more, these are joined with the
document's matches by hash, and only windows around a matching k-gram are cut out
and compared, as text, with the benchmark's windows. An item of fewer than
``span`` words is one window; its length is compared at every position.

Words are maximal runs of characters other than ASCII non-alphanumerics, with
A-Z lower-cased. Null or empty text has no words. Null ids stay in the result;
a benchmark item without words matches nothing; repeated rows keep one result
row each; equal item ids count once, and items without an id are found but not
listed. Extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sieveline.llm.common import cut, node_of, partitions, scratch, small, table, text_or_empty

SPAN, GRAM = 10, 5
SEPARATOR = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Rows of hashes that may be broadcast (16 bytes each); beyond it the join shuffles.
BROADCAST_ROWS = 500_000


def words_of(column: str = "text") -> Column:
    lowered = F.translate(text_or_empty(column), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.array_remove(F.split(lowered, SEPARATOR), "")


def _positions(n: Column, size: int) -> Column:
    """1 .. n - size + 1, or none."""
    return F.when(n >= size, F.sequence(F.lit(1), (n - (size - 1)).cast("int"))).otherwise(F.array().cast("array<int>"))


def _gram_hashes(words: str, size: int, tag: int) -> Column:
    return F.transform(_positions(F.size(words), size), lambda i: F.xxhash64(F.lit(tag), F.slice(F.col(words), i, size)))


def _fingerprints(df: DataFrame, short: list[int], span: int, k: int) -> DataFrame:
    """Adds grams (hash of each k-gram) and fps (distinct window minima and hashes at the short lengths)."""
    df = df.withColumn("grams", _gram_hashes("words", k, 0))
    width = span - k + 1
    minima = F.transform(_positions(F.size("grams"), width), lambda i: F.array_min(F.slice("grams", i, width)))
    fps = F.concat(minima, *(_gram_hashes("words", size, size) for size in short)) if short else minima
    return df.withColumn("fps", F.array_distinct(fps))


def _places(size: int, tag: int) -> Column:
    """(len, start, fp) of every run of ``size`` words; len is the tag, 0 for k-grams."""
    return F.transform(_positions(F.size("words"), size), lambda i: F.struct(F.lit(tag).alias("len"), i.alias("start"), F.xxhash64(F.lit(tag), F.slice("words", i, size)).alias("fp")))


def benchmark_windows(benchmark: DataFrame, span: int = SPAN) -> DataFrame:
    """(item_id, len, words): each item's windows."""
    items = benchmark.select("item_id", words_of("text").alias("w")).withColumn("len", F.least(F.size("w"), F.lit(span))).where("len > 0")
    starts = F.sequence(F.lit(1), F.size("w") - F.col("len") + 1)
    return items.select("item_id", "len", F.explode(F.transform(starts, lambda i: F.slice("w", i, F.col("len")))).alias("words"))


def contamination(documents: DataFrame, benchmark: DataFrame, span: int = SPAN, k: int = GRAM) -> DataFrame:
    """One row per document row: doc_id, node, n_words, n_hit, items (sorted distinct item ids as strings)."""
    windows = benchmark_windows(benchmark, span)
    short = sorted(r[0] for r in windows.select("len").where(F.col("len") < span).distinct().collect())  # fewer than span values
    tests = _fingerprints(windows, [], span, k).where(F.col("len") == span).select(F.explode("fps").alias("fp"))
    if short:
        tests = tests.union(windows.where(F.col("len") < span).select(F.xxhash64(F.col("len"), F.col("words")).alias("fp")))
    tests = cut(tests.distinct())

    docs = documents.select("doc_id", node_of().alias("node"), words_of().alias("words"))
    docs = _fingerprints(docs, short, span, k).select("doc_id", "node", F.size("words").alias("n_words"), F.explode(F.concat(F.array(F.lit(None).cast("bigint")), "fps")).alias("fp"))
    joined = docs.join(small(tests.withColumn("found", F.lit(True)), BROADCAST_ROWS), "fp", "left").where("fp is null or found")
    per_doc = cut(joined.groupBy("doc_id", "node", "n_words").agg(F.collect_set("fp").alias("hits"), F.count_if(F.col("fp").isNull()).alias("copies")))

    # each suspect text once: its k-grams and short windows by place, then those among its matches
    hits = cut(per_doc.where(F.size("hits") > 0).select("node", F.explode("hits").alias("fp")).distinct())
    suspects = hits.select("node").distinct()
    texts = documents.select(node_of().alias("node"), "text").join(small(suspects, BROADCAST_ROWS), "node").groupBy("node").agg(F.first("text").alias("text"))
    cand = texts.select("node", words_of("text").alias("words"))
    places = [_places(size, tag) for size, tag in [(k, 0), *((size, size) for size in short)]]
    met = cand.select("node", F.size("words").alias("n"), F.explode(F.concat(*places)).alias("x")).select("node", "n", "x.len", "x.start", "x.fp").join(small(hits, BROADCAST_ROWS), ["node", "fp"])
    first, last = F.greatest(F.col("start") - (span - k), F.lit(1)), F.least("start", F.col("n") - (span - 1))
    around = F.when(F.col("len") > 0, F.array("start")).when(first <= last, F.sequence(first, last))
    starts = met.select("node", F.when(F.col("len") > 0, F.col("len")).otherwise(span).alias("len"), F.explode(around).alias("start")).distinct()
    starts = starts.groupBy("node").agg(F.collect_list(F.struct("start", "len")).alias("starts"))  # at most some for each word of one text
    cut_out = F.transform("starts", lambda x: F.struct(x["start"].alias("start"), x["len"].alias("len"), F.concat_ws(" ", F.slice("words", x["start"], x["len"])).alias("win")))
    found = cand.join(starts, "node").select("node", F.explode(cut_out).alias("x")).select("node", "x.start", "x.len", "x.win")
    by_window = windows.select("item_id", "len", F.concat_ws(" ", "words").alias("win")).groupBy("win", "len").agg(F.collect_set(F.col("item_id").cast("string")).alias("items"))
    # dealt anew, so that adaptive execution can split a window that very many documents hold
    matched = found.join(by_window.repartition(partitions(documents.sparkSession)), ["win", "len"])
    hit = matched.groupBy("node").agg(
        F.array_distinct(F.flatten(F.collect_set(F.sequence(F.col("start"), F.col("start") + F.col("len") - 1)))).alias("hit_words"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("items"),
    )
    # dealt anew, so that adaptive execution can split the rows of one text
    out = per_doc.drop("hits").join(hit.repartition(partitions(documents.sparkSession)), "node", "left").withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))))
    return out.select("doc_id", "node", F.col("n_words").cast("long"), F.coalesce(F.size("hit_words"), F.lit(0)).cast("long").alias("n_hit"), F.coalesce("items", F.array().cast("array<string>")).alias("items"))


def clean(documents: DataFrame, benchmark: DataFrame, span: int = SPAN, k: int = GRAM) -> DataFrame:
    """Documents without those that hold a benchmark window; columns unchanged."""
    node = scratch(documents, "node")[0]
    hit = cut(contamination(documents, benchmark, span, k).where("n_hit > 0").select(F.col("node").alias(node)).distinct())
    return documents.withColumn(node, node_of()).join(small(hit, BROADCAST_ROWS), node, "left_anti").select(*documents.columns)


def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", "items").cast("binary"), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"),
    )


OP9_SQL = r"""
with w as (
  select doc_id, row_number() over () as r, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') as ws
  from documents),
b as (
  select item_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') as ws
  from benchmark),
bw as (
  select distinct item_id, least(len(ws), 10) as n, array_to_string(ws[i:i + least(len(ws), 10) - 1], ' ') as win
  from (select item_id, ws, unnest(range(1, len(ws) - least(len(ws), 10) + 2)) as i from b where len(ws) > 0)),
dw as (
  select r, i, n, array_to_string(ws[i:i + n - 1], ' ') as win
  from (select r, ws, n, unnest(range(1, len(ws) - n + 2)) as i from w, (select distinct n from bw) where len(ws) >= n)),
m as (select dw.r, dw.i, dw.n, bw.item_id from dw join bw using (n, win)),
hit as (select r, count(distinct p) as n_hit from (select r, unnest(range(i, i + n)) as p from m) group by r),
it as (select r, count(distinct item_id::varchar) as n_items, string_agg(distinct item_id::varchar, ',' order by item_id::varchar) as items from m group by r)
select w.doc_id, len(w.ws)::bigint as n_words, coalesce(hit.n_hit, 0)::bigint as n_hit, coalesce(it.n_items, 0)::bigint as n_items,
       sha256(coalesce(it.items, '')) as items_sha256, coalesce(hit.n_hit, 0) > 0 as contaminated
from w left join hit using (r) left join it using (r)
"""
