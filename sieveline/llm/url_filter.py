"""URL filtering by fixed rules and by mined association rules.

A url's host is what follows the first ``://`` up to ``/``, ``?``, ``#`` or the
end, with A-Z lower-cased; its path is what then follows up to ``?``, ``#`` or
the end. A rule ``host/path`` fits a host and all its subdomains when the url's
path starts with ``/path``; the longest fitting rule gives the verdict.

For urls that no rule fits, FP-growth mines which combinations of url tokens go
with a verdict in labelled urls. Every host label, path segment and query key is
a token. A combination has at most LONGEST tokens, MIN_SUPPORT of the labelled
urls and LEAST_ROWS of them. What is mined is made smaller without losing one:
rarer tokens are in none; tokens that lie in the same labelled urls are one
item, which a url has when it has any of them; tokens of all labelled urls add
nothing to a combination and are rules of their own; urls of many tokens are
dealt into baskets of few (see ``_baskets``), so that long urls that differ in a
token, or copies of one, never make FP-growth list the combinations of long
frequent sets. Rules below MIN_CONFIDENCE are dropped, as are rules that a more
general one with no less confidence makes redundant. They are matched through
an inverted index from each rule's rarest token; the matching rule of greatest
confidence, then support, then least tokens decides, and without one a url is
allowed. The executors get a table of the MAX_RULES best rules in this order.

Null urls, and urls without ``://``, have empty host and path and are allowed.
Repeated rows keep one result row each; extra columns are ignored.
"""

from __future__ import annotations

import itertools
import math
from collections import Counter

import pandas as pd
from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sieveline.llm.common import cut, table

#: The rules, as (rule, verdict).
RULES = [("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow")]
MIN_SUPPORT, MIN_CONFIDENCE, MAX_RULES = 0.005, 0.6, 20_000
#: Tokens of a rule at most, rows that must show it at least, and tokens in a basket that FP-growth gets at most.
LONGEST, LEAST_ROWS, MAX_ITEMS = 3, 3, 10
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_PARTS = r"(?s)^.*?://([^/?#]*)([^?#]*)"


def host_of(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, _PARTS, 1), F.lit("")), _UPPER, _LOWER)


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, _PARTS, 2), F.lit(""))


def rule_of(host: Column, path: Column, rules: list[tuple[str, str]]) -> tuple[Column, Column]:
    """(rule, verdict) of the longest fitting rule, null without one."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for text, say in sorted(rules, key=lambda r: (len(r[0]), r[0])):
        name, _, rest = text.partition("/")
        fits = ((host == name) | host.endswith("." + name)) & path.startswith("/" + rest)
        rule, verdict = F.when(fits, F.lit(text)).otherwise(rule), F.when(fits, F.lit(say)).otherwise(verdict)
    return rule, verdict


def tokens_of(url: Column, host: Column, path: Column) -> Column:
    """Scheme, top domain, domain, every label before it, first, last and every inner segment, depth, every query key, fragment."""
    url = F.coalesce(url, F.lit(""))
    labels, segments = F.split(host, r"\."), F.filter(F.split(path, "/"), lambda s: s != "")
    plain = lambda s: F.regexp_replace(s, r"[0-9]+", "0")
    keys = F.split(F.regexp_extract(url, r"\?([^#]*)", 1), "&")
    slots = {
        "scheme": F.lower(F.regexp_extract(url, r"(?s)^(.*?)://", 1)),
        "top": F.element_at(labels, -1), "domain": F.regexp_extract(host, r"([^.]+\.[^.]+)$", 1),
        "first": plain(F.get(segments, F.lit(0))), "last": F.when(F.size(segments) > 1, plain(F.element_at(segments, -1))),
        "depth": F.size(segments).cast("string"),
        "mark": F.when(url.contains("#"), F.lit("1")),
    }
    many = {
        "label": F.slice(labels, 1, F.greatest(F.size(labels) - 2, F.lit(0))),
        "segment": F.transform(F.slice(segments, 2, F.greatest(F.size(segments) - 2, F.lit(0))), plain),
        "query": F.transform(keys, lambda q: F.regexp_extract(q, "^([^=]*)", 1)),
    }
    named = lambda k: lambda v: F.when(v != "", F.concat(F.lit(k + "="), v))
    found = F.concat(F.array(*(named(k)(v) for k, v in slots.items())), *(F.transform(v, named(k)) for k, v in many.items()))
    return F.when(host == "", F.array().cast("array<string>")).otherwise(F.array_distinct(F.filter(found, lambda t: t.isNotNull())))


def items_of(labelled: DataFrame, min_support: float = MIN_SUPPORT) -> tuple[dict[str, str], set[str]]:
    """(item of each frequent token: the least token in the same rows; items of all rows)."""
    rows = labelled.withColumn("h", F.xxhash64(F.monotonically_increasing_id()))
    total = labelled.count()
    counts = rows.select(F.explode("tokens").alias("token"), "h").groupBy("token").agg(F.count(F.lit(1)).alias("n"), F.bit_xor("h").alias("x"), F.sum(F.col("h").cast("decimal(38,0)")).alias("y"))
    same, items, everywhere = {}, {}, set()
    for token, n, x, y in sorted(counts.where(F.col("n") >= min_support * total).collect()):
        items[token] = same.setdefault((n, x, y), token)
        if n == total:
            everywhere.add(items[token])
    return items, everywhere


def _baskets(labelled: DataFrame, least: int, longest: int) -> DataFrame:
    """Baskets (row, items) of the frequent tokens of rows (tokens, verdict), of few tokens each, so that FP-growth never meets a long frequent set.

    Tokens get colours, by falling frequency in turn. For every set of up to
    ``longest`` of the colours that a row has, it gives one basket of its tokens of
    these colours, marked with them. A set of so many tokens lies, under the mark of
    its own colours, in a basket of every row that has it, so its count there is
    exact. There are as many colours as keep every basket within MAX_ITEMS; where
    one is enough, each row is one basket.
    """
    counts = labelled.select(F.explode("tokens").alias("t")).groupBy("t").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least)
    frequent = [r[0] for r in counts.orderBy(F.desc("n"), "t").select("t").collect()]
    rank = {t: i for i, t in enumerate(frequent)}
    tries = [1, *(c for c in (2**i for i in range(2, 31)) if c < 2 * max(len(frequent), 2))]

    def loads(tokens):
        out = []
        for own in tokens:
            places = [rank[t] for t in own if t in rank]
            out.append([sum(sorted(Counter(p % c for p in places).values())[-longest:]) for c in tries])
        return pd.Series(out)

    load = F.pandas_udf(loads, "array<int>")("tokens")
    most = labelled.select(load.alias("load")).agg(*(F.max(F.col("load")[i]) for i in range(len(tries)))).first()
    colours = next((c for c, n in zip(tries, most) if (n or 0) <= MAX_ITEMS), tries[-1])

    def split(tokens):
        out = []
        for own in tokens:
            by: dict[int, list] = {}
            for t in sorted({t for t in own if t in rank}, key=rank.get):
                by.setdefault(rank[t] % colours, []).append(t)
            marks = [m for n in range(1, longest + 1) for m in itertools.combinations(sorted(by), n)]
            out.append([[f"{'.'.join(map(str, m))}|{c}|{t}" for c in m for t in by[c]] for m in marks])
        return pd.Series(out)

    parts = F.explode(F.pandas_udf(split, "array<array<string>>")("tokens"))
    rows = labelled.select(parts.alias("items"), "verdict").where(F.size("items") > 0)
    marked = F.concat(F.substring_index(F.col("items")[0], "|", 1), F.lit("|verdict="), "verdict")
    return cut(rows.select(F.array_append("items", marked).alias("items")))


def mine(labelled: DataFrame, min_support: float = MIN_SUPPORT, min_confidence: float = MIN_CONFIDENCE, items: dict[str, str] | None = None, everywhere: set[str] = frozenset(), longest: int = LONGEST) -> DataFrame:
    """(tokens, verdict, confidence, support) of up to ``longest`` tokens, shown by LEAST_ROWS rows at least, from rows (tokens, verdict); pruned. With items, tokens are first replaced by their items."""
    total = labelled.count()
    if items is not None:
        put = lambda own: own.map(lambda ts: sorted({items[t] for t in ts if t in items} - everywhere))
        labelled = cut(labelled.select(F.pandas_udf(put, "array<string>")("tokens").alias("tokens"), "verdict"))
    least = max(LEAST_ROWS, math.ceil(min_support * total - 1e-9))
    baskets = _baskets(labelled, least, longest)
    made = max(1, baskets.count())
    model = FPGrowth(itemsCol="items", minSupport=min(1.0, (least - 0.5) / made), minConfidence=min_confidence).fit(baskets)
    rules = model.associationRules.where(F.col("consequent")[0].contains("|verdict=") & (F.size("antecedent") <= longest) & ~F.exists("antecedent", lambda t: t.contains("|verdict=")))
    mark, colours = F.substring_index(F.col("antecedent")[0], "|", 1), F.array_sort(F.array_distinct(F.transform("antecedent", lambda t: F.split_part(t, F.lit("|"), F.lit(2)).cast("int"))))
    rules = rules.where(mark == F.array_join(F.transform(colours, lambda c: c.cast("string")), "."))
    after = lambda t, n: F.substring(t, F.length(F.substring_index(t, "|", n)) + 2, F.length(t))
    rules = rules.select(F.transform("antecedent", lambda t: after(t, 2)).alias("antecedent"), F.array(after(F.col("consequent")[0], 1)).alias("consequent"), "confidence", (F.round(F.col("support") * made) / total).alias("support"))
    rules = rules.select(F.array_sort("antecedent").alias("tokens"), F.expr("substring(consequent[0], 9)").alias("verdict"), "confidence", "support")
    if everywhere:
        share = labelled.groupBy("verdict").agg((F.count(F.lit(1)) / total).alias("support")).where((F.col("support") * total >= least - 0.5) & (F.col("support") >= min_confidence))
        rules = rules.unionByName(share.select(F.explode(F.array(*(F.array(F.lit(t)) for t in sorted(everywhere)))).alias("tokens"), "verdict", F.col("support").alias("confidence"), "support"))
    rules = cut(rules)
    # a rule is redundant when one with one token less says the same with no less confidence
    shorter = rules.select(F.explode(F.transform("tokens", lambda t: F.array_remove("tokens", t))).alias("part"), "tokens", "verdict", "confidence")
    general = rules.select(F.col("tokens").alias("part"), "verdict", F.col("confidence").alias("c0"))
    redundant = shorter.join(general, ["part", "verdict"]).where("c0 >= confidence").select("tokens", "verdict").distinct()
    return rules.join(redundant, ["tokens", "verdict"], "left_anti")


def judge(pages: DataFrame, rules: list[tuple[str, str]] = RULES) -> DataFrame:
    """page_id, host, path, rule, verdict, mined (the deciding token combination, else null)."""
    host, path = host_of(F.col("url")), path_of(F.col("url"))
    rows = pages.select("page_id", "url", host.alias("host"), path.alias("path"))
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    rows = rows.withColumns({"rule": rule, "said": verdict, "tokens": tokens_of(F.col("url"), F.col("host"), F.col("path"))})
    labelled = rows.where("said is not null").select("tokens", F.col("said").alias("verdict"))
    items, found = {}, []
    if labelled.limit(1).count():
        items, everywhere = items_of(labelled)
        mined = mine(labelled, items=items, everywhere=everywhere)
        found = [row.asDict() for row in mined.orderBy(F.desc("confidence"), F.desc("support"), "tokens", "verdict").limit(MAX_RULES).collect()]
    return match(rows, found, items).select("page_id", "host", "path", "rule", F.coalesce("said", "mined.verdict", F.lit("allow")).alias("verdict"), F.when(F.col("said").isNull(), F.array_join("mined.tokens", " ")).alias("mined"))


def match(rows: DataFrame, rules: list[dict], items: dict[str, str] | None = None) -> DataFrame:
    """Adds mined: the best rule whose tokens (with items: one token of each item) a row has, by an index from each rule's rarest token."""
    kind = "struct<tokens:array<string>,verdict:string,confidence:double,support:double>"
    if not rules:
        return rows.withColumn("mined", F.lit(None).cast(kind))
    seen: dict[str, int] = {}
    for r in rules:
        for t in r["tokens"]:
            seen[t] = seen.get(t, 0) + 1
    rank = sorted(rules, key=lambda r: (-r["confidence"], -r["support"], r["tokens"]))
    index: dict[str, list] = {}
    for place, r in enumerate(rank):
        index.setdefault(min(r["tokens"], key=lambda t: (seen[t], t)), []).append((place, frozenset(r["tokens"])))

    def best(tokens):
        out = []
        for own in tokens:
            own = {(items or {}).get(t, t): t for t in sorted(own, reverse=True)} if own is not None else {}
            hits = [place for t in own for place, need in index.get(t, ()) if need <= own.keys()]
            r = rank[min(hits)] if hits else None
            out.append(([own[t] for t in r["tokens"]], r["verdict"], r["confidence"], r["support"]) if r else (None, None, None, None))
        return pd.DataFrame(out, columns=["tokens", "verdict", "confidence", "support"])

    return rows.withColumn("mined", F.pandas_udf(best, kind)(F.col("tokens")))


def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "pages"))
