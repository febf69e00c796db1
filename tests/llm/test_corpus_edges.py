"""Very long texts, clashing columns, empty tables, ties, and plain versions of the learned and attributed results."""

import itertools
import math
import random
import re
import time
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from sieveline.llm import decontaminate, language_id, media, mixing, near_dup, secrets, substring_dedup, token_counts, toxicity, url_filter

CLASH = "doc_id long, text string, lang string, source string, copies int, node string, label string, n string, score double, lang_pred string, stays string, first string, row string, whole string"


@pytest.fixture(scope="module")
def clashing(spark, tmp_path_factory):
    rng = random.Random(3)
    base = " ".join(rng.choice("abcdefgh") + str(rng.randrange(50)) for _ in range(60))
    texts = [base, base, base + " more", " ".join(f"w{rng.randrange(9)}" for _ in range(50)), "", None]
    rows = [(i, t, "en", "src1", 7, "a", "b", "c", 0.5, "x", "y", "z", "r", "w") for i, t in enumerate(texts)]
    path = str(tmp_path_factory.mktemp("clash"))
    spark.createDataFrame(rows + [rows[3]], CLASH).write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def test_clashing_columns(spark, clashing):
    bench = spark.createDataFrame([(1, "no such words here at all in any of these texts really")], "item_id long, text string")
    assert sorted(r.doc_id for r in near_dup.one_of_each(clashing).collect()) == [0, 3, 4, 5]
    assert near_dup.one_of_each(clashing).columns == clashing.columns == decontaminate.clean(clashing, bench).columns == secrets.redact(clashing).columns
    assert {r.doc_id: r.component_id for r in near_dup.near_duplicates(clashing).collect()} == {0: 0, 1: 0, 2: 0, 3: 3, 4: 4, 5: 5}
    assert decontaminate.clean(clashing, bench).count() == 7
    out = mixing.mix_documents(clashing)
    assert out.columns == [*clashing.columns, "copies_"] and all(r.copies == 7 and r.copies_ > 0 for r in out.collect())
    kept = language_id.keep_identified(spark, clashing)
    assert kept.columns == clashing.columns and {r.lang_pred for r in kept.collect()} == {"x"}
    assert language_id.identify(clashing, None).columns == [*(c for c in clashing.columns if c not in language_id.ADDED), *language_id.ADDED]
    assert substring_dedup.dedup_substrings(clashing).count() == token_counts.count_tokens(clashing).count() == media.load(media.store(clashing)).count() == 7


def test_very_long_texts(spark):
    """Some MB a text: time about linear in spans, memory in pieces."""
    rng = np.random.default_rng(0)
    many = "é token=abcdef12 " * 60_000
    began = time.time()
    (spans,) = secrets.find_spans([many], None)
    assert len(spans) == 60_000 and many[spans[-1][0] : spans[-1][1]] == "token=abcdef12" and time.time() - began < 20
    data = rng.integers(32, 127, 3_000_000, dtype=np.uint8).tobytes().decode()
    df = spark.createDataFrame([(1, data), (2, "short"), (3, data)], "doc_id long, text string")
    got = {r.doc_id: r for r in media.load(media.store(df), tensors=True).collect()}
    payload = media.padded(data.encode())
    assert got[1].payload_bytes == len(payload) and got[1].tail_crc32 == zlib.crc32(payload[-64:]) and got[1].media_sha256 == got[3].media_sha256
    assert got[1].feature == got[3].feature and len(got[1].rgb) >= len(payload)
    assert token_counts.count_tokens(df).count() == 3 and language_id.identify(df, language_id.BiGRU(["a", "b"])).count() == 3
    passage = " ".join(f"p{i}" for i in range(40))
    long = " ".join(f"x{i}" for i in range(150_000))
    df = spark.createDataFrame([(1, f"{long} {passage}"), (2, passage)], "doc_id long, text string")
    assert {r.doc_id: r.n_removed for r in substring_dedup.dedup_substrings(df).collect()} == {1: 40, 2: 40}
    bench = spark.createDataFrame([(9, passage)], "item_id long, text string")
    assert {r.doc_id: r.n_hit for r in decontaminate.contamination(df, bench).collect()} == {1: 40, 2: 40}
    assert near_dup.near_duplicates(df).count() == 2


def test_pictures_of_a_long_payload():
    data = bytes(range(256)) * 5000
    joined = media.encode_long(media.padded(data))
    parts = media.pictures(joined)
    assert len(parts) == -(-len(data) // media.PICTURE) and b"".join(media.payload_of(p) for p in media.decode(parts)) == data
    assert media.encode_long(b"a" * 64) == media.encode_payloads([b"a" * 64])[0]


def test_base64_values_are_learned(spark):
    df = spark.createDataFrame([(i, f"token=c2VjcmV0dmFsdWU{i % 10}= plain words here") for i in range(40)], "doc_id long, text string")
    assert secrets.ASSIGN.search("token=c2VjcmV0dmFsdWU=")[2] == "c2VjcmV0dmFsdWU="
    model = secrets.train_from(df)
    s = np.frombuffer(b"\0c2VjcmV0dmFsdWU", np.uint8)
    assert model.ratio[s[:-1], s[1:]].mean() > 0


def test_letters_are_letters(spark):
    df = spark.createDataFrame([(1, "²½Ⅷ 12"), (2, "ß"), (3, "日本")], "doc_id long, text string")
    assert [r.lang_pred == "und" for r in language_id.identify(df, language_id.BiGRU(["a"])).orderBy("doc_id").collect()] == [True, False, False]


def test_gru_matches_a_plain_version(spark):
    """One byte at a time, both directions, and the mean over positions of a text of two windows and a rest."""
    net = language_id.BiGRU(["a", "b", "c"], hidden=4, seed=7)
    text = "".join(chr(97 + i * 7 % 26) for i in range(300)) + "é"
    w = {k: v.astype(np.float64) for k, v in net.w.items()}
    sigmoid = lambda x: 1 / (1 + math.exp(-x))

    def states(data, d):
        h, out = np.zeros(4), []
        for x in data:
            a, u = w["P" + d][:, x], w["U" + d] @ h
            z, r = (np.array([sigmoid(v) for v in (a + u)[k : k + 4]]) for k in (0, 4))
            c = np.tanh(a[8:] + r * (u[8:] + w["c" + d][:, 0]))
            h = z * h + (1 - z) * c
            out.append(h)
        return out

    data, total, votes = text.encode(), np.zeros(3), [0, 0, 0]
    for i in range(0, len(data), language_id.WINDOW):
        own = data[i : i + language_id.WINDOW]
        for f, b in zip(states(own, "f"), states(own[::-1], "b")[::-1]):
            e = np.exp(w["Vf"] @ f + w["Vb"] @ b + w["v"][:, 0])
            total += e / e.sum()
            votes[int(e.argmax())] += 1
    (r,) = language_id.identify(spark.createDataFrame([(1, text)], "doc_id long, text string"), net).collect()
    assert r.lang_pred == "abc"[int(total.argmax())] and r.score == pytest.approx(total.max() / len(data), abs=1e-4) and sum(abs(a - b) for a, b in zip(r.position_labels, votes)) <= 2


def test_pu_steps_match_a_plain_version():
    """One full-batch step follows the estimator's gradient, or goes against it where the bracket is negative."""
    rng = np.random.default_rng(3)
    for p, u, prior in ((rng.integers(0, 2, (6, 3)), rng.integers(0, 2, (20, 3)), 0.3), (np.ones((5, 3), int), np.zeros((9, 3), int), 0.9)):
        loss = lambda z: np.log1p(np.exp(-z))
        theta = np.array([0.0, 0.0, 0.0, -2.0])
        g = lambda x, t: x @ t[:3] + t[3]
        bracket = lambda t: loss(-g(u, t)).mean() - prior * loss(-g(p, t)).mean()
        risk = (lambda t: prior * loss(g(p, t)).mean() + bracket(t)) if bracket(theta) >= 0 else (lambda t: -bracket(t))
        grad = np.array([(risk(theta + e) - risk(theta - e)) / 2e-6 for e in np.eye(4) * 1e-6])
        weights, bias = toxicity._descend(toxicity.Presence.of(p), toxicity.Presence.of(u), prior, 1, 0.0, 0, len(p), len(u))
        moved = np.append(weights, bias) - theta
        keep = np.abs(grad) > 1e-6
        assert (np.sign(moved[keep]) == -np.sign(grad[keep])).all() and np.abs(moved[~keep]).max(initial=0) < 0.05
    scores, cut = np.array([3.0, 2.0, -1.0]), toxicity._threshold(np.array([3.0, 2.0, -1.0]), np.array([2.5, -1.0, -2.0, -3.0]), 0.3)
    risks = {c: 0.3 * (scores <= c).mean() + max(0, (np.array([2.5, -1.0, -2.0, -3.0]) > c).mean() - 0.3 * (scores > c).mean()) for c in (-2.5, -1.5, 0.5, 2.25, 2.75)}
    assert risks[cut] == min(risks.values())


def test_pu_weights_of_either_sign_and_areas_under_the_curve():
    """Presence lists give a matrix's sums; words that speak for and against the label get weights of their sign."""
    rng = np.random.default_rng(8)
    dense = rng.integers(0, 2, (30, 7))
    rows, w = toxicity.Presence.of(dense), rng.normal(size=7)
    assert np.allclose(rows.sums(w), dense @ w) and np.allclose(rows.only(np.array([1, 4])).sums(w[:2]), dense[:, [1, 4]] @ w[:2])
    row, place = rows.take(np.array([3, 3, 0]))
    assert [place[row == i].tolist() for i in range(3)] == [np.flatnonzero(dense[i]).tolist() for i in (3, 3, 0)]
    toxic = rng.random(3000) < 0.3
    seen = np.stack([rng.random(3000) < np.where(toxic, a, b) for a, b in ((0.7, 0.05), (0.05, 0.6), (0.4, 0.4))], 1).astype(int)
    weights, bias = toxicity.train(toxicity.Presence.of(seen[:1500][toxic[:1500]]), toxicity.Presence.of(seen[:1500]), 0.3)
    assert weights[0] > 0.5 and weights[1] < -0.5 and abs(weights[2]) < min(weights[0], -weights[1])
    g = seen[1500:] @ weights + bias
    pos, neg = g[toxic[1500:]], g[~toxic[1500:]]
    assert np.mean((pos[:, None] > neg) + 0.5 * (pos[:, None] == neg)) > 0.9 and np.mean((g >= 0) == toxic[1500:]) > 0.85


def test_attribution_matches_a_count_of_characters():
    rng = random.Random(8)
    encoding, sizes = token_counts.encoder(token_counts.VOCABULARY)
    for _ in range(40):
        text = "".join(rng.choice(["é", "日", "a", "word", " ", "\n", "\n\n", "🙂", "  x"]) for _ in range(60))
        ends = token_counts.line_sections(text)
        owner = [int(np.searchsorted(ends, k, "right")) for k in range(len(text))]
        at, want, crossing, place = 0, [0] * len(ends), 0, []
        for k, c in enumerate(text):
            place += [k] * len(c.encode())
        for token in encoding.encode_ordinary(text):
            own = sorted(set(place[at : at + int(sizes[token])]))
            at += int(sizes[token])
            lines = [owner[k] for k in own]
            want[max(sorted(set(lines)), key=lines.count)] += 1
            crossing += len(set(lines)) > 1
        got = token_counts.attribute(*token_counts.token_spans(text, token_counts.VOCABULARY), ends)
        assert got[0].tolist() == want and got[1] == crossing


def test_mining_matches_all_token_sets(spark):
    rng = np.random.default_rng(4)
    rows = [([f"{t}=1" for t in "abcde" if rng.random() < 0.5], str(rng.choice(["block", "allow"], p=[0.6, 0.4]))) for _ in range(120)]
    rows = [(ts, "block" if {"a=1", "b=1"} <= set(ts) else v) for ts, v in rows]
    want = {}
    for size in range(1, 6):
        for own in itertools.combinations([f"{t}=1" for t in "abcde"], size):
            have = [v for ts, v in rows if set(own) <= set(ts)]
            for v in ("block", "allow"):
                if have and have.count(v) / len(rows) >= 0.05 and have.count(v) / len(have) >= 0.6:
                    want[own, v] = (have.count(v) / len(have), have.count(v) / len(rows))
    kept = {k: x for k, x in want.items() if not any((tuple(t for t in k[0] if t != out), k[1]) in want and want[tuple(t for t in k[0] if t != out), k[1]][0] >= x[0] for out in k[0])}
    found = url_filter.mine(spark.createDataFrame(rows, "tokens array<string>, verdict string"), 0.05, 0.6)
    assert {(tuple(r.tokens), r.verdict): (pytest.approx(r.confidence), pytest.approx(r.support)) for r in found.collect()} == kept


def test_mined_rules_on_held_out_urls(spark):
    """Verdicts of rules mined from four fifths of the pages hold on the others."""
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    host, path = url_filter.host_of(F.col("url")), url_filter.path_of(F.col("url"))
    said = url_filter.rule_of(host, path, url_filter.RULES)[1]
    rows = pages.select(url_filter.tokens_of(F.col("url"), host, path).alias("tokens"), said.alias("verdict"), (F.crc32(F.col("page_id").cast("string").cast("binary")) % 5 == 0).alias("held")).where("verdict is not null")
    train = rows.where("not held").select("tokens", "verdict")
    items, everywhere = url_filter.items_of(train, 0.02)
    rules = [r.asDict() for r in url_filter.mine(train, 0.02, 0.6, items, everywhere).collect()]
    judged = url_filter.match(rows.where("held"), rules, items).select("verdict", F.coalesce("mined.verdict", F.lit("allow")).alias("said")).collect()
    assert len(judged) > 10 and np.mean([r.verdict == r.said for r in judged]) > 0.9


def test_equal_rows_at_the_end_of_a_prefix(spark):
    """Rows that are alike are taken as far as they fit, as SQL with a row frame has it."""
    rows = [(i // 3, "t " * (1 + i // 3 % 4), "en", "src1") for i in range(60)] + [(None, "a b", None, None)] * 4
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    narrow = mixing.counted(df)
    got = mixing.select_tokens(narrow, budget=(1, 2)).collect()
    budgets = {(r.domain, r.language, r.source): r.budget for r in mixing.leaf_budgets(narrow.groupBy(*mixing.LEVELS).agg(F.sum("n_tokens").alias("tokens")), sum(r.n_tokens for r in got) // 2).collect()}
    for leaf, budget in budgets.items():
        own = [r for r in got if (r.domain, r.language, r.source) == leaf]
        used, largest = sum(r.n_tokens * r.copies for r in own), max(r.n_tokens for r in own)
        assert budget - largest < used <= budget
    assert len(got) == len(rows)
    total = sum(len(r.text.split()) * r.copies for r in mixing.mix_documents(df).collect())
    assert total == sum(r.n_tokens * r.copies for r in got)


def test_empty_tables(spark):
    none = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
    labels = spark.createDataFrame([(1, 1), (2, 0)], "doc_id long, toxic int")
    assert toxicity.fit(none, labels) is None and toxicity.score(none, None).count() == 0
    assert near_dup.one_of_each(none).count() == mixing.mix_documents(none).count() == secrets.redact(none).count() == language_id.keep_identified(spark, none).count() == 0
    bench = spark.createDataFrame([(1, "a b")], "item_id long, text string")
    assert decontaminate.clean(none, bench).count() == 0 and url_filter.judge(spark.createDataFrame([], "page_id long, url string")).count() == 0


def test_pipeline_with_odd_rows(spark, tmp_path):
    """Nulls, empties, repeated rows and an empty table; what stays was not near a copy, clean of the benchmark and of secrets."""
    import corpus_pipeline

    rng = random.Random(6)
    vocab = {"en": ["the", "and", "with", "house", "water", "tree"], "fr": ["été", "où", "très", "être", "ça", "même"]}
    item = " ".join(f"bench{i}" for i in range(12))
    rows = []
    for i in range(150):
        lang = rng.choice(["en", "fr"])
        t = " ".join(rng.choice(vocab[lang]) + (str(rng.randrange(40)) if rng.random() < 0.6 else "") for _ in range(40))
        rows.append((i, t, lang, f"src{i % 5}", len(t)))
    rows += [(200, rows[0][1], "en", "src1", 0), rows[1], rows[1], (201, None, "en", "src1", 0), (202, "", None, None, 0), (None, rows[2][1] + " tail", "en", "src2", 0)]
    rows += [(203, f"the house {item} water", "en", "src1", 0), (204, rows[3][1] + " password=hunter2secret", "en", "src1", 0)]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    for name, own in (("odd", rows), ("empty", [])):
        folder = str(tmp_path / name)
        spark.createDataFrame(own, schema).write.parquet(f"{folder}/documents.parquet")
        spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
        docs = spark.read.parquet(f"{folder}/documents.parquet")
        for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
            stage(spark, docs, folder).write.parquet(f"{folder}/{k}")
            after = spark.read.parquet(f"{folder}/{k}")
            assert k == 4 or after.columns == docs.columns
            if own and k == 0:
                ids = [r.doc_id for r in after.collect()]
                assert 201 not in ids and 202 not in ids and len(ids) >= 150
            elif own and k == 1:
                texts = [r.text for r in after.collect()]
                sets = [{tuple(w[i : i + 5]) for i in range(len(w) - 4)} for w in (t.lower().split() for t in texts)]
                assert not any(a and 100 * len(a & b) >= 75 * len(a | b) for a, b in itertools.combinations(sets, 2))
                ids = [r.doc_id for r in after.collect()]
                assert 200 not in ids and None not in ids and ids.count(1) == 1 and 0 in ids and 2 in ids
            elif own and k == 2:
                assert after.count() == docs.count() - 1 and after.where("doc_id = 203").count() == 0
            elif own and k == 3:
                assert after.count() == docs.count() and not any(re.search("hunter2", r.text) for r in after.collect())
            docs = after
        assert docs.count() > 0 if own else docs.count() == 0


def test_near_duplicates_of_long_texts_take_linear_space(spark):
    """Three texts that share half of their words in pairs: what is written grows with their length, not with its square."""
    folder = spark.sparkContext._jsc.sc().getCheckpointDir().get()
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    size = lambda: path.getFileSystem(spark._jsc.hadoopConfiguration()).getContentSummary(path).getLength()
    took = []
    for n in (2000, 8000):
        parts = [" ".join(f"{k}{i}" for i in range(n // 2)) for k in "abc"]
        texts = [f"{parts[0]} {parts[1]}", f"{parts[1]} {parts[2]}", f"{parts[2]} {parts[0]}"]
        before = size()
        got = near_dup.near_duplicates(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
        assert {r.doc_id: r.component_id for r in got} == {0: 0, 1: 1, 2: 2}
        took.append(size() - before)
    assert took[1] < 6 * max(took[0], 200_000), took


def test_windows_are_compared_in_blocks(monkeypatch):
    monkeypatch.setattr(substring_dedup, "PAIRS", 3)
    hashes = np.array([5, 5, 7, 5, 9, 7, 8, 9, 9], np.uint64)
    words = np.array([1, 1, 2, 3, 4, 2, 6, 4, 4])
    asked = []
    mask = substring_dedup._repeated(hashes, lambda i: asked.append(len(i)) or words[i][:, None])
    assert mask.tolist() == [True, True, True, False, True, True, False, True, True] and max(asked[:4]) <= 3
