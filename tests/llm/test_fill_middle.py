"""Fill-in-the-middle against plain slicing, for every unit, and its round trip."""

import hashlib
import random
import re

from sieveline.llm import fill_middle
from sieveline.llm.fill_middle import Checkpoints

TEXTS = ["", "a", "é", "<", "a<S", "<P", "plain <S> mark", "naïve 𝒳 text\nwith lines\n\nend", "  lead and  tail \n", "\n\n", "𝒳" * 5000, "wörd " * 4000, "x" * 70_000]


def units_of(text, unit):
    if unit == "code_point":
        return list(text)
    if unit == "line":
        return re.findall(r"[^\n]*\n|[^\n]+", text)
    return re.findall(r"^[ \t-\r]+|[^ \t-\r]+[ \t-\r]*", text)


def test_checkpoints_find_every_cut():
    for text in TEXTS:
        data = text.encode()
        for unit in fill_middle.UNITS:
            parts = units_of(text, unit)
            for every, block in ((1, 7), (3, 5), (16, 64), (1024, 1 << 20)):
                if len(text) > 1000 and every < 16:
                    continue
                index = Checkpoints(data, unit, every, block)
                assert index.count == len(parts) and index.points == len(text)
                for u in {0, 1, 2, len(parts) // 3, len(parts) // 2, len(parts) - 1, len(parts)} & set(range(len(parts) + 1)):
                    before = "".join(parts[:u])
                    assert index.after(u) == (len(before.encode()), len(before)), (text[:20], unit, every, u)


def test_a_cut_reads_a_short_stretch_again():
    data = ("é" * 3_000_000).encode()
    index = Checkpoints(data)
    assert len(index.units) == -(-3_000_000 // fill_middle.EVERY)
    for u in (1, 1_500_001, 2_999_999):
        index.rescanned = 0
        index.after(u)
        assert index.rescanned <= 4 * fill_middle.EVERY


def plain(doc_id, text):
    text = text or ""
    h = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[8 * i : 8 * i + 8], 16) for i in range(4))
    n = len(text)
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    if not text or re.search("<[PSM]>", text) or h3 % 100 >= 90:
        return doc_id, n, "plain", None, None, text
    p, m, s = text[:a], text[a:b], text[b:]
    return (doc_id, n, "spm", a, b - a, f"<S>{s}<P>{p}<M>{m}") if h4 % 100 < 20 else (doc_id, n, "psm", a, b - a, f"<P>{p}<S>{s}<M>{m}")


def test_all_texts(spark):
    rng = random.Random(5)
    texts = [*TEXTS, None, *("".join(rng.choice("<PSM>aé ") for _ in range(rng.randint(0, 40))) for _ in range(300))]
    rows = [(i, t, "keep", -1) for i, t in enumerate(texts)] + [(None, "no id here", "keep", -1), (None, None, None, None), (3, TEXTS[3], "keep", -1), (3, TEXTS[3], "keep", -1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, output string, n long").repartition(3)
    made = fill_middle.fill_in_middle(docs)
    assert made.columns == ["doc_id", "text", *fill_middle.ADDED]
    got = made.withColumn("back", fill_middle.restored()).collect()
    key = lambda r: tuple(map(str, r))
    assert sorted(((r.doc_id, r.n, r.form, r.prefix_chars, r.middle_chars, r.output) for r in got), key=key) == sorted((plain(i, t) for i, t, *_ in rows), key=key)
    assert all(r.back == (r.text or "") for r in got)
    assert {r.form for r in got} == {"plain", "psm", "spm"}
    assert fill_middle.fill_in_middle(docs.limit(0)).count() == 0
    words = fill_middle.fill_in_middle(docs, unit="word", every=2).withColumn("back", fill_middle.restored()).collect()
    assert all(r.back == (r.text or "") and r.n == len(units_of(r.text or "", "word")) for r in words)
