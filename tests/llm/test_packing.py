"""Best-fit decreasing by plan against one piece at a time, and packed ids against the tokenizers library."""

import random
import zlib
from collections import Counter

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from sieveline.llm import packing


def one_at_a_time(lengths, capacity):
    """Rooms left in the windows of plain best-fit decreasing."""
    rooms = []
    for length in sorted(lengths, reverse=True):
        fit = [i for i, r in enumerate(rooms) if r >= length]
        if fit:
            i = min(fit, key=lambda i: rooms[i])
            rooms[i] -= length
        else:
            rooms.append(capacity - length)
    return sorted(rooms)


def spread(moves, windows, capacity):
    """(room left in each window, ranks placed by length), with every window gapless."""
    parts = [[] for _ in range(windows)]
    ranks = Counter()
    for length, rank, n, first, offset in moves.tolist():
        for i in range(n):
            parts[first + i].append((offset, length))
            ranks[length, rank + i] += 1
    for own in parts:
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert 0 < at <= capacity
    assert set(ranks.values()) <= {1}
    return sorted(capacity - sum(n for _, n in own) for own in parts), ranks


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(1, 16), max_size=60), st.sampled_from([16, 17, 23]))
def test_plan_is_best_fit_decreasing(lengths, capacity):
    counts = Counter(lengths)
    moves, windows = packing.plan(counts, capacity)
    rooms, ranks = spread(moves, windows, capacity)
    assert rooms == one_at_a_time(lengths, capacity)
    assert set(ranks) == {(n, i) for n, c in counts.items() for i in range(c)}


def test_plan_of_many_pieces_is_small():
    rng = np.random.default_rng(3)
    lengths = np.minimum(2048, rng.lognormal(6, 1, 40_000).astype(int) + 1)
    counts = dict(zip(*(x.tolist() for x in np.unique(lengths, return_counts=True))))
    few, _ = packing.plan(counts)
    moves, windows = packing.plan({k: 1_000_003 * v for k, v in counts.items()})
    assert len(moves) < 200_000 and len(few) < 100_000
    assert windows * 2048 * 0.999 < 1_000_003 * int(lengths.sum()) <= windows * 2048
    hot, windows = packing.plan({1: 10**15, 700: 10**14, 2048: 7})
    assert len(hot) < 5000 and windows >= 10**14 // 2


def test_room_tree():
    tree = packing.RoomTree(20)
    assert tree.least(1) is None
    for room in (3, 20, 11, 11):
        tree.add(room, 1)
    assert [tree.least(r) for r in (0, 3, 4, 11, 12, 20)] == [3, 3, 11, 11, 20, 20]
    tree.add(11, -2)
    assert tree.least(4) == 20


def test_packed_ids(spark):
    from tokenizers import Tokenizer

    rng = random.Random(8)
    words = ["the", "naïve", "quick", "𝒳", "  ", "\n\n", "don't", "1234", "zebra-crossing", "ß", "<|endoftext|>"]
    texts = ["", None, " ", "a", "é" * 3000, "x " * 9000, "end <|endoftext|> of", *(" ".join(rng.choice(words) for _ in range(rng.choice([1, 5, 40, 700, 4000]))) for _ in range(80))]
    rows = [(i, t, 9, "z") for i, t in enumerate(texts)] + [(3, "a", 9, "z"), (3, "a", 9, "z"), (None, "no id", 9, "z"), (None, None, 9, "z")]
    found = packing.packed(spark.createDataFrame(rows, "doc_id long, text string, length int, ids string").repartition(3))
    got = found.collect()
    plain = Tokenizer.from_file(packing.VOCABULARY)
    want = [(i, plain.encode(t or "", add_special_tokens=False).ids + [1]) for i, t, *_ in rows]
    docs = Counter()
    for r in got:
        assert len(r.ids) == 4 * r.length and 1 <= r.length <= 2048
        docs[(r.doc_id, r.start, r.length, r.ids, r.doc_tokens)] += 1
    assert docs == Counter((i, a, len(ids[a : a + 2048]), np.array(ids[a : a + 2048], "<u4").tobytes(), len(ids)) for i, ids in want for a in range(0, len(ids), 2048))
    lengths = [min(2048, len(ids) - a) for _, ids in want for a in range(0, len(ids), 2048)]
    filled = Counter()
    for r in got:
        filled[r.sequence_id] += r.length
    assert sorted(2048 - n for n in filled.values()) == one_at_a_time(lengths, 2048)
    whole = {r.sequence_id: r for r in packing.sequences(found).collect()}
    for r in got:
        assert whole[r.sequence_id].ids[4 * r.offset : 4 * (r.offset + r.length)] == r.ids
    for r in whole.values():
        assert [p.offset for p in r.pieces] == [sum(p.length for p in r.pieces[:i]) for i in range(len(r.pieces))] and 4 * filled[r.sequence_id] == len(r.ids)
    assert packing.packed(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    assert zlib.crc32(got[0].ids) >= 0


@settings(max_examples=150, deadline=None)
@given(st.text(max_size=60))
def test_encoder_gives_the_library_s_ids(text):
    e = packing.encoder(packing.VOCABULARY)
    assert e.encode(text).tolist() == e.plain.encode(text, add_special_tokens=False).ids
