"""The pipeline's stages against brute force."""

import random
from collections import Counter

import pytest

import corpus_pipeline
from sparkrx.llm import common, simhash

from .test_operators import SCHEMA, prose


def shingles(text):
    w = (text or "").encode().lower().split()
    return {b" ".join(w[i : i + 5]) for i in range(max(len(w) - 4, 1))} if w else set()


def similar(a, b):
    return a == b or (len(a & b) * 5 >= len(a | b) * 4 and bool(a | b))


def brute_first(rows):
    """The row that stays of each row's component: the smallest id."""
    sets = [shingles(r[1]) for r in rows]
    root = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if root[i] != root[j] and similar(sets[i], sets[j]):
                root = [root[j] if x == root[i] else x for x in root]
    low = {}
    for r, x in zip(root, rows):
        low[r] = min(low.get(r, x[0]), x[0])
    return set(low.values())


@pytest.fixture(scope="module")
def copies():
    """Pairs of texts from 8 to 400 words, a few words changed or added, their similarity from 0.7 to 1."""
    rng, out = random.Random(4), [(900, None), (901, ""), (902, " \n"), (903, "one two"), (904, "ONE  two"), (905, "one three")]
    for k in range(150):
        words = prose(rng, rng.randrange(8, 400)).split()
        out.append((2 * k, " ".join(words)))
        for _ in range(rng.randrange(1, 2 + len(words) // 50)):
            words[rng.randrange(len(words))] = f"changed{rng.randrange(10**6)}"
        out.append((2 * k + 1, " ".join(words + ["more"] * rng.randrange(2))))
    return [(i, t, "a", "s0", "x", 1) for i, t in out]


def test_near_copies_down_to_four_fifths_go(spark, copies):
    pairs = [(len(a & b) / len(a | b)) for a, b in zip(*[[shingles(r[1]) for r in copies[6 + k :: 2]] for k in (0, 1)])]
    assert sum(0.8 <= p < 0.9 for p in pairs) > 20 and sum(p < 0.8 for p in pairs) > 20
    docs = spark.createDataFrame(copies, SCHEMA)
    kept = corpus_pipeline.drop_near_copies(spark, docs, None)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == brute_first(copies)


def test_repeated_rows_and_rows_without_id_stay_once(spark, rows_with_repeats, monkeypatch):
    expect = Counter({1: 1, 3: 1, None: 1})
    for limit in (simhash.SMALL_LIST, 0):
        monkeypatch.setattr(simhash, "SMALL_LIST", limit)
        got = corpus_pipeline.drop_near_copies(spark, spark.createDataFrame(rows_with_repeats, SCHEMA), None).collect()
        assert Counter(r.doc_id for r in got) == expect
    assert corpus_pipeline.drop_near_copies(spark, spark.createDataFrame([], SCHEMA), None).collect() == []


@pytest.fixture
def rows_with_repeats():
    t = [prose(random.Random(k), 60) for k in range(3)]
    cells = [(1, t[0]), (1, t[0]), (2, t[0] + " more"), (None, t[0]), (3, t[1]), (None, t[2]), (None, t[2])]
    return [(i, x, "a", "s0", "x", 1) for i, x in cells]


def test_blocks_meet(spark, copies, monkeypatch):
    monkeypatch.setattr(simhash, "BLOCK", 100)
    rows = [(i, copies[6][1] + f" end{i % 7} last{i}", "a", "s0", "x", 1) for i in range(30)]
    assert {r.doc_id for r in corpus_pipeline.drop_near_copies(spark, spark.createDataFrame(rows, SCHEMA), None).collect()} == brute_first(rows)


@pytest.mark.parametrize("bits", [common.SIFT_BITS, 0])
def test_long_lists_are_not_broadcast(spark, monkeypatch, bits):
    """A list of 3,000 rows, null ids among them, and its rows out of 9,000; with the fewest bits most tables' bits are shared."""
    monkeypatch.setattr(common, "SIFT_BITS", bits)
    rows = [(None if k % 9 == 0 else k, k * 7919 % 2**31 - 2**30, f"text {k}") for k in range(9000)]
    docs = spark.createDataFrame(rows, "__d long, __xx long, text string")
    listed = spark.createDataFrame([(i, x, k) for k, (i, x, _) in enumerate(rows) if k % 3 == 0] + [(-1, 5, -1)], "__id long, __th long, k long")
    for how, expect in (("inner", rows[::3]), ("left_anti", [r for k, r in enumerate(rows) if k % 3])):
        got = simhash._rows_of(docs, listed, how)
        plan = got._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin [coalesce(__d" in plan and "BroadcastHashJoin [coalesce(__d" not in plan
        assert Counter(tuple(r)[:3] for r in got.collect()) == Counter(expect)
