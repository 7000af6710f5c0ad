import random
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tessera.llm import components as joined
from tessera.llm import near_dedup, textnp
from tessera.llm.components import components


def _lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        last = 0
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], last + 1 if x == y else max(row[j], row[j - 1])
    return row[-1]


def test_alignment_equals_plain_dynamic_programming():
    rng = random.Random(4)
    for _ in range(200):
        a = [rng.randrange(30) for _ in range(rng.randrange(1, 40))]
        b = list(a)
        for _ in range(rng.randrange(4)):
            b.insert(rng.randrange(len(b) + 1), rng.randrange(30))
        m = _lcs(a, b)
        assert near_dedup.common(np.array(a), np.array(b), len(a) + len(b)) == m
        assert near_dedup.linked(np.array(a), np.array(b))[0] == (9 * m >= 4 * (len(a) + len(b)))


def _groups(rows):
    """The ids of each class, by aligning all pairs of texts that have a run in common."""
    texts = sorted({r.text or "" for r in rows})
    runs, firsts = near_dedup.runs_of(*textnp.utf8(pa.array(texts, pa.large_string())))
    own = [runs[x:y] for x, y in zip(firsts[:-1], firsts[1:], strict=True)]
    holders = defaultdict(set)
    for i, r in enumerate(own):
        for x in r.tolist():
            holders[x].add(i)
    root = list(range(len(texts)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, j in {(i, j) for h in holders.values() for i in h for j in h if i < j}:
        if near_dedup.linked(own[i], own[j])[0]:
            root[find(j)] = find(i)
    ids = defaultdict(list)
    for r in rows:
        ids[find(texts.index(r.text or ""))].append(r.doc_id)
    return list(ids.values())


def _brute(rows):
    """``(id, class's id, class's size)`` of each row."""
    out = Counter()
    for members in _groups(rows):
        least = min((i for i in members if i is not None), default=None)
        out.update((i, least, len(members)) for i in members)
    return out


def _check(docs):
    found = near_dedup.classes(docs).collect()
    rows = docs.select("doc_id", "text").collect()
    assert Counter((r.doc_id, r.class_id, r.class_size) for r in found) == _brute(rows)
    return found


def test_classes_of_the_small_table(small):
    found = _check(small)
    kept = [r.doc_id for r in found if r.kept]
    assert sorted(kept) == sorted({r.class_id for r in found})


def test_classes_of_odd_rows(odd):
    found = _check(odd)
    stays = near_dedup.survivors(odd)
    assert stays.columns == odd.columns and stays.count() == sum(r.kept for r in found)


def test_classes_of_nothing(none):
    assert near_dedup.classes(none).collect() == [] and near_dedup.survivors(none).collect() == []


def test_a_clump_of_unlinked_texts_is_not_paired_off(spark):
    rng = random.Random(9)
    words = lambda n: [f"w{rng.randrange(10**6)}" for _ in range(n)]
    shared = words(70)
    rows = [(i, " ".join(shared + words(30))) for i in range(300)]
    rows += [(1000 + i, t.replace(t.split()[-1], "changed")) for i, t in rows[::30]]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = {r.doc_id: r.class_id for r in near_dedup.classes(docs).collect()}
    assert all(found[1000 + i] == i == found[i] for i, _ in rows[:300:30])
    tested, _ = near_dedup.links(docs)
    assert tested.count() < 300 * 299 / 4


@pytest.mark.parametrize("most", [0, joined.AT_ONCE])
def test_few_edges_are_joined_at_once(spark, monkeypatch, most):
    monkeypatch.setattr(joined, "AT_ONCE", most)
    rounds = []
    monkeypatch.setattr(joined, "join_held", lambda *x, f=joined.join_held: rounds.append(1) or f(*x))
    edges = [(bytes([i, 255 - i]), bytes([i + 1, 254 - i])) for i in range(20)] + [(b"\xff", b"\x7f"), (b"a", b"a")]
    rows = components(spark.createDataFrame([(bytearray(a), bytearray(b)) for a, b in edges[::-1]], "a binary, b binary")).collect()
    found = {bytes(r.node): bytes(r.label) for r in rows}
    assert found == {bytes([i, 255 - i]): b"\x00\xff" for i in range(21)} | {b"\xff": b"\x7f", b"\x7f": b"\x7f", b"a": b"a"}
    assert len(rows) == len(found) and bool(rounds) == (not most)


def test_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 101), (101, 100), (200, 200)]
    rows = components(spark.createDataFrame(edges, "a long, b long")).collect()
    assert {r.node: r.label for r in rows} == {**{i: 0 for i in range(41)}, 100: 100, 101: 100, 200: 200}
    assert components(spark.createDataFrame([], "a long, b long")).where(F.col("label").isNotNull()).collect() == []


def _clump(pairs):
    """Variants of one text that is not there: each pair lacks the same 11 of its 100 runs (likeness 89/111), no two others do."""
    rng = random.Random(12)
    base = [f"w{rng.randrange(10**7)}" for _ in range(104)]
    rows = []
    for i, (x, y) in enumerate(rng.sample([(x, y) for x in range(5, 90) for y in range(x + 8, 95)], pairs)):
        for k in (0, 1):
            own = list(base)
            for at in (x, y, y + 1):
                own[at] = f"v{rng.randrange(10**9)}"
            rows.append((10_000 * k + i, " ".join(own)))
    return rows


@pytest.mark.parametrize("few", [0, 2000])
def test_links_inside_a_large_clump_are_found(spark, monkeypatch, few):
    monkeypatch.setattr(near_dedup, "FEW", few)
    found = _check(spark.createDataFrame(_clump(300), "doc_id long, text string"))
    assert {r.class_size for r in found} == {2} and sum(r.kept for r in found) == 300


def test_a_family_is_compared_across_its_blocks(spark, monkeypatch):
    monkeypatch.setattr(near_dedup, "BLOCK", 20)
    monkeypatch.setattr(near_dedup, "COLUMNS", 64)
    _check(spark.createDataFrame(_clump(60), "doc_id long, text string"))


def test_the_last_stage_needs_no_second_bucket(spark):
    rng = random.Random(14)
    rows = []
    for i in range(200):
        own = [f"w{rng.randrange(10**7)}" for _ in range(31)]
        rows += [(f"a{i:03}", own), (f"b{i:03}", ["x", "y", "z", *own[3:]])]
    runs, firsts = near_dedup.runs_of(*textnp.utf8(pa.array([" ".join(t) for _, t in rows], pa.large_string())))
    short = [(runs[x:y] >> np.uint64(32)).astype("<u4").tobytes() for x, y in zip(firsts[:-1], firsts[1:], strict=True)]
    held = spark.createDataFrame([(bytearray(n, "ascii"), bytearray(x)) for (n, _), x in zip(rows, short, strict=True)], "node binary, runs binary")
    # Each pair has 24 of 27 runs in common; every text stands in one mixed bucket only.
    found = near_dedup._rest(held.select(F.lit(1).cast("long").alias("key"), "node", F.col("node").alias("label")), held).where("linked").collect()
    assert sorted((bytes(r.a), bytes(r.b), r.m) for r in found) == [(b"a%03d" % i, b"b%03d" % i, 24) for i in range(200)]


def test_runs_and_lists_of_them_are_not_broadcast(spark, monkeypatch):
    """Sizes after an Arrow function or a list's aggregate are guesses; only the rows of hot keys go through the driver."""
    plans = []
    monkeypatch.setattr(near_dedup, "written", lambda df, *x, f=near_dedup.written: plans.append(df._jdf.queryExecution().executedPlan().toString()) or f(df, *x))
    # A thousandth of the rows is more than two texts hold, so that no key is hot.
    runs = [np.random.default_rng(i // 2).integers(0, 1 << 32, 2000, dtype=np.uint64).astype("<u4").tobytes() for i in range(20)]
    rows = [(i, bytes([i]) * 16, bytes([i]) * 16, r, 2000) for i, r in enumerate(runs)]
    nodes = near_dedup.written(spark.createDataFrame(rows, "id long, node binary, label binary, runs binary, n long"), "near-test")
    found = {r.id: r.family for r in near_dedup._families(nodes).collect()}
    assert len(found) == 20 and len(set(found.values())) == 10
    heads = [p for p in plans if "MapInArrow" in p and "SortMergeJoin" in p]
    assert heads and not any("BroadcastExchange" in p for p in heads)
