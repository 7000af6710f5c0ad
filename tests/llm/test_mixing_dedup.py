import hashlib
import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from tessera.llm import exact_dedup, mixing

WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def expected_targets(sizes: dict, weights=(3, 1, 2), share=1.5, most=2) -> dict:
    """Water-filling by repeated capping."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    left, open_, out = share * sum(sizes.values()), set(order), {}
    while open_:
        total = sum(weight[s] for s in open_)
        over = {s for s in open_ if left * weight[s] / total > most * sizes[s]}
        if not over:
            return out | {s: left * weight[s] / total for s in open_}
        for s in over:
            out[s] = float(most * sizes[s])
            left -= out[s]
        open_ -= over
    return out


@pytest.mark.parametrize("which", ["odd", "small"])
def test_mix_meets_its_targets(request, which):
    docs = request.getfixturevalue(which)
    given = docs.select("doc_id", "text", "source").collect()
    sizes = defaultdict(int)
    for r in given:
        sizes[r.source] += len(WORDS.findall(r.text or ""))
    want = expected_targets(dict(sizes))
    rows = mixing.taken(docs).collect()
    assert Counter((r.doc_id, r.size) for r in rows) == Counter((r.doc_id, len(WORDS.findall(r.text or ""))) for r in given)
    taken = Counter()
    for r in rows:
        assert r.source_size == sizes[r.source] and r.target == pytest.approx(want[r.source])
        assert 0 <= r.taken <= 2 * r.size
        taken[r.source] += r.taken
    for source, target in want.items():
        assert abs(taken[source] - target) <= 128, source
    assert sorted(map(repr, rows)) == sorted(map(repr, mixing.taken(docs.repartition(5)).collect()))


def test_mix_of_nothing(none):
    assert mixing.taken(none).collect() == []
    assert mixing.mixed_documents(none).collect() == []


def test_permutations_permute(spark):
    df = spark.range(1000).withColumn("n", F.lit(1000).cast("long"))
    seen = [r[0] for r in df.select(mixing._permuted("id", "n", F.lit(3))).collect()]
    assert sorted(seen) == list(range(1000)) and seen != list(range(1000))


def test_mixed_passages_are_whole(odd):
    mix = mixing.Mix(block_words=16)
    rows = mixing.mixed_documents(odd, mix).select("doc_id", "text", "n_chars", "source").collect()
    texts = defaultdict(list)
    for r in odd.collect():
        texts[(r.doc_id, r.source)].append(r.text or "")
    for r in rows:
        assert any(r.text in t for t in texts[(r.doc_id, r.source)]) and r.n_chars == len(r.text)
        assert 1 <= len(WORDS.findall(r.text)) <= 16
    taken = Counter()
    for r in mixing.taken(odd, mix).collect():
        taken[r.doc_id] += r.taken
    made = Counter()
    for r in rows:
        made[r.doc_id] += len(WORDS.findall(r.text))
    assert made == +taken


def test_blocks_have_a_fixed_length(small):
    mix = mixing.Mix(block_words=100)
    rows = mixing.mixed_blocks(small, mix).collect()
    taken = mixing.taken(small, mix).collect()
    assert len({(r.source, r.slot) for r in rows}) == len(rows)
    assert all(len(WORDS.findall(r.text)) == r.n_words <= 100 for r in rows)
    # Of a source's blocks only the last is short; it is drawn twice at most.
    assert max(Counter(r.source for r in rows if r.n_words < 100).values()) <= 2
    assert sum(r.n_words for r in rows) == sum(r.taken for r in taken)
    assert {i for r in rows for i in r.doc_ids} == {r.doc_id for r in taken if r.taken}


@pytest.mark.parametrize("salts", [1, 32])
def test_exact_dedup(odd, salts):
    rows = odd.select("doc_id", "text").collect()
    groups = defaultdict(list)
    for r in rows:
        groups[r.text or ""].append(r.doc_id)
    keep = {t: max((i for i in ids if i is not None), default=None) for t, ids in groups.items()}
    want = [(r.doc_id, keep[r.text or ""], len(groups[r.text or ""]), r.doc_id == keep[r.text or ""], hashlib.sha256((r.text or "").encode()).hexdigest()) for r in rows]
    got = [tuple(r) for r in exact_dedup.assignments(odd, salts).collect()]
    assert Counter(got) == Counter(want)
    stays = exact_dedup.survivors(odd, salts)
    assert stays.columns == odd.columns
    assert Counter((r.doc_id, r.text or "") for r in stays.collect()) == Counter((i, t) for t, i in keep.items())


def test_survivors_of_rows_with_maps_and_nulls(spark):
    rows = [(None, None, {"a": 1}), (None, "", {"a": 2}), (3, "x", None), (2, "x", {"b": 1}), (3, "x", {"c": 1})]
    docs = spark.createDataFrame(rows, "doc_id long, text string, _row map<string,int>").repartition(3)
    stays = exact_dedup.survivors(docs).collect()
    assert sorted((r.doc_id is not None, r.doc_id, r.text or "") for r in stays) == [(False, None, ""), (True, 3, "x")]


def test_exact_dedup_of_nothing_and_of_one_text(spark, none):
    assert exact_dedup.assignments(none).collect() == [] and exact_dedup.survivors(none).collect() == []
    same = spark.range(3000).select(F.col("id").alias("doc_id"), F.lit("x").alias("text")).repartition(8)
    rows = exact_dedup.assignments(same).select("keep_id", "group_size").distinct().collect()
    assert [tuple(r) for r in rows] == [(2999, 3000)]
