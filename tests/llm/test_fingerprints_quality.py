import hashlib
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tessera.llm import fingerprints, quality, registry, textnp
from tessera.llm.common import crc_mod

SF = "/root/testdata/sf0.01"


def _jaccard(a: str, b: str) -> float:
    def sh(t):
        w = t.split(" ")
        return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))}

    x, y = sh(a), sh(b)
    return len(x & y) / len(x | y)


def test_likeness_estimates_jaccard():
    rng = np.random.default_rng(1)
    words = [f"w{i}" for i in range(3000)]
    errors = []
    for k in range(60):
        a = list(rng.choice(words, 300))
        b = list(a)
        for i in rng.integers(0, 300, k):
            b[i] = "x" + b[i]
        texts = [" ".join(a), " ".join(b)]
        bits, blank = fingerprints.sketch(*textnp.utf8(pa.array(texts)))
        errors.append(fingerprints.likeness(bits[:1], bits[1:], blank[:1], blank[1:])[0] - _jaccard(*texts))
    assert np.abs(errors).max() < 0.15 and abs(np.mean(errors)) < 0.02


_M = (1 << 64) - 1


def _mix(x):
    x ^= x >> 30
    x = x * 0xBF58476D1CE4E5B9 & _M
    x ^= x >> 27
    x = x * 0x94D049BB133111EB & _M
    return x ^ (x >> 31)


def _plain_print(text: str) -> str:
    """A fingerprint by plain integers: hash shingles, bin them, fill empty bins from others, store four bits of each."""
    byte, shingle = [int(x) for x in textnp._BYTE], [int(x) for x in textnp._SHINGLE]
    words = []
    for w in re.findall(rb"[^\x20\x09-\x0D]+", text.encode()):
        words.append(_mix(sum(byte[c] * pow(int(textnp._BASE), i, 1 << 64) for i, c in enumerate(w)) & _M))
    n = min(5, len(words))
    if not n:
        return "0" * 256
    bins = {}
    for i in range(len(words) - n + 1):
        h = _mix((sum(words[i + j] * shingle[j] for j in range(n)) + n) & _M)
        bins[h % 256] = min(bins.get(h % 256, _M), h >> 8)
    out = ""
    for b in range(256):
        at, attempt = b, 0
        while at not in bins:
            key = (attempt * 256 + b + 1) * 0xD6E8FEB86659FD93 & _M
            at, attempt = ((_mix(key) >> 40) if attempt < 2048 else b + attempt) % 256, attempt + 1
        out += f"{_mix(bins[at]) & 15:x}"
    return out


def _likeness(one: str, other: str, told) -> float:
    blank = [not x.strip(" \t\n\r\x0b\x0c") for x in (one, other)]
    if any(blank):
        return float(all(blank))
    same = sum(x == y for x, y in zip(told(one), told(other), strict=True)) / 256
    return min(max((same - 1 / 16) / (15 / 16), 0.0), 1.0)


@pytest.mark.parametrize("which", ["odd", "small"])
def test_edited_texts(request, which):
    docs = request.getfixturevalue(which)
    rows = fingerprints.against_edited(docs).collect()
    # Rows with equal ids stand in order of their text's hash; null ids come first.
    given = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("tie", F.xxhash64("text")).collect()
    given.sort(key=lambda r: (r.doc_id is not None, r.doc_id or 0, r.tie))
    prints = {}
    told = lambda t: prints.setdefault(t, _plain_print(t))
    want = Counter()
    for i, r in enumerate(given):
        after = given[(i + 1) % len(given)].text
        n = len(r.text) // 4
        edited = r.text[: len(r.text) - n] + after[:n]
        near = [round(_likeness(r.text, t, told), 9) for t in (edited, after)]
        want[(r.doc_id, len(r.text), hashlib.sha256(edited.encode()).hexdigest(), told(r.text), told(edited), *near)] += 1
    got = Counter((r.doc_id, r.n_chars, r.edited_sha256, r.fingerprint, r.edited_fingerprint, round(r.near_edited, 9), round(r.near_next, 9)) for r in rows)
    assert got == want


def test_fingerprints_keep_columns(odd, none):
    rows = fingerprints.fingerprints(odd, "doc_id", "text", "node").collect()
    assert len(rows) == odd.count() and all(len(r.fingerprint) == fingerprints.BINS for r in rows)
    assert fingerprints.fingerprints(none, "doc_id").collect() == []
    assert fingerprints.against_edited(none).collect() == []
    alone = fingerprints.against_edited(odd.where("doc_id = 10")).collect()
    assert len(alone) == 1 and alone[0].near_next == 1.0


def test_densification_fills_every_bin():
    bits, blank = fingerprints.sketch(*textnp.utf8(pa.array(["a", "b", "", "a"])))
    assert blank.tolist() == [False, False, True, False]
    assert (bits[0] == bits[3]).all() and len(set(bits[0].tolist())) == 1  # one shingle fills all bins
    assert not bits[2].any()


def test_quality_on_held_out_rows(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    model = quality.fitted(docs, labels)
    truth = {r.doc_id: r.quality for r in labels.collect() if r.quality is not None and zlib.crc32(str(r.doc_id).encode()) % 4 == 2}
    scored = {r.doc_id: r.score for r in quality.scores(docs.where(crc_mod("doc_id", 4) == 2), model, "doc_id").collect()}
    pairs = [(scored[i], y) for i, y in truth.items() if i in scored]
    hits = sum((s >= 0.5) == bool(y) for s, y in pairs)
    assert len(pairs) > 50 and hits / len(pairs) > 0.85


def test_quality_query(spark):
    rows = {r.doc_id: r for r in registry.QUERIES["op6_quality"](spark, SF).collect()}
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect() if r.quality is not None}
    assert len(rows) == spark.read.parquet(f"{SF}/documents.parquet").count()
    for i, r in rows.items():
        assert r.held_out == (zlib.crc32(str(i).encode()) % 4 == 2) and r.predicted == int(r.score >= 0.7) and 0 <= r.score <= 1
    held = [(rows[i].predicted, y) for i, y in labels.items() if i in rows and rows[i].held_out]
    assert len(held) > 50 and sum(p == y for p, y in held) / len(held) > 0.9


def test_character_runs_do_not_cross_words():
    text = "ab \u00e9\U0001f600\tc"
    data = np.frombuffer(text.encode(), np.uint8)
    words, two, three = (len(f) for f, _ in quality.features(np.array([0, len(data)]), data))
    # "ab", "b ", " é", "é😀", "😀 ", " c"; "ab ", " é😀", "é😀 ".
    assert (words, two, three) == (3, 6, 3)
    one, _ = quality.features(np.array([0, 3, 6]), np.frombuffer(b"abcabc", np.uint8))[1]
    assert one.tolist() == [*one[:2], *one[:2]]


def test_quality_of_odd_rows(spark, odd, none):
    labels = spark.createDataFrame([(1, 1, 0), (4, 1, 0), (7, 0, 0), (10, 1, 0), (10, 0, 0), (13, None, 1), (None, 1, 1)], "doc_id long, quality int, toxic int")
    model = quality.fitted(odd, labels)
    rows = quality.scores(odd, model, *odd.columns, score="__p").collect()
    assert len(rows) == odd.count() and all(0 <= r["__p"] <= 1 for r in rows)
    assert quality.scores(none, model, "doc_id").collect() == []
    nothing = quality.fitted(none, labels.where("doc_id < 0"))
    assert {r.score for r in quality.scores(odd, nothing, "doc_id").collect()} == {0.5}
