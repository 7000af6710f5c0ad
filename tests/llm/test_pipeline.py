"""Each stage of the pipeline against a plain version, on the small table and on odd rows, and the whole run."""

import hashlib
import re
from collections import Counter, defaultdict

import corpus_pipeline
import public_tokenizers
import pytest
import sentencepiece
from conftest import SMALL
from pyspark.sql import functions as F
from test_mixing_dedup import expected_targets
from test_near_dedup import _clump, _groups

from tessera.llm import quality, registry

WORDS = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.fixture(params=["small", "odd"])
def docs(request):
    return request.getfixturevalue(request.param)


def _rows(df):
    return Counter((r.doc_id, r.text, r.source) for r in df.select("doc_id", "text", "source").collect())


def test_stages_keep_the_columns(spark, docs):
    for name, stage in corpus_pipeline.STAGES[:-1]:
        made = stage(spark, docs, SMALL)
        assert made.columns == docs.columns and made.schema["text"].dataType == docs.schema["text"].dataType, name


def test_stages_of_nothing(spark, none):
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, none, SMALL).collect() == []


def test_good_documents_stay(spark, docs, small):
    found = _rows(corpus_pipeline.keep_good(spark, docs, SMALL))
    # The plain score: the mean weights of each kind of feature, text by text.
    labels = spark.read.parquet(f"{SMALL}/labels.parquet")
    weights, bias = quality.fitted(docs, labels)
    import numpy as np

    def score(text):
        data = np.frombuffer((text or "").encode(), np.uint8)
        parts = [weights[f].mean() for f, _ in quality.features(np.array([0, len(data)]), data) if len(f)]
        return 1 / (1 + np.exp(-(bias + sum(parts))))

    want = Counter({k: n for k, n in _rows(docs).items() if score(k[1]) >= corpus_pipeline.GOOD})
    assert found == want


def test_the_stage_and_the_query_agree(spark, small):
    kept = {r.doc_id for r in corpus_pipeline.keep_good(spark, small, SMALL).select("doc_id").collect()}
    assert kept == {r.doc_id for r in registry.QUERIES["op6_quality"](spark, SMALL).where("predicted = 1").collect()}


def test_copies_leave_the_largest_id(spark, docs):
    best = {}
    for i, text, _ in _rows(docs):
        best[text or ""] = max(best.get(text or "", (False, 0)), (i is not None, i or 0))
    found = corpus_pipeline.drop_copies(spark, docs, SMALL).collect()
    assert Counter((r.text or "", r.doc_id is not None, r.doc_id or 0) for r in found) == Counter((t, *i) for t, i in best.items())


def test_near_copies_leave_the_least_id(spark, docs):
    least = lambda ids: min((i for i in ids if i is not None), default=None)
    found = corpus_pipeline.drop_near_copies(spark, docs, SMALL).collect()
    assert Counter(r.doc_id for r in found) == Counter(map(least, _groups(docs.select("doc_id", "text").collect())))


def test_near_copies_in_a_clump_leave_one_of_each_pair(spark):
    docs = spark.createDataFrame(_clump(300), "doc_id long, text string")
    stays = corpus_pipeline.drop_near_copies(spark, docs, "").collect()
    assert sorted(r.doc_id for r in stays) == list(range(300))


def test_passages_make_up_the_targets(spark, docs):
    sizes, texts = defaultdict(int), defaultdict(set)
    for (i, text, source), n in _rows(docs).items():
        sizes[source] += n * len(WORDS.findall(text or ""))
        texts[(i, source)].add(text or "")
    taken = Counter()
    for r in corpus_pipeline.mix_sources(spark, docs, SMALL).collect():
        assert any(r.text in t for t in texts[(r.doc_id, r.source)]) and r.n_chars == len(r.text)
        taken[r.source] += len(WORDS.findall(r.text))
    for source, target in expected_targets(dict(sizes)).items():
        assert abs(taken[source] - target) <= 2 * corpus_pipeline.MIX.block_words, source


def test_passages_are_encoded_and_decoded(spark, docs):
    sp = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    want = Counter()
    for (i, text, _), n in _rows(docs).items():
        ids = [*sp.encode(text or ""), sp.eos_id()]
        want[(i, tuple(ids), hashlib.sha256(sp.decode(ids).encode()).hexdigest())] += n
    found = corpus_pipeline.encode(spark, docs, SMALL).collect()
    assert Counter((r.doc_id, tuple(r.ids), r.decoded_sha256) for r in found) == want
    assert all(r.n_tokens == len(r.ids) for r in found)


def test_the_run_applies_the_stages_in_order(spark, small):
    docs = small
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SMALL)
    told = lambda df: Counter((r.doc_id, r.n_tokens, r.decoded_sha256) for r in df.select("doc_id", "n_tokens", "decoded_sha256").collect())
    assert told(corpus_pipeline.run(spark, SMALL)) == told(docs)


def test_long_and_common_words(spark):
    long = " ".join(f"w{i % 977}x{i // 977}" for i in range(60_000))
    docs = spark.createDataFrame(
        [(1, long, "en", "a", 1), (2, long + " z", "en", "a", 1), (3, "the " * 30_000, "en", "b", 1), (4, "x", None, None, None)],
        "doc_id long, text string, lang string, source string, n_chars long",
    )
    assert {r.doc_id for r in corpus_pipeline.drop_near_copies(spark, docs, SMALL).collect()} == {1, 3, 4}
    made = corpus_pipeline.mix_sources(spark, docs, SMALL)
    assert made.agg(F.max("n_chars")).head()[0] > 1000 and corpus_pipeline.encode(spark, made, SMALL).count() == made.count()
