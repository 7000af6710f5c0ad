import math
import os
import re
import resource
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from tessera.llm import ngram_lm, textnp
from tessera.llm.common import crc_mod

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def _tokens(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return [*WORD.findall(low), None]


@pytest.mark.parametrize("which", ["odd", "small"])
def test_base_scores(request, which):
    docs = request.getfixturevalue(which)
    chosen = crc_mod("doc_id", 7) != 2
    rows = ngram_lm.scores(docs, ngram_lm.train(docs, chosen), "doc_id", "text").collect()
    counts = Counter(t for r in docs.where(chosen).collect() for t in _tokens(r.text))
    total = sum(counts.values())
    for r in rows:
        own = _tokens(r.text)
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(own), sum(t in counts for t in own), total)
        assert r.base_score == pytest.approx(sum(math.log10((counts[t] + 1) / (total + len(counts) + 1)) for t in own))
        assert r.score < 0
    assert sum(r.score for r in rows) > sum(r.base_score for r in rows)


class Plain:
    """The model over dictionaries, by its formulas."""

    def __init__(self, texts, order):
        self.order = order
        self.levels = [Counter() for _ in range(order)]  # by length less one: n-gram -> count
        for text in texts:
            own = ["<s>"] * (order - 1) + _tokens(text)
            self.levels[-1].update(tuple(own[i : i + order]) for i in range(len(own) - order + 1))
        for k in range(order - 1, 0, -1):
            self.levels[k - 1].update(g[1:] for g in self.levels[k])
        self.words = Counter(t for x in texts for t in _tokens(x))
        self.discounts = [self._discounts(Counter(c.values())) for c in self.levels]
        self.after = [defaultdict(dict) for _ in range(order)]
        for k, level in enumerate(self.levels):
            for g, c in level.items():
                self.after[k][g[:-1]][g[-1]] = c

    @staticmethod
    def _discounts(n):
        if not (n[1] and n[2] and n[3]):
            return (0, 0.5, 0.5, 0.5)
        y = n[1] / (n[1] + 2 * n[2])
        return (0, *(min(max(d, 0), k) for k, d in ((1, 1 - 2 * y * n[2] / n[1]), (2, 2 - 3 * y * n[3] / n[2]), (3, 3 - 4 * y * n[4] / n[3]))))

    def p(self, word, history):
        out = 1 / (len(self.words) + 1)
        for k in range(self.order):
            seen, d = self.after[k].get(tuple(history[len(history) - k :]), {}), self.discounts[k]
            total = sum(seen.values())
            if total:
                out = (max(seen.get(word, 0) - d[min(seen.get(word, 0), 3)], 0) + sum(d[min(c, 3)] for c in seen.values()) * out) / total
        return out

    def score(self, text):
        own = ["<s>"] * (self.order - 1) + _tokens(text)
        return sum(math.log10(self.p(own[i], own[i - self.order + 1 : i])) for i in range(self.order - 1, len(own)))


@pytest.mark.parametrize("order", [2, 3, 4])
def test_scores_equal_the_formulas(small, order):
    chosen = crc_mod("doc_id", 7) != 2
    plain = Plain([r.text for r in small.where(chosen).collect()], order)
    rows = ngram_lm.scores(small, ngram_lm.train(small, chosen, order), "doc_id", "text").collect()
    for r in rows[::5]:
        assert r.score == pytest.approx(plain.score(r.text), abs=1e-6)
        assert r.perplexity == pytest.approx(10 ** (-plain.score(r.text) / len(_tokens(r.text))))


@pytest.mark.parametrize("order", [2, 3])
def test_words_before_very_many_others_have_buckets_of_their_own(small, monkeypatch, order):
    monkeypatch.setattr(ngram_lm, "BUCKET_CHARS", 5_000)
    monkeypatch.setattr(ngram_lm, "SAMPLE", 2)
    every = crc_mod("doc_id", 7) >= 0
    model = ngram_lm.train(small, every, order)
    assert len(model.layout.hot) > 3
    plain = Plain([r.text for r in small.collect()], order)
    for r in ngram_lm.scores(small, model, "doc_id", "text").collect()[::9]:
        assert r.score == pytest.approx(plain.score(r.text), abs=1e-6)


@pytest.mark.parametrize("order", [2, 3])
def test_probabilities_sum_to_one(spark, order):
    texts = ["a b a c", "a b", "b c a", "c", "a b c d", "d d d a b", "b a c a a"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    model = ngram_lm.train(docs, docs.doc_id >= 0, order)
    # P(history word end) / P(end after history word), over all words, an unknown one and the end itself.
    plain = Plain(texts, order)
    for history in (["<s>", "a"], ["a", "b"], ["d", "d"], ["x", "y"], ["x", "a"]):
        assert sum(plain.p(w, history) for w in [*plain.words, "unseen"]) == pytest.approx(1)
    ask = spark.createDataFrame([(t,) for t in (*texts, "", "unseen", "a unseen b", "d c b a")], "text string")
    for r in ngram_lm.scores(ask, model, "text").collect():
        assert r.score == pytest.approx(plain.score(r.text))


def test_model_of_nothing(odd, none):
    empty = ngram_lm.train(none, none.doc_id >= 0)
    assert (empty.train_tokens, empty.vocabulary) == (0, 0)
    assert {r.score for r in ngram_lm.scores(odd, empty, "doc_id").collect()} == {0.0}


def test_a_chunk_of_over_a_million_contexts():
    n = (1 << 20) + 1000
    context, token = np.arange(n, dtype=np.uint64) << np.uint64(40), np.full(n, 7 << 20, np.uint64)
    packed = ngram_lm._packed([context], token, ngram_lm.Layout(1)).to_pylist()
    assert len(packed) == 1
    assert (np.frombuffer(packed[0]["sizes"], "<u4") == 1).all() and len(packed[0]["contexts"]) == 8 * n
    assert len(packed[0]["counts"]) == 4 * n and (np.frombuffer(packed[0]["counts"], "<u4") == 1).all()

def test_a_model_of_more_files_than_may_be_open(small, monkeypatch):
    monkeypatch.setattr(ngram_lm, "BUCKET_CHARS", 2_000)
    model = ngram_lm.train(small, crc_mod("doc_id", 7) != 2)
    assert len(os.listdir(model.folder)) > 500
    rows = small.select("text").collect()
    plain = Plain([r.text for r in small.where(crc_mod("doc_id", 7) != 2).collect()], 2)
    offsets, data = textnp.utf8(pa.array([r.text for r in rows]))
    contexts, token, firsts = ngram_lm.tokens(offsets, data)
    expected = {i: plain.score(rows[i].text) for i in range(0, len(rows), 40)}
    soft, hard = resource.getrlimit(resource.RLIMIT_NOFILE)
    for most in (ngram_lm.OPEN, 50):
        monkeypatch.setattr(ngram_lm, "OPEN", most)
        own = ngram_lm.Reader(model)
        resource.setrlimit(resource.RLIMIT_NOFILE, (400, hard))
        try:
            _, p = own.look_up(contexts, token)
        finally:
            resource.setrlimit(resource.RLIMIT_NOFILE, (soft, hard))
        assert len(own.open) <= most
        score = np.add.reduceat(np.log10(p), firsts[:-1])
        assert {i: score[i] for i in expected} == pytest.approx(expected, abs=1e-6)
