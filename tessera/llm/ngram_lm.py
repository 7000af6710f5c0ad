"""An interpolated modified Kneser-Ney n-gram model: counted in Spark, kept as sorted hash arrays, scored by workers.

Words are maximal runs of characters other than space and U+0009..U+000D, with A-Z in lower case; each text ends
with one end token, and before its first token stand begin marks that are no tokens themselves.

Counting.  A task cuts the n-grams of its texts into *buckets* by ranges of the hash of the word before the last,
counts them in bulk and sends one packed row for each bucket; a reducer merges a bucket's rows as they come.  All lower
orders down to pairs come from the same bucket: their counts are those of different words to the left.  The number of
buckets grows with the corpus.  A word that stands before more than a bucket's share of tokens, as a sample of the texts
shows, has buckets of its own, over which its n-grams are dealt by the last word; that decides the layout only.

Storage.  For each bucket and order there is a file of flat arrays in the shared folder, sorted by hash: contexts
(64 bits) with totals and count-of-count numbers, and n-grams (64 bits) with their counts; for each bucket of words, one
of their hashes, counts and numbers of distinct words to the left.  Workers map the files into memory and look up tokens
in sorted order; nothing is loaded whole, and the driver keeps a few sums.  The number of files grows with the corpus:
a mapped file stays without a file descriptor, and of more than ``OPEN`` the one not used for longest is let go.  Files are
written aside and renamed, so a task that runs twice leaves the same file.  Workers must see the shared folder as a
mounted path (``file:``).

Model.  P(w|h) = max(c(hw) - D(c), 0) / c(h) + g(h) P(w|h'), where h' lacks the first word of h: c are counts in the
highest order and numbers of different words to the left in the others, ending with the uniform 1 / (V + 1) over the
vocabulary and one unknown word.  Discounts for counts of 1, 2 and more are those of modified Kneser-Ney, by order;
where a count of counts is zero, the discount is a half.

Null texts are empty.  Without training rows every text has probability 1 and N = V = 0.
"""

from __future__ import annotations

import math
import mmap
import os
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import urlparse

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm import textnp
from tessera.llm.common import dropped, new_path, spread, text_of, written

_U = np.uint64
BEGIN, END = _U(0x0B5E5B1A6E0C4D21), _U(0xC3A5C85C97CB3127)
_PART = _U(20)  # a word's hash without these low bits tells it from others after one context
_STEP, _JOIN = _U(0xD6E8FEB86659FD93), _U(0x9FB21C651E98DF25)
CHUNK_TOKENS, BUCKET_CHARS, SCORE_BYTES = 1 << 20, 4 << 20, 4 << 20
#: One text in so many is looked at for words that stand before very many others.
SAMPLE = 64
#: Files a worker keeps mapped; Linux lets a process have 65,530 mappings.
OPEN = 1 << 15
#: Rows told to the words' buckets at a time.
TOLD = 1 << 20


def local_path(uri: str) -> str:
    """The path at which workers see a shared folder."""
    at = urlparse(uri)
    if at.scheme not in ("", "file"):
        raise ValueError(f"the model's arrays are mapped into memory, which needs a mounted folder, not {uri}")
    return at.path


def tokens(offsets: np.ndarray, data: np.ndarray, order: int = 2) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """``(contexts, token, firsts)``: the hashes of every token and of the 1, 2, ... tokens before it; ends are tokens."""
    words, firsts = textnp.hash_words(offsets, data, lower=True)
    n = len(offsets) - 1
    ends = firsts[1:] + np.arange(n)
    token = np.empty(len(words) + n, np.uint64)
    is_end = np.zeros(len(token), bool)
    is_end[ends] = True
    token[is_end] = END
    token[~is_end] = words
    starts = np.concatenate([[0], ends[:-1] + 1]) if n else np.zeros(0, np.int64)
    place = np.arange(len(token)) - np.repeat(starts, np.diff(np.append(starts, len(token))))
    contexts: list[np.ndarray] = []
    for j in range(1, order):
        before = np.full(len(token), BEGIN)
        before[j:] = np.where(place[j:] >= j, token[:-j], BEGIN)
        contexts.append(textnp.mix(contexts[-1] * _STEP + before) if contexts else before)
    return contexts, token, np.append(starts, len(token))


def gram(context: np.ndarray, word: np.ndarray) -> np.ndarray:
    """The hash of an n-gram from its context's and the last word's high bits."""
    return textnp.mix(context * _JOIN + word)


@dataclass(frozen=True)
class Layout:
    """Which bucket an n-gram is in: by ranges of the hash of the word before the last; *hot* words have their own."""

    buckets: int
    #: hash of the word, its first bucket, its number of buckets; sorted by hash.
    hot: tuple[tuple[int, int, int], ...] = ()

    def __post_init__(self) -> None:
        object.__setattr__(self, "_hot", np.array([h for h, _, _ in self.hot], np.uint64))
        object.__setattr__(self, "_own", np.array([x[1:] for x in self.hot], np.int64).reshape(-1, 2))

    def of_hot(self, before: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which words are hot, and their places in the list."""
        if not self.hot:
            return np.zeros(len(before), bool), np.zeros(len(before), np.int64)
        at = np.minimum(np.searchsorted(self._hot, before), len(self._hot) - 1)
        return self._hot[at] == before, at

    def bucket(self, before: np.ndarray, word: np.ndarray) -> np.ndarray:
        """The bucket of n-grams whose word before the last is *before* and whose last, without low bits, is *word*."""
        out = bucket_of(before, self.buckets)
        hot, at = self.of_hot(before)
        if hot.any():
            first, n = self._own[at[hot]].T
            out[hot] = first + (word[hot] % n.astype(np.uint64)).astype(np.int64)
        return out


def bucket_of(hashes: np.ndarray, buckets: int) -> np.ndarray:
    return (((hashes >> _U(32)) * _U(buckets)) >> _U(32)).astype(np.int64)


def _six(x: np.ndarray) -> bytes:
    return x.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6].tobytes()


def _from_six(b: bytes) -> np.ndarray:
    out = np.zeros((len(b) // 6, 8), np.uint8)
    out[:, :6] = np.frombuffer(b, np.uint8).reshape(-1, 6)
    return out.reshape(-1).view("<u8").astype(np.uint64)


def _merge(v: np.ndarray, w: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (v, w) in order with their counts summed, and where each was first found."""
    if not len(v):
        return v, w, c, np.zeros(0, np.int64)
    order = np.lexsort((w, v))
    v, w, c = v[order], w[order], c[order]
    new = np.ones(len(v), bool)
    new[1:] = (v[1:] != v[:-1]) | (w[1:] != w[:-1])
    at = np.flatnonzero(new)
    return v[at], w[at], np.add.reduceat(c, at), order[at]


_PACKED = ["bucket", "contexts", "sizes", "words", "counts"]


def _packed(contexts: list[np.ndarray], token: np.ndarray, layout: Layout) -> pa.RecordBatch:
    """One row for each bucket: its n-grams, counted, grouped by context; contexts of all lengths stand side by side."""
    names, first, inverse = np.unique(contexts[-1], return_index=True, return_inverse=True)
    every = np.stack([c[first] for c in contexts], axis=1)
    if len(names) <= 1 << 20:
        pair, count = np.unique((inverse.astype(np.uint64) << _U(44)) | (token >> _PART), return_counts=True)
        owner, word = (pair >> _U(44)).astype(np.int64), pair & _U((1 << 44) - 1)
    else:  # the contexts' numbers do not fit beside the words
        owner, word, count, _ = _merge(inverse, token >> _PART, np.ones(len(token), np.int64))
    bucket = layout.bucket(every[owner, 0], word)
    order = np.argsort(bucket, kind="stable")
    bucket, owner, word, count = bucket[order], owner[order], word[order], count[order]
    starts = np.flatnonzero(np.diff(bucket, prepend=-1) | np.diff(owner, prepend=-1))
    heads, sizes = every[owner[starts]], np.diff(np.append(starts, len(owner)))
    found, at = np.unique(bucket[starts], return_index=True)
    at = np.append(at, len(starts))
    edges = np.append(starts, len(owner))
    columns: list[list] = [[], [], [], [], []]
    for b, x, y in zip(found.tolist(), at[:-1], at[1:], strict=True):
        low, high = edges[x], edges[y]
        for column, value in zip(
            columns,
            (b, heads[x:y].astype("<u8").tobytes(), sizes[x:y].astype("<u4").tobytes(), _six(word[low:high]), count[low:high].astype("<u4").tobytes()),
            strict=True,
        ):
            column.append(value)
    return pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int64()), *[pa.array(c, pa.binary()) for c in columns[1:]]], names=_PACKED)


def _small(array: np.ndarray) -> np.ndarray:
    """Numbers that are not negative, in the narrowest kind that holds them; its width is told by the file's size."""
    most = int(array.max(initial=0))
    return array.astype(next(k for k in ("<u1", "<u2", "<u4", "<u8") if most < 1 << (8 * int(k[2]))))


def _save(path: str, *arrays: np.ndarray) -> None:
    """A file of the arrays' sizes in bytes, and the arrays, each at a multiple of eight bytes."""
    aside = f"{path}.{os.getpid()}.{os.urandom(4).hex()}"
    with open(aside, "wb") as f:
        f.write(np.array([a.nbytes for a in arrays], "<i8").tobytes())
        for a in arrays:
            f.write(a.tobytes() + bytes(-a.nbytes % 8))
    os.replace(aside, path)


def _mapped(path: str, n: int) -> list[np.ndarray]:
    """The bytes of the *n* arrays of a file, mapped into memory; none of them, if there is no file."""
    try:
        with open(path, "rb") as f:
            data = np.frombuffer(mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ, trackfd=False), np.uint8)
    except FileNotFoundError:
        return [np.zeros(0, np.uint8)] * n
    sizes = data[: 8 * n].view("<i8")
    ends = 8 * n + np.cumsum(sizes + -sizes % 8)
    return [data[end - size + -(-size % 8) : end - (-size % 8)] for size, end in zip(sizes.tolist(), ends.tolist(), strict=True)]


def _summed(key: np.ndarray, *counts: np.ndarray) -> tuple[np.ndarray, ...]:
    """Distinct keys in order, with their counts summed."""
    names, inverse = np.unique(key, return_inverse=True)
    return names, *(np.bincount(inverse, c, len(names)).astype(np.int64) for c in counts)


def _by_bucket(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, Iterator[tuple]]]:
    """Groups of consecutive rows with one bucket; a group must be used up before the next."""
    from itertools import groupby

    rows = (row for batch in batches for row in zip(*(c.to_pylist() for c in batch.columns), strict=True))
    return groupby(rows, lambda r: r[0])


def _of_counts(c: np.ndarray) -> list[int]:
    return [int((c == k).sum()) for k in (1, 2, 3, 4)]


@dataclass(frozen=True)
class Discounts:
    """What is taken from counts of 1, 2 and more."""

    one: float
    two: float
    more: float

    @classmethod
    def of(cls, n: list[int]) -> Discounts:
        n1, n2, n3, n4 = n
        if not (n1 and n2 and n3):
            return cls(0.5, 0.5, 0.5)
        y = n1 / (n1 + 2 * n2)
        return cls(*(min(max(d, 0.0), k) for k, d in ((1, 1 - 2 * y * n2 / n1), (2, 2 - 3 * y * n3 / n2), (3, 3 - 4 * y * n4 / n3))))

    def array(self) -> np.ndarray:
        return np.array([0.0, self.one, self.two, self.more])


@dataclass(frozen=True)
class Model:
    """Where the arrays are, and the corpus's sums."""

    folder: str
    order: int
    layout: Layout
    train_tokens: int
    vocabulary: int
    #: By order: of words, pairs, ...
    discounts: tuple[Discounts, ...]
    pair_types: int
    word_counts: tuple[int, int, int]


def _layout(rows: DataFrame, chars: int) -> Layout:
    """Buckets by the corpus's size, and the words that overflow them by a sample of one text in ``SAMPLE``."""
    buckets = max(1, math.ceil(chars / BUCKET_CHARS))
    if buckets < 8:
        return Layout(buckets)

    def heads(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            offsets, data = textnp.utf8(batch.column(0))
            for a, b in textnp.slices(offsets):
                (before,), _, _ = tokens(offsets[a : b + 1] - offsets[a], data[offsets[a] : offsets[b]])
                word, n = np.unique(before, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(word.view(np.int64)), pa.array(n)], names=["word", "n"])

    chosen = rows.where(F.pmod(F.xxhash64("text"), F.lit(SAMPLE)) == 0)
    counted = chosen.mapInArrow(heads, "word long, n long").groupBy("word").agg(F.sum("n").alias("n"))
    total = counted.agg(F.sum("n")).head()[0] or 0
    # No more than twice as many words as buckets can hold half a bucket each.
    found = counted.where(F.col("n") * (2 * buckets) > total).collect()
    hot, at = [], buckets
    for word, n in sorted((r.word % (1 << 64), r.n) for r in found):
        parts = 2 * math.ceil(n * buckets / total)
        hot.append((word, at, parts))
        at += parts
    return Layout(buckets, tuple(hot))


def train(docs: DataFrame, chosen: Column, order: int = 2) -> Model:
    """Count the rows of *docs* that *chosen* holds for; *order* is the length of the longest n-grams, two at least."""
    if order < 2:
        raise ValueError("the order is two at least")
    spark = docs.sparkSession
    rows = docs.where(chosen).select(text_of(docs).alias("text"))
    size = rows.agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("text")).alias("chars")).head()
    layout = _layout(rows, size.chars or 0)
    buckets = layout.buckets
    folder = local_path(new_path(spark, "ngrams"))
    os.makedirs(folder, exist_ok=True)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0

        def out() -> pa.RecordBatch:
            contexts, token = zip(*held, strict=True)
            return _packed([np.concatenate(x) for x in zip(*contexts, strict=True)], np.concatenate(token), layout)

        for batch in batches:
            offsets, data = textnp.utf8(batch.column(0))
            for a, b in textnp.slices(offsets):
                contexts, token, _ = tokens(offsets[a : b + 1] - offsets[a], data[offsets[a] : offsets[b]], order)
                held.append((contexts, token))
                n += len(token)
                if n >= CHUNK_TOKENS:
                    yield out()
                    held, n = [], 0
        if held:
            yield out()

    def level(bucket: int, k: int, v: np.ndarray, w: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Save a bucket's n-grams of order *k*, sorted by context; ``(contexts, totals)``."""
        names, first = np.unique(v, return_index=True)
        sums = np.stack([np.add.reduceat(x, first) for x in (c, c == 1, c == 2, c >= 3)], axis=1)
        key = gram(v, w)
        rank = np.argsort(key)
        _save(f"{folder}/{bucket}.{k}", names.astype("<u8"), _small(sums), key[rank].astype("<u8"), _small(c[rank]))
        return names, sums[:, 0]

    def told(rows: list[tuple]) -> pa.RecordBatch:
        """What n-grams of one or more buckets tell the words' buckets, a row for each of these."""
        word, follows, before, raw, sizes = zip(*rows, strict=True)
        word, follows = _summed(np.concatenate(word), np.concatenate(follows))
        before, raw = _summed(np.concatenate(before), np.concatenate(raw))
        words_at, before_at = bucket_of(word << _PART, buckets), bucket_of(before, buckets)
        found = np.unique(np.concatenate([words_at, before_at]))
        cut = lambda at, x: [x[i:j].tobytes() for i, j in zip(np.searchsorted(at, found), np.searchsorted(at, found, "right"), strict=True)]
        return pa.RecordBatch.from_arrays(
            [
                pa.array(found, pa.int64()),
                pa.array([_six(np.frombuffer(x, np.uint64)) for x in cut(words_at, word)], pa.binary()),
                pa.array(cut(words_at, follows.astype("<i8")), pa.binary()),
                pa.array(cut(before_at, before.astype("<u8")), pa.binary()),
                pa.array(cut(before_at, raw.astype("<i8")), pa.binary()),
                pa.array([np.sum(sizes, axis=0).tolist()] + [None] * (len(found) - 1), pa.list_(pa.int64())),
            ],
            names=["bucket", "words", "follows", "names", "totals", "sizes"],
        )

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        width = order - 1
        # A row for each pair of buckets would be rows by the square of the corpus: a task's buckets speak together.
        tell, telling = [], 0
        for bucket, group in _by_bucket(batches):
            v, w, c = np.zeros(0, np.uint64), np.zeros(0, np.uint64), np.zeros(0, np.int64)
            lower = np.zeros((0, width), np.uint64)
            new, held = [], 0

            def fold(v, w, c, lower, new):  # noqa: ANN001, ANN202
                top = [np.repeat(x[0][:, -1], x[1]) for x in new]
                v, w, c, _ = _merge(np.concatenate([v, *top]), np.concatenate([w, *(x[2] for x in new)]), np.concatenate([c, *(x[3] for x in new)]))
                every = np.concatenate([lower, *(x[0] for x in new)])
                return v, w, c, every[np.unique(every[:, -1], return_index=True)[1]]

            for _, names, sizes, words, counts in group:
                sizes = np.frombuffer(sizes, "<u4").astype(np.int64)
                new.append((np.frombuffer(names, "<u8").reshape(-1, width), sizes, _from_six(words), np.frombuffer(counts, "<u4").astype(np.int64)))
                held += int(sizes.sum())
                if held > max(1 << 20, len(v)):
                    v, w, c, lower = fold(v, w, c, lower, new)
                    new, held = [], 0
            if new:
                v, w, c, lower = fold(v, w, c, lower, new)
            # The raw counts of the words before the last, for the words' own buckets.
            number = np.searchsorted(lower[:, -1], v)
            before, inverse = np.unique(lower[number, 0], return_inverse=True)
            raw = np.bincount(inverse, c, len(before)).astype(np.int64)
            tokens_here, of_counts, types = int(c.sum()), [], 0
            for k in range(order, 1, -1):
                level(bucket, k, v, w, c)
                of_counts = _of_counts(c) + of_counts
                types = len(v)
                if k > 2:
                    # The next order's counts are the different words to the left.
                    rows_of = lower[np.searchsorted(lower[:, k - 2], v)]
                    v, w, c, at = _merge(rows_of[:, k - 3], w, np.ones(len(v), np.int64))
                    every = rows_of[at]
                    lower = every[np.unique(every[:, k - 3], return_index=True)[1]]
            word, follows = np.unique(w, return_counts=True)
            known = before != BEGIN
            before, raw = before[known], raw[known]
            tell.append((word, follows, before, raw, [tokens_here, types, *of_counts]))
            telling += len(word) + len(before)
            if telling >= TOLD:
                yield told(tell)
                tell, telling = [], 0
        if tell:
            yield told(tell)

    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)
    packed = spread(rows).mapInArrow(count, "bucket bigint, contexts binary, sizes binary, words binary, counts binary")
    merged = packed.repartition(tasks, "bucket").sortWithinPartitions("bucket").mapInArrow(
        merge, "bucket bigint, words binary, follows binary, names binary, totals binary, sizes array<bigint>"
    )
    merged = written(merged, "ngram-words")
    n_train = int(size.n)

    def words_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        none = np.zeros(0, np.int64)
        for bucket, group in _by_bucket(batches):
            word, count, names, total = none.astype(np.uint64), none, none.astype(np.uint64), none
            new, held = [], 0

            def fold(word, count, names, total, new):  # noqa: ANN001, ANN202
                six, follows, full, raw = zip(*new, strict=True)
                return (
                    *_summed(np.concatenate([word, *map(_from_six, six)]), np.concatenate([count, *(np.frombuffer(x, "<i8") for x in follows)])),
                    *_summed(np.concatenate([names, *(np.frombuffer(x, "<u8") for x in full)]), np.concatenate([total, *(np.frombuffer(x, "<i8") for x in raw)])),
                )

            for _, *row in group:
                new.append(row)
                held += len(row[1]) // 8 + len(row[2]) // 8
                if held > max(1 << 18, len(word) + len(names)):
                    word, count, names, total = fold(word, count, names, total, new)
                    new, held = [], 0
            if new:
                word, count, names, total = fold(word, count, names, total, new)
            # A word is followed as often as it occurs; only ends are not.
            if int(bucket_of(np.array([END]), buckets)[0]) == bucket:
                at = int(np.searchsorted(names, END))
                names, total = np.insert(names, at, END), np.insert(total, at, n_train)
            place = np.minimum(np.searchsorted(word, names >> _PART), max(len(word) - 1, 0))
            contexts = np.where(word[place] == names >> _PART, count[place], 0) if len(word) else np.zeros(len(names), np.int64)
            _save(f"{folder}/{bucket}.words", names.astype("<u8"), np.stack([total, contexts], axis=1).astype("<i8"))
            yield pa.RecordBatch.from_arrays(
                [pa.array([[len(names), *_of_counts(contexts), int((contexts > 2).sum())]], pa.list_(pa.int64()))], names=["sizes"]
            )

    known_words = merged.select("bucket", "words", "follows", "names", "totals").repartition(tasks, "bucket").sortWithinPartitions("bucket").mapInArrow(
        words_of, "sizes array<bigint>"
    )

    def summed(df: DataFrame, n: int) -> list[int]:
        row = df.where("sizes IS NOT NULL").agg(*[F.sum(F.col("sizes")[i]).alias(f"s{i}") for i in range(n)]).head()
        return [int(x or 0) for x in row]

    known, *of_words = summed(known_words, 6)
    total, types, *of_grams = summed(merged, 2 + 4 * (order - 1))
    dropped(merged)
    return Model(
        folder,
        order,
        layout,
        total,
        known,
        (Discounts.of(of_words[:4]), *(Discounts.of(of_grams[i : i + 4]) for i in range(0, len(of_grams), 4))),
        types,
        (of_words[0], of_words[1], of_words[4]),
    )


class Reader:
    """A model's arrays, mapped into memory as they are needed."""

    def __init__(self, model: Model):
        self.model, self.open = model, {}
        self.discounts = [d.array() for d in model.discounts]
        one, two, more = model.word_counts
        d = model.discounts[0]
        self.left = (d.one * one + d.two * two + d.more * more) / model.pair_types if model.pair_types else 1.0
        self.floor = self.left / (model.vocabulary + 1)

    def _file(self, name: str, n: int) -> list[np.ndarray]:
        found = self.open.pop(name, None)
        if found is None:
            if len(self.open) >= OPEN:
                del self.open[next(iter(self.open))]
            found = _mapped(f"{self.model.folder}/{name}", n)
        self.open[name] = found  # the last in order is the last used
        return found

    def words(self, bucket: int) -> tuple[np.ndarray, np.ndarray]:
        """A bucket's words, and how often each occurs and after how many others."""
        names, occur = self._file(f"{bucket}.words", 2)
        return names.view("<u8"), occur.view("<i8").reshape(-1, 2)

    def level(self, bucket: int, k: int, at: int) -> tuple[np.ndarray, np.ndarray]:
        """Of a bucket's n-grams of order *k*, its contexts with their sums (*at* is 0), or the n-grams with their counts (2)."""
        keys, values = self._file(f"{bucket}.{k}", 4)[at : at + 2]
        keys = keys.view("<u8")
        if not len(keys):
            return keys, values
        width = 1 if at else 4
        values = values.view(f"<u{len(values) // (len(keys) * width)}")
        return keys, values if at else values.reshape(-1, 4)

    @staticmethod
    def _runs(bucket: np.ndarray) -> list[tuple[int, np.ndarray]]:
        """``(bucket, places)`` of the rows of each bucket.  A bucket's arrays fit in a cache, so rows need no order."""
        order = np.argsort(bucket.astype(np.uint16) if bucket.max(initial=0) < 1 << 16 else bucket, kind="stable")
        ranked = bucket[order]
        at = np.append(np.flatnonzero(np.diff(ranked, prepend=-1)), len(ranked))
        return [(int(ranked[x]), order[x:y]) for x, y in zip(at[:-1], at[1:], strict=True)]

    @staticmethod
    def _find(table: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if not len(table):
            return np.zeros(len(keys), np.int64), np.zeros(len(keys), bool)
        at = np.minimum(np.searchsorted(table, keys), len(table) - 1)
        return at, table[at] == keys

    def _sums(self, k: int, bucket: int, context: np.ndarray, places: np.ndarray, into: np.ndarray) -> None:
        """Add what a bucket holds of the contexts at *places* to those rows of *into*."""
        names, sums = self.level(bucket, k, 0)
        at, there = self._find(names, context[places])
        if there.any():
            into[places[there]] += sums[at[there]].astype(np.int64)

    def look_up(self, contexts: list[np.ndarray], token: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """``(count, probability)`` of each token after its contexts."""
        m, layout = self.model, self.model.layout
        count, p = np.zeros(len(token), np.int64), np.full(len(token), self.floor)
        for b, own in self._runs(bucket_of(token, layout.buckets)):
            names, occur = self.words(b)
            at, there = self._find(names, token[own])
            at, places = at[there], own[there]
            if len(at):
                occur = occur[at].astype(np.int64)
                count[places] = occur[:, 0]
                p[places] += (occur[:, 1] - self.discounts[0][np.minimum(occur[:, 1], 3)]) / m.pair_types
        word = token >> _PART
        hot, number = layout.of_hot(contexts[0])
        runs = self._runs(layout.bucket(contexts[0], word))
        at_hot = np.flatnonzero(hot)
        spread = [(i, at_hot[x]) for i, x in self._runs(number[at_hot])]
        for k in range(2, m.order + 1):
            context, d = contexts[k - 2], self.discounts[k - 1]
            sums = np.zeros((len(token), 4), np.int64)
            for b, own in runs:
                if b < layout.buckets:
                    self._sums(k, b, context, own, sums)
            # A hot word's contexts are in several buckets, each with a part of the sums; each is looked up once.
            for i, own in spread:
                _, first, parts = layout.hot[i]
                names, inverse = np.unique(context[own], return_inverse=True)
                total, every = np.zeros((len(names), 4), np.int64), np.arange(len(names))
                for b in range(first, first + parts):
                    self._sums(k, b, names, every, total)
                sums[own] = total[inverse]
            known = sums[:, 0] > 0
            s = sums[known]
            p[known] *= (d[1] * s[:, 1] + d[2] * s[:, 2] + d[3] * s[:, 3]) / s[:, 0]
            key = gram(context, word)
            for b, own in runs:
                grams, counts = self.level(b, k, 2)
                at, there = self._find(grams, key[own])
                if there.any():
                    places = own[there]
                    c = counts[at[there]].astype(np.int64)
                    p[places] += (c - d[np.minimum(c, 3)]) / sums[places, 0]
        return count, p


_READERS: dict[Model, Reader] = {}


def reader(model: Model) -> Reader:
    if model not in _READERS:
        _READERS.clear()
        _READERS[model] = Reader(model)
    return _READERS[model]


def scores(docs: DataFrame, model: Model, *keep: str) -> DataFrame:
    """The columns *keep* with ``n_tokens, n_known, train_tokens, base_score, score, perplexity`` of each text.

    Scores are in log10; the perplexity is 10 ** (-score / n_tokens), and texts have one token, their end, at least.
    """
    out = T.StructType([docs.schema[c] for c in keep])
    for name, kind in (("n_tokens", T.LongType()), ("n_known", T.LongType()), ("train_tokens", T.LongType()), ("base_score", T.DoubleType()), ("score", T.DoubleType()), ("perplexity", T.DoubleType())):
        out = out.add(name, kind, False)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = reader(model)
        for batch in batches:
            offsets, data = textnp.utf8(batch.column(len(keep)))
            for a, b in textnp.slices(offsets, SCORE_BYTES, 1 << 16):
                contexts, token, firsts = tokens(offsets[a : b + 1] - offsets[a], data[offsets[a] : offsets[b]], model.order)
                count, p = own.look_up(contexts, token)
                base = np.log10((count + 1) / (model.train_tokens + model.vocabulary + 1))
                n = b - a
                columns = [batch.column(i).slice(a, n) for i in range(len(keep))]
                at = firsts[:-1]
                score, size = np.add.reduceat(np.log10(p), at), np.diff(firsts)
                yield pa.RecordBatch.from_arrays(
                    [
                        *columns,
                        pa.array(size, pa.int64()),
                        pa.array(np.add.reduceat((count > 0).astype(np.int64), at), pa.int64()),
                        pa.array(np.full(n, model.train_tokens), pa.int64()),
                        pa.array(np.add.reduceat(base, at), pa.float64()),
                        pa.array(score, pa.float64()),
                        pa.array(10 ** (-score / size), pa.float64()),
                    ],
                    names=out.names,
                )

    return spread(docs.select(*keep, text_of(docs).cast("string").alias("__text"))).mapInArrow(run, out)
