"""Document fingerprints by one-permutation MinHash.

A text's five-word shingles are hashed once.  The low bits of each hash choose one of ``BINS`` bins, which keeps the
smallest of the hashes' high bits.  Empty bins are filled by optimal densification: each tries bins chosen by a
fixed universal hash of its number and the attempt until it meets a bin that was filled, and copies that.  Of each
bin the lowest ``BITS`` bits are stored, packed, as lower-case hexadecimal digits.

Two fingerprints' likeness estimates the Jaccard similarity of the shingle sets: equal bins make up a share e, of
which c = 2**-BITS would agree by chance, so the estimate is (e - c) / (1 - c), held to 0..1.

A text of one to four words has one shingle, all its words.  A text without words (null, empty, white space) has the
empty fingerprint of all zero bits and is like the other empty ones only: their likeness is 1, with others 0.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm import textnp
from tessera.llm.common import SORTED_BYTES, parts_of, spread, written

BINS, BITS, WORDS = 256, 4, 5
_NONE = np.uint64(0xFFFFFFFFFFFFFFFF)


def _probes(attempts: int) -> np.ndarray:
    """``[attempt, bin]``: the bin that an empty bin looks at."""
    key = np.arange(1, attempts * BINS + 1, dtype=np.uint64).reshape(attempts, BINS)
    return ((textnp.mix(key * np.uint64(0xD6E8FEB86659FD93)) >> np.uint64(40)) % np.uint64(BINS)).astype(np.int16)


#: So many that an empty bin of a text with two filled ones misses them all with a chance of one in ten million.
_PROBES = _probes(2048)


def sketch(offsets: np.ndarray, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``(bins, blank)``: the stored bits of each text's bins as ``uint8[texts, BINS]``; which texts have no words."""
    n = len(offsets) - 1
    words, firsts = textnp.hash_words(offsets, data)
    hashes, firsts = textnp.shingles(words, firsts, WORDS)
    low = np.full(n * BINS, _NONE)
    row = np.repeat(np.arange(n), np.diff(firsts))
    np.minimum.at(low, row * BINS + (hashes % np.uint64(BINS)).astype(np.int64), hashes >> np.uint64(8))
    low = low.reshape(n, BINS)
    blank = np.diff(firsts) == 0
    filled = low != _NONE
    out = low.copy()
    rows, bins = np.nonzero(~filled & ~blank[:, None])
    attempt = 0
    while len(rows):
        if attempt < len(_PROBES):
            at = _PROBES[attempt][bins]
        else:  # beyond the table, step through the bins in order, which ends
            at = (bins + attempt) % BINS
        good = filled[rows, at]
        out[rows[good], bins[good]] = low[rows[good], at[good]]
        rows, bins = rows[~good], bins[~good]
        attempt += 1
    # The stored bits are remixed: a small minimum's low bits are as good as random, its copies' stay equal.
    bits = (textnp.mix(out) & np.uint64((1 << BITS) - 1)).astype(np.uint8)
    bits[blank] = 0
    return bits, blank


def pack(bits: np.ndarray) -> list[str]:
    """Hexadecimal digits, one for each bin."""
    two = (bits[:, 0::2] << 4) | bits[:, 1::2]
    return [x.tobytes().hex() for x in two]


def likeness(a: np.ndarray, b: np.ndarray, blank_a: np.ndarray, blank_b: np.ndarray) -> np.ndarray:
    """Row-wise estimates of similarity."""
    chance = 2.0**-BITS
    equal = (a == b).mean(axis=1)
    out = np.clip((equal - chance) / (1 - chance), 0.0, 1.0)
    return np.where(blank_a | blank_b, (blank_a & blank_b).astype(float), out)


def fingerprints(docs: DataFrame, *keep: str, text: str = "text") -> DataFrame:
    """The columns *keep* of *docs* and ``fingerprint``."""
    out = T.StructType([docs.schema[c] for c in keep]).add("fingerprint", T.StringType(), False)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            offsets, data = textnp.utf8(batch.column(len(keep)))
            for a, b in textnp.slices(offsets):
                bits, _ = sketch(offsets[a : b + 1] - offsets[a], data[offsets[a] : offsets[b]])
                columns = [batch.column(i).slice(a, b - a) for i in range(len(keep))]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(pack(bits), pa.string())], names=out.names)

    return spread(docs.select(*keep, F.col(text).cast("string").alias("__text"))).mapInArrow(run, out)


_ROW = (
    "doc_id bigint, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string,"
    " near_edited double, near_next double"
)
#: One row a task for the texts at its ends; the others have no part.
_EDGE = ", part int, first_text string, last_text string"


def _edited(text: str, follower: str) -> str:
    n = len(text) // 4
    return text[: len(text) - n] + follower[:n]


def _texts(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    return sketch(*textnp.utf8(pa.array(texts, pa.large_string())))


def _compared(ids: list, texts: list[str]) -> dict[str, list]:
    """The result columns of all texts but the last, each with the one after it."""
    changed = [_edited(a, b) for a, b in zip(texts, texts[1:], strict=False)]
    own, blank = _texts(texts)
    other, other_blank = _texts(changed)
    printed = pack(own[:-1])
    return {
        "doc_id": ids[:-1],
        "n_chars": [len(x) for x in texts[:-1]],
        "edited_sha256": [hashlib.sha256(x.encode()).hexdigest() for x in changed],
        "fingerprint": printed,
        "edited_fingerprint": pack(other),
        "near_edited": likeness(own[:-1], other, blank[:-1], other_blank).tolist(),
        "near_next": likeness(own[:-1], own[1:], blank[:-1], blank[1:]).tolist(),
    }


def against_edited(docs: DataFrame) -> DataFrame:
    """Each document's fingerprint beside that of its edited text and of the next document, in ascending id order.

    The edited text has its last quarter of code points replaced by the first as many of the next document; the
    last document's next is the first.  Texts are sorted by ranges of ids, so one task holds neighbours; the texts at
    a task's ends are compared afterwards, one row for each task.  Rows with equal ids are ordered by their text's
    hash; null ids come first.
    """
    spark = docs.sparkSession
    rows = docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    rows = rows.withColumn("tie", F.xxhash64("text"))
    ordered = rows.repartitionByRange(parts_of(docs, SORTED_BYTES), "doc_id", "tie").sortWithinPartitions("doc_id", "tie").select("doc_id", "text")
    names = [x.split()[0] for x in (_ROW + _EDGE).split(", ")]
    schema = T._parse_datatype_string(_ROW + _EDGE)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext
        from pyspark.sql.pandas.types import to_arrow_schema

        arrow = to_arrow_schema(schema)
        first, held = None, None

        def out(columns: dict[str, list]) -> pa.RecordBatch:
            n = len(columns["doc_id"])
            return pa.RecordBatch.from_arrays(
                [pa.array(columns.get(x, [None] * n), arrow.field(x).type) for x in names], schema=arrow
            )

        for batch in batches:
            all_ids, all_texts = batch.column(0).to_pylist(), batch.column(1)
            offsets, _ = textnp.utf8(all_texts)
            for a, b in textnp.slices(offsets):
                ids, texts = all_ids[a:b], all_texts.slice(a, b - a).to_pylist()
                if first is None:
                    first = (ids[0], texts[0])
                if held:
                    ids, texts = [held[0], *ids], [held[1], *texts]
                held = (ids[-1], texts[-1])
                if len(texts) > 1:
                    yield out(_compared(ids, texts))
        if held:
            yield out({"doc_id": [held[0]], "part": [TaskContext.get().partitionId()], "first_text": [first[1]], "last_text": [held[1]]})

    made = written(ordered.mapInArrow(run, schema), "fingerprints")
    inner = made.where("part IS NULL").drop("part", "first_text", "last_text")
    # One row a task: each task's last text needs only its follower's first quarter-length of the text.
    ends = made.where("part IS NOT NULL").select("part", "doc_id", "first_text", "last_text")
    parts = sorted(x.part for x in ends.select("part").collect())
    if not parts:
        return inner
    after = spark.createDataFrame(list(zip(parts, parts[1:] + parts[:1], strict=True)), "part int, next_part int")
    heads = ends.select(F.col("part").alias("next_part"), F.col("first_text").alias("next_text"))
    pairs = ends.join(after, "part").join(heads, "next_part").select("doc_id", "last_text", "next_text")

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, a, b in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                columns = _compared([i, None], [a, b])
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(v, pa.int64() if k in ("doc_id", "n_chars") else pa.float64() if k[:4] == "near" else pa.string())
                        for k, v in columns.items()
                    ],
                    names=list(columns),
                )

    return inner.unionByName(pairs.mapInArrow(finish, _ROW))
