"""SentencePiece encoding and decoding by a table of distinct marked words.

SentencePiece marks each space as U+2581.  In the models this is for, no piece holds the mark after another
character and none holds a line feed (both are checked when a model is loaded), and the normalizer changes nothing
but the marks.  So merges cannot cross the start of a run of marks or a line feed, and a text's ids are its marked
words' ids joined in order.  A model that fails the check is used on whole texts instead, with equal results.

Null and empty texts have no pieces: their ids are the end id alone, and they decode to the empty text.  Other
columns, ids and repeated rows are left as they are.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from tessera.llm import textnp
from tessera.llm.chunks import ChunkTable
from tessera.llm.common import spread

MARK = "▁"
_GENERAL = re.compile(f"{MARK}+[^{MARK}\n]*|\n[^{MARK}\n]*|[^{MARK}\n]+")
_MARK_BYTES = MARK.encode()
#: Bytes of text segmented at a time.
SLICE_BYTES = 4 << 20


class Codec:
    """A SentencePiece model with its chunk table.  A table value is (ids as int32 bytes, decoded text in UTF-8)."""

    def __init__(self, model: str):
        self.sp = sp = sentencepiece.SentencePieceProcessor(model_file=model)
        pieces = [sp.id_to_piece(i) for i in range(sp.get_piece_size())]
        sample = " \ufb01\xb2  x\t\uff21 e\u0301"
        self.chunked = (
            not any(re.search(f"[^{MARK}]{MARK}|\n", p) for p in pieces)
            and sp.decode(sp.encode(sample)) == sample
            and sp.id_to_piece(sp.encode("a")[0])[0] == MARK
        )
        self.eos = sp.eos_id()
        self.probe = sp.encode("a")
        # Ids that do not stand for their piece's text.
        self.special = np.array([sp.is_unknown(i) or sp.is_control(i) or sp.is_byte(i) or sp.is_unused(i) for i in range(sp.get_piece_size())])
        self.table = ChunkTable(self._segment, 2)

    def _segment(self, keys: list[bytes]) -> list[list[bytes]]:
        """The ids and the decoded texts of keys of the table: chunks as they stand in texts, the first of a text without its mark."""
        chunks = [k.decode().replace(" ", MARK) for k in keys]
        # A library call puts one mark before its text, as it does before a text's first chunk.
        ids = self.sp.encode([c[1:] if c[0] == MARK else c for c in chunks], num_threads=1)
        for i, c in enumerate(chunks):
            if c[0] == "\n":
                ids[i] = ids[i][1:]
            elif c == MARK:
                ids[i] = [self.sp.piece_to_id(MARK)]
        # Pieces make up their chunk, which is what they decode to; the library is asked about other ids alone.
        said = [c.replace(MARK, " ").encode() for c in chunks]
        sizes = np.array([len(x) for x in ids])
        odd = np.add.reduceat(self.special[np.fromiter(chain.from_iterable(ids), np.int64, sizes.sum())], np.cumsum(sizes) - sizes)
        unlike = [i for i in np.flatnonzero(odd).tolist() if sizes[i]]
        for i, text in zip(unlike, self.sp.decode([self.probe + ids[i] for i in unlike], num_threads=1), strict=True):
            said[i] = text[1 + (chunks[i][0] not in (MARK, "\n")) :].encode()
        return [[array("i", x).tobytes() for x in ids], said]

    def _whole(self, text: str) -> tuple[bytes, bytes]:
        """The ids, without the end, and the decoded text of a text that is not cut in bulk."""
        if not self.chunked:
            ids = self.sp.encode(text, num_threads=1)
            return array("i", ids).tobytes(), self.sp.decode(ids).encode()
        first, *rest = _GENERAL.findall(MARK + text.replace(" ", MARK))
        # The table knows a text's first chunk without its mark; where that leaves nothing or a mark, its text is cut.
        own = first[1:] if first[1:] and first[1] != MARK else first
        distinct = list(dict.fromkeys([own, *rest]))
        ids, said = (c.to_pylist() for c in self.table.values(pa.array([c.encode() for c in distinct], pa.large_binary())))
        known = dict(zip(distinct, zip(ids, said, strict=True), strict=True))
        head = known[own][1] if own != first else known[own][1][1:]
        values = [known[c] for c in rest]
        return known[own][0] + b"".join(v[0] for v in values), head + b"".join(v[1] for v in values)

    def encode_column(self, texts: pa.Array) -> tuple[pa.ListArray, pa.StringArray]:
        """Of each text, its ids with the end id, and what they decode to."""
        offsets, data = textnp.utf8(texts)
        n = len(offsets) - 1
        starts, odd = chunk_starts(offsets, data) if self.chunked else (offsets[:-1][np.diff(offsets) > 0], np.diff(offsets) > 0)
        edges = np.append(starts, len(data)).astype(np.int64)
        cut = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(edges), pa.py_buffer(data)])
        coded = cut.dictionary_encode()
        keys, index = coded.dictionary, coded.indices.to_numpy().astype(np.int64)
        firsts = np.searchsorted(starts, offsets)
        # Texts taken whole have entries of their own: their bytes may equal a chunk's.
        alone = firsts[:-1][odd]
        plain = np.ones(len(index), bool)
        plain[alone] = False
        used = np.unique(index[plain])
        wholes = [self._whole(keys[i].as_py().decode()) for i in index[alone].tolist()]
        ids, said = self.table.values(keys.take(pa.array(used)))
        place = np.zeros(len(keys), np.int64)
        place[used] = np.arange(len(used))
        index = place[index]
        index[alone] = len(used) + np.arange(len(alone))
        ids, said = (
            pa.concat_arrays([c, pa.array([*(w[i] for w in wholes), last], pa.large_binary())])
            for i, (c, last) in enumerate(((ids, array("i", [self.eos]).tobytes()), (said, b"")))
        )
        # The values of all chunks, and the end after each text's, one after another.
        chosen = pa.array(np.insert(index, firsts[1:], len(ids) - 1))
        ends = firsts[1:] + np.arange(1, n + 1)
        edges_of = lambda taken: np.insert(np.frombuffer(taken.buffers()[1], np.int64)[ends], 0, 0)
        flat, text = ids.take(chosen), said.take(chosen)
        lists = pa.ListArray.from_arrays(
            pa.array((edges_of(flat) // 4).astype(np.int32)), pa.array(np.frombuffer(flat.buffers()[2], np.int32)[: edges_of(flat)[-1] // 4])
        )
        decoded = pa.StringArray.from_buffers(n, pa.py_buffer(edges_of(text).astype(np.int32)), text.buffers()[2] or pa.py_buffer(b""))
        return lists, decoded


def chunk_starts(offsets: np.ndarray, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``(starts, odd)``: where the chunks of all texts begin in *data*, and which texts are one chunk as a whole.

    A chunk begins at a text's start, at each run of spaces and at each line feed.  Texts that begin with a space or a
    line feed, and those that hold the mark itself, are not cut.
    """
    space, full = data == 32, np.diff(offsets) > 0
    begins = space.copy()
    begins[1:] &= ~space[:-1]
    begins |= data == 10
    heads = offsets[:-1][full]
    odd = np.zeros(len(full), bool)
    odd[full] = space[heads] | (data[heads] == 10)
    sign = np.flatnonzero(data == _MARK_BYTES[0])
    sign = sign[sign + 2 < len(data)]
    sign = sign[(data[sign + 1] == _MARK_BYTES[1]) & (data[sign + 2] == _MARK_BYTES[2])]
    odd[np.searchsorted(offsets, sign, "right") - 1] = True
    begins[heads] = True
    starts = np.flatnonzero(begins)
    if odd.any():
        head = np.zeros(len(data), bool)
        head[heads] = True
        starts = starts[~odd[np.searchsorted(offsets, starts, "right") - 1] | head[starts]]
    return starts, odd


_CODECS: dict[str, Codec] = {}


def codec(model: str) -> Codec:
    """This worker's codec for a model file."""
    if model not in _CODECS:
        _CODECS[model] = Codec(model)
    return _CODECS[model]


def encode(docs: DataFrame, model: str, *keep: str, text: str = "text", decode: bool = True) -> DataFrame:
    """The columns *keep* of *docs* with ``ids`` (with the end id) and, unless *decode* is false, ``decoded``."""
    out = T.StructType([docs.schema[c] for c in keep])
    out = out.add("ids", T.ArrayType(T.IntegerType(), False), False)
    if decode:
        out = out.add("decoded", T.StringType(), False)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(model)
        for batch in batches:
            texts = batch.column(len(keep))
            for a, b in textnp.slices(textnp.utf8(texts)[0], SLICE_BYTES):
                columns = [batch.column(i).slice(a, b - a) for i in range(len(keep))]
                ids, said = own.encode_column(texts.slice(a, b - a))
                yield pa.RecordBatch.from_arrays([*columns, ids, said][: len(out)], names=out.names)

    from pyspark.sql import functions as F

    own = [F.col(c) for c in keep] + [F.col(text).cast("string").alias("__text")]
    return spread(docs.select(*own)).mapInArrow(run, out)
