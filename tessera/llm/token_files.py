"""Token-id files coded by a static range asymmetric numeral system (rANS).

A file set is a Parquet table of independent *blocks*, a shared *frequency table* for all of them, and the blocks'
order (shard, block).  A block holds whole documents (at least one; as many as fit in ``BLOCK_TOKENS``), its ids
coded over ``LANES`` interleaved states of 64 bits, renormalised by 32-bit words.  Every ``CHECKPOINT`` steps the
states and the place in the words are stored, so decoders can start there; a checksum of the block and one of its
ids are verified on reading.  Frequencies sum to 2**20; each id that occurs has at least one.

Ids are counted in one pass over tokens kept as 16- or 32-bit integers in the shared folder, then coded in a second.
Documents are in ascending order of id (ties by the text's hash, null ids first) because ranges of ids are dealt to
shards in order.  Null texts are empty: they have the end id alone.  Any number of documents, none included, works.
"""

from __future__ import annotations

import json
import re
import struct
import zlib
from array import array
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm import textnp
from tessera.llm.chunks import ChunkTable
from tessera.llm.common import ROW_GROUP, SORTED_BYTES, dropped, new_path, parts_of, written

SCALE_BITS, LANES, CHECKPOINT, BLOCK_TOKENS = 20, 1024, 64, 1 << 17
#: Bytes of text cut at a time.
SLICE_BYTES = 6 << 20
MAGIC = b"TSR1"
_U = np.uint64
_LOW = _U(1 << 31)
_HEAD = struct.Struct("<4sIHHI")


class FrequencyTable:
    """Quantised frequencies of ids, with their ranges and the inverse of the ranges."""

    def __init__(self, counts: np.ndarray):
        counts = np.asarray(counts, np.int64)
        total, size = int(counts.sum()), 1 << SCALE_BITS
        freq = np.zeros(len(counts), np.int64)
        used = np.flatnonzero(counts)
        if len(used) > size:
            raise ValueError(f"more than {size} distinct ids")
        if total:
            freq[used] = np.maximum(1, counts[used].astype(np.float64) * size / total).astype(np.int64)
            order = used[np.lexsort((used, -freq[used]))]
            while (over := int(freq.sum()) - size) != 0:
                if over < 0:
                    freq[order[0]] -= over
                else:  # the most frequent give, none below one
                    give = np.minimum(freq[order] - 1, max(1, over // len(order) + 1))
                    give = np.where(np.cumsum(give) <= over, give, np.maximum(0, over - (np.cumsum(give) - give)))
                    freq[order] -= give
        self.freq = freq.astype(np.uint64)
        self.start = np.concatenate([[0], np.cumsum(freq)[:-1]]).astype(np.uint64)
        self._symbols: np.ndarray | None = None

    @property
    def symbols(self) -> np.ndarray:
        if self._symbols is None:
            self._symbols = np.repeat(np.arange(len(self.freq), dtype=np.uint32), self.freq.astype(np.int64))
        return self._symbols


def encode_block(ids: np.ndarray, table: FrequencyTable) -> bytes:
    """One block of ids."""
    n = len(ids)
    steps = -(-n // LANES)
    freq, start = table.freq[ids], table.start[ids]
    if n and not freq.all():
        raise ValueError("an id without frequency")
    bits = _U(SCALE_BITS)
    limit = freq << _U(63 - SCALE_BITS)
    x = np.full(LANES, _LOW, np.uint64)
    words: list[np.ndarray] = []
    saved: list[tuple[int, np.ndarray]] = []
    total = 0
    for t in range(steps - 1, -1, -1):
        a = t * LANES
        b = min(n, a + LANES)
        f, y = freq[a:b], x[: b - a]
        full = y >= limit[a:b]
        out = y[full]
        if len(out):
            words.append(out.astype(np.uint32))
            y[full] = out >> _U(32)
            total += len(out)
        q = y // f
        y[:] = (q << bits) + (y - q * f) + start[a:b]
        if t and t % CHECKPOINT == 0:
            saved.append((total, x.copy()))
    stream = np.concatenate(words[::-1]) if words else np.zeros(0, np.uint32)
    body = [x.astype("<u8").tobytes()]
    for after, states in reversed(saved):
        body.append(struct.pack("<I", total - after) + states.astype("<u8").tobytes())
    body.append(stream.astype("<u4").tobytes())
    packed = _HEAD.pack(MAGIC, n, LANES, len(saved), zlib.crc32(ids.astype("<u4").tobytes())) + b"".join(body)
    return packed + struct.pack("<I", zlib.crc32(packed))


def decode_block(block: bytes, table: FrequencyTable, part: int | None = None) -> np.ndarray:
    """The ids of a block, or of its *part*-th run between checkpoints alone."""
    if len(block) < _HEAD.size + 4 or struct.unpack("<I", block[-4:])[0] != zlib.crc32(block[:-4]):
        raise ValueError("a block's checksum differs")
    magic, n, lanes, n_saved, crc = _HEAD.unpack_from(block)
    if magic != MAGIC:
        raise ValueError("not a token block")
    at = _HEAD.size
    starts = [(0, np.frombuffer(block, "<u8", lanes, at))]
    at += 8 * lanes
    for _ in range(n_saved):
        starts.append((struct.unpack_from("<I", block, at)[0], np.frombuffer(block, "<u8", lanes, at + 4)))
        at += 4 + 8 * lanes
    stream = np.frombuffer(block, "<u4", (len(block) - 4 - at) // 4, at)
    first, last = (0, -(-n // lanes)) if part is None else (part * CHECKPOINT, min(-(-n // lanes), (part + 1) * CHECKPOINT))
    place, x = starts[0 if part is None else part]
    x = x.astype(np.uint64)
    symbols, freq, start = table.symbols, table.freq, table.start
    mask, bits = _U((1 << SCALE_BITS) - 1), _U(SCALE_BITS)
    out = np.empty(min(n, last * lanes) - first * lanes, np.uint32)
    for t in range(first, last):
        a = (t - first) * lanes
        b = min(len(out), a + lanes)
        y = x[: b - a]
        slot = y & mask
        s = symbols[slot.astype(np.int64)]
        out[a:b] = s
        y[:] = freq[s] * (y >> bits) + slot - start[s]
        low = np.flatnonzero(y < _LOW)
        if len(low):
            y[low] = (y[low] << _U(32)) | stream[place : place + len(low)]
            place += len(low)
    if part is None and zlib.crc32(out.astype("<u4").tobytes()) != crc:
        raise ValueError("the ids' checksum differs")
    return out


_SPACE, _FEED = 32, 10
_LETTER, _SIGN, _CONTROL, _LEAD = (np.zeros(256, bool) for _ in range(4))
_LETTER[[*range(65, 91), *range(97, 123)]] = True
_SIGN[[*range(33, 39), *range(40, 48), *range(58, 65), *range(91, 97), *range(123, 127)]] = True
_CONTROL[[9, 11, 12, 13, 28, 29, 30, 31]] = True
#: The UTF-8 of white space beyond ASCII begins with one of these.
_LEAD[[0xC2, 0xE1, 0xE2, 0xE3]] = True


#: Keys joined for one call of the library.
_CALL_KEYS = 4096
#: Chunks that the pre-tokenizer cuts in two at most: letters, of blocks that are settled in Unicode, then signs.
_WORD = re.compile("([ \n]?)([A-Za-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-\u024f]+)([!-&(-/:-@\\[-`{-~]*)")


def _byte_signs() -> dict[int, int]:
    """The byte-level alphabet: printable Latin-1 signs stand for themselves, other bytes for signs from U+0100 on."""
    own = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b]
    rest = [b for b in range(256) if b not in set(own)]
    return dict(zip(own + rest, own + [256 + i for i in range(len(rest))], strict=True))


_SIGNS = _byte_signs()
_SPACE_SIGN = chr(_SIGNS[32])


def _wide_spaces(data: np.ndarray) -> np.ndarray:
    """Where the UTF-8 of white space beyond ASCII begins."""
    at = np.flatnonzero(_LEAD[data])
    if not len(at):
        return at
    padded = np.append(data, np.zeros(2, np.uint8))
    code = (data[at].astype(np.int64) << 16) | (padded[at + 1].astype(np.int64) << 8) | padded[at + 2]
    two = code >> 8
    wide = (two == 0xC285) | (two == 0xC2A0) | (code == 0xE19A80) | (code == 0xE2819F) | (code == 0xE38080)
    wide |= ((code >= 0xE28080) & (code <= 0xE2808A)) | (code == 0xE280A8) | (code == 0xE280A9) | (code == 0xE280AF)
    return at[wide]


def chunk_starts(offsets: np.ndarray, data: np.ndarray, added: list[bytes] = ()) -> tuple[np.ndarray, np.ndarray]:
    """``(starts, odd)``: where the chunks of all texts begin in *data*, and which texts are one chunk as a whole.

    A chunk begins at a text's start, at each space or line feed, which it holds, and at each ASCII sign but the
    apostrophe that follows an ASCII letter.  Texts with other white space, with two in a row or with one at an end,
    and those that hold one of the strings *added*, are not cut.
    """
    mark = (data == _SPACE) | (data == _FEED)
    row = lambda at: np.searchsorted(offsets, at, "right") - 1
    full = np.diff(offsets) > 0
    odd = np.zeros(len(full), bool)
    odd[row(np.flatnonzero(mark[1:] & mark[:-1]))] = True  # two texts' ends count, too, but those are odd anyway
    odd[full] |= mark[offsets[:-1][full]] | mark[offsets[1:][full] - 1]
    odd[row(np.flatnonzero(_CONTROL[data]))] = True
    odd[row(_wide_spaces(data))] = True
    whole = data.tobytes() if added else b""
    for x in added:
        at = whole.find(x)
        while at >= 0:
            odd[row(at)] = True
            at = whole.find(x, at + 1)
    begins = mark
    begins[1:] |= _LETTER[data[:-1]] & _SIGN[data[1:]]
    begins[offsets[:-1][full]] = True
    starts = np.flatnonzero(begins)
    if odd.any():
        first = np.zeros(len(data), bool)
        first[offsets[:-1][full]] = True
        starts = starts[~odd[row(starts)] | first[starts]]
    return starts, odd


class ByteTokenizer:
    """A byte-level BPE of the tokenizers library with a table of distinct chunks.

    The byte-level pre-tokenizer begins a new token where :func:`chunk_starts` cuts, so a text's ids are its chunks'
    ids in order.  Of chunks that the table lacks, those it would leave whole go to the library's model alone; others
    are joined by line feeds (one id that no chunk has) and encoded together.  Tokenizers of another kind get whole texts.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.size = self.library.get_vocab_size()
        self.kind = np.uint16 if self.size <= 1 << 16 else np.uint32
        told = json.loads(self.library.to_str())
        kind = told.get("pre_tokenizer") or {}
        added = told.get("added_tokens") or []
        feed = self.library.encode("\n", add_special_tokens=False).ids
        self.chunked = (
            told.get("normalizer") is None
            and kind.get("type") == "ByteLevel"
            and kind.get("use_regex", False)
            and not kind.get("add_prefix_space", True)
            and not any(t["lstrip"] or t["rstrip"] or t["single_word"] for t in added)
            and len(feed) == 1
        )
        self.feed = feed[0] if feed else -1
        self.added = [t["content"].encode() for t in added]
        self.tails: dict[str, list[int]] = {}
        self.table = ChunkTable(self._segment)

    def _whole(self, texts: list[bytes]) -> list[bytes]:
        found = self.library.encode_batch_fast([x.decode() for x in texts], add_special_tokens=False)
        return [np.array(x.ids, self.kind).tobytes() for x in found]

    def _segment(self, keys: list[bytes]) -> list[list[bytes]]:
        """The ids of chunks, none of which has white space after its first byte, as one column."""
        out: list[bytes] = [b""] * len(keys)
        tokenize, tails = self.library.model.tokenize, self.tails
        feed, kind, plain = np.array([self.feed], self.kind).tobytes(), np.dtype(self.kind).char, []
        for i, key in enumerate(keys):
            if not (found := _WORD.fullmatch(key.decode())):
                plain.append(i)
                continue
            lead, word, tail = found.groups()
            if not word.isascii():
                word = word.encode().decode("latin-1").translate(_SIGNS)
            ids = [t.id for t in tokenize(_SPACE_SIGN + word if lead == " " else word)]
            if tail:
                if tail not in tails:
                    if len(tails) > 10_000:
                        tails.clear()
                    tails[tail] = [t.id for t in tokenize(tail)]
                ids += tails[tail]
            packed = array(kind, ids).tobytes()
            out[i] = feed + packed if lead == "\n" else packed
        for at in range(0, len(plain), _CALL_KEYS):
            part = plain[at : at + _CALL_KEYS]
            joined = b"".join(b"\n" + (keys[i][1:] if keys[i][0] == _FEED else keys[i]) for i in part)
            (found,) = self.library.encode_batch_fast([joined.decode()], add_special_tokens=False)
            ids = np.array(found.ids, self.kind)
            cuts = np.append(np.flatnonzero(ids == self.feed), len(ids))
            if len(cuts) != len(part) + 1:
                raise ValueError("a chunk holds a line feed's id")
            width, packed = ids.itemsize, ids.tobytes()
            for i, a, b in zip(part, cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
                # A chunk that begins with a line feed keeps its id.
                out[i] = (feed if keys[i][0] == _FEED else b"") + packed[(a + 1) * width : b * width]
        return [out]

    def encode_column(self, texts: pa.Array, end: int) -> tuple[np.ndarray, np.ndarray]:
        """``(ids, lengths)``: all texts' ids, each text's followed by *end*, and how many each has."""
        offsets, data = textnp.utf8(texts)
        n = len(offsets) - 1
        if self.chunked:
            starts, odd = chunk_starts(offsets, data, self.added)
        else:
            starts, odd = offsets[:-1][np.diff(offsets) > 0], np.ones(n, bool)
        edges = np.append(starts, len(data))
        cut = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(edges.astype(np.int64)), pa.py_buffer(data)])
        coded = cut.dictionary_encode()
        keys, index = coded.dictionary, coded.indices.to_numpy().astype(np.int64)
        firsts = np.searchsorted(starts, offsets)
        # Texts that are one chunk as a whole go to the library, after the other chunks.
        whole = np.unique(index[firsts[:-1][odd & (np.diff(firsts) > 0)]])
        others = np.setdiff1d(np.arange(len(keys)), whole, assume_unique=True)
        place = np.empty(len(keys), np.int64)
        place[others], place[whole] = np.arange(len(others)), len(others) + np.arange(len(whole))
        index = place[index]
        ids_of = self._whole(keys.take(pa.array(whole)).to_pylist()) if len(whole) else []
        (known,) = self.table.values(keys.take(pa.array(others)))
        values = pa.concat_arrays([known, pa.array([*ids_of, np.array([end], self.kind).tobytes()], pa.large_binary())])
        # The values of all chunks, and the end after each text's, one after another.
        chosen = np.insert(index, firsts[1:], len(keys))
        taken = values.take(pa.array(chosen))
        edges = np.frombuffer(taken.buffers()[1], np.int64)[: len(chosen) + 1]
        ids = np.frombuffer(taken.buffers()[2], self.kind) if n else np.zeros(0, self.kind)
        ends = edges[firsts[1:] + np.arange(1, n + 1)] // np.dtype(self.kind).itemsize
        return ids[: ends[-1] if n else 0], np.diff(ends, prepend=0)

    def encode_batch(self, texts: list[str], end: int) -> list[bytes]:
        """Each text's ids and the end id, as bytes of ``kind``."""
        ids, lengths = self.encode_column(pa.array(texts, pa.large_string()), end)
        return [x.tobytes() for x in np.split(ids, np.cumsum(lengths)[:-1])] if texts else []


_TOKENIZERS: dict[str, ByteTokenizer] = {}


def tokenizer(path: str) -> ByteTokenizer:
    if path not in _TOKENIZERS:
        _TOKENIZERS[path] = ByteTokenizer(path)
    return _TOKENIZERS[path]


def forget() -> None:
    """Free what this worker has learned, before passes that tokenize nothing; workers are reused."""
    _TOKENIZERS.clear()


_TOKENS = "shard int, block int, doc_ids array<bigint>, lengths array<int>, ids binary"
_BLOCKS = "shard int, block int, doc_ids array<bigint>, lengths array<int>, coded binary"


def _lists(values: list[list[int]], kind: pa.DataType) -> pa.Array:
    return pa.array(values, pa.list_(kind))


def tokenized(docs: DataFrame, path: str, end: int = 0, text: str = "text") -> DataFrame:
    """Blocks of token ids in ascending order of document id, not yet coded."""
    rows = docs.select("doc_id", F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    rows = rows.withColumn("tie", F.xxhash64("text"))
    ordered = rows.repartitionByRange(parts_of(docs, SORTED_BYTES), "doc_id", "tie").sortWithinPartitions("doc_id", "tie").select("doc_id", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        own, shard = tokenizer(path), TaskContext.get().partitionId()
        block, held, ids, lengths, parts = 0, 0, [], [], []

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays(
                [
                    pa.array([shard], pa.int32()),
                    pa.array([block], pa.int32()),
                    _lists([ids], pa.int64()),
                    _lists([lengths], pa.int32()),
                    pa.array([b"".join(parts)], pa.binary()),
                ],
                names=["shard", "block", "doc_ids", "lengths", "ids"],
            )

        for batch in batches:
            numbers, texts = batch.column(0).to_pylist(), batch.column(1)
            for a, b in textnp.slices(textnp.utf8(texts)[0], SLICE_BYTES):
                flat, counts = own.encode_column(texts.slice(a, b - a), end)
                ends = np.cumsum(counts)
                for i, n, to in zip(numbers[a:b], counts.tolist(), ends.tolist(), strict=True):
                    if ids and held + n > BLOCK_TOKENS:
                        yield out()
                        block, held, ids, lengths, parts = block + 1, 0, [], [], []
                    ids.append(i)
                    lengths.append(n)
                    parts.append(flat[to - n : to].tobytes())
                    held += n
        if ids:
            yield out()

    return ordered.mapInArrow(run, _TOKENS)


def count_ids(tokens: DataFrame, size: int, kind: type) -> np.ndarray:
    """How often each of *size* ids, stored as *kind*, occurs; the vocabulary bounds the result."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        total = np.zeros(size, np.int64)
        for batch in batches:
            for x in batch.column(0):
                total += np.bincount(np.frombuffer(x.as_buffer(), kind), minlength=size)
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int64()), pa.array(total[used], pa.int64())], names=["id", "n"])

    rows = tokens.select("ids").mapInArrow(run, "id bigint, n bigint").groupBy("id").agg(F.sum("n").alias("n")).collect()
    out = np.zeros(size, np.int64)
    for r in rows:
        out[r.id] = r.n
    return out


def write(docs: DataFrame, path: str, to: str, end: int = 0) -> None:
    """Write the file set of *docs* below the folder *to*: ``blocks`` and ``frequencies``."""
    spark = docs.sparkSession
    tokens = written(tokenized(docs, path, end), "tokens")
    own = ByteTokenizer(path)
    size, kind = own.size, own.kind
    counts = count_ids(tokens, size, kind)
    spark.createDataFrame([(counts.astype("<i8").tobytes(),)], "counts binary").coalesce(1).write.parquet(f"{to}/frequencies")
    sent = spark.sparkContext.broadcast(counts)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = FrequencyTable(sent.value)
        for batch in batches:
            for i in range(batch.num_rows):
                ids = np.frombuffer(batch.column(4)[i].as_buffer(), kind)
                row = batch.slice(i, 1)
                yield pa.RecordBatch.from_arrays(
                    [*row.columns[:4], pa.array([encode_block(ids, table)], pa.binary())],
                    names=["shard", "block", "doc_ids", "lengths", "coded"],
                )

    tokens.mapInArrow(run, _BLOCKS).write.options(**{"compression": "uncompressed", "parquet.block.size": ROW_GROUP}).parquet(f"{to}/blocks")
    dropped(tokens)


def read(spark, at: str) -> tuple[DataFrame, np.ndarray]:
    """The blocks of a file set and the counts behind its frequency table."""
    counts = np.frombuffer(spark.read.parquet(f"{at}/frequencies").head().counts, "<i8")
    return spark.read.schema(_BLOCKS).parquet(f"{at}/blocks"), counts


def _decoded(spark, at: str, extra: str, made: Callable[[np.ndarray, np.ndarray], list[pa.Array]]) -> DataFrame:
    """``doc_id, start`` of each document and the columns *extra*, *made* of a block's ids and its documents' edges."""
    blocks, counts = read(spark, at)
    sent = spark.sparkContext.broadcast(counts)
    columns = "shard int, block int, doc_id bigint, inner bigint, " + extra
    names = [c.split()[0] for c in columns.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = FrequencyTable(sent.value)
        for batch in batches:
            for i in range(batch.num_rows):
                shard, block, doc_ids, lengths, coded = (c[i].as_py() for c in batch.columns)
                edges = np.concatenate([[0], np.cumsum(lengths)])
                n = len(doc_ids)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.full(n, shard), pa.int32()),
                        pa.array(np.full(n, block), pa.int32()),
                        pa.array(doc_ids, pa.int64()),
                        pa.array(edges[:-1], pa.int64()),
                        *made(decode_block(coded, table), edges),
                    ],
                    names=names,
                )

    # One row for each block; the window runs within a shard, then over one row for each shard.
    sizes = blocks.select("shard", "block", F.aggregate("lengths", F.lit(0).cast("long"), lambda a, x: a + x).alias("n"))
    before = Window.partitionBy("shard").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    earlier = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    none = F.lit(0).cast("long")
    shards = sizes.groupBy("shard").agg(F.sum("n").alias("n")).select("shard", F.coalesce(F.sum("n").over(earlier), none).alias("_shard"))
    offsets = (
        sizes.select("shard", "block", F.coalesce(F.sum("n").over(before), none).alias("_block"))
        .join(shards, "shard")
        .select("shard", "block", (F.col("_shard") + F.col("_block")).alias("_before"))
    )
    decoded = blocks.mapInArrow(run, columns)
    return decoded.join(offsets, ["shard", "block"]).select("doc_id", (F.col("_before") + F.col("inner")).alias("start"), *names[4:])


def documents(spark, at: str) -> DataFrame:
    """Decode a file set: ``doc_id, start, n_tokens, ids`` of each document; *start* counts the ids before it."""

    def made(ids: np.ndarray, edges: np.ndarray) -> list[pa.Array]:
        lists = pa.ListArray.from_arrays(pa.array(edges, pa.int32()), pa.array(ids.astype(np.int32)))
        return [pa.array(np.diff(edges), pa.int64()), lists]

    return _decoded(spark, at, "n_tokens bigint, ids array<int>", made)


def digests(spark, at: str) -> DataFrame:
    """``doc_id, start, n_tokens, ids_crc32`` of each document, read from a file set."""

    def made(ids: np.ndarray, edges: np.ndarray) -> list[pa.Array]:
        packed, at = memoryview(ids.astype("<u4").tobytes()), (edges * 4).tolist()
        crc = [zlib.crc32(packed[a:b]) for a, b in zip(at[:-1], at[1:], strict=True)]
        return [pa.array(np.diff(edges), pa.int64()), pa.array(crc, pa.int64())]

    return _decoded(spark, at, "n_tokens bigint, ids_crc32 bigint", made)


def write_and_read(docs: DataFrame, path: str, end: int = 0) -> DataFrame:
    """Write *docs* to a new file set in the shared folder and return its digests."""
    to = new_path(docs.sparkSession, "token-files")
    write(docs, path, to, end)
    return digests(docs.sparkSession, to)
