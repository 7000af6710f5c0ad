import hashlib
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
import public_tokenizers
import sentencepiece
from tokenizers import Tokenizer

from tessera.llm import chunks, registry, spm, token_files
from tessera.llm.common import new_path

BYTES, PIECES = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


def _order(r):
    return (r.doc_id is not None, r.doc_id or 0)


@pytest.mark.parametrize("which", ["odd", "small"])
def test_token_files_round_trip(request, which):
    docs = request.getfixturevalue(which)
    library = Tokenizer.from_file(BYTES)
    given = sorted(docs.select("doc_id", "text").collect(), key=_order)
    want = Counter()
    for r in given:
        ids = [*library.encode(r.text or "", add_special_tokens=False).ids, 0]
        want[(r.doc_id, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))] += 1
    rows = sorted(token_files.write_and_read(docs, BYTES).collect(), key=lambda r: r.start)
    assert Counter((r.doc_id, r.n_tokens, r.ids_crc32) for r in rows) == want
    at = 0
    for r in rows:
        assert r.start == at
        at += r.n_tokens
    assert [_order(r) for r in rows] == [_order(r) for r in given]


def test_token_files_give_their_ids(spark, odd):
    to = new_path(spark, "test-files")
    token_files.write(odd.where("doc_id = 14"), BYTES, to)
    library = Tokenizer.from_file(BYTES)
    want = Counter(tuple([*library.encode(r.text, add_special_tokens=False).ids, 0]) for r in odd.where("doc_id = 14").collect())
    assert Counter(tuple(r.ids) for r in token_files.documents(spark, to).collect()) == want


def test_token_files_of_nothing(none):
    assert token_files.write_and_read(none, BYTES).collect() == []


@pytest.mark.parametrize("n", [0, 1, 1023, 1024, 5000, token_files.LANES * token_files.CHECKPOINT * 2 + 77])
@pytest.mark.parametrize("skew", [0.0, 3.0])
def test_block_round_trip(n, skew):
    rng = np.random.default_rng(n)
    ids = (rng.random(n) ** (1 + skew) * 5000).astype(np.uint16)
    table = token_files.FrequencyTable(np.bincount(ids, minlength=5000))
    block = token_files.encode_block(ids, table)
    assert (token_files.decode_block(block, table) == ids).all()
    step = token_files.LANES * token_files.CHECKPOINT
    for k in range(-(-n // step)):
        assert (token_files.decode_block(block, table, k) == ids[k * step : (k + 1) * step]).all()
    broken = bytearray(block)
    broken[len(block) // 2] ^= 1
    with pytest.raises(ValueError, match="checksum"):
        token_files.decode_block(bytes(broken), table)


def test_frequencies():
    for counts in ([0, 5, 0], [1] * 70_000, [10**12, 1, 1], [0, 0]):
        freq = token_files.FrequencyTable(np.array(counts)).freq
        assert freq.sum() == ((1 << token_files.SCALE_BITS) if any(counts) else 0)
        assert ((freq > 0) == (np.array(counts) > 0)).all()


TRICKY = [
    "", " ", "  ", "\n", "\n\n", " \n ", "a", " a", "a ", "a  b", "a\nb", "a\n\nb c", "▁", "▁a▁", "a▁b", "\n a", "x \n", "ﬁ ²", "\x00\x01", "​ a",
    "é é \U0001f600", "\t tab", "a\r\nb", "<unk> <s> </s>", "0 1 23", "a" * 3000, "word " * 50,
]


def test_pieces_equal_the_library():
    sp = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    own = spm.Codec(PIECES)
    assert own.chunked
    tricky = [*TRICKY, "\nabc", "  x  y ", "\u2581 a", "\n\n a", "a\n\nb  \n c", " abc", "abc abc", "\u4e2d\u6587"]
    ids, said = own.encode_column(pa.array(tricky, pa.string()))
    for text, i, s in zip(tricky, ids.to_pylist(), said.to_pylist(), strict=True):
        want = [*sp.encode(text), sp.eos_id()]
        assert i == want, repr(text)
        assert s == sp.decode(want), repr(text)


def test_byte_tokens_equal_the_library():
    library, own = Tokenizer.from_file(BYTES), token_files.ByteTokenizer(BYTES)
    for text, coded in zip(TRICKY, own.encode_batch(TRICKY, 0), strict=True):
        assert np.frombuffer(coded, own.kind).tolist() == [*library.encode(text, add_special_tokens=False).ids, 0], repr(text)


def test_sentencepiece_query(spark):
    sp = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    sf = "/root/testdata/sf0.001"
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    want = set()
    for r in spark.read.parquet(f"{sf}/documents.parquet").collect():
        ids = [*sp.encode(r.text or ""), sp.eos_id()]
        want.add((r.doc_id, len(ids), sha(" ".join(map(str, ids))), sha(sp.decode(ids))))
    assert {tuple(r) for r in registry.QUERIES["op10_sentencepiece"](spark, sf).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256").collect()} == want


def test_sentencepiece_of_odd_rows(odd, none):
    sp = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    rows = spm.encode(odd, PIECES, "doc_id", "text", "node").collect()
    assert Counter((r.doc_id, r.text) for r in rows) == Counter((r.doc_id, r.text) for r in odd.collect())
    for r in rows:
        assert r.ids == [*sp.encode(r.text or ""), sp.eos_id()] and r.decoded == sp.decode(r.ids)
    assert spm.encode(none, PIECES, "doc_id").collect() == []


def test_chunk_table_forgets_its_older_half():
    table = chunks.ChunkTable(lambda xs: [[x.upper() for x in xs], [x * 2 for x in xs]], 2, size=3)
    for keys in ([b"a", b"b"], [b"c", b"d", b"a", b"b"], [], [b"e"], [b"d", b"a"], [b"f", b"ff", b"a"]):
        one, two = table.values(pa.array(keys, pa.large_binary()))
        assert one.to_pylist() == [x.upper() for x in keys] and two.to_pylist() == [x * 2 for x in keys]
        assert len(table.keys) <= 3


def test_equal_hashes_do_no_harm(monkeypatch):
    monkeypatch.setattr(chunks, "hashes", lambda keys: np.zeros(len(keys), np.uint64))
    table = chunks.ChunkTable(lambda xs: [[x.upper() for x in xs]], size=100)
    for keys in ([b"a", b"b"], [b"b", b"c", b"a"], [b"a"]):
        assert table.values(pa.array(keys, pa.large_binary()))[0].to_pylist() == [x.upper() for x in keys]
