import hashlib
import random
import zlib

import numpy as np
import public_tokenizers as P
import pytest
from tokenizers import Tokenizer

from gneiss.llm import bpe, tokenbin

BYTE, WORD = P.path("byte_bpe_50k.json"), P.path("word_bpe_49k.json")
LETTERS = "ab' \n\tLs.é ß1½́<|>字\xa0\x1c"


def odd_texts(n):
    rng = random.Random(11)
    return ["".join(rng.choice(LETTERS) for _ in range(rng.randint(1, 60))) for _ in range(n)] + ["<|endoftext|>a<|startoftext|>", "  a   b \n\n c", "İIΣ ΑΣ"]


def test_byte_codec_equals_library():
    ours, library = bpe.codec(BYTE), Tokenizer.from_file(BYTE)
    for text in odd_texts(1500):
        ids = library.encode(text, add_special_tokens=False).ids
        assert ours.encode(text) == ids
        assert ours.decode(ids) == library.decode(ids, skip_special_tokens=False)


def test_word_encoder_equals_library():
    ours, library = tokenbin.encoder(WORD), Tokenizer.from_file(WORD)
    for text in odd_texts(1500):
        assert np.frombuffer(ours.encode_packed(text), "<u4").tolist() == library.encode(text, add_special_tokens=False).ids


def test_cuts_are_certain():
    model = bpe.codec(BYTE)
    for piece in ("Ġhello", "qжz", "ĠÃ©t"):
        assert "".join(model.cut(piece)) == piece
        for a, b in zip(model.cut(piece), model.cut(piece)[1:], strict=False):
            assert (a[-1], b[0]) not in model.joined


def test_tables_forget_what_is_old():
    table = bpe.Table(limit=3)
    for n in range(10):
        assert table.join([str(n), "x"], str.encode, 5) == str(n).encode() + b"x"
    assert len(table.young) + len(table.old) <= 6


def test_digests(spark, docs, texts):
    library = Tokenizer.from_file(BYTE)
    rows = bpe.digests(docs, BYTE).collect()
    assert len(rows) == len(texts)
    for r in rows:
        ids = library.encode(texts[r["doc_id"]] or "", add_special_tokens=False).ids
        assert r["n_tokens"] == len(ids)
        assert r["ids_sha256"] == hashlib.sha256(np.array(ids, dtype="<u4").tobytes()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def test_encode_decode_columns(odd, empty):
    back = bpe.decode(bpe.encode(odd, BYTE), BYTE)
    assert {(r["node"], r["decoded"]) for r in back.collect()} == {(r["node"], r["text"] or "") for r in odd.collect()}
    assert bpe.encode(empty, BYTE).count() == 0
    with pytest.raises(ValueError, match="there already"):
        bpe.encode(odd, BYTE, into="node")


def test_pack_any_width():
    rng = np.random.default_rng(0)
    for bits in (1, 3, 8, 11, 16, 17, 31, 32):
        ids = rng.integers(0, 1 << bits, 1000, dtype=np.uint64).astype("<u4")
        payload = tokenbin.pack(ids, bits)
        assert len(payload) == -(-1000 * bits // 8)
        for a, b in ((0, 1000), (13, 14), (999, 1000), (5, 5), (100, 777)):
            assert (tokenbin.unpack(payload, bits, a, b) == ids[a:b]).all()


def test_blocks_round_trip(spark, docs, texts):
    library, start = Tokenizer.from_file(WORD), 0
    for r in sorted(tokenbin.digests(docs, WORD).collect(), key=lambda r: r["doc_id"]):
        ids = [*library.encode(texts[r["doc_id"]] or "", add_special_tokens=False).ids, 2]
        assert (r["start"], r["n_tokens"], r["ids_crc32"]) == (start, len(ids), zlib.crc32(np.array(ids, dtype="<u4").tobytes()))
        start += len(ids)


def test_blocks_of_odd_tables(spark, odd, empty, tmp_path):
    assert tokenbin.digests(empty, WORD).count() == 0
    path = f"file://{tmp_path}/blocks"
    tokenbin.write_blocks(odd, WORD, path, block_ids=10)
    rows = sorted(tokenbin.read_documents(spark, path).collect(), key=lambda r: r["start"])
    assert [r["doc_id"] for r in rows] == [None, None, 3, 7, 7, 7]
    assert tokenbin.read_blocks(spark, path).count() > 1
