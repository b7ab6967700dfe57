"""Byte-level BPE encoding and decoding by forced-boundary splitting.

A byte pair that occurs inside no vocabulary token can never be merged, so a boundary between
two such bytes is certain. Texts are cut first where a non-space meets an ASCII space that no
token holds after another byte, then at every other certain boundary inside a pre-token. The
fragments are encoded independently and their ids are concatenated; encodings of frequent
chunks and fragments are kept in bounded per-worker tables.

Defined results: a null text is the empty text (no ids, empty decoded text). Rows keep their
multiplicity and order of columns; texts of any length go through whole.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from gneiss.llm.storage import released

#: Entries of each of the two generations of a worker's tables.
TABLE_LIMIT = 150_000
#: Characters of text that are encoded before a batch is sent on (a longer single text is taken whole).
SENT_CHARS = 2_000_000
#: Chunks longer than this are encoded but not kept.
KEEP_LENGTH = 64
ASCII_SPACE = " \t\n\r\x0b\x0c"
OTHER_SPACE = re.compile("[\x1c-\x1f\x85\xa0  -     　]")


#: Letters, digits and signs on which the pre-tokenizer's pattern means the same in all its engines.
FAMILIAR = re.compile("[\t\n\r -~\xa1-\u024f]+")
PATTERN = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")


class Table:
    """A bounded table in two generations: what is looked up lately outlives what is not."""

    def __init__(self, limit: int = TABLE_LIMIT) -> None:
        self.limit, self.young, self.old = limit, {}, {}

    def older(self, name: str) -> bytes | None:
        """What the old generation has; it moves to the young one."""
        value = self.old.get(name)
        if value is not None:
            self.put(name, value)
        return value

    def put(self, name: str, value: bytes) -> None:
        if len(self.young) >= self.limit:
            self.old, self.young = self.young, {}
        self.young[name] = value

    def join(self, parts: list[str], make: Callable[[str], bytes], longest: int) -> bytes:
        """The values of all parts in a row; ``make`` gives those that are not there."""
        get = self.young.get
        found = list(map(get, parts))
        if None in found:
            for n in [n for n, value in enumerate(found) if value is None]:
                part = parts[n]
                value = self.young.get(part)
                if value is None:
                    value = self.older(part)
                    if value is None:
                        value = make(part)
                        if len(part) <= longest:
                            self.put(part, value)
                found[n] = value
        return b"".join(found)


def byte_alphabet() -> dict[int, str]:
    """The printable stand-in of every byte in byte-level vocabularies."""
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {b: chr(b) for b in shown} | {b: chr(256 + n) for n, b in enumerate(hidden)}


class ForcedBoundaryBpe:
    """Encoder and decoder over one tokenizer file with a byte-level BPE model."""

    def __init__(self, path: str) -> None:
        self.tokenizer = Tokenizer.from_file(path)
        self.stand_in = byte_alphabet()
        words, added = self._vocabulary()
        self.token_bytes: list[bytes] = [b""] * (max([*(i for _, i in words), *added.values()]) + 1)
        inside = np.zeros((256, 256), dtype=bool)
        for raw, i in words:
            self.token_bytes[i] = raw
            codes = np.frombuffer(raw, dtype=np.uint8)
            inside[codes[:-1], codes[1:]] = True
        for content, i in added.items():
            self.token_bytes[i] = content.encode()
        #: inside[a, b]: some token holds byte b right after byte a.
        self.inside = inside
        self.joined = {(self.stand_in[a], self.stand_in[b]) for a, b in zip(*np.nonzero(inside), strict=True)}
        space = re.escape(ASCII_SPACE)
        self.chunk = re.compile(f"[{space}]*[^{space}]+|[{space}]+")
        self.special = re.compile("(" + "|".join(map(re.escape, sorted(added, key=len, reverse=True))) + ")") if added else None
        self.added = added
        self.shown = {b: c for b, c in self.stand_in.items() if chr(b) != c}
        self.space = self.stand_in[32]
        self.chunks, self.fragments = Table(), Table()

    def _vocabulary(self) -> tuple[list[tuple[bytes, int]], dict[str, int]]:
        """(bytes, id) of the model's tokens, and the added tokens."""
        spec = json.loads(self.tokenizer.to_str())
        if spec["model"]["type"] != "BPE" or (spec["pre_tokenizer"] or {}).get("type") != "ByteLevel" or spec["normalizer"]:
            raise ValueError("a byte-level BPE tokenizer file without a normalizer is needed")
        real = {c: b for b, c in self.stand_in.items()}
        words = [(bytes(real[c] for c in token) if all(c in real for c in token) else token.encode(), i) for token, i in spec["model"]["vocab"].items()]
        return words, {t["content"]: t["id"] for t in spec["added_tokens"]}

    def cut(self, piece: str) -> list[str]:
        """A pre-token (in stand-in letters), split at every certain boundary."""
        if self.joined.issuperset(zip(piece, piece[1:], strict=False)):
            return [piece]
        ends = [i for i, pair in enumerate(zip(piece, piece[1:], strict=False), 1) if pair not in self.joined]
        return [piece[a:b] for a, b in zip([0, *ends], [*ends, len(piece)], strict=True)]

    def _model(self, fragment: str) -> bytes:
        return b"".join([t.id.to_bytes(4, "little") for t in self.tokenizer.model.tokenize(fragment)])

    def _show(self, piece: str) -> str:
        """The piece's bytes in stand-in letters."""
        if piece.isascii():
            return self.space + piece[1:] if piece[0] == " " and piece[1:].isprintable() and " " not in piece[1:] else piece.translate(self.shown)
        return piece.encode().decode("latin-1").translate(self.shown)

    def _chunk(self, chunk: str) -> bytes:
        if FAMILIAR.fullmatch(chunk):
            pieces = map(self._show, PATTERN.findall(chunk))
        else:
            pieces = [x for x, _ in self.tokenizer.pre_tokenizer.pre_tokenize_str(chunk)]
        out, known = [], self.fragments
        for piece in pieces:
            ids = known.young.get(piece)
            if ids is None:
                ids = known.older(piece) or b"".join([self._model(f) for f in self.cut(piece)])
                if len(piece) <= KEEP_LENGTH:
                    known.put(piece, ids)
            out.append(ids)
        return b"".join(out)

    def _plain(self, text: str) -> bytes:
        if not text:
            return b""
        if OTHER_SPACE.search(text):
            return self._chunk(text)
        return self.chunks.join(self.chunk.findall(text), self._chunk, KEEP_LENGTH)

    def encode_packed(self, text: str | None) -> bytes:
        """The ids as little-endian unsigned 32-bit integers."""
        text = text or ""
        if self.special is None or not self.special.search(text):
            return self._plain(text)
        parts = self.special.split(text)
        return b"".join(self.added[x].to_bytes(4, "little") if n % 2 else self._plain(x) for n, x in enumerate(parts))

    def encode(self, text: str | None) -> list[int]:
        return np.frombuffer(self.encode_packed(text), dtype="<u4").tolist()

    def decode_bytes(self, packed: bytes) -> bytes:
        """UTF-8 of the decoded text; broken sequences become U+FFFD."""
        raw = b"".join(map(self.token_bytes.__getitem__, np.frombuffer(packed, dtype="<u4").tolist()))
        try:
            raw.decode()
        except UnicodeDecodeError:
            return raw.decode("utf-8", "replace").encode()
        return raw

    def decode(self, ids: list[int]) -> str:
        return self.decode_bytes(np.asarray(ids, dtype="<u4").tobytes()).decode()


@lru_cache(maxsize=4)
def codec(path: str) -> ForcedBoundaryBpe:
    return ForcedBoundaryBpe(path)


def _parts(batch: pa.RecordBatch, text: int) -> Iterator[pa.RecordBatch]:
    """The batch in slices of about SENT_CHARS bytes of text."""
    sizes = np.cumsum(pc.binary_length(batch.column(text)).fill_null(0).to_numpy(zero_copy_only=False))
    start, sent = 0, 0
    while start < batch.num_rows:
        stop = max(start + 1, int(np.searchsorted(sizes, sent + SENT_CHARS, side="right")))
        yield batch.slice(start, stop - start)
        start, sent = stop, int(sizes[stop - 1])


def _texts(column: pa.Array) -> Iterator[str | None]:
    for value in column:
        yield value.as_py()


def _id_lists(packed: list[bytes]) -> pa.ListArray:
    ends = np.cumsum([0, *(len(p) // 4 for p in packed)], dtype=np.int32)
    values = np.frombuffer(b"".join(packed), dtype="<i4")
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(values, pa.int32()))


def encode(docs: DataFrame, path: str, text: str = "text", into: str = "ids") -> DataFrame:
    """``docs`` with the token ids of ``text`` in a new array column ``into``."""
    if into in docs.columns:
        raise ValueError(f"column {into} is there already")
    schema = docs.select("*", F.lit(None).cast("array<int>").alias(into)).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = codec(path)
        for batch in batches:
            packed = [model.encode_packed(t) for t in _texts(batch.column(text))]
            yield pa.RecordBatch.from_arrays([*batch.columns, _id_lists(packed)], [*batch.schema.names, into])

    return docs.mapInArrow(released(run), schema)


def decode(tokens: DataFrame, path: str, ids: str = "ids", into: str = "decoded") -> DataFrame:
    """``tokens`` with the decoded text of ``ids`` in a new string column; null ids decode to ''."""
    if into in tokens.columns:
        raise ValueError(f"column {into} is there already")
    schema = tokens.select("*", F.lit(None).cast("string").alias(into)).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = codec(path)
        for batch in batches:
            out = [model.decode(x.as_py() or []) for x in batch.column(ids)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.string())], [*batch.schema.names, into])

    return tokens.mapInArrow(released(run), schema)


def digests(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text", with_ids: bool = False) -> DataFrame:
    """Per row: the key, the number of ids, the digests of the ids and of their decoded text, and the ids if asked for."""
    schema = docs.select(key).schema.simpleString()[len("struct<") : -1].replace(":", " ")
    schema += ", n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * with_ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = codec(path)
        for batch in (part for whole in batches for part in _parts(whole, 1)):
            packed = [model.encode_packed(t) for t in _texts(batch.column(1))]
            columns = [
                batch.column(0), pa.array([len(p) // 4 for p in packed], pa.int64()), pa.array([hashlib.sha256(p).hexdigest() for p in packed], pa.string()),
                pa.array([hashlib.sha256(model.decode_bytes(p)).hexdigest() for p in packed], pa.string()),
            ]
            names = [key, "n_tokens", "ids_sha256", "decoded_sha256"]
            if with_ids:
                columns.append(_id_lists(packed))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(columns, names)
        codec.cache_clear()

    return docs.select(key, text).mapInArrow(released(run), schema)
