"""Token ids in fixed-width bit-packed blocks.

A table of blocks is the file format: each row holds the ids of consecutive documents, every id
in the fewest bits that the vocabulary needs, and the documents' offsets inside the block, so
any document is found by arithmetic and unpacked with numpy. Spark's own writer commits the
files, so a lost executor only costs its unfinished tasks.

    part, block   place in the global order (ascending key)
    before        ids of the part's earlier blocks
    bits          width of an id
    keys          keys of the block's documents
    ends          running count of ids after each document
    payload       ids, packed least significant bit first

Defined results: a null text has no ids but its end id; null keys come first; rows with the same
key stand in the order of their text. Documents are never split between blocks.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from gneiss.llm.bpe import Table, byte_alphabet
from gneiss.llm.storage import scratch_path

#: Chunks longer than this are encoded but not kept.
KEEP_LENGTH = 64
#: A block is closed once it holds this many ids.
BLOCK_IDS = 1 << 16
BLOCK_SCHEMA = "part int, block int, before bigint, bits int, keys array<bigint>, ends array<bigint>, payload binary"


def pack(ids: np.ndarray, bits: int) -> bytes:
    """ids in ``bits`` bits each, least significant bit first."""
    ids = np.ascontiguousarray(ids, dtype="<u4")
    if bits in (8, 16, 32):
        return ids.astype(f"<u{bits // 8}").tobytes()
    spread = np.unpackbits(ids.view(np.uint8).reshape(-1, 4), axis=1, bitorder="little")[:, :bits]
    return np.packbits(spread.reshape(-1), bitorder="little").tobytes()


def unpack(payload: bytes, bits: int, start: int, stop: int) -> np.ndarray:
    """The ids ``start`` to ``stop`` of a payload; only the bytes that hold them are read."""
    if stop <= start:
        return np.empty(0, dtype="<u4")
    if bits in (8, 16, 32):
        return np.frombuffer(payload, dtype=f"<u{bits // 8}", count=stop - start, offset=start * (bits // 8)).astype("<u4")
    first = start * bits // 8
    raw = np.frombuffer(payload, dtype=np.uint8, count=-(-stop * bits // 8) - first, offset=first)
    flat = np.unpackbits(raw, bitorder="little")[start * bits - first * 8 :][: (stop - start) * bits]
    wide = np.zeros((stop - start, 32), dtype=np.uint8)
    wide[:, :bits] = flat.reshape(-1, bits)
    return np.packbits(wide, axis=1, bitorder="little").view("<u4").reshape(-1)


class ChunkEncoder:
    """Encodes white-space-separated chunks with the tokenizers library and keeps frequent ones.

    Chunks are independent where the tokenizer normalizes with NFC, white space and lower case and
    drops white space before its model, as checked here; any other tokenizer gets whole texts.
    """

    SPACE = re.compile("[ \t\n\r\x0b\x0c]+")
    PLAIN = re.compile("[!-~À-ÿ]+")
    PIECES = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^a-zß-öø-ÿ0-9]+")
    #: The pre-tokenizer pattern for which PIECES holds on PLAIN chunks.
    PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"

    def __init__(self, path: str) -> None:
        import json

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_padding()
        self.tokenizer.no_truncation()
        spec = json.loads(self.tokenizer.to_str())
        kinds = [x["type"] for x in (spec.get("normalizer") or {}).get("normalizers", [])]
        steps = (spec.get("pre_tokenizer") or {}).get("pretokenizers", [])
        pattern = steps[0].get("pattern", {}).get("Regex") if steps else None
        self.split = kinds == ["NFC", "Replace", "Lowercase"] and pattern == self.PATTERN
        self.split &= not any(t["lstrip"] or t["rstrip"] or re.search(r"\s", t["content"]) for t in spec["added_tokens"])
        self.marks = [t["content"] for t in spec["added_tokens"]]
        self.vocabulary = self.tokenizer.get_vocab_size(with_added_tokens=True)
        self.shown = {b: c for b, c in byte_alphabet().items() if chr(b) != c}
        self.chunks, self.pieces = Table(), Table()

    def _library(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()

    def _model(self, piece: str) -> bytes:
        shown = piece.encode().decode("latin-1").translate(self.shown)
        return b"".join([t.id.to_bytes(4, "little") for t in self.tokenizer.model.tokenize(shown)])

    def _chunk(self, chunk: str) -> bytes:
        if len(chunk) <= KEEP_LENGTH and self.PLAIN.fullmatch(chunk) and not any(m in chunk for m in self.marks):
            return self.pieces.join(self.PIECES.findall(chunk.lower()), self._model, KEEP_LENGTH)
        return self._library(chunk)

    def encode_packed(self, text: str | None) -> bytes:
        if not text:
            return b""
        if not self.split:
            return self._library(text)
        if "<" not in text:
            # lower case changes nothing that the normalizer keeps, where it works letter by letter
            try:
                text.encode("latin-1")
                text = text.lower()
            except UnicodeEncodeError:
                pass
        return self.chunks.join([x for x in self.SPACE.split(text) if x], self._chunk, KEEP_LENGTH)


@lru_cache(maxsize=4)
def encoder(path: str) -> ChunkEncoder:
    return ChunkEncoder(path)


def _block(part: int, number: int, before: int, bits: int, keys: list, packed: list[bytes], end_id: bytes) -> pa.RecordBatch:
    ends = np.cumsum([len(p) // 4 + 1 for p in packed], dtype=np.int64)
    ids = np.frombuffer(b"".join(p + end_id for p in packed), dtype="<u4")
    rows = [[part], [number], [before], [bits], [keys], [ends], [pack(ids, bits)]]
    kinds = [pa.int32(), pa.int32(), pa.int64(), pa.int32(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.binary()]
    names = ["part", "block", "before", "bits", "keys", "ends", "payload"]
    return pa.RecordBatch.from_arrays([pa.array(r, k) for r, k in zip(rows, kinds, strict=True)], names)


def write_blocks(
    docs: DataFrame, tokenizer: str, path: str, end_id: int = 2, key: str = "doc_id", text: str = "text",
    partitions: int | None = None, block_ids: int = BLOCK_IDS,
) -> None:
    """Encode ``docs`` and write their blocks to ``path`` in ascending order of ``key``.

    Rows are dealt by ranges of the key before they are encoded, so sampling for the ranges never
    runs the encoder and only texts cross the network.
    """
    spark = docs.sparkSession
    n = partitions or max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    rows = docs.select(F.col(key).cast("long").alias("key"), F.col(text).cast("string").alias("text"))
    ranged = rows.repartitionByRange(n, F.col("key").asc_nulls_first(), F.xxhash64("text"))
    ordered = ranged.sortWithinPartitions(F.col("key").asc_nulls_first(), F.xxhash64("text"), "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, model = TaskContext.get().partitionId(), encoder(tokenizer)
        bits, tail = max(1, (model.vocabulary - 1).bit_length()), int(end_id).to_bytes(4, "little")
        keys, packed, held, number, before = [], [], 0, 0, 0
        for batch in batches:
            for k, t in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                keys.append(k)
                packed.append(model.encode_packed(t.as_py()))
                held += len(packed[-1]) // 4 + 1
                if held >= block_ids:
                    yield _block(part, number, before, bits, keys, packed, tail)
                    keys, packed, held, number, before = [], [], 0, number + 1, before + held
        if keys:
            yield _block(part, number, before, bits, keys, packed, tail)

    ordered.mapInArrow(run, BLOCK_SCHEMA).write.option("compression", "zstd").parquet(path)


def read_blocks(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(BLOCK_SCHEMA).parquet(path)


def read_documents(spark: SparkSession, path: str, digest: bool = False) -> DataFrame:
    """A row for each document of the files: key, start, n_tokens and its ids, or their crc32.

    start counts the ids of all documents before it. Each part's total (one row per written
    partition, a number fixed when writing) is summed up and sent to every task.
    """
    from pyspark.sql import Window

    blocks = read_blocks(spark, path)
    totals = blocks.groupBy("part").agg(F.max(F.col("before") + F.element_at("ends", -1)).alias("n"))
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = {r["part"]: r["base"] for r in totals.select("part", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("base")).collect()}
    last = "ids_crc32 long" if digest else "ids array<int>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, starts, counts, out = [], [], [], []
            for r in batch.to_pylist():
                base, begin = bases[r["part"]] + r["before"], 0
                for k, end in zip(r["keys"], r["ends"], strict=True):
                    ids = unpack(r["payload"], r["bits"], begin, end)
                    keys.append(k)
                    starts.append(base + begin)
                    counts.append(end - begin)
                    out.append(zlib.crc32(ids.tobytes()) if digest else ids.astype("<i4"))
                    begin = end
            yield pa.RecordBatch.from_arrays(
                [pa.array(keys, pa.int64()), pa.array(starts, pa.int64()), pa.array(counts, pa.int64()), pa.array(out, pa.int64() if digest else pa.list_(pa.int32()))],
                ["doc_id", "start", "n_tokens", "ids_crc32" if digest else "ids"],
            )

    return blocks.mapInArrow(run, f"doc_id long, start long, n_tokens long, {last}")


def digests(docs: DataFrame, tokenizer: str, end_id: int = 2) -> DataFrame:
    """Write the documents' ids to fresh files under the scratch root and report what reading them gives."""
    spark = docs.sparkSession
    path = scratch_path(spark, "token-blocks")
    write_blocks(docs, tokenizer, path, end_id)
    return read_documents(spark, path, digest=True)
