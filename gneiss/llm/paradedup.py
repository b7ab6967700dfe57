"""Substring dedup by MinHash banding of paragraphs.

Paragraphs are lines of ``MIN_LINE`` words or more, and windows of ``RUN_WORDS`` words that no
punctuation or line end marks.

Lines get MinHash signatures over their five-word shingles in ``BANDS`` bands of ``ROWS`` values, so
a pair of similarity 0.75 meets with a probability of 0.99. Colliding lines are verified by their exact
Jaccard similarity and joined to components.

Windows are compared for equality. Anchors are those with the least hash among all windows of some
``SHARED`` consecutive words, so each passage of ``SHARED`` words or more that two documents share has
an anchor in common. Where the stretch between two anchors does not repeat, a repeated passage begins
or ends: there all longer stretches from the anchor on, up to the next possible anchor, are compared
too, so a passage is covered from its first word to its last. (Where a document has a longer passage
in common with a third one, up to ``SHARED - RUN_WORDS`` words at the ends of the shorter may stay.)

Two passes find which bands, anchors and stretches occur twice at all, in bit tables of a fixed size;
only their paragraphs are exchanged. Shingles are not kept: one more pass makes those of the lines that
share a band with a different one. A paragraph that occurs in at least two documents stays where
(doc_id, position) is smallest, and goes from all other places.

Defined results: a null text has no paragraphs; a null id is an id like any other, before all
others; rows equal in id and text count as one document; empty tables give empty results; other
columns are passed on or ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gneiss.llm import bitfilter
from gneiss.llm import textvec as tv
from gneiss.llm.bands import united
from gneiss.llm.storage import discard, materialize, released

WIDTH = 5
PERCENT = 75
MIN_LINE = 20
RUN_WORDS = 24
#: Every run of so many words that documents share is found.
SHARED = 50
BANDS, ROWS = 10, 3
REPEAT_BITS = 27
_U = np.uint64
_RNG = np.random.default_rng(77)
_ODD = _RNG.integers(1, 1 << 63, (BANDS * ROWS,), dtype=np.uint64) * _U(2) + _U(1)
_SEQ = [0xA24BAED4963EE407, 0x9FB21C651E98DF25]


def _sliding(values: np.ndarray, width: int, least: np.ufunc) -> np.ndarray:
    """``least`` over each ``width`` consecutive values."""
    done = 1
    while done < width:
        step = min(done, width - done)
        values = least(values[:-step], values[step:])
        done += step
    return values


class Paragraphs:
    """Lines, windows and stretches of a slice, as word ranges [first, last)."""

    def __init__(self, part: tv.Slice, anchored: bool = True) -> None:
        data = part.data
        self.words = w = tv.words(part, tv.BLANK_SEPARATED)
        n = len(w.starts)
        self.row = np.repeat(np.arange(part.rows), np.diff(w.borders))
        self.row_first = w.borders[:-1][self.row] if n else np.empty(0, np.int64)
        self.row_end = w.borders[1:][self.row] if n else np.empty(0, np.int64)
        # hashes of word sequences by position-independent polynomials, two for 128 bits
        self.sums = []
        for base in _SEQ:
            up = tv._powers(base, n + 1)
            self.sums.append((np.concatenate([np.zeros(1, np.uint64), np.cumsum(w.hashes * up[:n], dtype=np.uint64)]), tv._powers(pow(base, -1, 1 << 64), n + 1)))
        self.windows, self.anchors = self._anchors(n if anchored else 0)
        self.data = data

    def lines(self) -> tuple[np.ndarray, np.ndarray]:
        """Lines of MIN_LINE words or more."""
        w, n = self.words, len(self.words.starts)
        feeds = np.concatenate([[0], np.cumsum(self.data == 10)])
        border = np.ones(n, dtype=bool)
        if n:
            border[1:] = (feeds[w.starts[1:]] != feeds[w.ends[:-1]]) | (self.row[1:] != self.row[:-1])
        first = np.flatnonzero(border)
        size = np.diff(np.append(first, n))
        return first[size >= MIN_LINE], (first + size)[size >= MIN_LINE]

    def keys(self, first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return tuple(tv.mix((c[last] - c[first]) * down[first] + (last - first).astype(np.uint64)) for c, down in self.sums)

    def line_keys(self, first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Keys of lines; a line and a window of the same words are different paragraphs."""
        k1, k2 = self.keys(first, last)
        return k1, k2 ^ _U(1)

    def _anchors(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """The hash of the window at each word, and the windows that are least among those of some SHARED words of a row."""
        if n < SHARED:
            return np.empty(0, np.uint64), np.empty(0, np.int64)
        first = np.arange(n - RUN_WORDS + 1)
        values, span = self.keys(first, first + RUN_WORDS)[0], SHARED - RUN_WORDS + 1
        least = _sliding(values, span, np.minimum)
        starts = np.arange(n - SHARED + 1)
        least[self.row_end[starts] < starts + SHARED] = 0
        edge = np.zeros(span - 1, dtype=np.uint64)
        highest = _sliding(np.concatenate([edge, least, edge]), span, np.maximum)
        return values, np.flatnonzero((values == highest) & (highest > 0))

    def between(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Anchors with a next one so near that a shared passage may hold both, and the stretches over the two."""
        a = self.anchors
        at = np.flatnonzero((np.diff(a) <= SHARED - RUN_WORDS + 1) & (self.row[a[1:]] == self.row[a[:-1]])) if len(a) else np.empty(0, np.int64)
        return at, a[at], a[at + 1] + RUN_WORDS

    def repeated(self, table: bitfilter.RepeatTable) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Windows and stretches to compare, (first, last), by the first table; then those around ends of repeated passages."""
        often = table.may_repeat(self.windows[self.anchors])
        at, first, last = self.between()
        linked = table.may_repeat(self.keys(first, last)[0])
        after, before = np.zeros(len(self.anchors), dtype=bool), np.zeros(len(self.anchors), dtype=bool)
        after[at], before[at + 1] = linked, linked
        own = self.anchors[often]
        wide = linked & (last - first >= 2 * RUN_WORDS)  # windows that do not overlap
        step = np.arange(1, SHARED - RUN_WORDS + 1)
        x, y = self.anchors[often & ~before], self.anchors[often & ~after] + RUN_WORDS
        left, right = (x[:, None] - step).reshape(-1), (y[:, None] + step).reshape(-1)
        x, y = np.repeat(x, len(step)), np.repeat(y, len(step))
        inside, within = left >= (self.row_first[x] if len(x) else 0), right <= (self.row_end[y - 1] if len(y) else 0)
        x, y = x[inside], y[within]
        return np.append(own, first[wide]), np.append(own + RUN_WORDS, last[wide]), np.append(left[inside], y - RUN_WORDS), np.append(x + RUN_WORDS, right[within])

    def bands(self, first: np.ndarray, last: np.ndarray) -> np.ndarray:
        """(lines, BANDS) values; a band holds ROWS least values of differently stirred shingle hashes."""
        if not len(first):
            return np.empty((0, BANDS), dtype=np.uint64)
        # only words of the lines are stirred
        sizes = last - first - WIDTH + 1
        heads = np.concatenate([[0], np.cumsum(sizes)])
        at = np.repeat(first - heads[:-1], sizes) + np.arange(heads[-1])
        grams = self.grams()[at]
        out = np.empty((len(first), BANDS), dtype=np.uint64)
        for b in range(BANDS):
            value = np.full(len(first), b + 1, dtype=np.uint64)
            for r in range(ROWS):
                stirred = grams * _ODD[b * ROWS + r]
                stirred ^= stirred >> _U(29)
                value = tv.mix(value * _U(0x9E3779B97F4A7C15) + np.minimum.reduceat(stirred, heads[:-1]))
            out[:, b] = value
        return out

    def grams(self) -> np.ndarray:
        full = max(len(self.words.hashes) - WIDTH + 1, 0)
        grams = np.zeros(full, dtype=np.uint64)
        for j in range(WIDTH):
            grams += self.words.hashes[j : j + full] * tv._LANE[j]
        return tv.mix(grams)


def _paragraphs(batch: pa.RecordBatch, anchored: bool = True) -> Iterator[tuple[tv.Slice, Paragraphs]]:
    for part in tv.slices(batch.column(batch.schema.get_field_index("text"))):
        yield part, Paragraphs(part, anchored)


def _first_hashes(batch: pa.RecordBatch) -> Iterator[np.ndarray]:
    for _, p in _paragraphs(batch):
        yield p.bands(*p.lines()).reshape(-1)
        yield p.windows[p.anchors]
        yield p.keys(*p.between()[1:])[0]


def _end_hashes(table: bytes) -> Callable[[pa.RecordBatch], Iterator[np.ndarray]]:
    def run(batch: pa.RecordBatch) -> Iterator[np.ndarray]:
        repeats = bitfilter.RepeatTable(table, REPEAT_BITS)
        for _, p in _paragraphs(batch):
            yield p.keys(*p.repeated(repeats)[2:])[0]

    return run


UNITS = "doc_id long, doc long, start int, stop int, n1 long, n2 long, bands array<long>"
SETS = "n1 long, n2 long, shingles array<long>"


def find_units(docs: DataFrame, table: bytes, ends: bytes) -> DataFrame:
    """Paragraphs that may occur twice; bands are null for all but lines."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        repeats, ended = bitfilter.RepeatTable(table, REPEAT_BITS), bitfilter.RepeatTable(ends, REPEAT_BITS)
        for batch in batches:
            ids = batch.column(0)
            for part, p in _paragraphs(batch):
                la, lb = p.lines()
                bands = p.bands(la, lb)
                often = repeats.may_repeat(bands.reshape(-1)).reshape(bands.shape)
                lines = often.any(axis=1)
                la, lb, bands, often = la[lines], lb[lines], bands[lines], often[lines]
                wa, wb, ea, eb = p.repeated(repeats)
                real = ended.may_repeat(p.keys(ea, eb)[0])
                a, b = np.concatenate([la, wa, ea[real]]), np.concatenate([lb, wb, eb[real]])
                if not len(a):
                    continue
                k1, k2 = p.keys(a, b)
                k1[: len(la)], k2[: len(la)] = p.line_keys(la, lb)
                row = p.row[a]
                used, at = np.unique(row, return_inverse=True)
                own = [int.from_bytes(hashlib.blake2b(part.data[part.offsets[r] : part.offsets[r + 1]].tobytes(), digest_size=8).digest(), "little", signed=True) for r in used]
                none = pa.nulls(len(a) - len(la), pa.list_(pa.int64()))
                columns = [
                    ids.take(pa.array(row + part.first)), pa.array(own, pa.int64()).take(pa.array(at)),
                    pa.array((p.words.starts[a] - part.offsets[row]).astype(np.int32)), pa.array((p.words.ends[b - 1] - part.offsets[row]).astype(np.int32)),
                    pa.array(k1.view(np.int64)), pa.array(k2.view(np.int64)),
                    pa.concat_arrays([pa.array([x[y].view(np.int64) for x, y in zip(bands, often, strict=True)], pa.list_(pa.int64())), none]),
                ]
                yield pa.RecordBatch.from_arrays(columns, [x.split()[0] for x in UNITS.split(", ")])

    return docs.mapInArrow(released(run), UNITS)


def find_sets(docs: DataFrame, wanted: bytes) -> DataFrame:
    """Shingles of lines whose n1 may be in the bit table ``wanted``; copies in a slice once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = bitfilter.BitFilter(wanted)
        for batch in batches:
            for _, p in _paragraphs(batch, anchored=False):
                first, last = p.lines()
                k1, k2 = p.line_keys(first, last)
                at = np.unique(np.stack([k1, k2]), axis=1, return_index=True)[1]
                at = at[bits.may_hold(pa.array(k1[at].view(np.int64)))]
                if not len(at):
                    continue
                grams = p.grams()
                sets = [tv.distinct(grams[x : y - WIDTH + 1]).view(np.int64) for x, y in zip(first[at], last[at], strict=True)]
                columns = [pa.array(k1[at].view(np.int64)), pa.array(k2[at].view(np.int64)), pa.array(sets, pa.list_(pa.int64()))]
                yield pa.RecordBatch.from_arrays(columns, [x.split()[0] for x in SETS.split(", ")])

    return docs.mapInArrow(released(run), SETS)


def find_repeats(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Each occurrence of a paragraph that several documents have: doc_id, doc (a hash of the text), start, stop (bytes), first_doc_id, removed."""
    spark = docs.sparkSession
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    rows = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    table = bitfilter.repeated(rows.select("text"), _first_hashes, parts, REPEAT_BITS)
    ends = bitfilter.repeated(rows.select("text"), _end_hashes(table), parts, REPEAT_BITS)
    units = materialize(find_units(rows, table, ends), "paragraphs")
    node = F.struct("n1", "n2").alias("node")
    lines = units.where("bands is not null").groupBy(node).agg(F.first("bands").alias("bands"))
    lines = materialize(lines, "paragraph-lines")
    posted = lines.select("node", F.explode(F.array_distinct("bands")).alias("band"))

    def sets(wanted: DataFrame) -> DataFrame:
        found = find_sets(rows.select("text"), bitfilter.build(wanted.select("node.n1"))).select(node, "shingles").join(wanted, "node", "left_semi")
        return found.groupBy("node").agg(F.first("shingles").alias("shingles"))

    roots = united(posted, sets, PERCENT)
    discard(lines)
    columns = ["doc_id", "doc", "start", "stop"]
    named = roots.select(F.col("node.n1").alias("n1"), F.col("node.n2").alias("n2"), F.col("root.n1").alias("r1"), F.col("root.n2").alias("r2"))
    placed = units.where("bands is not null").select(*columns, "n1", "n2").join(named, ["n1", "n2"], "left").select(*columns, F.coalesce("r1", "n1").alias("n1"), F.coalesce("r2", "n2").alias("n2"))
    placed = placed.unionByName(units.where("bands is null").select(*columns, "n1", "n2"))
    document, place = F.xxhash64("doc_id", "doc"), F.struct("doc_id", "doc", "start")
    groups = placed.groupBy("n1", "n2").agg(F.min(document).alias("x"), F.max(document).alias("y"), F.min(place).alias("keeper")).where("x != y")
    out = placed.join(groups.select("n1", "n2", "keeper"), ["n1", "n2"])
    return out.select(*columns, F.col("keeper.doc_id").alias("first_doc_id"), (~place.eqNullSafe(F.col("keeper"))).alias("removed"))


def passages(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Overlapping repeated paragraphs of a document as one row: doc_id, start, stop (bytes), removed, first_doc_id, n_paragraphs.

    first_doc_id is the smallest id of a document that keeps a part of the passage.
    """
    found = find_repeats(docs, key, text)
    line = Window.partitionBy("doc_id", "doc", "removed").orderBy("start", "stop")
    reach = F.max("stop").over(line.rowsBetween(Window.unboundedPreceding, -1))
    marked = found.withColumn("fresh", F.coalesce((F.col("start") > reach).cast("int"), F.lit(1)))
    numbered = marked.withColumn("passage", F.sum("fresh").over(line.rowsBetween(Window.unboundedPreceding, 0)))
    merged = numbered.groupBy("doc_id", "doc", "removed", "passage").agg(
        F.min("start").alias("start"), F.max("stop").alias("stop"), F.min("first_doc_id").alias("first_doc_id"), F.count(F.lit(1)).alias("n_paragraphs")
    )
    return merged.select("doc_id", "start", "stop", "removed", "first_doc_id", "n_paragraphs")


def remove_passages(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` without the removed passages; texts are cut at word borders."""
    gone = passages(docs, key, text).where("removed").groupBy(F.col("doc_id").alias("_gneiss_id")).agg(F.sort_array(F.collect_list(F.struct("start", "stop"))).alias("_gneiss_spans"))
    joined = docs.join(gone, F.col(key).cast("long").eqNullSafe(F.col("_gneiss_id")), "left").drop("_gneiss_id")
    at, names = docs.columns.index(text), docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for t, spans in zip(batch.column(at).to_pylist(), batch.column(len(names)).to_pylist(), strict=True):
                raw, done, kept = (t or "").encode(), 0, []
                for s in spans or []:
                    kept.append(raw[done : s["start"]])
                    done = max(done, s["stop"])
                out.append(None if t is None else (b"".join([*kept, raw[done:]])).decode("utf-8", "replace"))
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.string()) if i == at else batch.column(i) for i in range(len(names))], names)

    return joined.mapInArrow(run, docs.schema)
