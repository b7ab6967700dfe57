"""Removal of repeated byte strings with suffix sorting by difference covers.

A byte goes if a string of ``LENGTH`` bytes that covers it also starts anywhere else.

Sorting every suffix of a corpus would move many times its size, so the suffixes are first dealt
by content: every string of LENGTH bytes is assigned to its anchor, the position of its least
K-gram hash (rightmost in a tie), so equal strings have equal anchors at equal offsets. Strings of
an anchor that occurs once are unique. The text around every other anchor is its context; equal
contexts are merged before the exchange, and all contexts of an anchor meet in one task. Where
they differ, their suffixes are sorted by the difference-cover algorithm (sort triples at
positions not divisible by three, recurse on their names until all differ, merge the rest) and neighbours in that order are compared over their first LENGTH bytes.

Defined results: a null text is the empty text; nothing goes from texts shorter than LENGTH;
repeated rows and copies are each other's repeats, so all their bytes go.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gneiss.llm import bitfilter
from gneiss.llm import textvec as tv
from gneiss.llm.storage import materialize, released

LENGTH = 200
K = 50
#: Longer texts are worked on in pieces of this many windows.
PIECE = 1 << 20
ANCHOR_BITS = 27
#: Bytes of contexts that a task holds before it sends them.
HELD_BYTES = 4 << 20
#: Bytes of contexts that are sorted at a time (a larger group of one anchor is sorted whole).
SORT_BYTES = 400_000
_U = np.uint64


# -- suffix sorting ---------------------------------------------------------------------------


def _dense(columns: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, bool]:
    """Order of the rows, their dense ranks from 1 on, and whether all rows differ."""
    bits = [max(1, int(c.max()).bit_length()) if len(c) else 1 for c in columns]
    if sum(bits) <= 63:
        key = np.zeros(len(columns[0]), dtype=np.int64)
        for c, b in zip(columns, bits, strict=True):
            key = (key << b) | c
        order = np.argsort(key, kind="stable")
        ranked = key[order]
        fresh = ranked[1:] != ranked[:-1]
    else:
        order = np.lexsort(columns[::-1])
        fresh = np.zeros(max(len(order) - 1, 0), dtype=bool)
        for c in columns:
            ranked = c[order]
            fresh |= ranked[1:] != ranked[:-1]
    ranks = np.empty(len(order), dtype=np.int64)
    ranks[order] = np.concatenate([[1], 1 + np.cumsum(fresh)])[: len(order)]
    return order, ranks, bool(fresh.all())


def _below(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """For each row of ``right``, how many rows of ``left`` (in ascending order) come before it."""
    n = len(left[0])
    _, ranks, _ = _dense([np.concatenate([a, b]) for a, b in zip(left, right, strict=True)])
    return np.searchsorted(ranks[:n], ranks[n:], side="left")


def suffix_order(symbols: np.ndarray) -> np.ndarray:
    """Positions of ``symbols`` (positive integers) in the order of their suffixes."""
    n = len(symbols)
    if n < 3:
        return np.array(sorted(range(n), key=lambda i: symbols[i:].tolist()), dtype=np.int64)
    s = np.concatenate([symbols.astype(np.int64), np.zeros(3, dtype=np.int64)])
    one, two = np.arange(1, n + (n % 3 == 1), 3), np.arange(2, n, 3)
    cover = np.concatenate([one, two])
    order, names, unique = _dense([s[cover], s[cover + 1], s[cover + 2]])
    if not unique:
        order = suffix_order(names)
        names = np.empty(len(cover), dtype=np.int64)
        names[order] = np.arange(1, len(cover) + 1)
    rank = np.zeros(n + 4, dtype=np.int64)
    rank[cover] = names
    ranked = cover[order]
    ranked = ranked[ranked < n]
    rest = np.arange(0, n, 3)
    rest = rest[_dense([s[rest], rank[rest + 1]])[0]]
    first, second = ranked[ranked % 3 == 1], ranked[ranked % 3 == 2]
    ahead = _below([s[first], rank[first + 1]], [s[rest], rank[rest + 1]])
    ahead = ahead + _below([s[second], s[second + 1], rank[second + 2]], [s[rest], s[rest + 1], rank[rest + 2]])
    out = np.empty(n, dtype=np.int64)
    at = ahead + np.arange(len(rest))
    out[at] = rest
    others = np.ones(n, dtype=bool)
    others[at] = False
    out[others] = ranked
    return out


def repeated_windows(contexts: list[bytes], length: int = LENGTH) -> list[np.ndarray]:
    """For each context, which of its windows of ``length`` bytes occur in another place of any."""
    sizes = np.array([len(c) for c in contexts])
    text = np.frombuffer(b"\0".join(contexts) + b"\0", dtype=np.uint8)
    heads = np.concatenate([[0], np.cumsum(sizes + 1)])[:-1]
    # each context ends in a symbol of its own, so no suffixes are equal for long
    symbols = text.astype(np.int64) + len(contexts) + 1
    symbols[heads + sizes] = np.arange(1, len(contexts) + 1)
    starts = np.zeros(len(text), dtype=bool)
    for h, m in zip(heads, sizes, strict=True):
        starts[h : h + max(0, m - length + 1)] = True
    order = suffix_order(symbols)
    order = order[starts[order]]
    windows = np.ndarray((max(0, len(text) - length + 1),), dtype=f"V{length}", buffer=text.tobytes(), strides=(1,))
    same = np.zeros(max(len(order) - 1, 0), dtype=bool)
    for a in range(0, len(same), 50_000):
        part = windows[order[a : a + 50_001]]
        same[a : a + len(part) - 1] = part[1:] == part[:-1]
    twice = np.zeros(len(text), dtype=bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    return [twice[h : h + max(0, m - length + 1)] for h, m in zip(heads, sizes, strict=True)]


# -- anchors ----------------------------------------------------------------------------------


def anchors(data: np.ndarray, offsets: np.ndarray, length: int = LENGTH, k: int = K) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(row, anchor hash, first window, last window, inner) of each run of windows with one anchor hash.

    Windows are positions in ``data``. A run is inner if its anchor stands in several places, as in
    periodic text, so that its own windows may be equal.
    """
    none = np.empty(0, np.int64)
    nothing = none, np.empty(0, np.uint64), none, none, np.empty(0, bool)
    n = len(data)
    if n < length:
        return nothing
    h = tv.hash_windows(data, k)
    span, low = length - k + 1, _U(24)
    least = (h >> low << low) | (_U((1 << 24) - 1) - np.arange(len(h), dtype=np.uint64) % _U(1 << 24))
    width = 1
    while width * 2 <= span:
        least = np.minimum(least[:-width], least[width:])
        width *= 2
    if width < span:
        least = np.minimum(least[: len(least) - (span - width)], least[span - width :])
    place = ((1 << 24) - 1 - (least & _U((1 << 24) - 1)).astype(np.int64))
    row = np.searchsorted(offsets, np.arange(len(place)), side="right") - 1
    good = np.flatnonzero(np.arange(len(place)) + length <= offsets[row + 1])
    if not len(good):
        return nothing
    place, row = place[good], row[good]
    own = h[place]
    fresh = np.flatnonzero(np.concatenate([[True], (own[1:] != own[:-1]) | (row[1:] != row[:-1]) | (good[1:] != good[:-1] + 1)]))
    stops = np.concatenate([fresh[1:], [len(good)]]) - 1
    # least hashes are small numbers; stirred again they spread evenly over ranges and bit tables
    return row[fresh], tv.mix(own[fresh]), good[fresh], good[stops], place[fresh] != place[stops]


def _pieces(part: tv.Slice) -> Iterator[tuple[int, tv.Slice, int]]:
    """(row shift, slice, byte shift): a slice as it is, or the pieces of one long text."""
    if len(part.data) <= 4 * PIECE:
        yield 0, part, 0
        return
    for r in range(part.rows):
        a, b = part.offsets[r], part.offsets[r + 1]
        for start in range(0, max(1, b - a), PIECE):
            own = part.data[a + start : min(b, a + start + PIECE + LENGTH - 1)]
            yield r, tv.Slice(part.first + r, own, np.array([0, len(own)])), start


def _ranges(hashes: np.ndarray, parts: int) -> np.ndarray:
    return ((hashes >> _U(32)) * _U(parts) >> _U(32)).astype(np.int32)


def _anchor_hashes(batch: pa.RecordBatch) -> Iterator[np.ndarray]:
    for part in tv.slices(batch.column(0)):
        for _, piece, _ in _pieces(part):
            _, hashes, _, _, inner = anchors(piece.data, piece.offsets)
            yield np.concatenate([hashes, hashes[inner]])


FOUND = "range int, key binary, at long, context binary, anchor long, twice boolean, inner boolean, body binary"


def find_contexts(docs: DataFrame, parts: int, table: bytes) -> DataFrame:
    """Places (key, at, context) of contexts of repeated anchors, and each task's distinct contexts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = bitfilter.RepeatTable(table, ANCHOR_BITS)
        bodies: dict[bytes, list] = {}
        known: set[bytes] = set()
        size = 0

        def places(keys: list, ats: list, names: list) -> pa.RecordBatch:
            n = len(keys)
            cols = [pa.nulls(n, pa.int32()), pa.array(keys, pa.binary()), pa.array(ats, pa.int64()), pa.array(names, pa.binary()), pa.nulls(n, pa.int64()), pa.nulls(n, pa.bool_()), pa.nulls(n, pa.bool_()), pa.nulls(n, pa.binary())]
            return pa.RecordBatch.from_arrays(cols, [x.split()[0] for x in FOUND.split(", ")])

        def contexts() -> Iterator[pa.RecordBatch]:
            items = list(bodies.items())
            for a in range(0, len(items), 5_000):
                some = items[a : a + 5_000]
                n = len(some)
                hashes = np.array([v[0] for _, v in some], dtype=np.uint64)
                cols = [pa.array(_ranges(hashes, parts)), pa.nulls(n, pa.binary()), pa.nulls(n, pa.int64()), pa.array([k for k, _ in some], pa.binary())]
                cols += [pa.array(hashes.view(np.int64)), pa.array([v[1] for _, v in some], pa.bool_()), pa.array([v[2] for _, v in some], pa.bool_()), pa.array([v[3] for _, v in some], pa.binary())]
                yield pa.RecordBatch.from_arrays(cols, [x.split()[0] for x in FOUND.split(", ")])

        for batch in batches:
            for part in tv.slices(batch.column(0)):
                keys, ats, names = [], [], []
                own = [hashlib.blake2b(part.data[a:b].tobytes(), digest_size=16).digest() for a, b in zip(part.offsets[:-1], part.offsets[1:], strict=True)]
                for shift, piece, ahead in _pieces(part):
                    row, h, first, last, inner = anchors(piece.data, piece.offsets)
                    hit = np.flatnonzero(bits.may_repeat(h))
                    raw = piece.data.tobytes()
                    for r, v, a, b, own_again in zip(*(x[hit].tolist() for x in (row, h, first, last, inner)), strict=True):
                        body = raw[a : b + LENGTH]
                        name = hashlib.blake2b(body, digest_size=16).digest()
                        if own[r + shift] not in known:
                            keys.append(own[r + shift])
                            ats.append(a - int(piece.offsets[r]) + ahead)
                            names.append(name)
                        old = bodies.get(name)
                        if old is None:
                            bodies[name] = [v, False, own_again, body]
                            size += len(body)
                        else:
                            old[1] = True
                known.update(own)
                if keys:
                    yield places(keys, ats, names)
                if size > HELD_BYTES:
                    yield from contexts()
                    bodies.clear()
                    size = 0
        yield from contexts()

    return docs.select("text").mapInArrow(released(run), FOUND)


def mark_repeats(contexts: DataFrame, parts: int) -> DataFrame:
    """(context, spans): runs of bytes of a context that lie in repeated windows, as start, stop, start, stop ..."""

    def is_open(g: list[tuple[bytes, bool, bool, bytes]]) -> bool:
        return len(g) > 1 or (g[0][2] and not g[0][1])

    def settle(groups: list[list[tuple[bytes, bool, bool, bytes]]]) -> Iterator[tuple[bytes, list[int]]]:
        mixed = [x for g in groups if is_open(g) for x in g]
        marks = dict(zip((x[0] for x in mixed), repeated_windows([x[3] for x in mixed]), strict=True)) if mixed else {}
        for g in groups:
            for name, twice, _, body in g:
                if twice:
                    yield name, [0, len(body)]
                elif name in marks and marks[name].any():
                    w = np.concatenate([[0], marks[name].astype(np.int8), [0]])
                    edges = np.flatnonzero(np.diff(w))
                    starts, stops = edges[::2], edges[1::2] - 1 + LENGTH
                    out: list[int] = []
                    for a, b in zip(starts.tolist(), stops.tolist(), strict=True):
                        if out and a <= out[-1]:
                            out[-1] = b
                        else:
                            out += [a, b]
                    yield name, out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[bytes, list] = {}
        for batch in batches:
            for name, anchor, twice, inner, body in zip(*(batch.column(c).to_pylist() for c in ("context", "anchor", "twice", "inner", "body")), strict=True):
                old = seen.get(name)
                if old is None:
                    seen[name] = [anchor, twice, inner, body]
                else:
                    old[1] = True
        groups: dict[int, list] = {}
        for name, (anchor, twice, inner, body) in seen.items():
            groups.setdefault(anchor, []).append((name, twice, inner, body))
        seen.clear()

        def send(rows: list) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.binary()), pa.array([r[1] for r in rows], pa.list_(pa.int32()))], ["context", "spans"])

        held, size = [], 0
        for anchor in sorted(groups):
            g = groups[anchor]
            held.append(g)
            size += sum(len(x[3]) for x in g) if is_open(g) else 0
            if size >= SORT_BYTES or len(held) >= 20_000:
                yield send(list(settle(held)))
                held, size = [], 0
        if held:
            yield send(list(settle(held)))

    rows = contexts.where("body is not null").select("range", "context", "anchor", "twice", "inner", "body")
    return rows.repartitionById(parts, F.col("range")).mapInArrow(released(run), "context binary, spans array<int>")


def repeated_spans(docs: DataFrame, text: str = "text") -> DataFrame:
    """(key, spans) of each distinct text with repeated strings: sorted spans as start, stop, start, stop ..."""
    spark = docs.sparkSession
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    rows = docs.select(F.col(text).cast("string").alias("text"))
    found = materialize(find_contexts(rows, parts, bitfilter.repeated(rows, _anchor_hashes, parts, ANCHOR_BITS)), "suffix-contexts")
    marks = mark_repeats(found, parts)
    places = found.where("key is not null").select("key", "at", "context").distinct()
    pieces = places.join(marks, "context").select("key", F.transform("spans", lambda x: x + F.col("at")).alias("spans"))
    merged = pieces.groupBy("key").agg(F.flatten(F.collect_list("spans")).alias("spans"))

    def unite(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for spans in batch.column(1):
                pairs = np.asarray(spans.values, dtype=np.int64).reshape(-1, 2)
                pairs = pairs[np.argsort(pairs[:, 0], kind="stable")]
                reach = np.maximum.accumulate(pairs[:, 1])
                fresh = np.concatenate([[True], pairs[1:, 0] > reach[:-1]])
                heads = np.flatnonzero(fresh)
                stops = reach[np.concatenate([heads[1:], [len(pairs)]]) - 1]
                out.append(np.stack([pairs[heads, 0], stops], axis=1).reshape(-1))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.list_(pa.int64()))], ["key", "spans"])

    return merged.mapInArrow(released(unite), "key binary, spans array<long>")


def _keyed(docs: DataFrame, text: str) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = [hashlib.blake2b((t.as_py() or "").encode(), digest_size=16).digest() for t in batch.column(text)]
            marks = [int.from_bytes(k[:8], "little", signed=True) for k in keys]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(keys, pa.binary()), pa.array(marks, pa.int64())], [*batch.schema.names, "_gneiss_key", "_gneiss_mark"])

    return docs.mapInArrow(released(run), docs.select("*", F.lit(None).cast("binary").alias("_gneiss_key"), F.lit(None).cast("long").alias("_gneiss_mark")).schema)


def with_spans(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with a column ``_gneiss_spans`` (null: nothing repeats), the last.

    Only texts that may have spans, by a bit table over their keys, take part in the join.
    """
    spans = materialize(repeated_spans(docs, text), "suffix-spans")

    def marks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [int.from_bytes(k.as_py()[:8], "little", signed=True) for k in batch.column(0)]
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.int64())], ["mark"])

    table = bitfilter.build(spans.select("key").mapInArrow(released(marks), "mark long"))
    keyed = _keyed(docs, text)
    found = spans.select(F.col("key").alias("_gneiss_key"), F.col("spans").alias("_gneiss_spans"))
    some = bitfilter.split(keyed, "_gneiss_mark", table, True).join(found, "_gneiss_key", "left")
    rest = bitfilter.split(keyed, "_gneiss_mark", table, False).withColumn("_gneiss_spans", F.lit(None).cast("array<long>"))
    return some.select(*rest.columns).unionByName(rest).drop("_gneiss_key", "_gneiss_mark")


def _cut(raw: bytes, spans: list[int] | None) -> bytes:
    if not spans:
        return raw
    ends = [0, *spans, len(raw)]
    return b"".join(raw[a:b] for a, b in zip(ends[::2], ends[1::2], strict=True))


def report(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: doc_id, n_bytes, n_removed, n_spans, kept_sha256."""
    rows = with_spans(docs.select(F.col(key).alias("doc_id"), F.col(text).alias("text")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, gone, count, sums = [], [], [], []
            for t, s in zip(batch.column(1), batch.column(2), strict=True):
                raw, spans = (t.as_py() or "").encode(), s.as_py()
                kept = _cut(raw, spans)
                n.append(len(raw))
                gone.append(len(raw) - len(kept))
                count.append(len(spans) // 2 if spans else 0)
                sums.append(hashlib.sha256(kept).hexdigest())
            cols = [batch.column(0), *(pa.array(x, pa.int64()) for x in (n, gone, count)), pa.array(sums, pa.string())]
            yield pa.RecordBatch.from_arrays(cols, ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    head = rows.select("doc_id").schema.simpleString()[len("struct<") : -1].replace(":", " ")
    return rows.select("doc_id", "text", "_gneiss_spans").mapInArrow(released(run), f"{head}, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def remove_repeats(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with repeated bytes cut out of ``text``; a character cut in half becomes U+FFFD."""
    names = docs.columns
    rows = with_spans(docs, text)
    at = names.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [None if t.as_py() is None else _cut(t.as_py().encode(), s.as_py()).decode("utf-8", "replace") for t, s in zip(batch.column(at), batch.column(len(names)), strict=True)]
            columns = [pa.array(out, pa.string()) if i == at else batch.column(i) for i in range(len(names))]
            yield pa.RecordBatch.from_arrays(columns, names)

    return rows.select(*names, "_gneiss_spans").mapInArrow(released(run), docs.schema)
