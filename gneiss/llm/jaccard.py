"""Exact Jaccard self-join of documents on word n-grams, and its components.

All sets have one order of tokens: those of a single set first, as far as a bit table of fixed size
can tell, then rare ones by hash, then frequent ones by count. Two sets with similarity t or more
share a token among the first n - ceil(t * n) + 1 tokens of each, and k tokens among the first
n - ceil(t * n) + k. If the first token that they share is rare, they meet in its list. If it is
frequent, so are all others that they share, and they meet in the list of their first two: so sets
are indexed by single rare tokens of their prefixes, and by combinations of two frequent tokens of
their extended prefixes. Sets of more than ``LONG`` tokens, whose combinations would be too many,
are indexed by single frequent tokens instead; sets near that size by both.

1. Count every token of every document: tasks exchange sorted runs of hashes by ranges.
2. Exchange the indexed tokens and combinations the same way. Two members of a list are a
   candidate only if their sizes and the tokens that come after the listed ones leave room for the
   overlap that they need. A rare token's list is short by definition and gives all its candidates;
   other lists may be of any length, give each member's candidate pair with a centre, and are kept.
3. Candidates are verified exactly, and true links joined to components.
4. Lists that still hold several components: their members are held against a few pivots of other
   components, chosen by a hash that changes each round, as long as that joins many. The candidates
   across components that are left then are verified as well.

Copies share one set and are handled as one. Links inside a component are not all listed, but
every candidate pair is either verified or already connected.

Defined results: a text without words is an empty set, linked with nothing; a null id stands for a
row of its own; repeated rows form one class; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gneiss.llm import bitfilter
from gneiss.llm import textvec as tv
from gneiss.llm.components import connected
from gneiss.llm.storage import discard, materialize, released, trim

WIDTH = 5
PERCENT = 75
#: A token is frequent from this many sets on; no more than so many tokens, the most frequent, are sent to all tasks.
FREQUENT = 64
FREQUENT_KEPT = 1 << 20
#: Lists of rare tokens up to this length are compared pair by pair; longer ones, as tokens beyond FREQUENT_KEPT may have, are treated as those of frequent tokens.
SHORT_LIST = 128
#: Sets of up to so many tokens are indexed by combinations of frequent tokens, larger ones by single ones: a set then has at most four times as many entries as tokens.
LONG = 64
#: Bytes of text for each range of tokens, at most.
RANGE_BYTES = 8 << 20
#: Pivots of a list in later rounds; the first has one, as it joins most.
PIVOTS = 6
#: Earlier lists of its set that a row knows when what is left is compared.
EARLIER = 32
#: Tokens that a task holds before it sends its runs.
HELD_TOKENS = 600_000
COUNT_BITS = 40
#: Bits of the table of tokens that more than one set has.
SHARED_BITS = 27
_U = np.uint64


def required(n: int, percent: int = PERCENT) -> int:
    """The least overlap of a set of n tokens with any set as similar as asked for."""
    return -(-n * percent // 100)


def set_key(tokens: np.ndarray) -> bytes:
    return hashlib.blake2b(tokens.tobytes(), digest_size=16).digest()


def _sets(batch: pa.RecordBatch, width: int) -> Iterator[tuple[int, np.ndarray]]:
    for part in tv.slices(batch.column(1)):
        w = tv.words(part, tv.BLANK_SEPARATED)
        h, borders = tv.shingles(w.hashes, w.borders, width)
        for r, tokens in enumerate(tv.sorted_sets(h, borders)):
            yield part.first + r, tokens


def _ranges(tokens: np.ndarray, parts: int) -> np.ndarray:
    return ((tokens >> _U(32)) * _U(parts) >> _U(32)).astype(np.int64)


class Order:
    """The common order of tokens: of one set only, of a few sets by hash, of many sets by count."""

    def __init__(self, shared: bytes, frequent: np.ndarray, counts: np.ndarray) -> None:
        order = np.argsort(frequent)
        self.shared, self.frequent, self.counts = shared, frequent[order], counts[order]
        self.table: np.ndarray | None = None

    def __getstate__(self) -> dict:
        return self.__dict__ | {"table": None}

    def is_shared(self, tokens: np.ndarray) -> np.ndarray:
        """False for tokens that surely no second set has."""
        if self.table is None:
            self.table = np.frombuffer(zlib.decompress(self.shared), np.uint8)
        at = (tokens >> _U(64 - SHARED_BITS)).astype(np.int64)
        return (self.table[at >> 3] >> (7 - (at & 7)).astype(np.uint8)) & 1 == 1

    def split(self, tokens: np.ndarray) -> tuple[int, np.ndarray, np.ndarray]:
        """How many tokens surely no other set has, which stand first; the rare others; the frequent ones, all in order."""
        shared = tokens[self.is_shared(tokens)]
        lone = len(tokens) - len(shared)
        if not len(self.frequent):
            return lone, shared, shared[:0]
        short = shared >> _U(64 - COUNT_BITS)
        at = np.minimum(np.searchsorted(self.frequent, short), len(self.frequent) - 1)
        often = self.frequent[at] == short
        rest = shared[often]
        return lone, shared[~often], rest[np.lexsort((rest, self.counts[at[often]]))]

    def entries(self, tokens: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray, int]:
        """What a set is indexed by: names, the overlap that each leaves room for, and how many of them are single rare tokens (they come first)."""
        n = len(tokens)
        one = n - required(n, percent) + 1
        lone, rare, often = self.split(tokens)
        take = max(0, min(len(rare), one - lone))
        names, room = [rare[:take]], [n - lone - np.arange(take)]
        before = lone + len(rare)
        firsts = min(len(often), max(0, one - before))
        if firsts and percent * n <= 100 * LONG:
            i, j = np.triu_indices(min(len(often), one + 1 - before), 1)
            i, j = i[i < firsts], j[i < firsts]
            names.append(tv.mix(often[i] * tv._LANE[0] + often[j] * tv._LANE[1]))
            room.append(n - before - j + 1)
        if firsts and n > LONG:
            names.append(often[:firsts])
            room.append(n - before - np.arange(firsts))
        return np.concatenate(names), np.concatenate(room), take


def _by_range(df: DataFrame, parts: int) -> DataFrame:
    return df.repartitionById(parts, F.col("range"))


PASS_ONE = "range int, doc_id long, n int, key binary, blob binary, token long, count long, bits binary"


def _row(names: str, rows: int, /, **columns: pa.Array) -> pa.RecordBatch:
    kinds = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary()}
    fields = [x.split() for x in names.split(", ")]
    return pa.RecordBatch.from_arrays([columns[k] if k in columns else pa.nulls(rows, kinds[t]) for k, t in fields], [k for k, _ in fields])


def count_tokens(docs: DataFrame, parts: int, width: int) -> DataFrame:
    """Rows of the documents (doc_id, n, key), of the frequent tokens (token, count), and bits of the shared ones."""

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, seen = [], 0, set()

        def runs() -> Iterator[pa.RecordBatch]:
            tokens = np.sort(np.concatenate(held)) if held else np.empty(0, np.uint64)
            if not len(tokens):
                return
            short = tokens >> _U(64 - COUNT_BITS)
            bounds = np.searchsorted(_ranges(tokens, parts), np.arange(parts + 1))
            out = []
            for a, b in zip(bounds[:-1], bounds[1:], strict=True):
                steps = np.diff(short[a:b], prepend=short[a : a + 1]).astype("<u8").view(np.uint8).reshape(-1, 8)[:, :5]
                head = int(short[a]).to_bytes(8, "little") if b > a else b""
                out.append(zlib.compress(head + np.ascontiguousarray(steps.T).tobytes(), 1))
            yield _row(PASS_ONE, parts, range=pa.array(np.arange(parts), pa.int32()), blob=pa.array(out, pa.binary()))

        for batch in batches:
            ids, ns, keys = batch.column(0), [], []
            for _, tokens in _sets(batch, width):
                ns.append(len(tokens))
                keys.append(set_key(tokens))
                if keys[-1] not in seen and len(tokens):
                    seen.add(keys[-1])
                    held.append(tokens)
                    size += len(tokens)
                    if size >= HELD_TOKENS:
                        yield from runs()
                        held, size = [], 0
            spread = np.frombuffer(b"".join(k[:4] for k in keys), "<u4") % parts
            yield _row(PASS_ONE, len(ns), range=pa.array(spread.astype(np.int32)), doc_id=ids, n=pa.array(ns, pa.int32()), key=pa.array(keys, pa.binary()))
        yield from runs()

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = []
        for batch in batches:
            blobs = batch.column("blob")
            yield batch.filter(blobs.is_null())
            for blob in blobs.drop_null():
                raw = zlib.decompress(blob.as_py())
                if raw:
                    wide = np.zeros(((len(raw) - 8) // 5, 8), dtype=np.uint8)
                    wide[:, :5] = np.frombuffer(raw, np.uint8, offset=8).reshape(5, -1).T
                    steps = wide.reshape(-1).view("<u8").copy()
                    steps[0] = np.frombuffer(raw, "<u8", 1)[0]
                    held.append(np.cumsum(steps, dtype=np.uint64))
        if held:
            tokens = np.sort(np.concatenate(held))
            edges = np.flatnonzero(np.concatenate([[True], tokens[1:] != tokens[:-1], [True]]))
            counts = np.diff(edges)
            often = counts >= FREQUENT
            token, count = tokens[edges[:-1]][often], counts[often]
            yield _row(PASS_ONE, len(token), token=pa.array(token.astype(np.int64)), count=pa.array(count.astype(np.int64)))
            places = tokens[edges[:-1]][counts > 1] >> _U(COUNT_BITS - SHARED_BITS)
            steps = np.diff(np.unique(places), prepend=_U(0)).astype("<u4")
            yield _row(PASS_ONE, 1, bits=pa.array([zlib.compress(steps.tobytes(), 1)], pa.binary()))

    return _by_range(docs.mapInArrow(released(send), PASS_ONE), parts).mapInArrow(released(gather), PASS_ONE)


LISTS = "range int, blob binary, list long, key binary, n int, room int"
CANDIDATES = "a binary, b binary, list long, key binary, n int, room int"


def _posting_blobs(names: list[np.ndarray], rooms: list[np.ndarray], keys: list[bytes], sizes: list[int], parts: int) -> tuple[list[int], list[bytes]]:
    flat, room = np.concatenate(names), np.concatenate(rooms)
    node = np.repeat(np.arange(len(keys), dtype=np.uint32), [len(t) for t in names])
    order = np.argsort(flat)
    flat, room, node = flat[order], room[order], node[order]
    bounds = np.searchsorted(_ranges(flat, parts), np.arange(parts + 1))
    table = np.frombuffer(b"".join(keys), np.uint8).reshape(-1, 16)
    size = np.array(sizes, dtype="<u4")
    ranges, blobs = [], []
    for r, (a, b) in enumerate(zip(bounds[:-1], bounds[1:], strict=True)):
        if b > a:
            used, local = np.unique(node[a:b], return_inverse=True)
            head = np.array([b - a, len(used)], dtype="<u4").tobytes()
            blobs.append(head + flat[a:b].astype("<u8").tobytes() + local.astype("<u4").tobytes() + room[a:b].astype("<u4").tobytes() + table[used].tobytes() + size[used].tobytes())
            ranges.append(r)
    return ranges, blobs


def _read_blob(raw: bytes) -> list[np.ndarray]:
    m, k = (int(x) for x in np.frombuffer(raw, "<u4", 2))
    out, at = [], 8
    for kind, rows in (("<u8", m), ("<u4", m), ("<u4", m), ("S16", k), ("<u4", k)):
        out.append(np.frombuffer(raw, kind, rows, at))
        at += rows * np.dtype(kind).itemsize
    return out


def index_prefixes(docs: DataFrame, parts: int, width: int, percent: int, order: Order) -> DataFrame:
    """Blobs of rare tokens for each range, and rows (list, key, n, room) of the lists of frequent ones."""

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: tuple[list, list, list, list] = ([], [], [], [])
        size, seen = 0, set()

        def blobs() -> pa.RecordBatch:
            ranges, raw = _posting_blobs(*held, parts)
            for x in held:
                x.clear()
            return _row(LISTS, len(ranges), range=pa.array(ranges, pa.int32()), blob=pa.array(raw, pa.binary()))

        for batch in batches:
            for _, own in _sets(batch, width):
                key = set_key(own)
                if len(own) < 3 or key in seen:  # different sets of fewer tokens cannot be similar enough
                    continue
                seen.add(key)
                names, room, rare = order.entries(own, percent)
                if rare:
                    for x, value in zip(held, (names[:rare], room[:rare], key, len(own)), strict=True):
                        x.append(value)
                    size += rare
                    if size >= HELD_TOKENS:
                        yield blobs()
                        size = 0
                m = len(names) - rare
                if m:
                    yield _row(LISTS, m, list=pa.array(names[rare:].view(np.int64)), key=pa.array([key] * m, pa.binary()), n=pa.array([len(own)] * m, pa.int32()), room=pa.array(room[rare:].astype(np.int32)))
        if size:
            yield blobs()

    return docs.mapInArrow(released(send), LISTS)


def rare_candidates(blobs: DataFrame, parts: int, percent: int) -> DataFrame:
    """Candidates (a, b) of the rare tokens' lists, and rows (list, key, n, room) of those that are not short."""

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        read = [_read_blob(x.as_py()) for batch in batches for x in batch.column("blob")]
        if not read:
            return
        base = np.cumsum([0, *(len(p[3]) for p in read)])
        keys, ids = np.unique(np.concatenate([p[3] for p in read]), return_inverse=True)
        sizes = np.zeros(len(keys), dtype=np.int64)
        sizes[ids] = np.concatenate([p[4] for p in read])
        name, room = np.concatenate([p[0] for p in read]), np.concatenate([p[2] for p in read]).astype(np.int64)
        node = ids[np.concatenate([p[1] + base[i] for i, p in enumerate(read)])]
        del read
        by = np.lexsort((node, name))
        name, room, node = name[by], room[by], node[by]
        fresh = np.concatenate([[True], (name[1:] != name[:-1]) | (node[1:] != node[:-1])])
        name, room, node = name[fresh], room[fresh], node[fresh]
        edges = np.flatnonzero(np.concatenate([[True], name[1:] != name[:-1], [True]]))
        long = np.repeat(np.diff(edges) > SHORT_LIST, np.diff(edges))
        for s in range(0, int(long.sum()), 10_000):
            at = np.flatnonzero(long)[s : s + 10_000]
            columns = {"list": pa.array(name[at].view(np.int64)), "key": pa.array(_bytes(keys[node[at]]), pa.binary())}
            yield _row(CANDIDATES, len(at), **columns, n=pa.array(sizes[node[at]].astype(np.int32)), room=pa.array(room[at].astype(np.int32)))
        name, room, node = name[~long], room[~long], node[~long]
        size, found, step = sizes[node], [], 1
        while step < len(name):
            same = np.flatnonzero(name[step:] == name[:-step])
            if not len(same):
                break
            p, q = same, same + step
            need = -(-percent * (size[p] + size[q]) // (100 + percent))
            good = np.minimum(room[p], room[q]) >= need
            found.append(np.unique(node[p[good]] * len(keys) + node[q[good]]))
            step += 1
        pairs = np.unique(np.concatenate(found)) if found else np.empty(0, np.int64)
        for s in range(0, len(pairs), 10_000):
            a, b = np.divmod(pairs[s : s + 10_000], len(keys))
            yield _row(CANDIDATES, len(a), a=pa.array(_bytes(keys[a]), pa.binary()), b=pa.array(_bytes(keys[b]), pa.binary()))

    return _by_range(blobs, parts).mapInArrow(released(gather), CANDIDATES)


def _bytes(names: np.ndarray) -> list[bytes]:
    return [x.ljust(16, b"\0") for x in names.tolist()]


def fetch_sets(docs: DataFrame, reps: DataFrame, keys: DataFrame, width: int) -> DataFrame:
    """(key, tokens) for the sets in ``keys``; only documents that may stand for one are hashed again."""
    filter_ = bitfilter.build(reps.join(keys, "key", "left_semi").select("doc_id"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = bitfilter.BitFilter(filter_)
        for batch in batches:
            own = batch.filter(pa.array(bits.may_hold(batch.column(0))))
            sets = [t for _, t in _sets(own, width)]
            if sets:
                yield pa.RecordBatch.from_arrays([pa.array([set_key(t) for t in sets], pa.binary()), pa.array([t.tobytes() for t in sets], pa.binary())], ["key", "tokens"])

    found = docs.mapInArrow(released(run), "key binary, tokens binary")
    return found.join(keys, "key", "left_semi").dropDuplicates(["key"])


def verify(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose sets are as similar as asked for."""
    one = pairs.join(sets.withColumnsRenamed({"key": "a", "tokens": "x"}), "a")
    two = one.join(sets.withColumnsRenamed({"key": "b", "tokens": "y"}), "b").select("a", "b", "x", "y")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = []
            for x, y in zip(batch.column(2), batch.column(3), strict=True):
                p, q = (np.frombuffer(v.as_buffer(), "<u8") for v in (x, y))
                both = np.sort(np.concatenate([p, q]))
                shared = int((both[1:] == both[:-1]).sum())
                good.append(100 * shared >= percent * (len(both) - shared))
            yield batch.select([0, 1]).filter(pa.array(good, pa.bool_()))

    return two.mapInArrow(released(run), "a binary, b binary")


def components(docs: DataFrame, key: str = "doc_id", text: str = "text", width: int = WIDTH, percent: int = PERCENT) -> DataFrame:
    """Per row of ``docs``: doc_id, n_shingles and component_id (the smallest id reachable by links)."""
    placed = _placed(docs, key, text, width, percent)
    least = placed.where("root is not null").groupBy("root").agg(F.min("doc_id").alias("component_id"))
    out = placed.join(least, "root", "left")
    return out.select("doc_id", F.col("n").cast("long").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"))


def _parts(rows: DataFrame) -> int:
    """How many ranges of tokens: as many as the session's shuffle partitions, and more for large inputs."""
    size = rows.agg(F.sum(F.octet_length("text")).alias("size")).first()["size"] or 0
    return max(1, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), size // RANGE_BYTES)


def _packed(rows: Iterable[bytes], size: int) -> np.ndarray:
    """A bit for each of ``size`` places, eight in a byte as packbits has them; set are those of the rows, compressed steps from place to place."""
    table = np.zeros(size >> 3, dtype=np.uint8)
    for row in rows:
        at = np.cumsum(np.frombuffer(zlib.decompress(row), "<u4"), dtype=np.int64)
        np.bitwise_or.at(table, at >> 3, np.uint8(128) >> (at & 7).astype(np.uint8))
    return table


def _placed(docs: DataFrame, key: str, text: str, width: int = WIDTH, percent: int = PERCENT) -> DataFrame:
    """Per row of ``docs``: doc_id, n, key (of its set) and root, the component; null for texts without words."""
    rows = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    parts = _parts(rows)
    first = materialize(count_tokens(rows, parts, width), "jaccard-sets")
    members = first.where("key is not null").select("doc_id", "n", "key")
    frequent = first.where("token is not null").select("token", "count").orderBy(F.desc("count"), "token").limit(FREQUENT_KEPT).toPandas()
    table = _packed((row["bits"] for row in first.where("bits is not null").select("bits").toLocalIterator()), 1 << SHARED_BITS)
    order = Order(zlib.compress(table.tobytes(), 1), frequent["token"].to_numpy(np.int64).view(np.uint64), frequent["count"].to_numpy(np.int64))
    del table
    trim()
    reps = members.where("n > 2").groupBy("key").agg(F.min("doc_id").alias("doc_id"))

    indexed = materialize(index_prefixes(rows, parts, width, percent, order), "jaccard-index")
    found = materialize(rare_candidates(indexed.where("blob is not null").select("range", "blob"), parts, percent), "jaccard-candidates")
    rare = found.where("a is not null").select("a", "b").distinct()
    lists = indexed.unionByName(found, allowMissingColumns=True).where("list is not null").select("list", "key", "n", "room")
    keys = rare.select(F.col("a").alias("key")).unionByName(rare.select(F.col("b").alias("key"))).unionByName(lists.select("key")).distinct()
    sets = materialize(fetch_sets(rows, reps, materialize(keys, "jaccard-keys"), width), "jaccard-tokens")
    links = materialize(verify(rare, sets, percent), "jaccard-links")
    roots = materialize(connected(links, "a", "b"), "jaccard-roots")
    roots = _settled(lists, links, roots, sets, percent)
    placed = members.join(roots.select(F.col("node").alias("key"), "root"), "key", "left").withColumn("root", F.when(F.col("n") > 0, F.coalesce("root", "key")))
    return placed.select("doc_id", "n", "key", "root")


def _settled(lists: DataFrame, links: DataFrame, roots: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The roots after all candidates of ``lists`` are verified or connected."""
    opened, seed, left = _unsettled(lists.distinct(), roots), 0, None
    while opened is not None:
        seed += 1
        size = opened.count()
        last = left is not None and size > 0.9 * left
        tried = materialize(_across(opened, percent) if last else _tried(opened, seed, percent), "jaccard-pairs")
        fresh = materialize(verify(tried, sets, percent), "jaccard-links")
        links = materialize(links.unionByName(fresh), "jaccard-links")
        discard(tried, fresh)
        roots = materialize(connected(links, "a", "b"), "jaccard-roots")
        if last:
            break
        left, following = size, _unsettled(opened.select("list", "key", "n", "room"), roots)
        discard(opened)
        opened = following
    return roots


def _unsettled(lists: DataFrame, roots: DataFrame) -> DataFrame | None:
    """(list, key, n, room, root) of the lists whose sets are not all in one component yet."""
    placed = lists.join(roots.select(F.col("node").alias("key"), "root"), "key", "left").withColumn("root", F.coalesce("root", "key"))
    open_ = placed.groupBy("list").agg(F.min("root").alias("x"), F.max("root").alias("y")).where("x != y").select("list")
    out = materialize(placed.join(open_, "list").select("list", "key", "n", "room", "root"), "jaccard-open")
    return None if out.isEmpty() else out


def _candidate(percent: int) -> Column:
    """Whether rows x and y of a list leave room for the overlap that they need, and are of different components."""
    need = F.ceil(F.lit(percent) * (F.col("x.n") + F.col("y.n")) / F.lit(100 + percent))
    return (F.least("x.room", "y.room") >= need) & (F.col("x.root") != F.col("y.root"))


def _tried(opened: DataFrame, seed: int, percent: int) -> DataFrame:
    """Candidates of each member with a few pivots of its list."""
    pivot = lambda i: F.min(F.struct(F.xxhash64("key", F.lit(seed * PIVOTS + i)).alias("place"), "key", "n", "room", "root"))
    chosen = opened.groupBy("list").agg(F.array(*[pivot(i) for i in range(PIVOTS if seed > 1 else 1)]).alias("pivots"))
    chosen = chosen.select("list", F.explode(F.array_distinct("pivots")).alias("y"))
    met = opened.select("list", F.struct("key", "n", "room", "root").alias("x")).join(chosen, "list").where(_candidate(percent))
    return met.select(F.least("x.key", "y.key").alias("a"), F.greatest("x.key", "y.key").alias("b")).distinct()


def _across(opened: DataFrame, percent: int) -> DataFrame:
    """All candidates of different components.

    Two sets may share many lists. They are paired in the first, whose rest leaves the most room: each
    row knows up to ``EARLIER`` lists of its set that come before its own, and rows that share one
    of those are not paired again.
    """
    firsts = opened.groupBy("key").agg(F.slice(F.sort_array(F.collect_list(F.struct("room", "list")), asc=False), 1, EARLIER).alias("firsts"))
    before = F.transform(F.filter("firsts", lambda f: f["room"] > F.col("room")), lambda f: f["list"])
    rows = materialize(opened.join(firsts, "key").select("list", "key", "n", "room", "root", before.alias("before")), "jaccard-rows")
    both = [rows.select("list", F.struct("key", "n", "room", "root", "before").alias(c)) for c in "xy"]
    fit = (F.col("x.key") < F.col("y.key")) & _candidate(percent) & ~F.arrays_overlap("x.before", "y.before")
    met = both[0].join(both[1], "list").where(fit)
    return met.select(F.col("x.key").alias("a"), F.col("y.key").alias("b")).distinct()


def _keyed(rows: DataFrame, text: str, width: int) -> DataFrame:
    """``rows`` with _gneiss_key, the key of each text's set."""
    names = rows.columns
    at = names.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = pa.RecordBatch.from_arrays([batch.column(at), batch.column(at).cast(pa.string())], ["_", "text"])
            keys = [set_key(t) for _, t in _sets(texts, width)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(keys, pa.binary())], [*names, "_gneiss_key"])

    return rows.mapInArrow(run, T.StructType([*rows.schema.fields, T.StructField("_gneiss_key", T.BinaryType())]))


def keep_one(docs: DataFrame, key: str = "doc_id", text: str = "text", width: int = WIDTH, percent: int = PERCENT) -> DataFrame:
    """One row of each component stays: one with the smallest id, null ids last. Texts without words all stay.

    Rows are told by id and set, as ids may be null or repeated. Only rows that may be among those to
    go, by a bit table, are joined with them; the rest pass by.
    """
    found = materialize(_placed(docs, key, text, width, percent), "jaccard-found").where("root is not null")
    rows = found.groupBy("root", "doc_id", "key").agg(F.count(F.lit(1)).alias("n"))
    place = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "key")
    groups = rows.groupBy("root").agg(F.min(place).alias("keeper"), F.sum("n").alias("total")).where("total > 1")
    judged = rows.join(groups, "root").withColumn("kept", place == F.col("keeper")).where("not kept or n > 1")
    judged = materialize(judged.select(F.col("doc_id").alias("_id"), F.col("key").alias("_key"), F.col("kept").alias("_kept")), "jaccard-judged")
    filter_ = bitfilter.build(judged.select("_id"))
    ided = docs.withColumn("_gneiss_id", F.col(key).cast("long"))
    maybe = _keyed(bitfilter.split(ided, "_gneiss_id", filter_, True), text, width)
    same = (F.col("_gneiss_key") == F.col("_key")) & F.col("_gneiss_id").eqNullSafe(F.col("_id"))
    met = materialize(maybe.join(judged, same, "left").drop("_id", "_key"), "jaccard-met")
    free, copies = met.where("_kept is null"), met.where("_kept").dropDuplicates(["_gneiss_id", "_gneiss_key"])
    kept = free.unionByName(copies).drop("_gneiss_key", "_kept")
    return kept.unionByName(bitfilter.split(ided, "_gneiss_id", filter_, False)).drop("_gneiss_id")
