"""Similar nodes from bands: candidate pairs, their exact verification and components, in DataFrame functions only.

1. In a band every node is paired with the band's smallest and largest node.
2. Bands of up to ``SHORT_BAND`` nodes that still hold several components are compared pair by pair
   across components.
3. In longer ones a node of each band, another one in each round, is paired with the nodes of other
   components, as long as that finds many similar pairs (up to ``ROUNDS`` times): groups of near
   copies become one component by pairs in proportion to their size.
4. What is still in bands of several components is indexed by the shingles of their prefixes, rare ones first: sets as
   similar as asked for share one of the first n - ceil(t * n) + 1 shingles. Two nodes of different
   components that meet in such a list are compared if the shingles after it leave room for the
   overlap that they need. Lists go through the rounds of 3 first, with ``HUBS`` nodes at once; then all
   pairs that are left are compared. So no similar pair of a long band stays apart, and nodes that only
   share what is common do not meet.

A node's mark is the parity of its shingles in each of ``64 * MARKS`` bins. Two marks differ in no more bins
than the sets differ in shingles, so pairs whose marks differ too much for their sizes are surely not
similar: their sets are not exchanged.

Defined results: repeated rows count once; nodes that meet no other give no rows; empty tables give
empty results.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gneiss.llm.components import FEW, connected, gathered
from gneiss.llm.storage import discard, materialize

#: The shingles (distinct values) of a body.
Made = Callable[[Column], Column]
#: Bands up to this many nodes are compared pair by pair across components.
SHORT_BAND = 16
#: Earlier lists of its node that a row knows.
EARLIER = 32
#: Longs of a mark.
MARKS = 4
#: Nodes of a list that are paired with its others in each round.
HUBS = 8
#: Rounds in which one node of a group is paired with the others, before all pairs are.
ROUNDS = 8
#: A round that links less than one in so many rows is the last.
WORTH = 50


def _met(posted: DataFrame) -> DataFrame:
    """(node, band, size, head, tail) of bands of several nodes: the band's smallest and largest node."""
    sizes = posted.groupBy("band").agg(F.count(F.lit(1)).alias("size"), F.min("node").alias("head"), F.max("node").alias("tail")).where("size > 1")
    return posted.join(sizes, "band").select("node", "band", "size", "head", "tail")


def _ends(met: DataFrame) -> DataFrame:
    """Pairs of each node with the ends of its bands."""
    pairs = met.select(F.explode(F.array("head", "tail")).alias("a"), F.col("node").alias("b")).where("a != b")
    return pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))


def _open(listed: DataFrame, roots: DataFrame) -> DataFrame:
    """(band, node, size, root) of the bands whose nodes are not all in one component yet."""
    placed = listed.join(roots, "node", "left").select("band", "node", "size", F.coalesce("root", "node").alias("root"))
    mixed = placed.groupBy("band").agg(F.min("root").alias("x"), F.max("root").alias("y")).where("x != y")
    return materialize(placed.join(mixed.select("band"), "band"), "bands-open")


def _across(listed: DataFrame) -> DataFrame:
    """Pairs of different components inside each band."""
    left = listed.select("band", F.col("node").alias("a"), F.col("root").alias("r"))
    right = listed.select("band", F.col("node").alias("b"), F.col("root").alias("s"))
    return left.join(right, "band").where("a < b and r != s").select("a", "b")


def _marked(sets: DataFrame, made: Made) -> DataFrame:
    """(node, body, n, mark) of ``sets`` (node, body): the number of their shingles, and a mark."""
    one, none = F.lit(1).cast("long"), F.lit(0).cast("long")
    flip = lambda h: F.call_function("shiftleft", one, h.bitwiseAND(F.lit(63)).cast("int"))
    long = lambda i: F.aggregate("shingles", none, lambda m, h: m.bitwiseXOR(F.when(F.shiftrightunsigned(h, 6).bitwiseAND(F.lit(MARKS - 1)) == i, flip(h)).otherwise(none)))
    return sets.withColumn("shingles", made(F.col("body"))).select("node", "body", F.size("shingles").alias("n"), F.array(*[long(i) for i in range(MARKS)]).alias("mark"))


def _alike(x: str, y: str, percent: int) -> Column:
    """False only if the marks of structs x and y (n, mark) show that their sets are not similar."""
    apart = sum((F.bit_count(F.get(f"{x}.mark", F.lit(i)).bitwiseXOR(F.get(f"{y}.mark", F.lit(i)))) for i in range(MARKS)), F.lit(0))
    return apart <= F.col(f"{x}.n") + F.col(f"{y}.n") - 2 * _need(f"{x}.n", f"{y}.n", percent)


def _relisted(listed: DataFrame, roots: DataFrame) -> DataFrame:
    """``listed`` by the components of now, without lists of a single one."""
    placed = listed.drop("root").join(roots, "node", "left").select("token", "node", F.coalesce("root", "node").alias("root"), "n", "mark", "room")
    mixed = placed.groupBy("token").agg(F.min("root").alias("x"), F.max("root").alias("y")).where("x != y")
    return materialize(placed.join(mixed.select("token"), "token"), "band-lists")


def _spokes(listed: DataFrame, group: str, turn: int) -> DataFrame:
    """(group, hub, and the columns of ``listed``) of each node and its group's hub of this turn, if of different components."""
    key = F.struct(F.xxhash64("node", F.lit(turn)).alias("turn"), *[c for c in listed.columns if c != group])
    hubs = listed.groupBy(group).agg(F.min(key).alias("hub"))
    return listed.join(hubs, group).where(F.col("root") != F.col("hub.root"))


def _list_spokes(listed: DataFrame, turn: int, percent: int) -> DataFrame:
    """Pairs of each node and the hubs of its lists in this turn, if of different components and maybe similar."""
    hub = lambda i: F.min(F.struct(F.xxhash64("node", F.lit(turn * HUBS + i)).alias("turn"), "node", "root", "n", "mark", "room"))
    hubs = listed.groupBy("token").agg(F.array(*[hub(i) for i in range(HUBS)]).alias("hubs"))
    hubs = hubs.select("token", F.explode(F.array_distinct(F.transform("hubs", lambda h: h.dropFields("turn")))).alias("y"))
    met = listed.select("token", F.struct("node", "root", "n", "mark", "room").alias("x")).join(hubs, "token")
    fit = (F.col("x.root") != F.col("y.root")) & (F.least("x.room", "y.room") >= _need("x.n", "y.n", percent)) & _alike("x", "y", percent)
    return met.where(fit).select(F.least("x.node", "y.node").alias("a"), F.greatest("x.node", "y.node").alias("b"))


def _prefix_lists(nodes: DataFrame, sets: DataFrame, percent: int, made: Made) -> DataFrame:
    """(token, node, root, n, mark, room) of the shingles of the prefixes of ``nodes`` (node, root) that several components have."""
    tokens = materialize(nodes.select("node").join(sets, "node").select("node", F.explode(made(F.col("body"))).alias("token")), "band-tokens")
    often = materialize(tokens.groupBy("token").agg(F.count(F.lit(1)).alias("often")).where("often > 1"), "band-often")
    # shingles of one node come first in its prefix and are in no list: their number is all that is needed
    shared = materialize(tokens.join(often, "token"), "band-shared")
    discard(tokens, often)
    whole = Window.partitionBy("node")
    place = F.col("n") - F.count(F.lit(1)).over(whole).cast("int") + F.row_number().over(whole.orderBy("often", "token"))
    ranked = shared.join(nodes.join(sets.select("node", "n"), "node"), "node").withColumn("place", place)
    ranked = ranked.where(F.col("place") <= F.col("n") - F.ceil(F.col("n") * percent / 100) + 1)
    ranked = materialize(ranked.select("token", "node", "root", (F.col("n") - F.col("place") + 1).alias("room")), "band-ranked")
    discard(shared)
    # a list whose nodes are all in one component has nothing to compare
    mixed = ranked.groupBy("token").agg(F.min("root").alias("x"), F.max("root").alias("y")).where("x != y")
    listed = materialize(ranked.join(mixed.select("token"), "token").join(sets.select("node", "n", "mark"), "node"), "band-lists")
    discard(ranked)
    return listed


def _need(x: str, y: str, percent: int) -> Column:
    """The shared values without which two sets of such sizes are not similar."""
    return F.ceil(F.lit(percent) * (F.col(x) + F.col(y)) / F.lit(100 + percent))


def _in_lists(listed: DataFrame, percent: int) -> DataFrame:
    """Pairs of different components that share a list and have room for the overlap they need."""
    # nodes that share several lists are paired in the first only, whose rest leaves the most room
    firsts = listed.groupBy("node").agg(F.slice(F.sort_array(F.collect_list(F.struct("room", "token")), asc=False), 1, EARLIER).alias("firsts"))
    before = F.transform(F.filter("firsts", lambda f: f["room"] > F.col("room")), lambda f: f["token"])
    listed = materialize(listed.join(firsts, "node").select("token", "node", "root", "n", "mark", "room", before.alias("before")), "band-rows")
    left, right = (listed.select("token", F.struct("node", "root", "n", "mark", "room", "before").alias(c)) for c in "xy")
    fit = (F.col("x.node") < F.col("y.node")) & (F.col("x.root") != F.col("y.root")) & (F.least("x.room", "y.room") >= _need("x.n", "y.n", percent)) & _alike("x", "y", percent) & ~F.arrays_overlap("x.before", "y.before")
    return left.join(right, "token").where(fit).select(F.col("x.node").alias("a"), F.col("y.node").alias("b"))


def _merged(roots: DataFrame, fresh: DataFrame, found: int) -> DataFrame:
    """``roots`` with the components united that the ``found`` pairs ``fresh`` link."""
    held, most = roots, max(roots.count(), found)
    roots, fresh = gathered(roots, most), gathered(fresh, most)
    ends = [roots.select(F.col("node").alias(c), F.col("root").alias(f"root_{c}")) for c in "ab"]
    edges = fresh.join(ends[0], "a", "left").join(ends[1], "b", "left").select(F.coalesce("root_a", "a").alias("a"), F.coalesce("root_b", "b").alias("b"))
    moved = materialize(connected(edges, "a", "b"), "band-moves")
    moves = gathered(moved, most)
    old = roots.join(moves.select(F.col("node").alias("root"), F.col("root").alias("least")), "root", "left").select("node", F.coalesce("least", "root").alias("root"))
    out = materialize(old.unionByName(moves.join(roots, "node", "left_anti")), "band-roots")
    discard(held, moved)
    return out


def united(posted: DataFrame, fetch: Callable[[DataFrame], DataFrame], percent: int, made: Made = lambda body: body) -> DataFrame:
    """(node, root) of the nodes that are similar to another one of a band; posted: (node, band), each row once.

    ``fetch`` gives the sets (node, shingles) of the nodes of a table, or (node, body) if ``made`` makes the shingles of a body.
    """
    met = materialize(_met(posted), "band-met")
    wanted = materialize(met.select("node").distinct(), "band-nodes")
    sets = materialize(_marked(fetch(wanted).withColumnRenamed("shingles", "body"), made), "band-sets")
    discard(wanted)
    links = verified(_ends(met).distinct(), sets, percent, made)
    roots = materialize(connected(links, "a", "b"), "band-roots")
    discard(links)

    def settle(pairs: DataFrame) -> int:
        """The number of similar pairs; their components are united."""
        nonlocal roots
        fresh = verified(pairs.distinct(), sets, percent, made)
        found = fresh.count()
        if found:
            roots = _merged(roots, fresh, found)
        discard(fresh)
        return found

    # in a band of three all pairs are tried by now
    opened = _open(met.where("size > 3").select("node", "band", "size"), roots)
    discard(met)
    short, long = opened.where(F.col("size") <= SHORT_BAND), opened.where(F.col("size") > SHORT_BAND)
    settle(_across(short))
    long, used = _open(long.select("node", "band", "size"), roots), opened
    discard(used)
    for turn in range(ROUNDS):
        rows = long.count()
        if not rows or settle(_spokes(long, "band", turn).select(F.least("hub.node", "node").alias("a"), F.greatest("hub.node", "node").alias("b"))) * WORTH < rows:
            break
        long, used = _open(long.select("node", "band", "size"), roots), long
        discard(used)
    if rows:
        # the last round may have united some
        placed = long.select("node").distinct().join(roots, "node", "left").select("node", F.coalesce("root", "node").alias("root"))
        listed = _prefix_lists(placed, sets, percent, made)
        for turn in range(ROUNDS):
            found, rows = settle(_list_spokes(listed, turn, percent)), listed.count()
            listed, used = _relisted(listed, roots), listed
            discard(used)
            if found * WORTH < rows:
                break
        settle(_in_lists(listed, percent))
        discard(listed)
    discard(long)
    discard(sets)
    return roots


def verified(pairs: DataFrame, sets: DataFrame, percent: int, made: Made) -> DataFrame:
    """The pairs of ``sets`` (node, body, n, mark) with a Jaccard similarity of percent / 100 or more, written."""
    marks = [sets.select(F.col("node").alias(c), F.struct("n", "mark").alias(m)) for c, m in ("ax", "by")]
    near = materialize(pairs.join(marks[0], "a").join(marks[1], "b").where(_alike("x", "y", percent)).select("a", "b"), "band-near")
    rows = near.count()
    if rows <= FEW:
        # only sets of such pairs are exchanged; their hashes are smaller to send than they are, and the joins are exact
        wanted = near.select(F.explode(F.array("a", "b")).alias("node")).select(F.xxhash64("node").alias("hash")).distinct()
        sets = sets.join(F.broadcast(wanted), F.xxhash64("node") == F.col("hash"), "left_semi")
    left, right = (sets.select(F.col("node").alias(c), F.col("n").alias(f"n_{c}"), F.col("body").alias(f"body_{c}")) for c in "ab")
    both = near.join(left, "a").join(right, "b").withColumn("shared", F.size(F.array_intersect(made(F.col("body_a")), made(F.col("body_b")))))
    links = materialize(both.where(100 * F.col("shared") >= percent * (F.col("n_a") + F.col("n_b") - F.col("shared"))).select("a", "b"), "band-links")
    discard(near)
    return links
