"""Graph operators over edge tables (src, dst): degrees, traversal, components, cycles, motifs."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rounds between checkpoints of the traversal loops.
CUT_EVERY = 4


def _cut(df: DataFrame) -> DataFrame:
    """Lineage cut in the cluster's checkpoint folder."""
    from gneiss.sources.scratch import ensure

    ensure(df.sparkSession)
    return df.checkpoint(eager=True)


def cut(df: DataFrame) -> DataFrame:
    """``df`` written once, for plans that read it several times."""
    return _cut(df)


def degrees(nodes: DataFrame, edges: DataFrame, node: str = "node") -> DataFrame:
    """``nodes`` with fan_in and fan_out over distinct edges."""
    return nodes.join(fans(edges.select("src", "dst").distinct(), node), node, "left").fillna(0, ["fan_in", "fan_out"])


def fans(pairs: DataFrame, node: str = "node") -> DataFrame:
    """(node, fan_in, fan_out) of the ends of ``pairs``, which are distinct: both from one pass."""
    end = lambda c, into: F.struct(F.col(c).alias(node), F.lit(into).alias("into"))
    ends = pairs.select(F.inline(F.array(end("dst", True), end("src", False))))
    return ends.groupBy(node).agg(F.count_if("into").alias("fan_in"), F.count_if(~F.col("into")).alias("fan_out"))


def vertices(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("src").alias("node")).unionByName(edges.select(F.col("dst").alias("node"))).distinct()


def symmetric(edges: DataFrame) -> DataFrame:
    return edges.select("src", "dst").unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct()


def reach(starts: DataFrame, edges: DataFrame, max_hops: int | None = None) -> DataFrame:
    """(start, node, hops): nodes reached from each start by forward edges, with the least number of hops.

    ``starts`` has a column ``start``. A start is reached again only through a cycle. One frontier
    step is one join; visited pairs are never walked again, so cycles end.
    """
    step = _cut(edges.select(F.col("src").alias("node"), F.col("dst").alias("next")).distinct())
    frontier = starts.select("start", F.col("start").alias("node"))
    found: DataFrame | None = None
    hops = 0
    while max_hops is None or hops < max_hops:
        hops += 1
        fresh = frontier.join(step, "node").select("start", F.col("next").alias("node")).distinct()
        if found is not None:
            fresh = fresh.join(found.select("start", "node"), ["start", "node"], "left_anti")
        fresh = _cut(fresh.withColumn("hops", F.lit(hops)))
        if fresh.isEmpty():
            break
        found = fresh if found is None else found.unionByName(fresh)
        if hops % CUT_EVERY == 0:
            found = _cut(found)
        frontier = fresh.select("start", "node")
    if found is None:
        return starts.select("start", F.col("start").alias("node"), F.lit(0).alias("hops")).limit(0)
    return found


def spread(starts: DataFrame, edges: DataFrame) -> DataFrame:
    """(node, hops): nodes that any start reaches by forward edges, with the least number of hops.

    ``starts`` has a column ``node``; starts themselves have no hops. A node is walked from once, so
    the work grows with the edges, whatever the number of starts.
    """
    step = _cut(edges.select(F.col("src").alias("node"), F.col("dst").alias("next")).distinct())
    found = frontier = _cut(starts.select("node", F.lit(0).alias("hops")).distinct())
    hops = 0
    while not frontier.isEmpty():
        hops += 1
        fresh = frontier.join(step, "node").select(F.col("next").alias("node")).distinct().join(found.select("node"), "node", "left_anti")
        frontier = _cut(fresh.withColumn("hops", F.lit(hops)))
        found = found.unionByName(frontier)
        if hops % CUT_EVERY == 0:
            found = _cut(found)
    return found


def _trim(edges: DataFrame) -> DataFrame:
    """Edges left when nodes without a way in or out are taken off until none is left."""
    size = None
    while True:
        ends = edges.select("src").intersect(edges.select("dst")).withColumnRenamed("src", "node")
        slim = edges.join(ends.withColumnRenamed("node", "src"), "src", "left_semi").join(ends.withColumnRenamed("node", "dst"), "dst", "left_semi")
        edges = _cut(slim)
        left = edges.count()
        if left in (0, size):
            return edges
        size = left


def strong_components(edges: DataFrame) -> DataFrame:
    """(node, component): nodes on cycles of two or more, with the smallest node of their strongly connected component.

    Each round gives every node of the trimmed graph the smallest node that reaches it; a component lies
    inside one such colour, and the one of a colour's root is what reaches the root inside the colour.
    Those leave, edges between colours leave, and the rest goes on. Loops of single nodes count as none.
    """
    kind = dict(edges.dtypes)["src"]
    core = _trim(_cut(edges.where("src != dst").select("src", "dst").distinct()))
    found: DataFrame | None = None
    while not core.isEmpty():
        colours = _least_above(core)
        inside = core.join(colours.select(F.col("node").alias("src"), F.col("colour").alias("a")), "src").join(colours.select(F.col("node").alias("dst"), F.col("colour").alias("b")), "dst")
        inside = _cut(inside.where("a = b").select("src", "dst", F.col("a").alias("colour")))
        back = inside.select(F.col("dst").alias("src"), F.col("src").alias("dst"))
        roots = colours.where("node = colour").select("node")
        whole = spread(roots, back).select("node").join(colours, "node").select("node", F.col("colour").alias("component"))
        whole = _cut(whole)
        found = whole if found is None else _cut(found.unionByName(whole))
        gone = whole.select("node")
        rest = inside.select("src", "dst").join(gone.withColumnRenamed("node", "src"), "src", "left_anti").join(gone.withColumnRenamed("node", "dst"), "dst", "left_anti")
        core = _trim(_cut(rest))
    if found is None:
        return edges.sparkSession.createDataFrame([], f"node {kind}, component {kind}")
    return found.join(found.groupBy("component").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "component", "left_semi").select("node", "component")


def _least_above(edges: DataFrame) -> DataFrame:
    """(node, colour): the smallest node among a node and those that reach it. Only nodes whose colour changed pass it on."""
    step = edges.select(F.col("src").alias("node"), F.col("dst").alias("next"))
    colours = _cut(vertices(edges).select("node", F.col("node").alias("colour")))
    moved = colours
    while not moved.isEmpty():
        offered = moved.join(step, "node").groupBy(F.col("next").alias("node")).agg(F.min("colour").alias("offer"))
        now = _cut(colours.join(offered, "node", "left").select("node", F.least("colour", "offer").alias("colour"), (F.col("offer") < F.col("colour")).alias("moved")))
        colours, moved = now.select("node", "colour"), now.where("moved").select("node", "colour")
    return colours


def condensed(nodes: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(node, part) of all nodes, and the edges between parts: strongly connected components as single nodes."""
    strong = strong_components(edges).select("node", F.col("component").alias("_c"))
    placed = _cut(nodes.select("node").distinct().join(strong, "node", "left").select("node", F.coalesce("_c", "node").alias("part")))
    ends = edges.join(placed.select(F.col("node").alias("src"), F.col("part").alias("a")), "src").join(placed.select(F.col("node").alias("dst"), F.col("part").alias("b")), "dst")
    return placed, _cut(ends.where("a != b").select(F.col("a").alias("src"), F.col("b").alias("dst")).distinct())


def reach_parts(starts: DataFrame, between: DataFrame) -> DataFrame:
    """(start, node): parts that each starting part reaches in a condensed graph, itself included.

    Nodes of one part reach the same, so pairs are of parts, not of nodes; how many there are depends
    on what the condensed graph has left to tell apart.
    """
    found = reach(starts, between).select("start", "node")
    return found.unionByName(starts.select("start", F.col("start").alias("node")))


def reach_path(starts: DataFrame, edges: DataFrame, max_hops: int | None = None) -> DataFrame:
    """(start, node, hops, parent): as ``reach``, with the parent that comes first in breadth-first queue order.

    Among parents of a level the queue holds those with smaller discovery places first; a node's
    place follows its parent's place, then its own name.
    """
    from pyspark.sql import Window

    step = _cut(edges.select(F.col("src").alias("node"), F.col("dst").alias("next")).distinct())
    frontier = starts.select("start", F.col("start").alias("node"), F.lit(1).cast("long").alias("place"))
    found = frontier.select("start", "node", F.lit(0).alias("hops"), F.lit(None).cast(dict(frontier.dtypes)["node"]).alias("parent"))
    hops = 0
    while max_hops is None or hops < max_hops:
        hops += 1
        met = frontier.join(step, "node").groupBy("start", F.col("next").alias("found")).agg(F.min(F.struct("place", "node")).alias("by"))
        met = met.join(found.select("start", F.col("node").alias("found")), ["start", "found"], "left_anti")
        queue = Window.partitionBy("start").orderBy(F.col("by.place"), "found")
        fresh = _cut(met.select("start", F.col("found").alias("node"), F.col("by.node").alias("parent"), F.row_number().over(queue).cast("long").alias("place")))
        if fresh.isEmpty():
            break
        found = found.unionByName(fresh.select("start", "node", F.lit(hops).alias("hops"), "parent"))
        if hops % CUT_EVERY == 0:
            found = _cut(found)
        frontier = fresh.select("start", "node", "place")
    return found


def _to_least(pairs: DataFrame) -> DataFrame:
    """Each larger neighbour of a node is tied to the least node around that node instead."""
    both = pairs.unionByName(pairs.select(F.col("low").alias("high"), F.col("high").alias("low"))).select(F.col("high").alias("node"), F.col("low").alias("other"))
    least = both.groupBy("node").agg(F.least(F.col("node"), F.min("other")).alias("least"))
    return both.where("other > node").join(least, "node").select(F.col("other").alias("high"), F.col("least").alias("low")).distinct()


def _to_root(pairs: DataFrame) -> DataFrame:
    """Each node and its smaller neighbours are tied to the least of them."""
    least = pairs.groupBy("high").agg(F.min("low").alias("least"))
    tied = pairs.join(least, "high").select(F.col("low").alias("high"), F.col("least").alias("low"))
    return tied.unionByName(least.select("high", F.col("least").alias("low"))).where("high != low").distinct()


def weak_components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(node, component): the smallest node of each weakly connected component.

    Edges are rewritten in two alternating ways until all of them are stars around the smallest
    node of their component; paths shrink by a constant factor each time, so the number of rounds
    grows with the logarithm of the diameter. Nodes without edges are components of their own.
    """
    ends = edges.where("src != dst")
    pairs = _cut(ends.select(F.greatest("src", "dst").alias("high"), F.least("src", "dst").alias("low")).distinct())
    state = None
    while True:
        pairs = _cut(_to_root(_to_least(pairs)))
        now = pairs.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("high", "low").cast("decimal(38,0)")).alias("sum")).first()
        if now == state or not now["n"]:
            break
        state = now
    placed = nodes.select("node").distinct().join(pairs.select(F.col("high").alias("node"), F.col("low").alias("component")), "node", "left")
    return placed.select("node", F.coalesce("component", "node").alias("component"))


def betti(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """One row: n_vertices, n_edges, beta_0, beta_1, beta_2. Both directions of a pair count as edges."""
    parts = weak_components(nodes, edges).agg(F.count(F.lit(1)).alias("n_vertices"), F.countDistinct("component").alias("beta_0"))
    counted = parts.crossJoin(edges.select("src", "dst").distinct().agg(F.count(F.lit(1)).alias("n_edges")))
    beta_1 = F.greatest(F.lit(0).cast("long"), F.col("n_edges") - F.col("n_vertices") + F.col("beta_0"))
    return counted.select("n_vertices", "n_edges", "beta_0", beta_1.alias("beta_1"), F.lit(0).cast("long").alias("beta_2"))


def diamonds(edges: DataFrame) -> DataFrame:
    """(src, left, right, dst): src reaches dst over two different middles, left < right.

    Paths are not shuffled one by one: each source gets the lists of its middles, spreads them in its own
    task, and finds there the middles that share an end.
    """
    pairs = edges.select("src", "dst").where("src is not null and dst is not null").distinct()
    ahead = pairs.groupBy(F.col("src").alias("mid")).agg(F.collect_list("dst").alias("ends"))
    lists = pairs.select("src", F.col("dst").alias("mid")).join(ahead, "mid").repartition("src")
    met = lists.select("src", "mid", F.explode("ends").alias("dst")).groupBy("src", "dst").agg(F.array_sort(F.collect_list("mid")).alias("mids")).where(F.size("mids") > 1)
    left = met.select("src", "dst", "mids", F.posexplode("mids").alias("at", "left"))
    return left.select("src", "left", F.explode(F.slice("mids", F.col("at") + 2, F.size("mids"))).alias("right"), "dst")


def hubs(edges: DataFrame, least: int = 4) -> DataFrame:
    """(node, importers): nodes with at least ``least`` distinct importers."""
    return edges.groupBy(F.col("dst").alias("node")).agg(F.countDistinct("src").alias("importers")).where(F.col("importers") >= least)


def on_cycle(edges: DataFrame) -> DataFrame:
    """(node): nodes that reach themselves.

    Nodes without a way in or out are taken off until none is left; what stays has a cycle below and
    one above, and those that reach themselves are then found by traversal of what stayed.
    """
    core = _cut(edges.where("src != dst").select("src", "dst").distinct())
    loops = edges.where("src = dst").select(F.col("src").alias("node")).distinct()
    size = core.count()
    while size:
        slim = core.join(core.select(F.col("dst").alias("src")).distinct(), "src", "left_semi").join(core.select(F.col("src").alias("dst")).distinct(), "dst", "left_semi")
        core = _cut(slim)
        left = core.count()
        if left == size:
            break
        size = left
    found = reach(core.select(F.col("src").alias("start")).distinct(), core)
    return found.where("start = node").select(F.col("start").alias("node")).unionByName(loops).distinct()


def _witnesses(pdf: pd.DataFrame) -> Iterator[list]:
    """Cycles closed by back edges of a depth-first search in sorted order, turned to their smallest node."""
    ahead: dict = {}
    for a, b in sorted(zip(pdf["src"], pdf["dst"], strict=True)):
        ahead.setdefault(a, []).append(b)
        ahead.setdefault(b, [])
    state: dict = {}
    seen = set()
    for root in sorted(ahead):
        if root in state:
            continue
        state[root] = 1
        path, stack = [root], [iter(ahead[root])]
        while stack:
            for nxt in stack[-1]:
                if state.get(nxt, 0) == 1:
                    cycle = path[path.index(nxt) :]
                    at = cycle.index(min(cycle))
                    turned = tuple(cycle[at:] + cycle[:at])
                    if turned not in seen:
                        seen.add(turned)
                        yield list(turned)
                elif nxt not in state:
                    state[nxt] = 1
                    path.append(nxt)
                    stack.append(iter(ahead[nxt]))
                    break
            else:
                state[path.pop()] = 2
                stack.pop()


def cycle_witnesses(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(component, cycle): one cycle for each back edge of a depth-first search; not all cycles.

    The search never leaves a component, so components are searched side by side.
    """
    placed = edges.select("src", "dst").distinct().join(weak_components(nodes, edges), F.col("src") == F.col("node"))
    kind = dict(edges.dtypes)["src"]

    def search(pdf: pd.DataFrame) -> pd.DataFrame:
        found = list(_witnesses(pdf))
        names = pd.Series([pdf["component"].iloc[0]] * len(found), dtype=object)
        return pd.DataFrame({"component": names, "cycle": pd.Series(found, dtype=object)})

    return placed.select("component", "src", "dst").groupBy("component").applyInPandas(search, f"component {kind}, cycle array<{kind}>")


def cycle_basis(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(component, src, dst, cycle, orientation): the cycle that each edge outside a spanning forest closes.

    Edges join the forest in the order (smaller end, larger end, src, dst); orientation is directed
    if the walk follows the edges all the way around, mixed otherwise.
    """
    placed = edges.select("src", "dst").distinct().join(weak_components(nodes, edges), F.col("src") == F.col("node"))
    kind = dict(edges.dtypes)["src"]

    def span(pdf: pd.DataFrame) -> pd.DataFrame:
        pairs = sorted(zip(pdf["src"], pdf["dst"], strict=True), key=lambda e: (min(e), max(e), *e))
        have = set(pairs)
        parent: dict = {}

        def root(x):
            while parent.setdefault(x, x) != x:
                parent[x] = parent[parent[x]]
                x = parent[x]
            return x

        tree: dict = {}
        rest = []
        for a, b in pairs:
            ra, rb = root(a), root(b)
            if ra != rb:
                parent[rb] = ra
                tree.setdefault(a, []).append(b)
                tree.setdefault(b, []).append(a)
            else:
                rest.append((a, b))
        out = []
        for a, b in rest:
            if a == b:
                out.append((a, b, [a, a], "directed"))
                continue
            back, queue = {b: None}, [b]
            for x in queue:
                if x == a:
                    break
                for y in sorted(tree.get(x, [])):
                    if y not in back:
                        back[y] = x
                        queue.append(y)
            walk, x = [], a
            while x is not None:
                walk.append(x)
                x = back[x]
            walk = [a, *walk[::-1]]  # a, b, ... , a
            forward = all((u, v) in have for u, v in zip(walk, walk[1:], strict=False))
            out.append((a, b, walk, "directed" if forward else "mixed"))
        frame = pd.DataFrame(out, columns=["src", "dst", "cycle", "orientation"])
        frame.insert(0, "component", pdf["component"].iloc[0])
        return frame

    schema = f"component {kind}, src {kind}, dst {kind}, cycle array<{kind}>, orientation string"
    return placed.select("component", "src", "dst").groupBy("component").applyInPandas(span, schema)


def would_close_cycle(proposed: DataFrame, edges: DataFrame) -> DataFrame:
    """``proposed`` (src, dst) with unsafe: a self-loop, or dst already reaches src."""
    ends = proposed.select(F.col("dst").alias("start")).distinct()
    back = reach(ends, edges).select(F.col("start").alias("dst"), F.col("node").alias("src"), F.lit(True).alias("_back"))
    joined = proposed.join(back, ["src", "dst"], "left")
    return joined.select("src", "dst", (F.coalesce("_back", F.lit(False)) | (F.col("src") == F.col("dst"))).alias("unsafe"))
