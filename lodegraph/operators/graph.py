"""Neighbours, impact radius, shortest path, cycles and strongly connected components.

Traversals are frontier loops over DataFrames. Each level is materialised in the shared folder: lineage stays
short, a lost executor costs nothing, and the number of new rows is known before the next level is planned.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import schema
from ..plans.steps import materialize, sized


def _side(symbols: DataFrame, edges: DataFrame, own: str, other: str, node: str, kinds: tuple[str, ...] | None) -> DataFrame:
    e = edges.filter(F.col(own) == node)
    e = e.filter(F.col("kind").isin(*kinds)) if kinds else e
    e = e.select(F.col(other).alias("id"), F.col("kind").alias("edge_kind"))
    return e.join(symbols, "id")


def callers(symbols: DataFrame, edges: DataFrame, node: str, limit: int = 50) -> DataFrame:
    return _side(symbols, edges, "target_id", "source_id", node, schema.CALLS).orderBy("id").limit(limit)


def callees(symbols: DataFrame, edges: DataFrame, node: str, limit: int = 50) -> DataFrame:
    return _side(symbols, edges, "source_id", "target_id", node, schema.CALLS).orderBy("id").limit(limit)


def dependencies(symbols: DataFrame, edges: DataFrame, node: str) -> DataFrame:
    return _side(symbols, edges, "source_id", "target_id", node, None).orderBy("edge_kind", "name", "id")


def dependents(symbols: DataFrame, edges: DataFrame, node: str) -> DataFrame:
    return _side(symbols, edges, "target_id", "source_id", node, None).orderBy("edge_kind", "name", "id")


def children(symbols: DataFrame, edges: DataFrame, node: str) -> DataFrame:
    return _side(symbols, edges, "source_id", "target_id", node, schema.MEMBER).orderBy("start_line", "id")


def _levels(arcs: DataFrame, start: str, depth: int, stop: str | None = None) -> DataFrame:
    """Breadth first along arcs (u, v) from start: id, depth, path (ids before it, least of the shortest).

    arcs should be materialised. Stops at ``depth``, when nothing is new, or at the level that reaches ``stop``.
    """
    spark = arcs.sparkSession
    frontier = spark.createDataFrame([(start, 0, [])], "id string, depth int, path array<string>")
    levels = [frontier]
    seen, n = frontier.select("id"), 1
    for d in range(1, depth + 1):
        near = sized(frontier, n, 200)
        step = arcs.join(near, arcs["u"] == near["id"]).select(F.col("v").alias("to"), F.concat("path", F.array("id")).alias("path"))
        step = step.groupBy("to").agg(F.min("path").alias("path")).select(F.col("to").alias("id"), F.lit(d).alias("depth"), "path")
        frontier = materialize(step.join(seen, "id", "left_anti"))
        n = frontier.count()
        if not n:
            break
        levels.append(frontier)
        seen = seen.unionByName(frontier.select("id"))
        if stop is not None and frontier.filter(F.col("id") == stop).limit(1).count():
            break
    return reduce(DataFrame.unionByName, levels)


def impact(symbols: DataFrame, edges: DataFrame, node: str, depth: int = 3) -> DataFrame:
    """Symbols that depend on node, directly or not: id, depth, path from the node to just before the symbol."""
    arcs = materialize(edges.filter(F.col("kind").isin(*schema.IMPACT)).select(F.col("target_id").alias("u"), F.col("source_id").alias("v")).distinct())
    found = _levels(arcs, node, depth).filter("depth > 0")
    return found.join(symbols.select("id"), "id", "left_semi")


def impact_by_depth(found: DataFrame) -> DataFrame:
    return found.groupBy("depth").agg(F.count("*").alias("n"), F.array_join(F.sort_array(F.collect_list("id")), ",").alias("ids")).orderBy("depth")


def shortest_path(symbols: DataFrame, edges: DataFrame, start: str, end: str, depth: int = 10) -> DataFrame:
    """hop (from 0) and id along the least of the shortest undirected paths over all edge kinds; empty if there is none.

    Levels grow from both ends, the smaller one next, until they meet; edges are read as they are, without a copy in both
    directions. Then the path is followed from the start, to the least neighbour that is on a shortest path each time.
    """
    spark = edges.sparkSession
    none = spark.createDataFrame([], "hop int, id string")
    if not symbols.filter(F.col("id") == end).limit(1).count():
        return none
    both = edges.select(F.col("source_id").alias("u"), F.col("target_id").alias("v"))
    arcs = both.unionByName(both.select(F.col("v").alias("u"), F.col("u").alias("v"))).filter("u <> v")

    def beside(front: DataFrame, n: int) -> DataFrame:
        near = sized(front.select(F.col("id").alias("u")), n, 100)
        return arcs.join(near, "u").select(F.col("v").alias("id")).distinct()

    sides = [[(spark.createDataFrame([(x,)], "id string"), 1)] for x in (start, end)]
    met = sides[0][0] if start == end else None
    while met is None:
        if sum(map(len, sides)) - 2 >= depth:
            return none
        own = min(sides, key=lambda s: s[-1][1])
        other = sides[1] if own is sides[0] else sides[0]
        # An undirected edge leads at most one level back.
        seen = reduce(DataFrame.unionByName, [f for f, _ in own[-2:]])
        front = materialize(beside(*own[-1]).join(seen, "id", "left_anti"))
        n = front.count()
        if not n:
            return none
        own.append((front, n))
        common = materialize(front.join(other[-1][0], "id", "left_semi"))
        met = (common, k) if (k := common.count()) else None
    # The nodes on shortest paths: from where the sides meet back to the start, and all of the other side's levels.
    on = [met]
    for level, n in reversed(sides[0][1:-1]):
        before = materialize(sized(level, n, 100).join(beside(*on[0]), "id", "left_semi"))
        on.insert(0, (before, before.count()))
    on = (on if len(sides[0]) > 1 else []) + sides[1][-2::-1] if start != end else []
    path = [start]
    for level, _ in on:
        step = arcs.filter(F.col("u") == path[-1]).select(F.col("v").alias("id")).distinct()
        path.append(step.join(level, "id", "left_semi").agg(F.min("id")).first()[0])
    return spark.createDataFrame(list(enumerate(path)), "hop int, id string").orderBy("hop")


def cycles(edges: DataFrame, limit: int | None = 20) -> DataFrame:
    """Simple cycles of any length over the cycle kinds: path (joined by >, closed), size, via; the shortest first, then by path.

    A cycle starts at its least id. Each edge from a node u to a node r, r not above u, that closes a cycle through ids
    from r up gives one: the least of the shortest. So every cyclic component has one at least, and of the cycles with
    the same closing edge the shortest is named; ``via`` is the least kind of that edge. Edges outside strongly
    connected components cannot lie on a cycle and are left out first. Cycles are found by rising size, up to the
    first size at which there are ``limit``.
    """
    e = edges.filter(F.col("kind").isin(*schema.CYCLE)).select(F.col("source_id").alias("u"), F.col("target_id").alias("v"), "kind")
    scc = members(e.select("u", "v"))
    inside = e.filter("u = v")
    if scc is not None:
        scc, n = (scc := materialize(scc)), scc.count()
        near = [sized(scc.select(F.col("id").alias(x), F.col("c").alias(f"c{x}")), n, 200) for x in "uv"]
        inside = inside.unionByName(e.filter("u <> v").join(near[0], "u").join(near[1], "v").filter("cu = cv").select("u", "v", "kind"))
    inside = materialize(inside.groupBy("u", "v").agg(F.min("kind").alias("kind")))
    closing = materialize(inside.filter("v <= u").select(F.col("v").alias("root"), F.col("u").alias("at"), "kind"))
    front = materialize(closing.select("root").distinct().select("root", F.col("root").alias("at"), F.array("root").alias("path")))
    seen, found, size = front.select("root", "at"), [], 1
    n, all_ = 0, closing.count()
    while True:
        hit = materialize(front.join(closing, ["root", "at"]).select("path", F.col("kind").alias("via"), F.lit(size).alias("size")))
        found.append(hit)
        n += hit.count()
        if n == all_ or (limit is not None and n >= limit):
            break
        step = front.join(inside.select(F.col("u").alias("at"), F.col("v").alias("next")), "at").filter("next > root")
        step = step.groupBy("root", "next").agg(F.min("path").alias("path")).select("root", F.col("next").alias("at"), F.concat("path", F.array("next")).alias("path"))
        front = materialize(step.join(seen, ["root", "at"], "left_anti"))
        if not front.limit(1).count():
            break
        seen, size = seen.unionByName(front.select("root", "at")), size + 1
        if size % 8 == 0:  # short plans
            seen = materialize(seen)
    named = reduce(DataFrame.unionByName, found).select(F.array_join(F.concat("path", F.array(F.col("path")[0])), ">").alias("cycle"), "size", "via").orderBy("size", "cycle")
    return named.limit(limit) if limit is not None else named


def _between(arcs: DataFrame) -> DataFrame:
    """arcs whose ends both have arcs in and out. These nodes are counted first: where they are few, no arc moves."""
    inner = materialize(arcs.select(F.col("u").alias("id")).distinct().join(arcs.select(F.col("v").alias("id")).distinct(), "id", "left_semi"))
    n = inner.count()
    near = [sized(inner.select(F.col("id").alias(x)), n, 100) for x in "uv"]
    return arcs.join(near[0], "u", "left_semi").join(near[1], "v", "left_semi").select("u", "v")


def _trimmed(arcs: DataFrame, size: int, rounds: int) -> tuple[DataFrame, int]:
    """arcs without nodes that lack an arc in or out, which lie on no cycle; at most ``rounds`` layers of them."""
    for _ in range(rounds):
        kept = materialize(_between(arcs))
        after = kept.count()
        if after == size:
            return arcs, size
        arcs, size = kept, after
        if not size:
            break
    return arcs, size


def _contracted(arcs: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame] | None:
    """Chains of nodes with one arc in and one out, replaced by arcs; None if there are no such nodes.

    (arcs left, chains: id of each such node with the nodes p and v that its chain leads from and to, rings: id and c of
    those whose chain leads back to itself). Pointers along chains double, so rounds grow with the logarithm of the
    longest chain.
    """
    ends = arcs.select(F.explode(F.array(F.struct(F.col("u").alias("id"), F.col("v").alias("next"), F.lit(1).alias("o"), F.lit(0).alias("i")), F.struct(F.col("v").alias("id"), F.lit(None).alias("next"), F.lit(0).alias("o"), F.lit(1).alias("i")))).alias("e"))
    mid = ends.groupBy("e.id").agg(F.sum("e.o").alias("o"), F.sum("e.i").alias("i"), F.max("e.next").alias("next")).filter("o = 1 and i = 1").select("id", "next")
    mid = materialize(mid)
    n = mid.count()
    if not n:
        return None
    # to: the node as far along the chain as is known, low: the least id on the way; ``done`` at the chain's last node.
    ids = mid.select(F.col("id").alias("next"), F.lit(True).alias("more"))
    state = materialize(mid.join(ids, "next", "left").select("id", F.when(F.col("more"), F.col("next")).otherwise(F.col("id")).alias("to"), F.when(F.col("more"), F.least("id", "next")).otherwise(F.col("id")).alias("low"), F.col("more").isNull().alias("done")))
    for _ in range(n.bit_length() + 1):
        if not state.filter("not done").limit(1).count():
            break
        far = state.select(F.col("id").alias("to"), F.col("to").alias("to2"), F.col("low").alias("low2"), F.col("done").alias("done2"))
        ahead = state.filter("not done").join(far, "to").select("id", F.col("to2").alias("to"), F.least("low", "low2").alias("low"), F.col("done2").alias("done"))
        state = materialize(state.filter("done").unionByName(ahead))
    rings = state.filter("not done").select("id", F.col("low").alias("c"))
    chain = state.filter("done").select("id", F.col("to").alias("last"))
    last = mid.select(F.col("id").alias("last"), F.col("next").alias("to_"))
    ids = mid.select("id")
    # A chain's first node is the one whose arc in comes from a node that isn't of this kind.
    into = arcs.join(ids.withColumnRenamed("id", "u"), "u", "left_anti").join(chain.withColumnRenamed("id", "v"), "v").select(F.col("u").alias("p"), "last")
    spans = materialize(into.join(last, "last").select("last", "p", F.col("to_").alias("v")))
    chains = materialize(chain.join(spans, "last").select("id", "p", "v"))
    left = arcs.join(ids.withColumnRenamed("id", "u"), "u", "left_anti").join(ids.withColumnRenamed("id", "v"), "v", "left_anti")
    left = materialize(left.unionByName(spans.select(F.col("p").alias("u"), "v")).filter("u <> v").distinct())
    return left, chains, materialize(rings)


def components(arcs: DataFrame) -> DataFrame:
    """Strongly connected components of (u, v): id and component, the component's least id."""
    nodes = arcs.select(F.explode(F.array("u", "v")).alias("id")).distinct()
    named = members(arcs)
    if named is None:
        return nodes.select("id", F.col("id").alias("component"))
    return nodes.join(named, "id", "left").select("id", F.coalesce("c", "id").alias("component"))


def members(arcs: DataFrame) -> DataFrame | None:
    """id and c, the least id of its component, for every node in a component of several and maybe some others; None if there are none.

    Nodes without arcs in or out are left out before arcs are made distinct. Layers without arcs in or out are trimmed and chains contracted in turn, as long as that takes a tenth of the arcs.
    On what is left: the least id that reaches a node colours it; a colour's component is what its root reaches against
    the arcs within the colour; repeat on the rest. Rounds grow with the distances in the contracted graph.
    """
    left = materialize(_between(arcs.filter("u <> v")).distinct())
    size = left.count()
    found: list[DataFrame] = []  # (id, c): members of components
    chains: list[DataFrame] = []
    while size:
        before = size
        left, size = _trimmed(left, size, 4)
        made = _contracted(left) if size else None
        if made:
            left, chain, rings = made
            chains.append(chain)
            found.append(rings)
            size = left.count()
        if size > 0.9 * before:
            break
    while size:
        colour = materialize(left.select(F.explode(F.array("u", "v")).alias("id")).distinct().withColumn("c", F.col("id")))
        while True:
            seen = left.join(colour.withColumnRenamed("id", "u"), "u").groupBy("v").agg(F.min("c").alias("m")).withColumnRenamed("v", "id")
            after = materialize(colour.join(seen, "id", "left").select("id", F.least("c", "m").alias("c"), (F.col("m") < F.col("c")).alias("moved")))
            moved = after.filter("moved").limit(1).count()
            colour = after.select("id", "c")
            if not moved:
                break
        inner = left.join(colour.select(F.col("id").alias("u"), F.col("c").alias("cu")), "u").join(colour.select(F.col("id").alias("v"), F.col("c").alias("cv")), "v").filter("cu = cv")
        inner = materialize(inner.select("u", "v", F.col("cu").alias("c")))
        reach = front = materialize(colour.filter("id = c"))
        while front.limit(1).count():
            back = inner.join(front.select(F.col("id").alias("v")), "v").select(F.col("u").alias("id"), "c").distinct()
            front = materialize(back.join(reach, "id", "left_anti"))
            reach = reach.unionByName(front)
        reach = materialize(reach)
        found.append(reach)
        gone = reach.select("id")
        left = materialize(left.join(gone.select(F.col("id").alias("u")), "u", "left_anti").join(gone.select(F.col("id").alias("v")), "v", "left_anti").select("u", "v"))
        left, size = _trimmed(left, left.count(), 4)
    if not found and not chains:
        return None
    named = reduce(DataFrame.unionByName, found) if found else chains[0].limit(0).select("id", F.col("p").alias("c"))
    # The nodes of a chain belong to its ends' component if that is one: chains made last are undone first.
    for chain in reversed(chains):
        own = materialize(named)
        p, v = own.select(F.col("id").alias("p"), F.col("c").alias("cp")), own.select(F.col("id").alias("v"), F.col("c").alias("cv"))
        both = chain.join(p, "p", "left").join(v, "v", "left").filter("p = v or cp = cv").select("id", F.coalesce("cp", "p").alias("c"), "p", "cp")
        named = own.unionByName(both.select("id", "c")).unionByName(both.filter("cp is null").select(F.col("p").alias("id"), "c").distinct())
    least = named.groupBy("c").agg(F.min("id").alias("least"))
    return named.join(least, "c").select("id", F.col("least").alias("c"))


def scc_members(edges: DataFrame) -> DataFrame:
    """id, component and size of the components of several symbols, over the cycle kinds."""
    c = members(edges.filter(F.col("kind").isin(*schema.CYCLE)).select(F.col("source_id").alias("u"), F.col("target_id").alias("v")))
    if c is None:
        return edges.sparkSession.createDataFrame([], "id string, component string, size long")
    c = c.select("id", F.col("c").alias("component"))
    n = c.groupBy("component").agg(F.count("*").alias("size")).filter("size > 1")
    return c.join(n, "component").select("id", "component", "size")
