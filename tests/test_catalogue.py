"""Every catalogue query with SQL against DuckDB on the smallest tables."""

from collections import defaultdict

import pytest

from lodegraph import schema
from lodegraph.plans import catalogue
from lodegraph.sources import fixtures as fx

from .comparing import SF, assert_same, connect


@pytest.fixture(scope="module")
def con():
    return connect()


@pytest.mark.parametrize("name", sorted(catalogue.ORACLES))
def test_equals_duckdb(spark, con, name):
    assert_same(catalogue.QUERIES[name](spark, SF), con, catalogue.ORACLES[name])


def walk(arcs, start, depth):
    """id: least of the shortest paths to it, without it."""
    out, front = defaultdict(set), {start: ()}
    for u, v in arcs:
        out[u].add(v)
    paths = dict(front)
    for _ in range(depth):
        after = {}
        for u, p in front.items():
            for v in out[u] - paths.keys():
                after[v] = min(after.get(v, (*p, u)), (*p, u))
        front = after
        paths |= after
    return paths


def test_whole_graph_by_plain_python(spark):
    got = {n: [tuple(r) for r in catalogue.QUERIES[n](spark, SF).collect()] for n in ("dead_code", "impact_paths", "impact_by_depth", "shortest_path", "circular_deps", "scc_members")}
    symbols = {r["id"]: r for r in fx.whole_symbols(spark, SF).collect()}
    # The edges themselves, from the tables.
    t = {n: fx.table(spark, SF, n).toPandas() for n in ("nation", "supplier", "customer", "orders", "lineitem")}
    nation_of_c, nation_of_s = (dict(zip(t[n][f"{n[0]}_{k}key"], t[n][f"{n[0]}_nationkey"])) for n, k in (("customer", "cust"), ("supplier", "supp")))
    buyer = dict(zip(t["orders"]["o_orderkey"], t["orders"]["o_custkey"]))
    edges = {(f"r:{r}", f"n:{n}", "contains") for r, n in zip(t["nation"]["n_regionkey"], t["nation"]["n_nationkey"])}
    edges |= {(f"n:{n}", f"c:{c}", "contains") for c, n in nation_of_c.items()} | {(f"n:{n}", f"s:{s}", "contains") for s, n in nation_of_s.items()}
    for o, s, p in zip(t["lineitem"]["l_orderkey"], t["lineitem"]["l_suppkey"], t["lineitem"]["l_partkey"]):
        edges |= {(f"c:{buyer[o]}", f"s:{s}", "calls"), (f"s:{s}", f"p:{p}", "imports")}
        if nation_of_c[buyer[o]] != nation_of_s[s]:
            edges.add((f"n:{nation_of_c[buyer[o]]}", f"n:{nation_of_s[s]}", "calls"))
    trade = {(a, b) for a, b, _ in edges if a[0] == b[0] == "n"}
    assert len(trade) > 50

    used = {b for _, b, k in edges if k in schema.IMPACT}
    assert {r[0] for r in got["dead_code"]} == {i for i, r in symbols.items() if r["kind"] in catalogue.DEAD_KINDS and i not in used}
    found = walk({(b, a) for a, b, k in edges if k in schema.IMPACT}, "p:1", 3)
    want = {i: (len(p), ">".join(p)) for i, p in found.items() if p and i in symbols}
    assert {r[0]: r[1:] for r in got["impact_paths"]} == want and len(got["impact_paths"]) == len(want)
    assert got["impact_by_depth"] == [(d, len(i), ",".join(i)) for d in sorted({d for d, _ in want.values()}) for i in [sorted(x for x, w in want.items() if w[0] == d)]]
    both = {(a, b) for a, b, _ in edges} | {(b, a) for a, b, _ in edges}
    assert got["shortest_path"] == list(enumerate([*walk(both, "r:0", 10)["p:1"], "p:1"]))
    # Other kinds of node call and import downwards only, so cycles are among the nations.
    nodes = sorted({x for a in trade for x in a})
    reach = {a: set(walk(trade, a, 30)) for a in nodes}
    comp = {a: {b for b in nodes if b in reach[a] and a in reach[b]} for a in nodes}
    assert set(got["scc_members"]) == {(a, min(c), len(c)) for a, c in comp.items() if len(c) > 1}
    rings = [[(a, b) for a, b in trade if a < b and (b, a) in trade]]
    rings.append([(a, b, c) for a, b in trade for c in nodes if a < b and a < c and b != c and (b, c) in trade and (c, a) in trade])
    listed = [(">".join([*r, r[0]]), len(r), "calls") for n in rings for r in sorted(n, key=lambda r: ">".join([*r, r[0]]))]
    assert len(listed) >= 20 and got["circular_deps"] == listed[:20]


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() == 20
    assert set(e.oracle_sql()) <= set(e.queries())
