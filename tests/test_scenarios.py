"""Single operators on tiny graphs."""

import random
from collections import deque

import pytest
from pyspark.sql import functions as F

from lodegraph import schema
from lodegraph.functions import text
from lodegraph.operators import analysis, graph, lookup, resolve, search, semantic
from lodegraph.sources import store


def symbols(spark, *rows):
    """Rows (name, extra fields) with defaults."""
    out = []
    for r in rows:
        name, extra = (r, {}) if isinstance(r, str) else r
        d = {"id": name, "kind": "function", "name": name, "qualified_name": f"test.{name}", "file_path": "test.ts", "start_line": 1, "end_line": 10, "language": "typescript", "signature": f"function {name}()", "docstring": None, "exported": False, "complexity": 0} | extra
        out.append(tuple(d.values()))
    return spark.createDataFrame(out, "id string, kind string, name string, qualified_name string, file_path string, start_line int, end_line int, language string, signature string, docstring string, exported boolean, complexity int")


def edges(spark, *rows):
    return spark.createDataFrame(list(rows), "source_id string, target_id string, kind string")


def ids(df):
    return [r["id"] for r in df.collect()]


def test_search_by_prefix(spark):
    s = symbols(spark, "getUserById", "getPostById", "createUser")
    assert ids(search.search(s, "getUser")) == ["getUserById"]
    assert ids(search.search(s, "user")) == []  # camel case is not split here


def test_search_with_kind(spark):
    s = symbols(spark, ("Foo", {"kind": "class"}), "foo")
    assert ids(search.search(s, "foo", "class")) == ["Foo"]


def test_search_needs_all_terms_and_takes_operators_as_words(spark):
    s = symbols(spark, "alpha", "beta", ("both", {"docstring": "alpha beta"}))
    assert ids(search.search(s, "alpha beta")) == ["both"]
    assert ids(search.search(s, "alpha AND")) == []
    assert ids(search.search(s, "get_alpha")) == []
    assert set(ids(search.search(s, "%"))) == {"alpha", "beta", "both"}


def test_search_folds_accents(spark):
    s = symbols(spark, ("x", {"docstring": "Élan vital"}), ("y", {"docstring": "e\u0301toile"}), ("z", {"docstring": "άλφα йод"}))
    assert ids(search.search(s, "elan")) == ["x"] and ids(search.search(s, "etoile")) == ["y"]
    tokens = {r["token"] for r in search.build_postings(s).filter("id = 'z'").collect()}
    assert {"αλφα", "иод"} <= tokens


def test_a_search_fetches_symbols_after_the_cut(spark):
    s = symbols(spark, *[(f"s{i}", {"docstring": "shared " * (i % 4 + 1), "kind": "class" if i % 2 else "function"}) for i in range(12)])
    s = s.unionByName(s.filter("id = 's7'")).unionByName(s.filter("id = 's1'").withColumn("id", F.lit(None).cast("string"))).repartition(3)
    index = search.built(s)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as if no side were small
    try:
        for kind, stored in ((None, None), ("class", index)):
            rows = s.filter(F.col("kind") == kind) if kind else s
            ranked = search.bm25(search.naming(index[0], ["shared"]), search.term_frame(s, ["shared"]), index[1])
            every = [(r["id"], r["docstring"], round(r["score"], 9)) for r in rows.join(ranked, "id").collect()]
            for limit in (3, 20):
                found = search.search(s, "shared", kind, limit, stored)
                assert [(r["id"], r["docstring"], round(r["score"], 9)) for r in found.collect()] == sorted(every, key=lambda r: (-r[2], r[0]))[:limit]
            assert found.columns == [*s.columns, "score"]
            assert "BroadcastHashJoin [id" in _plan(found) and ("LeftSemi" in _plan(found)) == bool(kind or stored)  # rows aren't sorted to meet the hits
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_a_search_reads_the_tokens_it_names(spark, tmp_path):
    s = symbols(spark, *[(f"s{i}", {"docstring": f"word{i} shared"}) for i in range(20)])
    kept = store.Store(spark, f"file://{tmp_path}/store")
    postings, stats = search.built(s)
    kept.commit(postings=postings, search_stats=stats)
    stored = kept.read("postings"), kept.read("search_stats")
    found = search.search(s, "shared word7", index=stored)
    assert [tuple(r) for r in found.collect()] == [tuple(r) for r in search.search(s, "shared word7").collect()] and ids(found) == ["s7"]
    plan = search.naming(stored[0], ["shared word7"])._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters" in plan and "StringStartsWith(token,word7)" in plan and "EqualTo(token,shared)" in plan


def test_by_file_and_delete(spark):
    s = symbols(spark, "x", "y")
    assert lookup.by_file(s, "test.ts").count() == 2
    gone = spark.createDataFrame([("test.ts",)], "file_path string")
    assert store.without_files(s, gone).count() == 0


def test_upsert_keeps_created(spark):
    old = spark.createDataFrame([("a", 1, "then"), ("b", 1, "then")], "id string, v int, created_at string")
    new = spark.createDataFrame([("b", 2, "now"), ("c", 2, "now")], "id string, v int, created_at string")
    got = {tuple(r) for r in store.upsert(old, new, ["id"]).collect()}
    assert got == {("a", 1, "then"), ("b", 2, "then"), ("c", 2, "now")}


def test_callers_and_callees(spark):
    s, e = symbols(spark, "caller", "callee"), edges(spark, ("caller", "callee", "calls"))
    assert ids(graph.callers(s, e, "callee")) == ["caller"]
    assert ids(graph.callees(s, e, "caller")) == ["callee"]
    assert ids(graph.callers(s, e, "caller")) == []


def test_dependencies(spark):
    s, e = symbols(spark, "Component", "Service"), edges(spark, ("Component", "Service", "imports"))
    assert [(r["id"], r["edge_kind"]) for r in graph.dependencies(s, e, "Component").collect()] == [("Service", "imports")]


def test_impact(spark):
    s = symbols(spark, "base", "middle", "top")
    e = edges(spark, ("middle", "base", "calls"), ("top", "middle", "calls"), ("ghost", "base", "calls"))
    got = {r["id"]: (r["depth"], r["path"]) for r in graph.impact(s, e, "base").collect()}
    assert got == {"middle": (1, ["base"]), "top": (2, ["base", "middle"])}
    assert graph.impact(s, e, "base", 0).count() == 0


def test_path(spark):
    s = symbols(spark, "start", "middle", "other", "end", "alone")
    e = edges(spark, ("start", "middle", "calls"), ("end", "middle", "imports"), ("start", "other", "calls"), ("other", "end", "calls"))
    assert ids(graph.shortest_path(s, e, "start", "end")) == ["start", "middle", "end"]
    assert ids(graph.shortest_path(s, e, "start", "alone")) == []
    assert ids(graph.shortest_path(s, e, "start", "start")) == ["start"]


def test_cycles(spark):
    e = edges(spark, ("a", "b", "calls"), ("b", "a", "imports"), ("b", "c", "calls"), ("c", "a", "calls"), ("d", "d", "calls"), ("d", "a", "calls"), ("x", "a", "uses_type"), ("a", "x", "uses_type"))
    got = [(r["cycle"], r["size"], r["via"]) for r in graph.cycles(e).collect()]
    assert got == [("d>d", 1, "calls"), ("a>b>a", 2, "imports"), ("a>b>c>a", 3, "calls")]
    assert {r["id"] for r in graph.scc_members(e).collect()} == {"a", "b", "c"}


def brute_cycles(arcs):
    """For each arc u to r that closes a cycle through nodes from r up: the least of the shortest paths from r to u."""
    out = []
    for u, r in arcs:
        if r > u:
            continue
        front, seen = {r: (r,)}, {r}
        while front and u not in front:
            after = {}
            for x, p in front.items():
                for a, b in arcs:
                    if a == x and b > r and b not in seen:
                        after[b] = min(after.get(b, (*p, b)), (*p, b))
            front = after
            seen |= front.keys()
        if u in front:
            out.append((len(front[u]), ">".join([*front[u], r])))
    return sorted(out)


def test_long_cycles_are_reported(spark):
    def ring(ids):
        return [(a, b, "calls") for a, b in zip(ids, ids[1:] + ids[:1])]

    seven, nine = [f"a{i}" for i in range(7)], [f"b{i}" for i in range(9)]
    # b has cycles of 8 and 9 edges with the same closing edge: the shorter one counts.
    arcs = ring(seven) + ring(nine) + [("b3", "b5", "extends"), ("a0", "b0", "calls"), ("x", "y", "calls"), ("y", "x", "calls")]
    want = [("x>y>x", 2, "calls"), (">".join([*seven, "a0"]), 7, "calls"), (">".join([*nine[:4], *nine[5:], "b0"]), 8, "calls")]
    assert [tuple(r) for r in graph.cycles(edges(spark, *arcs)).collect()] == want


@pytest.mark.parametrize("seed", [1, 2])
def test_cycles_by_brute_force(spark, seed):
    rnd = random.Random(seed)
    arcs = {(f"v{rnd.randrange(14):02}", f"v{rnd.randrange(14):02}") for _ in range(24)} | {(f"w{i}", f"w{(i + 1) % 8}") for i in range(8)}
    want = brute_cycles(arcs)
    e = edges(spark, *[(a, b, "calls") for a, b in arcs])
    assert [(r["size"], r["cycle"]) for r in graph.cycles(e, None).collect()] == want and len(want) > 2
    assert [(r["size"], r["cycle"]) for r in graph.cycles(e, 2).collect()] == want[:2]


def test_components_of_chains_and_rings(spark):
    """Chains that lead into, out of and through components, a ring of nothing else, and rings in series."""
    chain = [(f"q{i:03}", f"q{i + 1:03}") for i in range(60)]
    ring = [(f"r{i:02}", f"r{(i + 1) % 20:02}") for i in range(20)]
    loop = [("m", "n"), ("n", "o"), ("o", "m"), ("m", "z1"), ("z1", "z2"), ("z2", "o"), ("n", "x1"), ("x1", "x2"), ("q060", "m"), ("o", "q000"), ("e1", "e2"), ("e2", "e1"), ("e2", "r05")]
    arcs = chain + ring + loop
    got = {r["id"]: r["component"] for r in graph.components(spark.createDataFrame(arcs, "u string, v string")).collect()}
    big = {"m", "n", "o", "z1", "z2"} | {x for a in chain for x in a}
    want = {x: "m" if x in big else "r00" if x[0] == "r" else "e1" if x[0] == "e" else x for a in arcs for x in a}
    assert got == want


@pytest.mark.parametrize("seed", [1, 2])
def test_random_graph(spark, seed):
    rnd = random.Random(seed)
    names = [f"v{i:02}" for i in range(18)]
    arcs = {(a, b) for a in names for b in rnd.sample(names, 2) if rnd.random() < 0.6}
    e = edges(spark, *[(a, b, "calls") for a, b in arcs])
    s = symbols(spark, *names)
    depth, queue = {"v00": 0}, deque(["v00"])
    while queue:
        x = queue.popleft()
        for a, b in arcs:
            if b == x and a not in depth:
                depth[a] = depth[x] + 1
                queue.append(a)
    got = {r["id"]: r["depth"] for r in graph.impact(s, e, "v00", 20).collect()}
    assert got == {k: v for k, v in depth.items() if v}
    reach = {v: {v} for v in names}
    for _ in names:
        for a, b in arcs:
            reach[a] |= reach[b]
    want = {v: min(w for w in reach[v] if v in reach[w]) for v in names if any(v in x for x in arcs)}
    assert {r["id"]: r["component"] for r in graph.components(e.select(F.col("source_id").alias("u"), F.col("target_id").alias("v"))).collect()} == want


def test_dead_code(spark):
    s, e = symbols(spark, "used", "unused", ("main", {"exported": True})), edges(spark, ("main", "used", "calls"), ("main", "unused", "contains"))
    assert set(ids(analysis.dead_code(s, e))) == {"unused", "main"}
    assert ids(analysis.dead_code(s, e, include_exported=False)) == ["unused"]


def test_hotspots(spark):
    s = symbols(spark, "hub", "a", "b", "c")
    e = edges(spark, ("a", "hub", "calls"), ("b", "hub", "calls"), ("c", "hub", "calls"))
    first = analysis.hotspots(s, e).first()
    assert (first["id"], first["in_degree"], first["out_degree"]) == ("hub", 3, 0)


def test_stats(spark):
    s = symbols(spark, "a", ("B", {"kind": "class"}))
    f = spark.createDataFrame([("test.ts", "typescript", 50)], "file_path string, language string, line_count int")
    r = analysis.stats(s, edges(spark), f).first()
    assert (r["nodes"], r["edges"], r["files"], r["lines"]) == (2, 0, 1, 50)
    assert r["nodes_by_kind"] == {"function": 1, "class": 1}


def test_semantic(spark):
    s = symbols(spark, ("authenticateUser", {"signature": "authenticateUser(email, password)"}), ("validateToken", {"signature": "validateToken(jwt)"}), ("renderDashboard", {"signature": "renderDashboard()"}))
    assert ids(semantic.search(s, "authenticate user password"))[0] == "authenticateUser"


def test_complexity(spark):
    s = symbols(spark, ("a", {"complexity": 3}), ("b", {"complexity": 25}), ("c", {"complexity": 12}))
    assert ids(analysis.complexity_report(s)) == ["b", "c"]


def test_ids(spark):
    def one(name):
        return spark.range(1).select(schema.node_id(F.lit("function"), F.lit("test.ts"), F.lit(name), F.lit(1))).first()[0]

    assert one("foo") == one("foo") != one("bar") and len(one("foo")) == 16


def test_name_tiers_and_resolution(spark):
    s = symbols(spark, "foo", ("f2", {"name": "foo", "file_path": "b.ts"}), ("bar", {"qualified_name": "test.bar"}))
    assert set(ids(lookup.by_name(s, "foo"))) == {"foo", "f2"}
    assert ids(lookup.by_name(s, "test.bar")) == ["bar"]
    assert ids(lookup.by_name(s, "st.ba")) == ["bar"]
    assert lookup.resolve(s, "foo").first()["status"] == "ambiguous"
    assert lookup.resolve(s, "foo", "b.ts").first()["id"] == "f2"
    assert lookup.resolve(s, "none").first()["status"] == "not_found"


def test_dangling(spark):
    s, e = symbols(spark, "a", "b"), edges(spark, ("a", "b", "calls"), ("a", "gone", "calls"))
    assert store.connected(e, s).count() == 1
    assert [(r["no_source"], r["no_target"]) for r in store.dangling(e, s).collect()] == [(False, True)]


def test_reference_resolution(spark):
    s = symbols(spark, ("near", {"name": "helper", "file_path": "src/a/x.ts"}), ("far", {"name": "helper", "file_path": "lib/y.ts", "exported": True}), ("me", {"name": "caller", "file_path": "src/a/z.ts"}))
    refs = spark.createDataFrame([("me", "helper", "calls", "src/a/z.ts"), ("me", "caller", "calls", "src/a/z.ts"), ("me", "nothing", "calls", "src/a/z.ts")], schema.REFS)
    assert [(r["source_id"], r["target_id"], r["kind"]) for r in resolve.resolve(refs, s).collect()] == [("me", "near", "calls")]


def test_bm25_of_many_names_equals_single_searches(spark):
    words = ["alpha", "alphabet", "beta", "gamma ray", "a", "ray"]
    rnd = random.Random(3)
    s = symbols(spark, *[(f"s{i}", {"docstring": " ".join(rnd.choices(["alpha", "alphabet", "beta", "gamma", "ray", "arc"], k=6))}) for i in range(30)])
    postings, stats = search.built(s)
    names = spark.createDataFrame([(w,) for w in words], "ref_name string")
    many = resolve.bm25_by_name(postings, resolve.name_terms(names), stats)
    one = search.bm25(search.naming(postings, words), search.term_frame(s, words), stats)
    assert sorted((r["query"], r["id"], round(r["score"], 9)) for r in many.collect()) == sorted((r["query"], r["id"], round(r["score"], 9)) for r in one.collect())


def test_references_are_rated_once_for_each_place(spark):
    s = symbols(spark, ("near", {"name": "helper", "file_path": "src/a/x.ts"}), ("far", {"name": "helper", "file_path": "lib/y.ts"}), ("me", {"name": "caller", "file_path": "src/a/z.ts"}), ("red", {"name": "red red", "file_path": "lib/r.ts"}))
    refs = [("me", "helper", "calls", "src/a/z.ts"), ("other", "helper", "calls", "src/a/z.ts"), ("near", "helper", "calls", "src/a/x.ts"), ("up", "helper", "calls", None), ("up", "helper", "imports", "lib/q.ts"), ("me", "red red", "calls", "lib/q.ts"), ("me", "red none", "calls", "lib/q.ts"), ("me", "", "calls", "lib/q.ts")]
    got = resolve.resolve(spark.createDataFrame(refs, schema.REFS), s)
    assert "Window" not in _plan(got)  # the references themselves are only joined to the ratings of their places
    want = {("me", "near", "calls"), ("other", "near", "calls"), ("up", "far", "calls"), ("up", "far", "imports"), ("me", "red", "calls")}
    rows = [(r["source_id"], r["target_id"], r["kind"]) for r in got.collect()]
    assert set(rows) == want and len(rows) == len(want)


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_tokens_are_counted_within_a_row(spark):
    rows = spark.createDataFrame([("a", "Red red", None), ("a", "red blueGreen", "x"), ("b", "", "two two one"), (None, "red", None), ("c", None, None)], "id string, name string, docstring string")
    fields = ("name", "docstring")
    counts = semantic.token_counts(rows, fields)
    assert "Aggregate" not in _plan(counts) and "Aggregate" not in _plan(search.build_postings(rows, fields))  # a task would hold every token it meets
    got = {tuple(r) for r in counts.collect()}
    assert got == {("a", "name", "red", 3, 3), ("a", "name", "blue", 1, 3), ("a", "name", "green", 1, 3), ("b", "docstring", "two", 2, 2), ("b", "docstring", "one", 1, 2), (None, "name", "red", 1, 1)}
    assert {tuple(r) for r in semantic.vocabulary(rows, fields).collect()} == {("red", 2), ("blue", 1), ("green", 1), ("two", 1), ("one", 1)}
    assert {tuple(r) for r in search.build_postings(rows, fields).collect()} == {("a", "red", 3, 5), ("a", "bluegreen", 1, 5), ("a", "x", 1, 5), ("b", "two", 2, 3), ("b", "one", 1, 3), (None, "red", 1, 1)}


def test_texts_of_single_keys_stay_in_their_rows(spark, monkeypatch):
    rows = spark.createDataFrame([("a", "Red red", None), ("b", "", "two two one"), (None, "red", None), ("c", None, None)], "id string, name string, docstring string")
    fields = ("name", "docstring")
    for df in (semantic.token_counts(rows, fields), search.build_postings(rows, fields)):
        assert "Exchange" not in _plan(df) and "Sort" not in _plan(df)  # a task would hold the texts that it sorts
    tokens = semantic.vocabulary(rows, fields)
    assert "Window" not in _plan(tokens) and {tuple(r) for r in tokens.collect()} == {("red", 2), ("two", 1), ("one", 1)}
    twice = rows.unionByName(rows.filter("id is null or id = 'b'"))
    want = [("a", "Red red", ""), ("b", " ", "two two one two two one"), ("c", "", ""), (None, "red red", "")]
    for width in (text.KEY_BYTES, 1 << 40):  # few repeated keys; more than a broadcast takes
        monkeypatch.setattr(text, "KEY_BYTES", width)
        assert sorted(map(tuple, text.merged(twice, "id", fields).collect()), key=str) == sorted(want, key=str)


@pytest.mark.parametrize("width", [text.KEY_BYTES, 1 << 40])  # few repeated keys; more than a broadcast takes
def test_documents_without_an_id_are_not_counted_and_not_joined(spark, tmp_path, monkeypatch, width):
    import duckdb

    from lodegraph.plans import catalogue

    monkeypatch.setattr(text, "KEY_BYTES", width)
    docs = [(1, "red red blue"), (2, "red"), (2, "red two"), (3, None), (None, "red green"), (None, "green green"), (None, None)]
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {tuple(r) for r in catalogue.QUERIES["tokenize"](spark, str(tmp_path)).select("token", "n", "docs").collect()}
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    assert got == set(con.execute(f"SELECT token, n, docs FROM ({catalogue.ORACLES['tokenize']})").fetchall())
    assert got == {("red", 5, 2), ("blue", 1, 1), ("two", 1, 1), ("green", 3, 0)}
    apart = text.merged(spark.read.parquet(f"{tmp_path}/documents.parquet"), "doc_id", ("text",), nulls=False)
    assert sorted(r["text"] for r in apart.filter("doc_id is null").collect()) == ["", "green green", "red green"]


def test_edges_are_made_distinct_by_keys():
    from lodegraph.sources import fixtures

    assert fixtures._EDGES_BY_KEYS.count("SELECT DISTINCT ") == 2 and "DISTINCT concat" not in fixtures._EDGES_BY_KEYS
