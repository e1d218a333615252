"""Extraction, indexing, sync, watching, the facade and its tools, on a small tree of files."""

import os
import time

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lodegraph import schema
from lodegraph.api import Graph, Tools, format_context
from lodegraph.operators import extract
from lodegraph.sources import files as src
from lodegraph.sources.store import Store
from lodegraph.streaming import watch
from lodegraph.streaming.sync import Index

TREE = {
    "src/auth.py": 'import os\n\n\nclass Session(Base):\n    """A login."""\n\n    def open(self):\n        if self.user and check(self.user):\n            return make_token(self.user)\n\n\ndef make_token(user):\n    return str(user)\n',
    "src/web.ts": "/** Shows it. */\nexport class Panel extends Widget implements Drawable {\n  draw(x: number) {\n    for (const y of [1]) { makeToken(x); }\n  }\n}\n\nexport function useLogin() { return makeToken(1); }\nconst makeToken = (u) => { return u; };\nfunction TestCard() { return 1; }\n",
    "lib/core.go": "package core\n\ntype Thing struct {\n\tA int\n}\n\nfunc (t *Thing) Run() {\n\tstart()\n}\n\nfunc start() {}\n",
    "lib/it.rb": "class Cart < Basket\n  def total\n    sum(1)\n  end\nend\n",
    "node_modules/x.js": "function hidden() {}\n",
    "env/kept.py": "X = 1\n",
    ".hidden/y.py": "def hidden():\n    pass\n",
    "notes.txt": "not code",
    "broken.py": "def broken(:\n",
}


@pytest.fixture
def tree(tmp_path):
    for path, text in TREE.items():
        at = tmp_path / "tree" / path
        at.parent.mkdir(parents=True, exist_ok=True)
        at.write_text(text)
    return str(tmp_path / "tree")


def facts(index):
    read = index.store.read
    return {
        "symbols": sorted(tuple(r) for r in read("symbols").select("id", "kind", "name", "file_path", "start_line", "end_line").collect()),
        "edges": sorted(tuple(r) for r in read("edges").select("id", "source_id", "target_id", "kind").collect()),
        "files": sorted(tuple(r) for r in read("files").select("file_path", "hash", "node_count", "line_count").collect()),
        "refs": sorted(tuple(r) for r in read("refs").collect()),
        "tokens": sorted(tuple(r) for r in read("search_tokens").select("node_id", "token", "source", "tf").collect()),
        "idf": sorted(tuple(r) for r in read("idf").select("token", "idf", "doc_count").collect()),
        "postings": sorted(tuple(r) for r in read("postings").select("id", "token", "tf", "size").collect()),
        "stats": [tuple(r) for r in read("search_stats").collect()],
    }


def test_discovery(spark, tree):
    got = {r["file_path"]: r["language"] for r in src.discover(spark, tree).collect()}
    assert got == {"src/auth.py": "python", "src/web.ts": "typescript", "lib/core.go": "go", "lib/it.rb": "ruby", "broken.py": "python", "env/kept.py": "python"}
    assert {r["file_path"] for r in src.discover(spark, tree, ("lib/**", "*.py")).collect()} == {"src/auth.py", "src/web.ts", "env/kept.py"}
    assert src.discover(spark, tree, max_bytes=40).count() == 2
    assert not any("node_modules" in p for p in src._entered(spark, tree))  # not even listed


def test_extraction(spark, tree):
    rows = extract.parsed(src.discover(spark, tree))
    got = {(r["file_path"], r["kind"], r["name"]) for r in extract.symbols(rows).collect()}
    assert got == {
        ("src/auth.py", "class", "Session"), ("src/auth.py", "method", "open"), ("src/auth.py", "function", "make_token"),
        ("src/web.ts", "class", "Panel"), ("src/web.ts", "method", "draw"), ("src/web.ts", "hook", "useLogin"), ("src/web.ts", "function", "makeToken"), ("src/web.ts", "component", "TestCard"),
        ("lib/core.go", "type", "Thing"), ("lib/core.go", "method", "Run"), ("lib/core.go", "function", "start"), ("lib/it.rb", "class", "Cart"), ("lib/it.rb", "method", "total"),
    }
    by = {r["name"]: r for r in extract.symbols(rows).collect()}
    assert by["Session"]["docstring"] == "A login." and by["Panel"]["docstring"] == "/** Shows it. */"
    assert by["Panel"]["exported"] and by["useLogin"]["exported"] and not by["makeToken"]["exported"]
    assert by["open"]["complexity"] == 2 and by["open"]["qualified_name"] == "src.auth.open"
    refs = {(r["ref_kind"], r["ref_name"]) for r in extract.refs(rows).join(extract.symbols(rows).filter("name = 'Panel'").select(F.col("id").alias("from_node_id")), "from_node_id").collect()}
    assert refs == {("extends", "Widget"), ("implements", "Drawable"), ("calls", "makeToken")}  # what its method calls counts as well
    assert [r["file_path"] for r in extract.errors(rows).collect()] == ["broken.py"]
    names = extract.symbols(rows).select("id", "name")
    inside = extract.contains(rows).join(names.select(F.col("id").alias("source_id"), F.col("name").alias("s")), "source_id").join(names.select(F.col("id").alias("target_id"), F.col("name").alias("t")), "target_id")
    assert {(r["s"], r["t"]) for r in inside.collect()} == {("Session", "open"), ("Panel", "draw"), ("Cart", "total")}


def test_sync_equals_rebuild(spark, tree, tmp_path):
    index = Index(spark, "file://" + str(tmp_path / "a"))
    assert index.build(src.discover(spark, tree))["added"] == 6
    first = facts(index)
    phases = []
    report = index.sync(src.discover(spark, tree), lambda phase, n: phases.append(phase))
    assert {k: report[k] for k in ("added", "modified", "removed", "unchanged", "errors")} == {"added": 0, "modified": 0, "removed": 0, "unchanged": 6, "errors": 0}
    assert phases == ["scanning", "done"] and report["duration_ms"] > 0
    names = {r["id"]: r["name"] for r in index.store.read("symbols").collect()}
    assert ("open", "make_token", "calls") in {(names[s], names[t], k) for _, s, t, k in first["edges"]}
    # The called function moves, a file goes, another comes; calls from files that did not change must follow.
    auth = os.path.join(tree, "src/auth.py")
    with open(auth) as f:
        text = f.read()
    with open(auth, "w") as f:
        f.write("# moved down\n" + text)
    os.remove(os.path.join(tree, "lib/it.rb"))
    with open(os.path.join(tree, "src/more.py"), "w") as f:
        f.write("def caller():\n    return make_token(2)\n")
    got = index.sync(src.discover(spark, tree), lambda phase, n: phases.append(phase))
    assert (got["added"], got["modified"], got["removed"], got["unchanged"]) == (1, 1, 1, 4)
    assert phases[2:] == ["scanning", "parsing", "resolving", "done"]
    again = Index(spark, "file://" + str(tmp_path / "b"))
    again.build(src.discover(spark, tree), force=True)
    assert facts(index) == facts(again) != first
    index.store.vacuum()
    assert facts(index) == facts(again)


def test_debounce_batch_and_stream(spark, tmp_path):
    rows = [("a", "add", 0), ("a", "change", 200), ("a", "change", 900), ("b", "add", 100), ("b", "unlink", 350), ("z", "add", 60000)]
    log = spark.createDataFrame([(p, o, 1000000.0 + t / 1000, f"{p}{t}") for p, o, t in rows], "path string, op string, t double, content string").select("path", "op", F.timestamp_millis(F.round(F.col("t") * 1000).cast("long")).alias("ts"), "content")
    batch = sorted((r["path"], r["op"], r["content"], r["events"]) for r in watch.bursts(log).collect())
    assert batch == [("a", "change", "a200", 2), ("a", "change", "a900", 1), ("b", "unlink", "b350", 2), ("z", "add", "z60000", 1)]
    where = str(tmp_path / "log")
    log.write.parquet(where)
    stream = watch.debounced(spark.readStream.schema(log.schema).parquet(where))
    q = stream.writeStream.format("memory").queryName("debounced").outputMode("append").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "cp")).start()
    q.awaitTermination()
    got = sorted((r["path"], r["op"], r["content"], r["events"]) for r in spark.table("debounced").collect())
    assert got == batch[:3]  # the last burst is still open


def test_watch_applies_changes(spark, tmp_path):
    def t(ms):
        return F.timestamp_millis(F.lit(1000000000000 + ms))

    def event(path, op, ms, content):
        return spark.range(1).select(F.lit(path).alias("path"), F.lit(op).alias("op"), t(ms).alias("ts"), F.lit(content).cast("string").alias("content"))

    log = event("a.py", "add", 0, "def one():\n    pass\n").union(event("a.py", "change", 100, "def two():\n    pass\n")).union(event("b.py", "add", 0, "def gone():\n    pass\n")).union(event("b.py", "unlink", 2000, None)).union(event("node_modules/c.js", "add", 0, "function no() {}")).union(event("end.py", "add", 90000, "x = 1"))
    where = str(tmp_path / "log")
    log.write.parquet(where)
    index = Index(spark, "file://" + str(tmp_path / "store"))
    index.watch(spark.readStream.schema(schema._schema(schema.CHANGES)).parquet(where), str(tmp_path / "cp")).awaitTermination()
    assert [r["name"] for r in index.store.read("symbols").collect()] == ["two"]
    assert sorted(r["file_path"] for r in index.store.read("files").collect()) == ["a.py", "end.py"]  # the last burst too
    before, version = facts(index), index.store.version()
    (stream, number), = index.store.pointer()["_batches"].items()
    index.apply_changes(event("a.py", "unlink", 200, None), (stream, number))  # a repeated batch changes nothing
    index.apply_changes(event("a.py", "unlink", 1, None).filter("false"), (stream, number + 1))  # nor does an empty one
    index.apply_changes(event("a.py", "unlink", 50, None), (stream, number + 1))  # nor one that is older than what was applied
    assert facts(index) == before and index.store.version() == version
    # Another stream's batches have numbers of their own, and what comes out of order is put in order by its time.
    index.apply_changes(event("c.py", "add", 300, "def three():\n    pass\n"), ("other", 0))
    index.apply_changes(event("a.py", "unlink", 400, None), ("other", 1))
    index.apply_changes(event("a.py", "change", 350, "def late():\n    pass\n"), ("third", 0))
    assert [r["name"] for r in index.store.read("symbols").collect()] == ["three"]
    # A new checkpoint starts at batch 0 again, and is another stream.
    more = str(tmp_path / "more")
    event("d.py", "add", 500, "def four():\n    pass\n").write.parquet(more)
    index.watch(spark.readStream.schema(schema._schema(schema.CHANGES)).parquet(more), str(tmp_path / "cp2")).awaitTermination()
    assert {r["name"] for r in index.store.read("symbols").collect()} == {"three", "four"}


def test_a_crash_leaves_the_last_version(spark, tmp_path):
    kept = Store(spark, f"file://{tmp_path}/store")
    assert not kept.exists() and kept.version() == 0
    kept.reset()
    idf = spark.createDataFrame([("a", 1.0, 1)], schema.IDF)
    kept.commit(idf=idf)
    for name in ("next-half-written", "idf-half-written", "VERSION-junk"):  # what a commit leaves that dies before its rename
        (tmp_path / "store" / name).write_text("{")
    again = Store(spark, f"file://{tmp_path}/store")
    assert again.version() == 2 and again.read("idf").count() == 1
    (tmp_path / "store" / "VERSION-000000000003").write_text('{"idf": "gone"}')  # someone else was faster
    stale = Store(spark, f"file://{tmp_path}/store")
    stale.version = lambda: 2
    with pytest.raises(OSError):
        stale.commit(idf=idf.limit(0))
    (tmp_path / "store" / "VERSION-000000000003").unlink()
    again.vacuum()
    assert again.read("idf").count() == 1 and sorted(n for n in again._names() if n.startswith("VERSION")) == ["VERSION-000000000002"]


def test_ruby_comments_and_strings_are_not_code():
    rows = extract.parse_ruby('class A\n  # calls ghost(1)\n  def m\n    real(1) # never_called(2)\n    s = "also not(3) # here"\n    after(4)\n  end\nend\n=begin\ndef no\nend\n=end\n')
    assert [(r.kind, r.name) for r in rows] == [("class", "A"), ("function", "m")]
    assert [n for k, n in rows[1].refs if k == "calls"] == ["real", "after"] and rows[1].doc == "# calls ghost(1)"


def test_any_exception_of_a_parser_is_one_files_error(spark, monkeypatch):
    files = spark.createDataFrame([("a.go", "go", "func f() {}"), ("b.py", "python", "def g():\n    pass\n")], "file_path string, language string, content string")
    batches = [pa.RecordBatch.from_pylist(files.toPandas().to_dict("records"))]

    def bad(text):
        raise KeyError("odd")

    monkeypatch.setitem(extract.PARSERS, "go", bad)
    rows = [r for b in extract._parse(iter(batches)) for r in b.to_pylist()]
    assert [(r["file_path"], r["n"], r["error"]) for r in rows] == [("a.go", -1, "KeyError: 'odd'"), ("b.py", 0, None)]


@pytest.mark.parametrize("lang", ["typescript", "ruby", "python"])
def test_work_grows_with_the_file_not_with_its_square(lang):
    n = 12_000
    head, method, tail = {"typescript": ("class A {\n", "  m_%d(x) { return f_%d(x); }\n", "}\n"), "ruby": ("class A\n", "  def m_%d(x)\n    f_%d(x)\n  end\n", "end\n"), "python": ("class A:\n", "    def m_%d(self):\n        return f_%d(1)\n", "")}[lang]
    text = head + "".join(method % (i, i) for i in range(n)) + tail
    began = time.process_time()
    rows = extract.PARSERS[lang](text)
    assert time.process_time() - began < 10  # a search of all declarations for each call took 30 and more
    assert [(r.name, r.parent) for r in rows] == [("A", -1)] + [(f"m_{i}", 0) for i in range(n)]
    assert [[n for k, n in r.refs if k == "calls" and n[0] == "f"] for r in rows] == [[]] + [[f"f_{i}"] for i in range(n)]


def test_declarations_are_handed_on_in_batches():
    text = "".join(f"def f{i}():\n    pass\n" for i in range(extract.BATCH_ROWS + 5))
    out = list(extract._parse(iter([pa.RecordBatch.from_pylist([{"file_path": "a.py", "language": "python", "content": text}])])))
    assert [b.num_rows for b in out] == [extract.BATCH_ROWS, 5]


def test_deep_nesting_and_far_comments(spark):
    deep = "".join("    " * i + f"def f{i}():\n" for i in range(20)) + "    " * 20 + "inner()\n"
    comment = "/* " + "long " * 1000 + "*/"
    far = f"{comment}\nexport function far(a)\n" + " " * 400 + "\n{ call(); }\n// one\n// two\nfunction near() { return 1; }\ntype T = { a: number };\n"
    files = spark.createDataFrame([("d.py", "python", deep), ("f.ts", "typescript", far), ("s.rs", "rust", "struct S { a: i32 }\n")], "file_path string, language string, content string")
    rows = extract.parsed(files)
    found = {r["name"]: r for r in extract.symbols(rows).collect()}
    refs = extract.refs(rows).join(extract.symbols(rows).select(F.col("id").alias("from_node_id"), "name"), "from_node_id").collect()
    assert {r["name"] for r in refs if r["ref_name"] == "inner"} == {f"f{i}" for i in range(20)}
    assert {r["name"] for r in refs if r["ref_name"] == "call"} == {"far"}
    assert found["far"]["docstring"].startswith("/* long") and found["near"]["docstring"] == "// one\n// two"
    assert (found["T"]["kind"], found["S"]["kind"]) == ("interface", "class")


def test_facade_and_tools(spark, tree, tmp_path):
    g = Graph.init(spark, "file://" + str(tmp_path / "store"), tree)
    tools = Tools(g)
    assert len(tools.names()) == 16
    assert "make_token" in tools.call("search", query="make_tok")
    assert "open" in tools.call("callers", name="make_token")
    assert "make_token" in tools.call("callees", name="open")
    assert "Session" in tools.call("impact", name="make_token")
    assert "open" in tools.call("node", name="Session") and "class Session" in tools.call("node", name="Session")
    assert "make_token" in tools.call("deps", name="open")
    assert "python" in tools.call("overview") and "src/" in tools.call("overview")
    assert "Panel" in tools.call("deadcode")
    assert "make_token" in tools.call("hotspots")
    assert "src/web.ts" in tools.call("files", contains="web") and "web" not in tools.call("files", language="go")
    assert "symbols" in tools.call("status") or "nodes" in tools.call("status")
    assert "make_token" in tools.call("semantic", query="make token")
    assert "->" in tools.call("path", start="open", end="make_token")
    assert tools.call("circular") and "complexity" in tools.call("complexity", threshold=90)
    assert "not found" in tools.call("callers", name="nowhere") and "no tool" in tools.call("nothing")
    rows = g.context("token session").collect()
    assert {r["name"] for r in rows} >= {"make_token", "Session"} and any(r["code"] and "def make_token" in r["code"] for r in rows)
    for style in ("markdown", "json", "compact"):
        assert "make_token" in format_context(rows, "q", style)
    assert g.sync()["unchanged"] == 6
    with pytest.raises(FileNotFoundError):
        Graph.open(spark, "file://" + str(tmp_path / "nothing"))
    g.close()


def test_config(tmp_path):
    assert src.load_config(str(tmp_path / "none.json"))["maxFileSize"] == 1 << 20
    (tmp_path / "c.json").write_text('{"exclude": ["a/**"]}')
    assert src.load_config(str(tmp_path / "c.json"))["exclude"] == ["a/**"]
    (tmp_path / "x/y").mkdir(parents=True)
    assert src.find_root(str(tmp_path / "x/y"), "c.json") == str(tmp_path)
