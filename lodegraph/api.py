"""The library's face: one object over a stored graph, and the tools that answer in text."""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from .operators import analysis, context, graph, lookup, search, semantic
from .schema import DEAD_KINDS
from .sources import files as src
from .sources.files import snippets
from .streaming.sync import Index


class Graph:
    """Queries over the graph stored at ``store``; every method gives a DataFrame unless it says otherwise."""

    def __init__(self, spark: SparkSession, store: str, source: str | None = None, config: dict | None = None) -> None:
        config = src.DEFAULTS | (config or {})
        self.spark, self.source, self.config = spark, source, config
        self._index = Index(spark, store, tuple(config["exclude"]), config["maxFileSize"])
        self.load()

    @classmethod
    def init(cls, spark: SparkSession, store: str, source: str, index: bool = True, config: dict | None = None) -> Graph:
        """Create the store, and index the source tree unless told not to."""
        made = cls(spark, store, source, config)
        if not made._index.store.exists():
            made._index.store.reset()
        if index:
            made.index()
        made.load()
        return made

    @classmethod
    def open(cls, spark: SparkSession, store: str, source: str | None = None, config: dict | None = None) -> Graph:
        """Open a store that exists."""
        made = cls(spark, store, source, config)
        if not made._index.store.exists():
            raise FileNotFoundError(f"no graph at {store}; create one with init")
        return made

    def load(self) -> None:
        """Read the current version of the tables."""
        read = self._index.store.read
        self.symbols, self.edges, self.files = read("symbols"), read("edges"), read("files")

    def _discovered(self) -> DataFrame:
        if self.source is None:
            raise ValueError("this graph was opened without a source tree")
        return src.discover(self.spark, self.source, tuple(self.config["exclude"]), self.config["maxFileSize"])

    def index(self, force: bool = False) -> dict[str, int]:
        out = self._index.build(self._discovered(), force)
        self.load()
        return out

    def sync(self) -> dict[str, int]:
        out = self._index.sync(self._discovered())
        self.load()
        return out

    def watch(self, log: DataFrame, checkpoint: str, once: bool = True):  # noqa: ANN201
        return self._index.watch(log, checkpoint, once)

    def search(self, query: str, kind: str | None = None, limit: int = 20) -> DataFrame:
        return search.search(self.symbols, query, kind, limit, self._postings())

    def _postings(self) -> tuple[DataFrame, DataFrame]:
        return self._index.store.read("postings"), self._index.store.read("search_stats")

    def semantic_search(self, query: str, limit: int = 20) -> DataFrame:
        read = self._index.store.read
        return semantic.search(self.symbols, query, limit, (read("search_tokens"), read("idf")))

    def callers(self, node: str, limit: int = 50) -> DataFrame:
        return graph.callers(self.symbols, self.edges, node, limit)

    def callees(self, node: str, limit: int = 50) -> DataFrame:
        return graph.callees(self.symbols, self.edges, node, limit)

    def impact(self, node: str, depth: int = 3) -> DataFrame:
        return graph.impact(self.symbols, self.edges, node, depth)

    def dependencies(self, node: str) -> DataFrame:
        return graph.dependencies(self.symbols, self.edges, node)

    def dependents(self, node: str) -> DataFrame:
        return graph.dependents(self.symbols, self.edges, node)

    def children(self, node: str) -> DataFrame:
        return graph.children(self.symbols, self.edges, node)

    def path(self, start: str, end: str, depth: int = 10) -> DataFrame:
        return graph.shortest_path(self.symbols, self.edges, start, end, depth)

    def dead_code(self, kinds: tuple[str, ...] = DEAD_KINDS, include_exported: bool = True) -> DataFrame:
        return analysis.dead_code(self.symbols, self.edges, kinds, include_exported)

    def hotspots(self, limit: int = 20) -> DataFrame:
        return analysis.hotspots(self.symbols, self.edges, limit)

    def cycles(self) -> DataFrame:
        return graph.cycles(self.edges)

    def complexity(self, threshold: int = 10) -> DataFrame:
        return analysis.complexity_report(self.symbols, threshold)

    def stats(self) -> DataFrame:
        return analysis.stats(self.symbols, self.edges, self.files)

    def file_tree(self, contains: str | None = None, language: str | None = None) -> DataFrame:
        return lookup.file_tree(self.files, contains, language)

    def context(self, query: str, options: context.Options = context.Options()) -> DataFrame:
        return context.build(self.symbols, self.edges, query, options, self._discovered() if self.source and options.include_code else None, self._postings())

    def overview(self) -> dict[str, DataFrame]:
        return context.overview(self.symbols, self.edges, self.files)

    def close(self) -> None:
        self.spark.catalog.clearCache()


# Text: results are small by their limits, and are rendered on the driver.


def _at(r: Row) -> str:
    return f"{r['file_path']}:{r['start_line']}"


def _listed(title: str, rows: list[Row], line: Callable[[Row], str], none: str) -> str:
    return "\n".join([title, *(f"* {line(r)}" for r in rows)]) if rows else none


def format_context(rows: list[Row], query: str, style: str = "markdown") -> str:
    """A context result as markdown, json or compact text."""
    if style == "json":
        return json.dumps({"query": query, "nodes": [{k: v for k, v in r.asDict(True).items() if k not in ("created_at", "updated_at")} for r in rows]}, indent=2, default=str)
    if style == "compact":
        return "\n".join(f"{r['kind']} {r['qualified_name']} at {_at(r)}" + (f": {r['signature'][:120]}" if r["signature"] else "") for r in rows)
    out = [f"# {query}", f"{len(rows)} symbols in {len({r['file_path'] for r in rows})} files"]
    for path in dict.fromkeys(r["file_path"] for r in rows):
        out.append(f"\n## {path}")
        for r in (r for r in rows if r["file_path"] == path):
            out.append(f"\n### {r['name']} ({r['kind']}{', exported' if r['exported'] else ''}), lines {r['start_line']} to {r['end_line']}")
            got = r.asDict()
            for label, value in (("Signature", r["signature"]), ("Documentation", (r["docstring"] or "")[:200]), ("Callers", ", ".join(got.get("callers") or [])), ("Callees", ", ".join(got.get("callees") or []))):
                if value:
                    out.append(f"{label}: {value}")
            if got.get("code"):
                out.append(f"```\n{got['code']}\n```")
    return "\n".join(out)


class Tools:
    """Named tools with plain arguments and text answers over a ``Graph``."""

    def __init__(self, graph_: Graph) -> None:
        self.g = graph_

    def names(self) -> list[str]:
        return sorted(n[5:] for n in dir(self) if n.startswith("tool_"))

    def call(self, tool: str, /, **args) -> str:  # noqa: ANN003
        found = getattr(self, f"tool_{tool}", None)
        return found(**args) if found else f"There is no tool {tool}"

    def _resolve(self, name: str, file: str | None, kind: str | None = None) -> tuple[Row | None, str]:
        r = lookup.resolve(self.g.symbols, name, file, kind).first()
        if r["status"] == "ok":
            return lookup.by_id(self.g.symbols, r["id"]).first(), ""
        if r["status"] == "not_found":
            return None, f"{name}: not found"
        some = lookup.by_name(self.g.symbols, name, kind).orderBy("file_path", "start_line").limit(10).collect()
        return None, _listed(f"{name} is ambiguous, {r['matches']} symbols in {r['files']} files; name a file:", some, lambda s: f"{s['kind']} {_at(s)}", "")

    def _around(self, name: str, file: str | None, what: str, get: Callable[[str], DataFrame]) -> str:
        node, problem = self._resolve(name, file)
        if node is None:
            return problem
        return _listed(f"{what} of {node['name']} ({_at(node)})", get(node["id"]).collect(), lambda r: f"{r['qualified_name']} ({_at(r)})", f"{node['name']} ({_at(node)}) has no {what.lower()}")

    def tool_search(self, query: str, kind: str | None = None, limit: int = 20) -> str:
        return _listed(f"Symbols for {query}", self.g.search(query, kind, limit).collect(), lambda r: f"{r['kind']} {r['name']} {_at(r)} {(r['signature'] or '')[:150]}", f"Nothing matches {query}")

    def tool_semantic(self, query: str, limit: int = 20) -> str:
        return _listed(f"Symbols about {query}", self.g.semantic_search(query, limit).collect(), lambda r: f"{r['score']:.2f} {r['kind']} {r['name']} {_at(r)}", f"Nothing is about {query}")

    def tool_context(self, query: str, max_nodes: int = 25, include_code: bool = True, style: str = "markdown", file: str | None = None) -> str:
        rows = self.g.context(query, context.Options(max_nodes=max_nodes, include_code=include_code, file_filter=file)).collect()
        return format_context(rows, query, style)

    def tool_callers(self, name: str, file: str | None = None, limit: int = 30) -> str:
        return self._around(name, file, "Callers", lambda i: self.g.callers(i, limit))

    def tool_callees(self, name: str, file: str | None = None, limit: int = 30) -> str:
        return self._around(name, file, "Callees", lambda i: self.g.callees(i, limit))

    def tool_impact(self, name: str, file: str | None = None, depth: int = 3) -> str:
        node, problem = self._resolve(name, file)
        if node is None:
            return problem
        rows = self.g.impact(node["id"], depth).join(self.g.symbols, "id").orderBy("depth", "file_path", "start_line").collect()
        return _listed(f"{len(rows)} symbols depend on {node['name']}", rows, lambda r: f"depth {r['depth']}: {r['qualified_name']} ({_at(r)})", f"Nothing depends on {node['name']}")

    def tool_node(self, name: str, file: str | None = None, kind: str | None = None, include_code: bool = True) -> str:
        node, problem = self._resolve(name, file, kind)
        if node is None:
            return problem
        out = [f"{node['kind']} {node['qualified_name']}, {node['file_path']} lines {node['start_line']} to {node['end_line']}, exported: {node['exported']}, complexity: {node['complexity']}"]
        out += [x for x in (node["signature"], node["docstring"]) if x]
        out += [f"* {c['kind']} {c['name']} {(c['signature'] or '')[:100]}" for c in self.g.children(node["id"]).collect()]
        if include_code and self.g.source:
            code = snippets(lookup.by_id(self.g.symbols, node["id"]), self.g._discovered(), 3000).first()["code"]
            out += [f"```{node['language']}\n{code}\n```"] if code else []
        return "\n".join(out)

    def tool_deps(self, name: str, file: str | None = None) -> str:
        node, problem = self._resolve(name, file)
        if node is None:
            return problem
        return _listed(f"Dependencies of {node['name']}", self.g.dependencies(node["id"]).collect(), lambda r: f"{r['edge_kind']} {r['qualified_name']} ({_at(r)})", f"{node['name']} depends on nothing")

    def tool_overview(self) -> str:
        parts = {k: v.collect() for k, v in self.g.overview().items()}
        t = parts["totals"][0]
        out = [f"{t['files']} files, {t['lines']} lines, {t['nodes']} symbols, {t['edges']} relations"]
        for key in ("languages", "kinds"):
            out.append(f"{key}: " + ", ".join(f"{r[0]} {r['n']}" for r in parts[key]))
        out += [f"* {r['name']} ({r['kind']}): {r['in_degree']} in, {r['out_degree']} out" for r in parts["hotspots"]]
        return "\n".join(out + [f"{r['dir']}/: {r['files']} files, {r['symbols']} symbols" for r in parts["directories"]])

    def tool_deadcode(self, kinds: tuple[str, ...] = DEAD_KINDS, include_exported: bool = True) -> str:
        return _listed("Unreferenced symbols", self.g.dead_code(tuple(kinds), include_exported).collect(), lambda r: f"{r['kind']} {r['name']} {_at(r)}{' (exported)' if r['exported'] else ''}", "No unreferenced symbol")

    def tool_hotspots(self, limit: int = 20) -> str:
        return _listed("Most connected", self.g.hotspots(limit).collect(), lambda r: f"{r['name']} ({r['kind']}, {r['file_path']}): {r['in_degree']} in, {r['out_degree']} out, {r['total_degree']} in all", "No symbols")

    def tool_files(self, contains: str | None = None, language: str | None = None) -> str:
        return _listed("Files", self.g.file_tree(contains, language).collect(), lambda r: f"{r['path']} ({r['language']}, {r['node_count']} symbols, {r['line_count']} lines)", "No such file")

    def tool_status(self) -> str:
        return "\n".join(f"{k}: {v}" for k, v in self.g.stats().first().asDict().items())

    def tool_path(self, start: str, end: str, start_file: str | None = None, end_file: str | None = None, depth: int = 10) -> str:
        a, problem = self._resolve(start, start_file)
        b, other = self._resolve(end, end_file)
        if a is None or b is None:
            return problem or other
        rows = self.g.path(a["id"], b["id"], depth).join(self.g.symbols, "id").orderBy("hop").collect()
        return " -> ".join(f"{r['name']} ({_at(r)})" for r in rows) or f"No path of up to {depth} steps from {start} to {end}"

    def tool_circular(self) -> str:
        ids = {r["id"]: r for r in self.g.symbols.join(graph.scc_members(self.g.edges), "id").collect()}
        return _listed("Cycles", self.g.cycles().collect(), lambda r: " -> ".join(ids[i]["name"] if i in ids else i for i in r["cycle"].split(">")) + f" (via {r['via']})", "No cycle")

    def tool_complexity(self, threshold: int = 10) -> str:
        return _listed(f"Complexity from {threshold}", self.g.complexity(threshold).collect(), lambda r: f"{r['complexity']} {r['kind']} {r['name']} {_at(r)}", f"No symbol has complexity {threshold} or more")
