"""The query catalogue: every operator on the driver's tables, with DuckDB SQL for each that SQL can express."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import code
from ..functions.text import INDEX_STOP_WORDS, QUERY_STOP_WORDS, counted, fts_terms, index_tokens, merged, query_keywords
from ..operators import analysis, context, extract, graph, lookup, resolve, search, semantic
from ..schema import CYCLE, DEAD_KINDS, HOTSPOT_KINDS, IMPACT, MEMBER, edge_id, node_id
from ..sources import files as sources_files
from ..sources import fixtures as fx
from ..sources import store
from ..streaming import watch
from ..streaming.sync import Index
from . import steps

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[name] = f
        if sql is not None:
            ORACLES[name] = sql
        return f

    return add


def _in(values: tuple[str, ...]) -> str:
    return "(" + ", ".join(f"'{v}'" for v in values) + ")"


SUPPLY, WHOLE, TEXT, PART = fx.SUPPLY_SQL, fx.WHOLE_SQL, fx.TEXT_SQL, fx.PART_SQL

# Counts and reports


@query("stats_totals", f"WITH {SUPPLY}, f AS (SELECT length(text) - length(replace(text, chr(10), '')) + 1 AS line_count FROM documents) SELECT (SELECT count(*) FROM symbols) AS nodes, (SELECT count(*) FROM edges) AS edges, (SELECT count(*) FROM f) AS files, CAST((SELECT coalesce(sum(line_count), 0) FROM f) AS BIGINT) AS lines")
def stats_totals(s, d):  # noqa: ANN001, ANN201
    return analysis.totals(fx.supply_symbols(s, d), fx.supply_edges(s, d), fx.text_files(s, d))


@query("stats", f"""WITH {SUPPLY}, f AS (SELECT lang AS language, length(text) - length(replace(text, chr(10), '')) + 1 AS line_count FROM documents),
    k AS (SELECT string_agg(kind || '=' || n, ',' ORDER BY kind) AS v FROM (SELECT kind, count(*) AS n FROM symbols GROUP BY 1) AS x), l AS (SELECT string_agg(language || '=' || n, ',' ORDER BY language) AS v FROM (SELECT language, count(*) AS n FROM f GROUP BY 1) AS x), e AS (SELECT string_agg(kind || '=' || n, ',' ORDER BY kind) AS v FROM (SELECT kind, count(*) AS n FROM edges GROUP BY 1) AS x)
    SELECT (SELECT count(*) FROM symbols) AS nodes, (SELECT count(*) FROM edges) AS edges, (SELECT count(*) FROM f) AS files, CAST((SELECT sum(line_count) FROM f) AS BIGINT) AS lines, k.v AS nodes_by_kind, l.v AS files_by_language, e.v AS edges_by_kind FROM k, l, e""")
def stats(s, d):  # noqa: ANN001, ANN201
    out = analysis.stats(fx.supply_symbols(s, d), fx.supply_edges(s, d), fx.text_files(s, d))

    def flat(c: str):  # noqa: ANN202
        return F.array_join(F.transform(F.array_sort(F.map_entries(c)), lambda x: F.concat(x["key"], F.lit("="), x["value"])), ",").alias(c)

    return out.select("nodes", "edges", "files", "lines", flat("nodes_by_kind"), flat("files_by_language"), flat("edges_by_kind"))


@query("nodes_by_kind", f"WITH {SUPPLY} SELECT kind, count(*) AS n FROM symbols GROUP BY kind")
def nodes_by_kind(s, d):  # noqa: ANN001, ANN201
    return analysis.counts(fx.supply_symbols(s, d), "kind")


@query("edges_by_kind", f"WITH {SUPPLY} SELECT kind, count(*) AS n FROM edges GROUP BY kind")
def edges_by_kind(s, d):  # noqa: ANN001, ANN201
    return analysis.counts(fx.supply_edges(s, d), "kind")


@query("files_by_language", "SELECT lang AS language, count(*) AS n FROM documents GROUP BY lang")
def files_by_language(s, d):  # noqa: ANN001, ANN201
    return analysis.counts(fx.text_files(s, d), "language")


QUERIES["overview_languages"], ORACLES["overview_languages"] = files_by_language, ORACLES["files_by_language"]
QUERIES["overview_kinds"], ORACLES["overview_kinds"] = nodes_by_kind, ORACLES["nodes_by_kind"]
_HOT = f"""WITH {SUPPLY}, o AS (SELECT source_id, count(*) AS n FROM edges GROUP BY 1), i AS (SELECT target_id, count(*) AS n FROM edges GROUP BY 1)
    SELECT id, name, kind, file_path, CAST(coalesce(i.n, 0) AS BIGINT) AS in_degree, CAST(coalesce(o.n, 0) AS BIGINT) AS out_degree, CAST(coalesce(i.n, 0) + coalesce(o.n, 0) AS BIGINT) AS total_degree
    FROM symbols LEFT JOIN o ON id = source_id LEFT JOIN i ON id = target_id WHERE kind IN {_in(HOTSPOT_KINDS)} ORDER BY total_degree DESC, id LIMIT """


@query("hotspots", _HOT + "20")
def hotspots(s, d):  # noqa: ANN001, ANN201
    return analysis.hotspots(fx.supply_symbols(s, d), fx.supply_edges(s, d))


@query("overview_hotspots", _HOT + "10")
def overview_hotspots(s, d):  # noqa: ANN001, ANN201
    return context.overview(fx.supply_symbols(s, d), fx.supply_edges(s, d), fx.text_files(s, d))["hotspots"]


@query("complexity_report", f"WITH {SUPPLY} SELECT id, name, kind, complexity FROM symbols WHERE complexity >= 10")
def complexity_report(s, d):  # noqa: ANN001, ANN201
    return analysis.complexity_report(fx.supply_symbols(s, d)).select("id", "name", "kind", "complexity")


@query("file_tree", f"WITH {TEXT} SELECT file_path AS path, language, node_count, line_count FROM files")
def file_tree(s, d):  # noqa: ANN001, ANN201
    return lookup.file_tree(fx.text_files(s, d))


@query("file_tree_filtered", f"WITH {TEXT} SELECT file_path AS path, language, node_count, line_count FROM files WHERE contains(file_path, 'src1') AND language = 'en'")
def file_tree_filtered(s, d):  # noqa: ANN001, ANN201
    return lookup.file_tree(fx.text_files(s, d), "src1", "en")


@query("file_lookup", f"WITH {TEXT} SELECT file_path, hash, language, node_count, line_count FROM files WHERE file_path = 'src0/0'")
def file_lookup(s, d):  # noqa: ANN001, ANN201
    return lookup.file(fx.text_files(s, d), "src0/0")


@query("directory_rollup", f"WITH {TEXT} SELECT regexp_replace(file_path, '/[^/]*$', '') AS dir, count(*) AS files, CAST(sum(node_count) AS BIGINT) AS symbols FROM files GROUP BY 1")
def directory_rollup(s, d):  # noqa: ANN001, ANN201
    return lookup.directory_rollup(fx.text_files(s, d))


@query("node_ids", f"WITH {SUPPLY} SELECT id, substr(sha256(kind || ':' || file_path || ':' || name || ':' || start_line), 1, 16) AS node_id FROM symbols")
def node_ids(s, d):  # noqa: ANN001, ANN201
    return fx.supply_symbols(s, d).select("id", node_id(*map(F.col, ("kind", "file_path", "name", "start_line"))).alias("node_id"))


@query("edge_ids", f"WITH {SUPPLY} SELECT source_id, target_id, kind, substr(sha256(source_id || '->' || target_id || ':' || kind), 1, 16) AS edge_id FROM edges")
def edge_ids(s, d):  # noqa: ANN001, ANN201
    return fx.supply_edges(s, d).select("source_id", "target_id", "kind", edge_id(*map(F.col, ("source_id", "target_id", "kind"))).alias("edge_id"))


# Neighbours


def _neighbour_sql(own: str, other: str, node: str, kinds: tuple[str, ...] | None, limit: int | None = None) -> str:
    where = f" AND e.kind IN {_in(kinds)}" if kinds else ""
    return f"WITH {SUPPLY} SELECT s.id, s.name, e.kind AS edge_kind FROM edges AS e JOIN symbols AS s ON s.id = e.{other} WHERE e.{own} = '{node}'{where} ORDER BY s.id" + (f" LIMIT {limit}" if limit else "")


def _neighbours(name: str, f: Callable, sql: str, node: str) -> None:
    QUERIES[name] = lambda s, d: f(fx.supply_symbols(s, d), fx.supply_edges(s, d), node).select("id", "name", "edge_kind")
    ORACLES[name] = sql


_neighbours("callers", graph.callers, _neighbour_sql("target_id", "source_id", "s:1", ("calls",), 50), "s:1")
_neighbours("callees", graph.callees, _neighbour_sql("source_id", "target_id", "c:1", ("calls",), 50), "c:1")
_neighbours("dependencies", graph.dependencies, _neighbour_sql("source_id", "target_id", "s:1", None), "s:1")
_neighbours("dependents", graph.dependents, _neighbour_sql("target_id", "source_id", "s:1", None), "s:1")
_neighbours("children", graph.children, _neighbour_sql("source_id", "target_id", "n:1", MEMBER), "n:1")


@query("dependencies_by_kind", f"WITH {SUPPLY} SELECT e.kind AS edge_kind, count(*) AS n, string_agg(s.id, ',' ORDER BY s.id) AS ids FROM edges AS e JOIN symbols AS s ON s.id = e.target_id WHERE e.source_id = 's:1' GROUP BY 1")
def dependencies_by_kind(s, d):  # noqa: ANN001, ANN201
    return graph.dependencies(fx.supply_symbols(s, d), fx.supply_edges(s, d), "s:1").groupBy("edge_kind").agg(F.count("*").alias("n"), F.array_join(F.sort_array(F.collect_list("id")), ",").alias("ids"))


# Dead code

_DEAD = "SELECT id, name, file_path FROM symbols AS s WHERE kind IN {k}{x} AND NOT EXISTS (SELECT 1 FROM edges AS e WHERE e.target_id = s.id AND e.kind IN " + _in(IMPACT) + ")"


@query("dead_code", f"WITH {WHOLE} " + _DEAD.format(k=_in(DEAD_KINDS), x=""))
def dead_code(s, d):  # noqa: ANN001, ANN201
    return analysis.dead_code(fx.whole_symbols(s, d), fx.whole_edges(s, d)).select("id", "name", "file_path")


@query("dead_code_unexported", f"WITH {SUPPLY} " + _DEAD.format(k=_in(DEAD_KINDS), x=" AND NOT exported"))
def dead_code_unexported(s, d):  # noqa: ANN001, ANN201
    return analysis.dead_code(fx.supply_symbols(s, d), fx.supply_edges(s, d), include_exported=False).select("id", "name", "file_path")


@query("dead_code_by_file", f"WITH {SUPPLY}, dead AS (" + _DEAD.format(k=_in(DEAD_KINDS), x="") + ") SELECT file_path, count(*) AS n, string_agg(id, ',' ORDER BY id) AS ids FROM dead GROUP BY file_path")
def dead_code_by_file(s, d):  # noqa: ANN001, ANN201
    dead = analysis.dead_code(fx.supply_symbols(s, d), fx.supply_edges(s, d))
    return dead.groupBy("file_path").agg(F.count("*").alias("n"), F.array_join(F.sort_array(F.collect_list("id")), ",").alias("ids"))


# Names


@query("node_lookup", f"WITH {SUPPLY} SELECT id, name, kind FROM symbols WHERE id = 'c:7'")
def node_lookup(s, d):  # noqa: ANN001, ANN201
    return lookup.by_id(fx.supply_symbols(s, d), "c:7").select("id", "name", "kind")


@query("nodes_by_file", f"WITH {SUPPLY} SELECT id, name, kind FROM symbols WHERE file_path = 'parts/Brand#11'")
def nodes_by_file(s, d):  # noqa: ANN001, ANN201
    return lookup.by_file(fx.supply_symbols(s, d), "parts/Brand#11").select("id", "name", "kind")


_A_NAME = "(SELECT min(p_name) FROM part)"


def _first_part(s: SparkSession, d: str) -> str:
    return fx.table(s, d, "part").agg(F.min("p_name")).first()[0]


@query("name_lookup_single", f"WITH {PART} SELECT id, name, file_path FROM symbols WHERE name = {_A_NAME} ORDER BY exported DESC, file_path, id LIMIT 1")
def name_lookup_single(s, d):  # noqa: ANN001, ANN201
    return lookup.one_by_name(fx.part_symbols(s, d), _first_part(s, d)).select("id", "name", "file_path")


@query("name_lookup_exact", f"WITH {PART} SELECT id, name, 1 AS tier FROM symbols WHERE name = {_A_NAME}")
def name_lookup_exact(s, d):  # noqa: ANN001, ANN201
    return lookup.by_name(fx.part_symbols(s, d), _first_part(s, d)).select("id", "name", "tier")


@query("name_lookup_qualified", f"WITH {PART} SELECT id, name, 2 AS tier FROM symbols WHERE qualified_name = (SELECT min(qualified_name) FROM symbols)")
def name_lookup_qualified(s, d):  # noqa: ANN001, ANN201
    parts = fx.part_symbols(s, d)
    return lookup.by_name(parts, parts.agg(F.min("qualified_name")).first()[0]).select("id", "name", "tier")


@query("name_lookup_partial", f"WITH {PART} SELECT id, name, 3 AS tier FROM symbols WHERE qualified_name ILIKE '%brand#1%' ORDER BY exported DESC, file_path, id LIMIT 20")
def name_lookup_partial(s, d):  # noqa: ANN001, ANN201
    return lookup.by_name(fx.part_symbols(s, d), "brand#1").select("id", "name", "tier")


@query("resolve_status", f"""WITH {PART}, m AS (SELECT * FROM symbols WHERE name = {_A_NAME}), one AS (SELECT * FROM m WHERE contains(file_path, 'Brand#1')),
    best AS (SELECT id FROM one ORDER BY exported DESC, file_path, id LIMIT 1)
    SELECT 'any' AS asked, CASE WHEN count(*) = 0 THEN 'not_found' WHEN count(DISTINCT file_path) = 1 THEN 'ok' ELSE 'ambiguous' END AS status, CASE WHEN count(DISTINCT file_path) = 1 THEN min(id) END AS id, count(*) AS matches, count(DISTINCT file_path) AS files FROM m
    UNION ALL SELECT 'file', CASE WHEN count(*) = 0 THEN 'not_found' ELSE 'ok' END, (SELECT id FROM best), count(*), count(DISTINCT file_path) FROM one
    UNION ALL SELECT 'none', 'not_found', NULL, 0, 0""")
def resolve_status(s, d):  # noqa: ANN001, ANN201
    parts, name = fx.part_symbols(s, d), _first_part(s, d)
    rows = [("any", lookup.resolve(parts, name)), ("file", lookup.resolve(parts, name, "Brand#1")), ("none", lookup.resolve(parts, "no such name"))]
    out = [r.select(F.lit(a).alias("asked"), "status", "id", "matches", "files") for a, r in rows]
    return out[0].unionByName(out[1]).unionByName(out[2])


# Keyed writes: customers in debt are changed, and each gets a new neighbour

_DELTA = "delta AS (SELECT id, 'function' AS kind, name || ' (new)' AS name, file_path FROM s0 WHERE in_debt UNION ALL SELECT 'x:' || substr(id, 3), 'function', name, file_path FROM s0 WHERE in_debt)"
_S0 = f"{SUPPLY}, s0 AS (SELECT id, kind, name, file_path, id IN (SELECT 'c:' || c_custkey FROM customer WHERE c_acctbal < 0) AS in_debt FROM symbols)"


def _delta(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    old = fx.supply_symbols(s, d).select("id", "kind", "name", "file_path")
    debt = fx.table(s, d, "customer").filter("c_acctbal < 0").select(F.concat(F.lit("c:"), "c_custkey").alias("id"))
    base = old.join(debt, "id", "left_semi")
    new = base.withColumn("name", F.concat("name", F.lit(" (new)"))).unionByName(base.withColumn("id", F.concat(F.lit("x:"), F.expr("substr(id, 3)"))))
    return old, new


@query("upsert_nodes", f"WITH {_S0}, {_DELTA} SELECT coalesce(d.id, o.id) AS id, coalesce(d.kind, o.kind) AS kind, coalesce(d.name, o.name) AS name, coalesce(d.file_path, o.file_path) AS file_path FROM s0 AS o FULL JOIN delta AS d ON o.id = d.id")
def upsert_nodes(s, d):  # noqa: ANN001, ANN201
    old, new = _delta(s, d)
    return store.upsert(old, new, ["id"])


@query("last_write_wins", f"WITH {_S0} SELECT id, CASE WHEN in_debt THEN name || ' (new)' ELSE name END AS name FROM s0 UNION ALL SELECT 'x:' || substr(id, 3), name FROM s0 WHERE in_debt")
def last_write_wins(s, d):  # noqa: ANN001, ANN201
    old, new = _delta(s, d)
    log = old.withColumn("seq", F.lit(1)).unionByName(new.withColumn("seq", F.lit(2)))
    return store.last_per_key(log.select("id", "name", "seq"), ["id"], "seq")


_GONE = "(SELECT file_path FROM symbols WHERE id IN (SELECT 's:' || s_suppkey FROM supplier WHERE s_acctbal > 9000))"


def _gone(s: SparkSession, d: str) -> DataFrame:
    rich = fx.table(s, d, "supplier").filter("s_acctbal > 9000").select(F.concat(F.lit("s:"), "s_suppkey").alias("id"))
    return fx.supply_symbols(s, d).join(rich, "id", "left_semi").select("file_path")


@query("delete_by_file", f"WITH {SUPPLY} SELECT id, file_path FROM symbols WHERE file_path NOT IN {_GONE}")
def delete_by_file(s, d):  # noqa: ANN001, ANN201
    return store.without_files(fx.supply_symbols(s, d), _gone(s, d)).select("id", "file_path")


@query("delete_file_edges", f"WITH {SUPPLY}, gone AS (SELECT id FROM symbols WHERE file_path IN {_GONE}) SELECT source_id, target_id, kind FROM edges WHERE source_id NOT IN (SELECT id FROM gone) AND target_id NOT IN (SELECT id FROM gone)")
def delete_file_edges(s, d):  # noqa: ANN001, ANN201
    return store.without_file_edges(fx.supply_edges(s, d), fx.supply_symbols(s, d), _gone(s, d))


@query("dangling_edges", f"WITH {SUPPLY}, left_ AS (SELECT id FROM symbols WHERE file_path NOT IN {_GONE}) SELECT source_id, target_id, kind, source_id NOT IN (SELECT id FROM left_) AS no_source, target_id NOT IN (SELECT id FROM left_) AS no_target FROM edges WHERE source_id NOT IN (SELECT id FROM left_) OR target_id NOT IN (SELECT id FROM left_)")
def dangling_edges(s, d):  # noqa: ANN001, ANN201
    return store.dangling(fx.supply_edges(s, d), store.without_files(fx.supply_symbols(s, d), _gone(s, d)))


@query("connected_edges", f"WITH {SUPPLY}, left_ AS (SELECT id FROM symbols WHERE file_path NOT IN {_GONE}) SELECT source_id, target_id, kind FROM edges WHERE source_id IN (SELECT id FROM left_) AND target_id IN (SELECT id FROM left_)")
def connected_edges(s, d):  # noqa: ANN001, ANN201
    return store.connected(fx.supply_edges(s, d), store.without_files(fx.supply_symbols(s, d), _gone(s, d)))


# Text and search


def _tokens_sql(text: str) -> str:
    stop = ", ".join(f"'{w}'" for w in sorted(INDEX_STOP_WORDS))
    split = rf"string_split_regex(lower(regexp_replace(regexp_replace(coalesce({text}, ''), '([a-z])([A-Z])', '\1 \2', 'g'), '[_\-./\\:]', ' ', 'g')), '\s+')"
    return f"list_filter({split}, lambda w: length(w) > 1 AND length(w) < 40 AND NOT list_contains([{stop}], w))"


@query("tokenize", f"SELECT token, count(*) AS n, count(DISTINCT doc_id) AS docs FROM (SELECT doc_id, unnest({_tokens_sql('text')}) AS token FROM documents) AS x GROUP BY token")
def tokenize(s, d):  # noqa: ANN001, ANN201
    # Texts are counted within a row; then only distinct tokens of each part move. Rows without an id count as no document.
    docs = merged(fx.table(s, d, "documents").select("doc_id", "text"), "doc_id", ("text",), nulls=False)
    rows = counted(docs.select("doc_id", index_tokens(F.col("text")).alias("t")), "t").select("doc_id", F.explode_outer("entries").alias("e")).filter("e is not null")
    return rows.groupBy("e.token").agg(F.sum("e.n").alias("n"), F.count("doc_id").alias("docs"))


_COUNTED = f"""counted AS (SELECT node_id, source, token, count(*) AS n FROM (
    SELECT id AS node_id, 'name' AS source, unnest({_tokens_sql("name")}) AS token FROM symbols UNION ALL SELECT id, 'qualified_name', unnest({_tokens_sql("qualified_name")}) FROM symbols
    UNION ALL SELECT id, 'signature', unnest({_tokens_sql("signature")}) FROM symbols UNION ALL SELECT id, 'docstring', unnest({_tokens_sql("docstring")}) FROM symbols) AS x GROUP BY ALL),
    tf AS (SELECT node_id, source, token, n / max(n) OVER (PARTITION BY node_id, source) AS tf FROM counted), df AS (SELECT token, count(DISTINCT node_id) AS doc_count FROM counted GROUP BY token),
    idfs AS (SELECT token, doc_count, ln((greatest(n, 1) + 1) / (doc_count + 1)) + 1 AS idf FROM df, (SELECT count(*) AS n FROM symbols) AS a)"""


@query("term_frequency", f"WITH {TEXT}, {_COUNTED} SELECT node_id, source, token, round(tf, 6) AS tf FROM tf")
def term_frequency(s, d):  # noqa: ANN001, ANN201
    return semantic.term_frequency(semantic.token_counts(fx.text_symbols(s, d))).withColumn("tf", F.round("tf", 6))


@query("document_frequency", f"WITH {TEXT}, {_COUNTED} SELECT token, doc_count FROM df")
def document_frequency(s, d):  # noqa: ANN001, ANN201
    return semantic.vocabulary(fx.text_symbols(s, d))


@query("idf", f"WITH {TEXT}, {_COUNTED} SELECT token, doc_count, round(idf, 6) AS idf FROM idfs")
def idf(s, d):  # noqa: ANN001, ANN201
    return semantic.build_index(fx.text_symbols(s, d))[1].withColumn("idf", F.round("idf", 6))


def _semantic_sql(prefix: str, q: str) -> str:
    return f"""WITH {prefix}, {_COUNTED}, asked AS (SELECT unnest({_tokens_sql(f"'{q}'")}) AS token),
    s AS (SELECT node_id, sum(tf * idf * CASE source WHEN 'name' THEN 4 WHEN 'signature' THEN 2 WHEN 'docstring' THEN 1.5 ELSE 1 END) AS score FROM asked JOIN idfs USING (token) JOIN tf USING (token) GROUP BY node_id)
    SELECT node_id AS id, round(score, 4) AS score FROM s ORDER BY round(score, 9) DESC, node_id LIMIT 20"""


@query("semantic_search", _semantic_sql(PART, "small ring widget ring Brand#13"))
def semantic_search(s, d):  # noqa: ANN001, ANN201
    return semantic.search(fx.part_symbols(s, d), "small ring widget ring Brand#13").select("id", F.round("score", 4).alias("score"))


@query("semantic_search_text", _semantic_sql(TEXT, "apache license version worthless"))
def semantic_search_text(s, d):  # noqa: ANN001, ANN201
    return semantic.search(fx.text_symbols(s, d), "apache license version worthless").select("id", F.round("score", 4).alias("score"))


def _fts_sql(prefix: str, q: str, kind: str | None = None) -> str:
    terms = fts_terms(q)
    listed = ", ".join(f"({i}, '{t}', {str(i == len(terms) - 1).lower()})" for i, t in enumerate(terms))
    split = "list_filter(string_split_regex(lower(strip_accents(concat_ws(' ', name, qualified_name, signature, docstring))), '[^\\p{L}\\p{N}]+'), lambda w: length(w) > 0)"
    where = f" WHERE kind = '{kind}'" if kind else ""
    return f"""WITH {prefix}, sized AS (SELECT id, {split} AS t FROM symbols), postings AS (SELECT id, token, count(*) AS tf FROM (SELECT id, unnest(t) AS token FROM sized) AS x GROUP BY ALL),
    terms(no, term, is_prefix) AS (VALUES {listed}), per_term AS (SELECT no, id, sum(tf) AS f FROM postings JOIN terms ON token = term OR (is_prefix AND starts_with(token, term)) GROUP BY no, id),
    found AS (SELECT no, count(*) AS n_i FROM per_term GROUP BY no), a AS (SELECT count(*) AS n, sum(len(t)) / count(*) AS avgdl FROM sized),
    scored AS (SELECT id, sum((CASE WHEN n - n_i + 0.5 <= n_i + 0.5 THEN 1e-6 ELSE ln((n - n_i + 0.5) / (n_i + 0.5)) END) * f * 2.2 / (f + 1.2 * (0.25 + 0.75 * len(t) / avgdl))) AS score, count(*) AS got FROM per_term JOIN found USING (no) JOIN sized USING (id), a GROUP BY id)
    SELECT id, round(score, 4) AS score FROM scored JOIN (SELECT id, kind FROM symbols{where}) AS k USING (id) WHERE got = {len(terms)} ORDER BY round(score, 9) DESC, id LIMIT 20"""


@query("keyword_search", _fts_sql(PART, "small bra"))
def keyword_search(s, d):  # noqa: ANN001, ANN201
    return search.search(fx.part_symbols(s, d), "small bra").select("id", F.round("score", 4).alias("score"))


@query("keyword_search_text", _fts_sql(TEXT, "apache licens"))
def keyword_search_text(s, d):  # noqa: ANN001, ANN201
    return search.search(fx.text_symbols(s, d), "apache licens").select("id", F.round("score", 4).alias("score"))


@query("keyword_search_kind", _fts_sql(SUPPLY.replace("CAST(NULL AS VARCHAR) AS docstring", "NULL AS docstring"), "africa bui", "function"))
def keyword_search_kind(s, d):  # noqa: ANN001, ANN201
    return search.search(fx.supply_symbols(s, d), "africa bui", "function").select("id", F.round("score", 4).alias("score"))


@query("keyword_search_like", f"WITH {PART} SELECT id, 0.0::DOUBLE AS score FROM symbols WHERE name ILIKE '%%%' ORDER BY id LIMIT 20")
def keyword_search_like(s, d):  # noqa: ANN001, ANN201
    return search.search(fx.part_symbols(s, d), "%").select("id", "score")


@query("complexity_estimate", f"SELECT doc_id, CAST(least(1 + len(regexp_extract_all(text, '{code.BRANCHES}')), 100) AS INTEGER) AS complexity FROM documents")
def complexity_estimate(s, d):  # noqa: ANN001, ANN201
    return fx.table(s, d, "documents").select("doc_id", code.complexity(F.col("text")).alias("complexity"))


@query("signature_extract", """SELECT doc_id, CASE WHEN instr(text, '{') > 1 THEN left(trim(split_part(text, '{', 1), ' '), 300) WHEN instr(text, ':') BETWEEN 2 AND 200 THEN trim(split_part(text, ':', 1), ' ')
    WHEN length(split_part(text, chr(10), 1)) > 300 THEN left(split_part(text, chr(10), 1), 300) || '...' ELSE split_part(text, chr(10), 1) END AS signature FROM documents""")
def signature_extract(s, d):  # noqa: ANN001, ANN201
    return fx.table(s, d, "documents").select("doc_id", code.signature(F.col("text")).alias("signature"))


_FORMS = ", ".join("nullif(regexp_extract(html, '" + p.replace("'", "''") + "', 1), '')" for p in code.IMPORTS)


@query("import_path_extract", f"SELECT page_id, coalesce({_FORMS}) AS path FROM pages")
def import_path_extract(s, d):  # noqa: ANN001, ANN201
    return fx.table(s, d, "pages").select("page_id", code.import_path(F.col("html")).alias("path"))


@query("qualified_name", r"""WITH p AS (SELECT page_id, string_split(regexp_replace(regexp_replace(url, '^[a-z]+://', ''), '\.[^.]+$', ''), '/') AS a FROM pages),
    q AS (SELECT page_id, CASE WHEN a[-1] IN ('index', 'main', 'mod') THEN a[1 : len(a) - 1] ELSE a END AS a FROM p)
    SELECT page_id, array_to_string(list_append(a[greatest(len(a) - 2, 1) : len(a)], 'page'), '.') AS qualified_name FROM q""")
def qualified_name(s, d):  # noqa: ANN001, ANN201
    return fx.table(s, d, "pages").select("page_id", code.qualified_name(F.regexp_replace("url", "^[a-z]+://", ""), F.lit("page")).alias("qualified_name"))


# Traversal


def _impact_sql(prefix: str, start: str, depth: int) -> str:
    return f"""WITH RECURSIVE {prefix}, arcs AS (SELECT DISTINCT target_id AS u, source_id AS v FROM edges WHERE kind IN {_in(IMPACT)}),
    walk AS (SELECT '{start}' AS id, 0 AS depth UNION SELECT v, depth + 1 FROM walk JOIN arcs ON u = id WHERE depth < {depth})
    SELECT id, CAST(min(depth) AS INTEGER) AS depth FROM walk WHERE id <> '{start}' GROUP BY id"""


@query("impact_radius", _impact_sql(SUPPLY, "p:1", 3))
def impact_radius(s, d):  # noqa: ANN001, ANN201
    return graph.impact(fx.supply_symbols(s, d), fx.supply_edges(s, d), "p:1").select("id", "depth")


_WALK = f"""WITH RECURSIVE {WHOLE}, arcs AS (SELECT DISTINCT target_id AS u, source_id AS v FROM edges WHERE kind IN {_in(IMPACT)}),
    walk AS (SELECT 'p:1' AS id, 0 AS depth, CAST([] AS VARCHAR[]) AS path UNION ALL SELECT v, depth + 1, list_append(path, id) FROM walk JOIN arcs ON u = id WHERE depth < 3 AND NOT list_contains(path, v)),
    first AS (SELECT id, depth, array_to_string(path, '>') AS path, row_number() OVER (PARTITION BY id ORDER BY depth, path) AS place FROM walk), found AS (SELECT id, depth, path FROM first WHERE place = 1 AND id <> 'p:1')"""


def _impact(s: SparkSession, d: str) -> DataFrame:
    return graph.impact(fx.whole_symbols(s, d), fx.whole_edges(s, d), "p:1")


@query("impact_paths", _WALK + " SELECT id, CAST(depth AS INTEGER) AS depth, path FROM found")
def impact_paths(s, d):  # noqa: ANN001, ANN201
    return _impact(s, d).select("id", "depth", F.array_join("path", ">").alias("path"))


@query("impact_by_depth", _WALK + " SELECT CAST(depth AS INTEGER) AS depth, count(*) AS n, string_agg(id, ',' ORDER BY id) AS ids FROM found GROUP BY depth")
def impact_by_depth(s, d):  # noqa: ANN001, ANN201
    return graph.impact_by_depth(_impact(s, d))


# Depths first, each symbol once a depth; then only steps that lead down to the end are followed.
@query("shortest_path", f"""WITH RECURSIVE {WHOLE}, arcs AS (SELECT source_id AS u, target_id AS v FROM edges UNION SELECT target_id, source_id FROM edges),
    reach AS (SELECT 'r:0' AS id, 0 AS depth UNION SELECT v, depth + 1 FROM reach JOIN arcs ON u = id WHERE depth < 6),
    depths AS (SELECT id, min(depth) AS depth FROM reach GROUP BY id),
    back AS (SELECT id, depth FROM depths WHERE id = 'p:1' UNION SELECT d.id, d.depth FROM back AS b JOIN arcs ON v = b.id JOIN depths AS d ON d.id = u AND d.depth = b.depth - 1),
    walk AS (SELECT 'r:0' AS id, 0 AS depth, ['r:0'] AS path UNION ALL SELECT b.id, b.depth, list_append(path, b.id) FROM walk AS w JOIN arcs ON u = w.id JOIN back AS b ON b.id = v AND b.depth = w.depth + 1),
    best AS (SELECT path FROM walk WHERE id = 'p:1' ORDER BY path LIMIT 1)
    SELECT CAST(i - 1 AS INTEGER) AS hop, path[i] AS id FROM best, unnest(range(1, len(path) + 1)) AS r(i)""")
def shortest_path(s, d):  # noqa: ANN001, ANN201
    return graph.shortest_path(fx.whole_symbols(s, d), fx.whole_edges(s, d), "r:0", "p:1")


# Twenty pairs of nations buy from each other, so the twenty shortest cycles are among those of one or two calls.
@query("circular_deps", f"""WITH {WHOLE}, arcs AS (SELECT source_id AS u, target_id AS v, min(kind) AS kind FROM edges WHERE kind IN {_in(CYCLE)} GROUP BY 1, 2)
    SELECT u || '>' || u AS cycle, 1 AS size, kind AS via FROM arcs WHERE u = v UNION ALL SELECT a.u || '>' || a.v || '>' || a.u, 2, b.kind FROM arcs AS a JOIN arcs AS b ON a.v = b.u AND b.v = a.u WHERE a.u < a.v ORDER BY size, cycle LIMIT 20""")
def circular_deps(s, d):  # noqa: ANN001, ANN201
    return graph.cycles(fx.whole_edges(s, d))


@query("scc_members", f"""WITH RECURSIVE {WHOLE}, arcs AS (SELECT DISTINCT source_id AS u, target_id AS v FROM edges WHERE kind IN {_in(CYCLE)}),
    reach AS (SELECT u AS a, v AS b FROM arcs UNION SELECT a, v FROM reach JOIN arcs ON u = b),
    comp AS (SELECT x.a AS id, min(x.b) AS component FROM reach AS x JOIN reach AS y ON x.a = y.b AND x.b = y.a GROUP BY 1), n AS (SELECT component, count(*) AS size FROM comp GROUP BY 1 HAVING count(*) > 1) SELECT id, component, size FROM comp JOIN n USING (component)""")
def scc_members(s, d):  # noqa: ANN001, ANN201
    return graph.scc_members(fx.whole_edges(s, d))


# Context and resolution


@query("keywords", rf"""WITH t AS (SELECT doc_id, list_filter(string_split_regex(lower(replace(regexp_replace(text, '([a-z])([A-Z])', '\1 \2', 'g'), '_', ' ')), '[\s,;:.!?/\\]+'), lambda w: length(w) > 1 AND NOT list_contains([{", ".join(f"'{w}'" for w in sorted(QUERY_STOP_WORDS))}], w)) AS k FROM documents)
    SELECT doc_id, array_to_string(list_filter(k, lambda w, i: list_position(k, w) = i), ' ') AS keywords FROM t""")
def keywords(s, d):  # noqa: ANN001, ANN201
    return fx.table(s, d, "documents").select("doc_id", F.array_join(query_keywords(F.col("text")), " ").alias("keywords"))


_TASK = "fix small ring Brand#13 widget"
_SCORE = "(CASE WHEN lower(name) = k THEN 10 WHEN contains(lower(name), k) THEN 5 ELSE 0 END + CASE WHEN contains(lower(qualified_name), k) THEN 3 ELSE 0 END + CASE WHEN contains(lower(coalesce(signature, '')), k) THEN 2 ELSE 0 END + CASE WHEN contains(lower(coalesce(docstring, '')), k) THEN 2 ELSE 0 END)"
_SCORED = f"""scored AS (SELECT id, CAST(sum({_SCORE}) + max(CASE WHEN exported THEN 2 ELSE 0 END) + max(CASE WHEN kind IN ('class', 'component', 'interface') THEN 1 ELSE 0 END)
    + max(CASE WHEN regexp_matches(lower(name), '^(api|app|controller|handler|index|main|route|server)') THEN 1 ELSE 0 END) AS DOUBLE) AS score FROM symbols, (SELECT unnest(['small', 'ring', 'brand#13', 'widget']) AS k) AS words GROUP BY id)"""


@query("context_score", f"WITH {SUPPLY}, {_SCORED} SELECT id, score FROM scored")
def context_score(s, d):  # noqa: ANN001, ANN201
    words = context.keywords(s, _TASK)
    return fx.supply_symbols(s, d).select("id", context.node_score(words).alias("score"))


def _hits_sql(words: list[str]) -> str:
    """Ids among the 50 best keyword hits of any word, over the supply symbols."""
    parts = []
    for w in words:
        body = _fts_sql("@", w).replace("LIMIT 20", "LIMIT 50").replace("WITH @, ", "WITH ")
        parts.append(f"SELECT id FROM ({body}) AS x")
    return " UNION ".join(parts)


_HITS = f"{_SCORED}, hits AS ({_hits_sql(['small', 'ring', 'brand#13', 'widget'])}), found AS (SELECT id, score FROM scored JOIN hits USING (id))"
_EXPANDED = f"""{_HITS}, seeds AS (SELECT id, row_number() OVER (ORDER BY score DESC, id) AS seed FROM found QUALIFY seed <= 10),
    near AS (SELECT target_id AS id, seed, 0 AS side FROM edges JOIN seeds ON source_id = id UNION ALL SELECT source_id, seed, 1 FROM edges JOIN seeds ON target_id = id),
    more AS (SELECT id, CASE WHEN arg_min(side, seed * 2 + side) = 0 THEN 0.5 ELSE 0.4 END AS score FROM near WHERE id NOT IN (SELECT id FROM found) AND id IN (SELECT id FROM symbols) GROUP BY id),
    wide AS (SELECT id, score FROM found UNION ALL SELECT id, CAST(score AS DOUBLE) FROM more)"""


def _found(s: SparkSession, d: str) -> DataFrame:
    return context.candidates(fx.supply_symbols(s, d), context.keywords(s, _TASK), context.Options())


@query("context_candidates", f"WITH {SUPPLY}, {_HITS} SELECT id, score FROM found")
def context_candidates(s, d):  # noqa: ANN001, ANN201
    return _found(s, d)


@query("context_expand", f"WITH {SUPPLY}, {_EXPANDED} SELECT id, score FROM wide")
def context_expand(s, d):  # noqa: ANN001, ANN201
    return context.expand(_found(s, d), fx.supply_edges(s, d), fx.supply_symbols(s, d), context.Options())


def _near_sql(own: str, other: str) -> str:
    return f"(SELECT string_agg(q, ',' ORDER BY i) FROM (SELECT s.qualified_name AS q, s.id AS i FROM edges AS e JOIN symbols AS s ON s.id = e.{other} WHERE e.{own} = t.id AND e.kind = 'calls' ORDER BY s.id LIMIT 5) AS x)"


@query("context", f"""WITH {SUPPLY}, {_EXPANDED}, top AS (SELECT id, score, row_number() OVER (ORDER BY score DESC, id) AS place FROM wide QUALIFY place <= 25)
    SELECT CAST(place AS INTEGER) AS place, t.id, t.score, s.name, coalesce({_near_sql("target_id", "source_id")}, '') AS callers, coalesce({_near_sql("source_id", "target_id")}, '') AS callees, (SELECT count(*) FROM wide) AS searched FROM top AS t JOIN symbols AS s ON s.id = t.id""")
def context_(s, d):  # noqa: ANN001, ANN201
    out = context.build(fx.supply_symbols(s, d), fx.supply_edges(s, d), _TASK)
    return out.select("place", "id", "score", "name", F.array_join("callers", ",").alias("callers"), F.array_join("callees", ",").alias("callees"), "searched")


_RESOLVED = rf"""WITH {SUPPLY}, sized AS (SELECT id, list_filter(string_split_regex(lower(strip_accents(concat_ws(' ', name, qualified_name, signature, docstring))), '[^\p{{L}}\p{{N}}]+'), lambda w: length(w) > 0) AS t FROM symbols),
    postings AS (SELECT id, token, count(*) AS tf FROM (SELECT id, unnest(t) AS token FROM sized) AS x GROUP BY ALL), names AS (SELECT q, string_split(q, ' ') AS t FROM (SELECT DISTINCT p_name AS q FROM part) AS x),
    terms AS (SELECT q, i AS no, t[i] AS term, i = len(t) AS is_prefix FROM names, unnest(range(1, len(t) + 1)) AS r(i)), per_term AS (SELECT q, no, id, sum(tf) AS f FROM postings JOIN terms ON token = term OR (is_prefix AND starts_with(token, term)) GROUP BY ALL),
    found AS (SELECT q, no, count(*) AS n_i FROM per_term GROUP BY ALL), a AS (SELECT count(*) AS n, sum(len(t)) / count(*) AS avgdl FROM sized),
    scored AS (SELECT q, id, sum((CASE WHEN n - n_i + 0.5 <= n_i + 0.5 THEN 1e-6 ELSE ln((n - n_i + 0.5) / (n_i + 0.5)) END) * f * 2.2 / (f + 1.2 * (0.25 + 0.75 * len(t) / avgdl))) AS score, count(*) AS got FROM per_term JOIN found USING (q, no) JOIN sized USING (id), a GROUP BY ALL),
    top AS (SELECT q, id, row_number() OVER (PARTITION BY q ORDER BY round(score, 9) DESC, id) AS place FROM scored JOIN names USING (q) WHERE got = len(names.t) QUALIFY place <= 10),
    refs AS (SELECT DISTINCT 's:' || l_suppkey AS source_id, p_name AS q FROM lineitem JOIN part ON l_partkey = p_partkey),
    rated AS (SELECT r.source_id, r.q, c.id, CASE WHEN c.name = r.q THEN 10 ELSE 0 END + CASE WHEN o.file_path = c.file_path THEN 8 WHEN regexp_replace(o.file_path, '/[^/]*$', '') = regexp_replace(c.file_path, '/[^/]*$', '') THEN 5
        ELSE least(3, list_sum(list_transform(list_zip(string_split(o.file_path, '/'), string_split(c.file_path, '/')), lambda p: CASE WHEN p[1] = p[2] THEN 1 ELSE 0 END))) END + CASE WHEN c.exported THEN 3 ELSE 0 END + CASE WHEN c.kind IN ('class', 'interface', 'module') THEN 2 ELSE 0 END AS points, c.file_path, place
        FROM refs AS r JOIN symbols AS o ON o.id = r.source_id JOIN top USING (q) JOIN symbols AS c ON c.id = top.id),
    won AS (SELECT source_id, id AS target_id FROM rated QUALIFY row_number() OVER (PARTITION BY source_id, q ORDER BY points DESC, length(file_path), place) = 1)
    SELECT DISTINCT substr(sha256(source_id || '->' || target_id || ':imports'), 1, 16) AS id, source_id, target_id, 'imports' AS kind FROM won WHERE source_id <> target_id"""


@query("reference_resolution", _RESOLVED)
def reference_resolution(s, d):  # noqa: ANN001, ANN201
    """Every distinct part name as a reference from each supplier that ships such a part, resolved among the supply symbols."""
    parts = fx.table(s, d, "part").select("p_partkey", "p_name")
    ships = fx.table(s, d, "lineitem").select("l_suppkey", "l_partkey").join(parts, F.col("l_partkey") == F.col("p_partkey")).select("l_suppkey", "p_name").distinct()
    refs = ships.select(F.concat(F.lit("s:"), "l_suppkey").alias("from_node_id"), F.col("p_name").alias("ref_name"))
    own = fx.supply_symbols(s, d).filter(F.col("id").startswith("s:")).select(F.col("id").alias("from_node_id"), "file_path")
    return resolve.resolve(refs.join(own, "from_node_id").withColumn("ref_kind", F.lit("imports")), fx.supply_symbols(s, d))


# Incremental maintenance: the old state has no Spanish file, the new one no French, and German files have changed

_STATES = "old AS (SELECT * FROM files WHERE language <> 'es'), new_ AS (SELECT file_path, CASE WHEN language = 'de' THEN reverse(hash) ELSE hash END AS hash, language, line_count FROM files WHERE language <> 'fr')"


def _states(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    files = fx.text_files(s, d)
    return files.filter("language <> 'fr'").withColumn("hash", F.when(F.col("language") == "de", F.reverse("hash")).otherwise(F.col("hash"))), files.filter("language <> 'es'")


_CLASS = "CASE WHEN o.file_path IS NULL THEN 'added' WHEN n.file_path IS NULL THEN 'removed' WHEN o.hash = n.hash THEN 'unchanged' ELSE 'modified' END"


@query("sync_classify", f"WITH {TEXT}, {_STATES} SELECT coalesce(n.file_path, o.file_path) AS file_path, {_CLASS} AS status FROM new_ AS n FULL JOIN old AS o ON n.file_path = o.file_path")
def sync_classify(s, d):  # noqa: ANN001, ANN201
    now, indexed = _states(s, d)
    return sources_files.classify_changes(now, indexed)


def _index(s: SparkSession) -> Index:
    return Index(s, f"{steps.shared_dir(s)}/store-{uuid.uuid4().hex}")


@query("sync_apply", f"WITH {TEXT}, {_STATES} SELECT file_path, hash, line_count FROM new_")
def sync_apply(s, d):  # noqa: ANN001, ANN201
    """An index of the old files, synced to the new ones."""
    now, indexed = _states(s, d)
    text = fx.table(s, d, "documents").select(F.concat("source", F.lit("/"), "doc_id").alias("file_path"), F.col("text").alias("content"))
    index = _index(s)
    for files in (indexed, now):
        index.sync(files.join(text, "file_path"))
    return index.store.read("files").select("file_path", "hash", "line_count")


_BURST = "e AS (SELECT *, CASE WHEN ts - lag(ts) OVER w <= INTERVAL 1 HOUR THEN 0 ELSE 1 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)), b AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS burst FROM e)"


@query("watch_debounce", f"WITH {_BURST} SELECT user_id, arg_max(event_id, (ts, event_id)) AS event_id, count(*) AS events FROM b GROUP BY user_id, burst")
def watch_debounce(s, d):  # noqa: ANN001, ANN201
    log = fx.table(s, d, "events").withColumnRenamed("user_id", "path")
    return watch.bursts(log, "1 hour", "event_id").select(F.col("path").alias("user_id"), "event_id", "events")


@query("watch_apply", f"WITH {_BURST}, last AS (SELECT user_id, arg_max(event_type, (ts, event_id)) AS event_type, max(ts) AS ts, arg_max(event_id, (ts, event_id)) AS event_id FROM b GROUP BY user_id) SELECT 'u' || user_id || '.py' AS file_path, 'event_' || event_id AS name FROM last WHERE event_type <> 'error'")
def watch_apply(s, d):  # noqa: ANN001, ANN201
    """Each user's events as changes of a file, which an error removes, applied to an index in two batches: the later half first."""
    log = fx.table(s, d, "events").select(F.concat(F.lit("u"), "user_id", F.lit(".py")).alias("path"), F.when(F.col("event_type") == "error", "unlink").otherwise("change").alias("op"), "ts", F.concat(F.lit("def event_"), "event_id", F.lit("():\n    pass\n")).alias("content"), "event_id")
    kept = watch.bursts(log, "1 hour", "event_id")
    middle = F.lit(kept.agg(F.percentile_approx("ts", 0.5)).first()[0])
    index = _index(s)
    for n, part in enumerate((kept.filter(F.col("ts") > middle), kept.filter(F.col("ts") <= middle))):
        index.apply_changes(watch.latest(part, "event_id").select("path", "op", "ts", "content"), ("events", n))
    return index.store.read("symbols").select("file_path", "name")


# Extraction: a class for each nation with a method for each customer, in Python or TypeScript

_CODE = """k AS (SELECT n_nationkey AS n, n_nationkey % 2 = 0 AS py, CASE WHEN n_nationkey % 2 = 0 THEN 'py/nation' || n_nationkey || '.py' ELSE 'web/nation' || n_nationkey || '.ts' END AS file_path, c_custkey AS c, lower(c_mktsegment) AS segment,
    row_number() OVER (PARTITION BY n_nationkey ORDER BY c_custkey) AS i, count(*) OVER (PARTITION BY n_nationkey) AS k FROM nation JOIN customer ON c_nationkey = n_nationkey),
    decl AS (SELECT DISTINCT 'class' AS kind, 'Nation' || n AS name, file_path, 1 AS start_line, CAST(CASE WHEN py THEN 2 * k + 1 ELSE k + 2 END AS INTEGER) AS end_line, CASE WHEN py THEN 'python' ELSE 'typescript' END AS language, NOT py AS exported, NULL AS segment, n FROM k
        UNION ALL SELECT 'method', 'customer_' || c, file_path, CAST(CASE WHEN py THEN 2 * i ELSE i + 1 END AS INTEGER), CAST(CASE WHEN py THEN 2 * i + 1 ELSE i + 1 END AS INTEGER), CASE WHEN py THEN 'python' ELSE 'typescript' END, false, segment, n FROM k),
    named AS (SELECT *, substr(sha256(kind || ':' || file_path || ':' || name || ':' || start_line), 1, 16) AS id FROM decl)"""


def _code(s: SparkSession, d: str, columns: str = "*") -> DataFrame:
    return extract.parsed(fx.code_files(s, d)).select(*columns.split())


@query("extract_symbols", f"WITH {_CODE} SELECT id, kind, name, file_path, start_line, end_line, language, exported FROM named")
def extract_symbols(s, d):  # noqa: ANN001, ANN201
    return extract.symbols(_code(s, d)).select("id", "kind", "name", "file_path", "start_line", "end_line", "language", "exported")


@query("extract_contains", f"WITH {_CODE} SELECT substr(sha256(a.id || '->' || b.id || ':contains'), 1, 16) AS id, a.id AS source_id, b.id AS target_id, 'contains' AS kind FROM named AS a JOIN named AS b ON a.n = b.n AND a.kind = 'class' AND b.kind = 'method'")
def extract_contains(s, d):  # noqa: ANN001, ANN201
    # A table, as both sides of a join read it and files are parsed once.
    return extract.contains(steps.materialize(_code(s, d, "file_path n parent id"))).drop("metadata")


@query("extract_refs", f"WITH {_CODE} SELECT DISTINCT a.id AS from_node_id, 'segment_' || b.segment AS ref_name, 'calls' AS ref_kind, a.file_path FROM named AS a JOIN named AS b ON a.n = b.n AND b.kind = 'method' AND (a.kind = 'class' OR a.id = b.id)")
def extract_refs(s, d):  # noqa: ANN001, ANN201
    """What each method calls, and what a class calls through its methods."""
    return extract.refs(steps.materialize(_code(s, d, "file_path n ancestors refs id")))
