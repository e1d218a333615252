"""The driver's tables as graph data, in Spark and as SQL common table expressions of the same content.

SUPPLY: regions, nations, suppliers, customers and parts as symbols; containment, calls (customer to supplier
through orders) and imports (supplier to part) as edges. WHOLE: SUPPLY with the nations as functions and a call from
each nation to every other one it buys from. TEXT: documents as symbols and as files.

A graph is derived once a session and written to the shared folder, as an index would hold it; queries read it there.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.steps import exists, shared_dir
from .files import with_facts

_STORED: dict[tuple[str, str, str], str] = {}


def _stored(make: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    """The frame that ``make`` derives, written once for each session and folder of tables."""
    def read(spark: SparkSession, sf_dir: str) -> DataFrame:
        key = (spark.sparkContext.applicationId, sf_dir, make.__name__)
        df = make(spark, sf_dir)
        if key not in _STORED or not exists(spark, _STORED[key]):
            path = f"{shared_dir(spark)}/graph-{make.__name__}-{uuid.uuid4().hex}"
            df.write.parquet(path)
            _STORED[key] = path
        return spark.read.schema(df.schema).parquet(_STORED[key])

    return read


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _views(spark: SparkSession, sf_dir: str, sql: str, names: str) -> DataFrame:
    return spark.sql(sql, **{n: table(spark, sf_dir, n) for n in names.split()})


_SYMBOLS = """
    SELECT concat('r:', r_regionkey) AS id, 'module' AS kind, r_name AS name, r_name AS file_path, CAST(NULL AS STRING) AS signature, CAST(NULL AS STRING) AS docstring, true AS exported, 1 AS complexity FROM {region}
    UNION ALL SELECT concat('n:', n_nationkey), 'namespace', n_name, concat(r_name, '/', n_name), NULL, NULL, true, 1 FROM {nation} JOIN {region} ON n_regionkey = r_regionkey
    UNION ALL SELECT concat('s:', s_suppkey), 'class', s_name, concat(r_name, '/', n_name), NULL, NULL, s_acctbal > 0, 1 FROM {supplier} JOIN {nation} ON s_nationkey = n_nationkey JOIN {region} ON n_regionkey = r_regionkey
    UNION ALL SELECT concat('c:', c_custkey), 'function', c_name, concat(r_name, '/', n_name), c_mktsegment, NULL, c_acctbal > 0, CAST(least(1 + coalesce(n, 0), 100) AS INT) FROM {customer} JOIN {nation} ON c_nationkey = n_nationkey JOIN {region} ON n_regionkey = r_regionkey LEFT JOIN (SELECT o_custkey, count(*) AS n FROM {orders} GROUP BY o_custkey) ON o_custkey = c_custkey
    UNION ALL SELECT concat('p:', p_partkey), 'interface', p_name, concat('parts/', p_brand), p_type, p_brand, p_retailprice > 1000, 1 FROM {part}"""
_EDGES = """
    SELECT concat('r:', n_regionkey) AS source_id, concat('n:', n_nationkey) AS target_id, 'contains' AS kind FROM {nation}
    UNION ALL SELECT concat('n:', c_nationkey), concat('c:', c_custkey), 'contains' FROM {customer}
    UNION ALL SELECT concat('n:', s_nationkey), concat('s:', s_suppkey), 'contains' FROM {supplier}
    UNION ALL (SELECT DISTINCT concat('c:', o_custkey), concat('s:', l_suppkey), 'calls' FROM {orders} JOIN {lineitem} ON o_orderkey = l_orderkey)
    UNION ALL (SELECT DISTINCT concat('s:', l_suppkey), concat('p:', l_partkey), 'imports' FROM {lineitem})"""
#: The same edges, made distinct by their keys and written as ids afterwards: numbers take less to move and to hold.
_EDGES_BY_KEYS = _EDGES.replace(
    "SELECT DISTINCT concat('c:', o_custkey), concat('s:', l_suppkey), 'calls' FROM {orders} JOIN {lineitem} ON o_orderkey = l_orderkey",
    "SELECT concat('c:', o_custkey), concat('s:', l_suppkey), 'calls' FROM (SELECT DISTINCT o_custkey, l_suppkey FROM {orders} JOIN {lineitem} ON o_orderkey = l_orderkey) AS x",
).replace(
    "SELECT DISTINCT concat('s:', l_suppkey), concat('p:', l_partkey), 'imports' FROM {lineitem}",
    "SELECT concat('s:', l_suppkey), concat('p:', l_partkey), 'imports' FROM (SELECT DISTINCT l_suppkey, l_partkey FROM {lineitem}) AS x",
)
_TRADE = """
    SELECT DISTINCT concat('n:', c_nationkey) AS source_id, concat('n:', s_nationkey) AS target_id, 'calls' AS kind
    FROM {lineitem} JOIN {orders} ON l_orderkey = o_orderkey JOIN {customer} ON o_custkey = c_custkey JOIN {supplier} ON l_suppkey = s_suppkey
    WHERE c_nationkey <> s_nationkey"""
_TRADE_SYMBOLS = "SELECT concat('n:', n_nationkey) AS id, 'function' AS kind, n_name AS name, concat('nations/', n_name) AS file_path, n_nationkey + 1 AS start_line, n_regionkey > 1 AS exported FROM {nation}"


@_stored
def supply_symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _views(spark, sf_dir, _SYMBOLS, "region nation supplier customer orders part")
    return rows.withColumn("qualified_name", F.concat(F.replace("file_path", F.lit("/"), F.lit(".")), F.lit("."), F.col("name"))).withColumn("start_line", F.lit(1))


@_stored
def supply_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _views(spark, sf_dir, _EDGES_BY_KEYS, "nation customer supplier orders lineitem")


@_stored
def whole_symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    nations = _views(spark, sf_dir, _TRADE_SYMBOLS, "nation").withColumn("qualified_name", F.concat(F.lit("nations."), "name"))
    return supply_symbols(spark, sf_dir).filter("kind <> 'namespace'").select(nations.columns).unionByName(nations)


@_stored
def whole_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return supply_edges(spark, sf_dir).unionByName(_views(spark, sf_dir, _TRADE, "lineitem orders customer supplier"))


def text_symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as symbols: name source, qualified name language.source, signature first line, docstring whole text."""
    d = table(spark, sf_dir, "documents")
    return d.select(F.col("doc_id").cast("string").alias("id"), F.lit("function").alias("kind"), F.col("source").alias("name"), F.concat("lang", F.lit("."), "source").alias("qualified_name"), F.concat("source", F.lit("/"), "doc_id").alias("file_path"), F.lit(1).alias("start_line"), F.lit(False).alias("exported"), F.substring_index("text", "\n", 1).alias("signature"), F.col("text").alias("docstring"))


def text_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    return d.select(F.concat("source", F.lit("/"), "doc_id").alias("file_path"), F.substring(F.sha2("text", 256), 1, 16).alias("hash"), F.col("lang").alias("language"), F.lit(1).alias("node_count"), (F.length("text") - F.length(F.replace("text", F.lit("\n"), F.lit(""))) + 1).alias("line_count"))


def code_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Source files: a class for each nation with a method for each of its customers, in Python for even keys, else in TypeScript."""
    c = table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("n"), "c_custkey", F.lower("c_mktsegment").alias("segment"))
    py = F.format_string("    def customer_%s(self):\n        return segment_%s()\n", F.col("c_custkey").cast("string"), "segment")
    ts = F.format_string("  customer_%s(x) { return segment_%s(x); }\n", F.col("c_custkey").cast("string"), "segment")
    even = F.col("n") % 2 == 0
    body = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("c_custkey", F.when(even, py).otherwise(ts).alias("text")))), lambda x: x["text"]), "")
    files = c.groupBy("n").agg(body.alias("body"))
    path = F.when(even, F.format_string("py/nation%d.py", "n")).otherwise(F.format_string("web/nation%d.ts", "n"))
    text = F.when(even, F.concat(F.format_string("class Nation%d:\n", "n"), "body")).otherwise(F.concat(F.format_string("export class Nation%d {\n", "n"), "body", F.lit("}\n")))
    return with_facts(files.select(path.alias("file_path"), text.alias("content")))


def part_symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as symbols with four text fields: name, brand.name, type, brand."""
    p = table(spark, sf_dir, "part")
    return p.select(F.col("p_partkey").cast("string").alias("id"), F.lit("interface").alias("kind"), F.col("p_name").alias("name"), F.concat("p_brand", F.lit("."), "p_name").alias("qualified_name"), F.concat(F.lit("parts/"), "p_brand").alias("file_path"), F.lit(1).alias("start_line"), (F.col("p_retailprice") > 1000).alias("exported"), F.col("p_type").alias("signature"), F.col("p_brand").alias("docstring"))


def _plain(sql: str) -> str:
    return sql.replace("{", "").replace("}", "").replace("AS STRING", "AS VARCHAR")


SUPPLY_SQL = f"symbols AS (SELECT *, replace(file_path, '/', '.') || '.' || name AS qualified_name, 1 AS start_line FROM ({_plain(_SYMBOLS)}) AS x), edges AS ({_plain(_EDGES)})"
WHOLE_SQL = f"""symbols AS (SELECT id, kind, name, file_path, start_line, exported, qualified_name FROM (SELECT *, replace(file_path, '/', '.') || '.' || name AS qualified_name, 1 AS start_line FROM ({_plain(_SYMBOLS)}) AS x) AS y WHERE kind <> 'namespace'
    UNION ALL SELECT id, kind, name, file_path, start_line, exported, 'nations.' || name FROM ({_plain(_TRADE_SYMBOLS)}) AS z), edges AS ({_plain(_EDGES)} UNION ALL ({_plain(_TRADE)}))"""
TEXT_SQL = "symbols AS (SELECT CAST(doc_id AS VARCHAR) AS id, 'function' AS kind, source AS name, lang || '.' || source AS qualified_name, source || '/' || doc_id AS file_path, 1 AS start_line, false AS exported, split_part(text, chr(10), 1) AS signature, text AS docstring FROM documents), files AS (SELECT source || '/' || doc_id AS file_path, substr(sha256(text), 1, 16) AS hash, lang AS language, 1 AS node_count, length(text) - length(replace(text, chr(10), '')) + 1 AS line_count FROM documents)"
PART_SQL = "symbols AS (SELECT CAST(p_partkey AS VARCHAR) AS id, 'interface' AS kind, p_name AS name, p_brand || '.' || p_name AS qualified_name, 'parts/' || p_brand AS file_path, 1 AS start_line, p_retailprice > 1000 AS exported, p_type AS signature, p_brand AS docstring FROM part)"
