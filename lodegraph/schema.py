"""Schemas, closed vocabularies and key expressions of the graph model."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _schema(spec: str) -> T.StructType:
    return T._parse_datatype_string(spec)  # noqa: SLF001


SYMBOLS = "id string, kind string, name string, qualified_name string, file_path string, start_line int, end_line int, language string, signature string, docstring string, exported boolean, complexity int, metadata string, created_at timestamp, updated_at timestamp"
EDGES = "id string, source_id string, target_id string, kind string, metadata string"
FILES = "file_path string, hash string, language string, indexed_at timestamp, node_count int, line_count int"
SEARCH_TOKENS = "node_id string, token string, tf double, source string"
IDF = "token string, idf double, doc_count long"
POSTINGS = "id string, token string, tf long, size int"
SEARCH_STATS = "n_all long, all_tokens long"
APPLIED = "path string, ts timestamp"
REFS = "from_node_id string, ref_name string, ref_kind string, file_path string"
CHANGES = "path string, op string, ts timestamp, content string"

NODE_KINDS = tuple("class component constant decorator enum function hook interface method middleware module namespace property route struct test trait type variable".split())
EDGE_KINDS = tuple("calls contains decorates exports extends has_method has_property implements imports overrides renders returns_type tests uses_type".split())

CALLS = ("calls",)
CYCLE = ("calls", "extends", "implements", "imports")
IMPACT = (*CYCLE, "uses_type")
MEMBER = ("contains", "has_method", "has_property")
HOTSPOT_KINDS = ("class", "component", "function", "hook", "interface", "method")
DEAD_KINDS = ("class", "function", "method")

LANGUAGES = {
    "c": "c h", "cpp": "cc cpp cxx hh hpp hxx", "csharp": "cs", "go": "go", "java": "java", "javascript": "cjs js jsx mjs", "kotlin": "kt kts",
    "php": "php", "python": "py pyw", "ruby": "rb", "rust": "rs", "swift": "swift", "typescript": "ts tsx",
}


def all_extensions() -> list[str]:
    """Every known extension, without its dot."""
    return [e for exts in LANGUAGES.values() for e in exts.split()]


def short_sha(text: Column) -> Column:
    """First 16 hex digits of SHA-256."""
    return F.substring(F.sha2(text, 256), 1, 16)


def node_id(kind: Column, file_path: Column, name: Column, line: Column) -> Column:
    return short_sha(F.concat_ws(":", kind, file_path, name, line.cast("string")))


def edge_id(source_id: Column, target_id: Column, kind: Column) -> Column:
    return short_sha(F.concat(source_id, F.lit("->"), target_id, F.lit(":"), kind))
