"""File discovery, content and change detection, and source snippets."""

from __future__ import annotations

import json
import os
import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.code import language_of
from ..schema import all_extensions

MAX_BYTES = 1 << 20
#: Directory names that are left out at the root of the tree, and file-name endings that are left out there.
SKIPPED_DIRS = tuple(".git .next .nuxt .venv __pycache__ bin build coverage dist node_modules out target vendor venv".split())
SKIPPED_ENDINGS = (".map", ".bundle.js", ".min.css", ".min.js")
DEFAULTS = {"exclude": [], "maxFileSize": MAX_BYTES}


def load_config(path: str) -> dict:
    """Defaults overlaid by a JSON file; a missing or broken file means the defaults."""
    try:
        with open(path, encoding="utf-8") as f:
            return DEFAULTS | json.load(f)
    except (OSError, ValueError):
        return dict(DEFAULTS)


def find_root(start: str, marker: str) -> str | None:
    """The nearest directory from ``start`` upwards that holds ``marker``."""
    at = os.path.abspath(start)
    while not os.path.exists(os.path.join(at, marker)):
        if os.path.dirname(at) == at:
            return None
        at = os.path.dirname(at)
    return at


def _glob(pattern: str) -> str:
    """A glob as a regular expression over a relative path: ** spans directories, * and ? do not."""
    out, i = "", 0
    while i < len(pattern):
        if pattern.startswith("**/", i):
            out, i = out + "(?:.*/)?", i + 3
        elif pattern.startswith("**", i):
            out, i = out + ".*", i + 2
        else:
            c = pattern[i]
            out, i = out + ("[^/]*" if c == "*" else "[^/]" if c == "?" else "\\" + c if c in ".+()[]{}^$|\\" else c), i + 1
    return f"^{out}$"


def wanted(path: Column, size: Column, exclude: tuple[str, ...] = (), max_bytes: int = MAX_BYTES) -> Column:
    """Is the relative path discovered: known extension, no hidden part, not excluded, not too large?"""
    top = F.substring_index(path, "/", 1)
    ok = language_of(path).isNotNull() & (size <= (max_bytes or MAX_BYTES)) & ~path.rlike(r"(^|/)\.")
    ok &= ~((F.instr(path, "/") > 0) & top.isin(*SKIPPED_DIRS))
    for end in SKIPPED_ENDINGS:
        ok &= ~((F.instr(path, "/") == 0) & path.endswith(end))
    for pattern in exclude:
        ok &= ~path.rlike(_glob(pattern))
    return ok


def with_facts(files: DataFrame) -> DataFrame:
    """(file_path, content) with hash, language and line_count."""
    lines = F.length("content") - F.length(F.replace("content", F.lit("\n"), F.lit(""))) + 1
    return files.select("file_path", "content", F.substring(F.sha2("content", 256), 1, 16).alias("hash"), language_of(F.col("file_path")).alias("language"), lines.cast("int").alias("line_count"))


def discover(spark: SparkSession, root: str, exclude: tuple[str, ...] = (), max_bytes: int = MAX_BYTES) -> DataFrame:
    """Source files below root: file_path (relative), content, hash, language, line_count."""
    base = root.rstrip("/")
    glob = "*.{" + ",".join(all_extensions()) + "}"
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", glob).load(_entered(spark, base))
    stem = F.regexp_replace("path", "^file:/+", "/")
    rel = F.expr(f"substring(_p, {len(os.path.abspath(base)) + 2})")
    named = raw.withColumn("_p", stem).withColumn("file_path", rel).filter(wanted(F.col("file_path"), F.col("length"), exclude, max_bytes))
    return with_facts(named.select("file_path", F.decode("content", "UTF-8").alias("content")))


def _entered(spark: SparkSession, base: str) -> list[str]:
    """base's files, and its directories but those that are skipped: what lies in them is neither listed nor read."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(base)  # noqa: SLF001
    fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())  # noqa: SLF001
    found = [(s.getPath(), s.isDirectory()) for s in fs.listStatus(path)]
    ends = tuple("." + e for e in all_extensions())
    kept = [p.toString() for p, is_dir in found if not p.getName().startswith(".") and (p.getName() not in SKIPPED_DIRS if is_dir else p.getName().lower().endswith(ends))]
    return [_escaped(p) for p in kept] or [_escaped(path.toString())]


def _escaped(path: str) -> str:
    return re.sub(r"([{}\[\]*?\\])", r"\\\1", path)


def snippets(symbols: DataFrame, files: DataFrame, limit: int = 500) -> DataFrame:
    """symbols with ``code``: their lines, cut at ``limit`` characters with a note; null where the file is gone."""
    text = files.select("file_path", F.split("content", "\n", -1).alias("_lines"))
    start = F.greatest(F.col("start_line"), F.lit(1))
    body = F.array_join(F.slice("_lines", start, F.greatest(F.col("end_line") - start + 1, F.lit(0))), "\n")
    cut = F.when(F.length(body) > limit, F.concat(F.substring(body, 1, limit), F.lit("\n// ... truncated"))).otherwise(body)
    return symbols.join(text, "file_path", "left").withColumn("code", cut).drop("_lines")


def classify_changes(now: DataFrame, indexed: DataFrame) -> DataFrame:
    """file_path and status (added, modified, removed, unchanged) from the hashes of two file tables."""
    a, b = now.select("file_path", F.col("hash").alias("_now")), indexed.select("file_path", F.col("hash").alias("_old"))
    status = F.when(F.col("_old").isNull(), "added").when(F.col("_now").isNull(), "removed").when(F.col("_now") == F.col("_old"), "unchanged").otherwise("modified")
    return a.join(b, "file_path", "full_outer").select("file_path", status.alias("status"))
