"""Source-code heuristics as column expressions: signature, complexity, import path, qualified name, paths."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

BRANCHES = r"\b(" + "|".join("case catch else for if match switch while".split() + [r"\?", r"\|{2}", "&{2}"]) + r")\b"
_QUOTE, _QUOTED = r"""["']""", r"""([^"']+)"""
#: Forms that name an import, in the order they are tried; group 1 is the path.
IMPORTS = (rf"from\s+{_QUOTE}{_QUOTED}{_QUOTE}", rf"import\s+{_QUOTE}{_QUOTED}{_QUOTE}", rf"require\s*[(]\s*{_QUOTE}{_QUOTED}{_QUOTE}\s*[)]", r"use\s+([:\w]+)")


def complexity(text: Column) -> Column:
    """1 plus the branch words, 100 at most."""
    return F.least(F.regexp_count(text, F.lit(BRANCHES)) + 1, F.lit(100)).cast("int")


def signature(text: Column) -> Column:
    """Up to the first brace (300 characters), else up to a colon within the first 200, else the first line."""
    brace, colon = F.instr(text, "{"), F.instr(text, ":")
    line = F.substring_index(text, "\n", 1)
    return (
        F.when(brace > 1, F.substring(F.trim(F.substring_index(text, "{", 1)), 1, 300))
        .when((colon > 1) & (colon <= 200), F.trim(F.substring_index(text, ":", 1)))
        .otherwise(F.when(F.length(line) > 300, F.concat(F.substring(line, 1, 300), F.lit("..."))).otherwise(line))
    )


def import_path(text: Column) -> Column:
    """The path that the first matching form of import names, else null."""
    return F.coalesce(*[F.nullif(F.regexp_extract(text, p, 1), F.lit("")) for p in IMPORTS])


def qualified_name(file_path: Column, name: Column) -> Column:
    """The path's last three segments without extension (an entry file's own name left out) and the name."""
    parts = F.split(F.regexp_replace(file_path, r"\.[^.]+$", ""), "/")
    last = F.element_at(parts, -1)
    parts = F.when(last.isin("index", "main", "mod"), F.slice(parts, F.lit(1), F.size(parts) - 1)).otherwise(parts)
    n = F.size(parts)
    return F.concat_ws(".", F.slice(parts, F.greatest(n - 2, F.lit(1)), F.lit(3)), name)


def directory(path: Column) -> Column:
    return F.when(F.instr(path, "/") > 0, F.regexp_replace(path, "/[^/]*$", "")).otherwise(F.lit("."))


def language_of(path: Column) -> Column:
    """Language by lower-cased extension; null where unknown."""
    from ..schema import LANGUAGES

    table = [F.lit(x) for lang, exts in LANGUAGES.items() for e in exts.split() for x in (e, lang)]
    return F.try_element_at(F.create_map(*table), F.lower(F.regexp_extract(path, r"[^/]\.([^./]+)$", 1)))
