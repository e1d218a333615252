"""Symbols, containment and references from source text: one file to many rows, in Arrow batches.

Python is parsed by its own grammar (``ast``); brace languages and Ruby by a scanner that blanks comments and strings,
recognises declarations by keyword and finds their extent by counting braces (or ``end``). Its work is in proportion to
a file's length, however many declarations the file has. Parsers are plain
functions from text to ``Raw`` declarations in ``PARSERS``; a language without one gives no row, and so does a file
that cannot be parsed. All classification of what a parser found is done by column expressions afterwards.
"""

from __future__ import annotations

import ast
import re
from bisect import bisect_left
from collections import defaultdict
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import code
from ..schema import edge_id, node_id


@dataclass
class Raw:
    """A declaration: what it is, where, within which other one, its text, and the references directly in it."""

    kind: str
    name: str
    start: int
    end: int
    text: str
    parent: int = -1
    in_class: bool = False
    exported: bool = False
    doc: str | None = None
    refs: list[tuple[str, str]] = field(default_factory=list)


def _callee(node: ast.expr) -> str | None:
    return node.id if isinstance(node, ast.Name) else node.attr if isinstance(node, ast.Attribute) else None


def parse_python(text: str) -> list[Raw]:
    """Functions, methods, classes and their calls, imports and bases, by Python's grammar."""
    lines = text.split("\n")
    out: list[Raw] = []

    def visit(node: ast.AST, parent: int, in_class: bool) -> None:
        for child in ast.iter_child_nodes(node):
            at, inner = parent, in_class
            if isinstance(child, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)):
                is_class = isinstance(child, ast.ClassDef)
                body = "\n".join(lines[child.lineno - 1 : child.end_lineno])[child.col_offset :]
                doc = ast.get_docstring(child, clean=False)
                out.append(Raw("class" if is_class else "function", child.name, child.lineno, child.end_lineno or child.lineno, body, parent, in_class and not is_class, bool(child.decorator_list), doc))
                at, inner = len(out) - 1, is_class
                if is_class:
                    out[at].refs += [("extends", b) for b in map(_callee, child.bases) if b]
            elif isinstance(child, ast.Call) and at >= 0 and (name := _callee(child.func)):
                out[at].refs.append(("calls", name))
            elif isinstance(child, ast.Import) and at >= 0:
                out[at].refs += [("imports", a.name) for a in child.names]
            elif isinstance(child, ast.ImportFrom) and at >= 0 and child.module:
                out[at].refs.append(("imports", child.module))
            visit(child, at, inner)

    visit(ast.parse(text), -1, False)
    return out


_BLANK = re.compile(r"//[^\n]*|/\*.*?\*/|\"(?:\\.|[^\"\\\n])*\"|'(?:\\.|[^'\\\n])*'|`(?:\\.|[^`\\])*`", re.S)
_WORDS_BEFORE = r"(?P<pre>(?:(?:export|default|public|private|protected|internal|static|final|abstract|async|override|open|sealed|data|virtual|inline|unsafe|pub(?:\([a-z]+\))?)\s+)*)"
_DECLARED = re.compile(
    rf"^[ \t]*{_WORDS_BEFORE}(?:(?P<word>class|interface|trait|struct|enum|namespace|module|mod|record|protocol|object|type|fun|func|fn|function)\b\*?\s*(?:\([^)]*\)\s*)?(?P<name>[A-Za-z_]\w*)"
    r"|(?:const|let|var|val)\s+(?P<var>[A-Za-z_]\w*)\s*(?::[^=\n]+)?=\s*(?P<arrow>(?:async\s*)?(?:\([^)]*\)|\w+)\s*(?::[^=\n]+)?=>|function\b)?"
    r"|(?:[A-Za-z_][\w<>\[\],.*&: ]*[\s*&])??(?P<fun>[A-Za-z_]\w*)\s*\([^;{}()]*(?:\([^()]*\)[^;{}()]*)*\)\s*(?:->\s*[^{;\n]+|:\s*[^{;\n]+|const|throws\s+[\w., ]+)?\s*(?=\{))",
    re.M,
)
_KIND = {"class": "class", "record": "class", "object": "class", "interface": "interface", "protocol": "interface", "trait": "trait", "struct": "struct", "enum": "enum", "namespace": "namespace", "module": "namespace", "mod": "namespace", "type": "type"}
_NOT_NAMES = frozenset("if for while switch catch return else do try new function sizeof match foreach using lock until when elif".split())
_ENDS = re.compile(r"[;}]")
_RECEIVER = re.compile(r"\s*\(")
_CALL = re.compile(r"(?:\bnew\s+)?([A-Za-z_]\w*)\s*\(")
_BASES = re.compile(r"\b(extends|implements)\s+([\w.]+(?:\s*,\s*[\w.]+)*)")
_IMPORT_LINE = re.compile(r"^[ \t]*(?:import|use|from|require|#include|(?:const|let|var)\b[^\n=]*=\s*require)\b[^\n;]*", re.M)


def parse_braces(text: str) -> list[Raw]:
    """Declarations of brace languages; a declaration ends with the brace that closes it, or with its line."""
    plain = _BLANK.sub(lambda m: re.sub(r"[^\n]", " ", m.group()), text)
    close: dict[int, int] = {}
    stack: list[int] = []
    for m in re.finditer(r"[{}]", plain):
        if m.group() == "{":
            stack.append(m.start())
        elif stack:
            close[stack.pop()] = m.end()
    opens = sorted(close)
    found = []
    matches = list(_DECLARED.finditer(plain))
    for i, m in enumerate(matches):
        name = m["name"] or m["var"] or m["fun"]
        if not name or name in _NOT_NAMES:
            continue
        start = m.end("pre")
        line_end = plain.find("\n", m.end())
        line_end = len(plain) if line_end < 0 else line_end
        # Its body is the next brace, unless the declaration ends, or another begins, before that.
        k = bisect_left(opens, m.end() - 1)
        following = matches[i + 1].start() if i + 1 < len(matches) else len(plain)
        body = k < len(opens) and opens[k] < max(following, m.end()) and not _ENDS.search(plain, m.end(), opens[k])
        end = close[opens[k]] if body else line_end
        kind = _KIND.get(m["word"] or "", "function") if m["word"] or m["fun"] or m["arrow"] else "variable"
        receiver = m["word"] == "func" and _RECEIVER.match(plain, m.end("word")) is not None
        found.append((start, end, kind, name, bool(re.search(r"\b(export|public|pub)\b", m["pre"] or "")), receiver))
    return _nested(text, plain, found)


def _comment_before(text: str, at: int) -> str | None:
    """The block comment, or the run of line comments, that ends where the declaration at ``at`` begins, but for its modifiers."""
    line = text.rfind("\n", 0, at) + 1
    if not re.fullmatch(r"[\w \t]*", text[line:at]):
        return None
    end = line
    while end and text[end - 1].isspace():
        end -= 1
    if text.endswith("*/", 0, end):
        begin = text.rfind("/*", 0, end)
        return text[begin:end].strip() if begin >= 0 else None
    begin = end
    while begin > 0:
        line = text.rfind("\n", 0, begin - 1 if begin < end else end) + 1
        if not text[line:begin].lstrip().startswith(("//", "#")):
            break
        begin = line
    return text[begin:end].strip() or None


def _nested(text: str, plain: str, found: list[tuple[int, int, str, str, bool, bool]]) -> list[Raw]:
    """Rows in order, each with its nearest enclosing one, the comment before it and the references it owns."""
    out: list[Raw] = []
    spans: list[tuple[int, int]] = []
    open_: list[int] = []
    newlines = [m.start() for m in re.finditer("\n", text)]
    braces: list[int] = []  # of each its first one, or its end
    for start, end, kind, name, exported, receiver in found:
        while open_ and spans[open_[-1]][1] <= start:
            open_.pop()
        parent = open_[-1] if open_ else -1
        row = Raw(kind, name, bisect_left(newlines, start) + 1, bisect_left(newlines, end) + 1, text[start:end], parent, receiver or (parent >= 0 and out[parent].kind in ("class", "interface", "struct", "trait")), exported, _comment_before(text, start))
        brace = plain.find("{", start, end)
        braces.append(brace if brace >= 0 else end)
        row.refs += [("implements" if w == "implements" else "extends", b.strip().split(".")[-1]) for w, bs in _BASES.findall(plain[start : braces[-1]]) for b in bs.split(",")]
        out.append(row)
        spans.append((start, end))
        open_.append(len(out) - 1)

    heads = {s for s, _ in spans}
    for m, i in _owned(_CALL, plain, spans):
        if m[1] not in _NOT_NAMES and not (m[1] == out[i].name and braces[i] >= m.start()) and m.start() not in heads:
            out[i].refs.append(("calls", m[1]))
    for m, i in _owned(_IMPORT_LINE, plain, spans):
        out[i].refs.append(("imports", text[m.start() : m.end()].strip()))
    return out


def _owned(pattern: re.Pattern[str], plain: str, spans: list[tuple[int, int]]) -> Iterator[tuple[re.Match[str], int]]:
    """Matches within spans, which are by start, each with the span around it that begins last: one sweep over both."""
    open_: list[int] = []
    n = 0
    for m in pattern.finditer(plain):
        while n < len(spans) and spans[n][0] <= m.start():
            open_.append(n)
            n += 1
        # What has ended before this match holds no later one.
        while open_ and spans[open_[-1]][1] <= m.start():
            open_.pop()
        if open_:
            yield m, open_[-1]


_RUBY = re.compile(r"^([ \t]*)(class|module|def)\s+(?:self\.)?([A-Za-z_]\w*[?!]?)(?:\s*<\s*([\w:]+))?", re.M)


_RUBY_END = re.compile(r"^([ \t]*)end\b", re.M)
_RUBY_BLANK = re.compile(r"\"(?:\\.|[^\"\\\n])*\"|'(?:\\.|[^'\\\n])*'|#[^\n]*|^=begin\b.*?^=end\b[^\n]*", re.S | re.M)


def parse_ruby(text: str) -> list[Raw]:
    """Ruby's classes, modules and methods; each ends at the ``end`` of its own indentation."""
    found, bases = [], []
    # Strings and comments are blanked in place, so that offsets hold.
    plain = _RUBY_BLANK.sub(lambda m: re.sub(r"[^\n]", " ", m.group()), text)
    ends: dict[str, list[int]] = defaultdict(list)
    for m in _RUBY_END.finditer(plain):
        ends[m[1]].append(m.start())
    for m in _RUBY.finditer(plain):
        same = ends[m[1]]
        k = bisect_left(same, m.end())
        kind = {"class": "class", "module": "namespace", "def": "function"}[m[2]]
        found.append((m.end(1), same[k] + len(m[1]) + len("end") if k < len(same) else len(text), kind, m[3], False, False))
        bases.append(m[4])
    out = _nested(text, plain, found)
    for row, base in zip(out, bases):
        row.refs += [("extends", base.split("::")[-1])] if base else []
    return out


PARSERS: dict[str, Callable[[str], list[Raw]]] = {"python": parse_python, "ruby": parse_ruby} | dict.fromkeys(("c", "cpp", "csharp", "go", "java", "javascript", "kotlin", "php", "rust", "swift", "typescript"), parse_braces)

_ROW = "file_path string, language string, n int, kind string, name string, start_line int, end_line int, text string, parent int, ancestors array<int>, in_class boolean, exported boolean, docstring string, refs array<struct<kind:string,name:string>>, error string"


#: Rows, and characters of their texts, that are handed on together at least.
BATCH_ROWS, BATCH_CHARS = 10_000, 1 << 23


def _parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = [c.split()[0] for c in re.split(r", (?=\w+ )", _ROW)]
    types = [pa.string(), pa.string(), pa.int32(), pa.string(), pa.string(), pa.int32(), pa.int32(), pa.string(), pa.int32(), pa.list_(pa.int32()), pa.bool_(), pa.bool_(), pa.string(), pa.list_(pa.struct([("kind", pa.string()), ("name", pa.string())])), pa.string()]

    def made(rows: list[tuple]) -> pa.RecordBatch:
        columns = list(zip(*rows)) if rows else [()] * len(types)
        return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, types)], names)

    for batch in batches:
        rows, chars = [], 0
        for path, lang, text in zip(*(batch.column(i) for i in range(3))):
            path, lang, text = path.as_py(), lang.as_py(), text.as_py()
            try:
                found = PARSERS[lang](text) if lang in PARSERS and text else []
            except Exception as e:  # noqa: BLE001  a file that no parser can take is one file's error, whatever it raises
                rows.append((path, lang, -1, *[None] * 11, f"{type(e).__name__}: {e}"))
                continue
            up: list[list[int]] = []
            for i, r in enumerate(found):
                up.append([r.parent, *up[r.parent]] if r.parent >= 0 else [])
                rows.append((path, lang, i, r.kind, r.name, r.start, r.end, r.text, r.parent, up[i], r.in_class, r.exported, r.doc, [{"kind": k, "name": n} for k, n in r.refs], None))
                chars += len(r.text)
                if len(rows) >= BATCH_ROWS or chars >= BATCH_CHARS:
                    yield made(rows)
                    rows, chars = [], 0
        yield made(rows)


def parsed(files: DataFrame) -> DataFrame:
    """Declarations of (file_path, language, content), with id, ancestors' ids and errors; the input of the functions below."""
    rows = files.select("file_path", "language", "content").mapInArrow(_parse, _ROW)
    name, kind, lang = F.col("name"), F.col("kind"), F.col("language")
    kind = F.when((kind == "function") & F.col("in_class"), "method").otherwise(kind)
    kind = F.when((kind == "type") & (lang == "typescript"), "interface").when((kind == "struct") & (lang == "rust"), "class").otherwise(kind)
    # In this order: a component may become neither hook nor test.
    free = kind == "function"
    kind = F.when(free & name.rlike("^[A-Z]") & lang.isin("typescript", "javascript"), "component").when(free & name.rlike("^use[A-Z]"), "hook").when(free & name.rlike("(?i)^(describe|it|spec|test)"), "test").otherwise(kind)
    return rows.withColumn("kind", kind).withColumn("id", node_id(F.col("kind"), F.col("file_path"), name, F.col("start_line")))


def symbols(rows: DataFrame) -> DataFrame:
    """The graph's symbols of parsed declarations."""
    text = F.col("text")
    r = rows.filter("n >= 0").dropDuplicates(["id"])
    return r.select(
        "id", "kind", "name", code.qualified_name(F.col("file_path"), F.col("name")).alias("qualified_name"), "file_path", "start_line", "end_line", "language",
        code.signature(text).alias("signature"), F.substring("docstring", 1, 500).alias("docstring"), "exported", code.complexity(text).alias("complexity"),
        F.lit(None).cast("string").alias("metadata"), F.current_timestamp().alias("created_at"), F.current_timestamp().alias("updated_at"),
    )


def contains(rows: DataFrame) -> DataFrame:
    """Edges from each declaration to those directly within it."""
    inner = rows.filter("parent >= 0").select("file_path", F.col("parent").alias("n"), F.col("id").alias("target_id"))
    outer = rows.filter("n >= 0").select("file_path", "n", F.col("id").alias("source_id"))
    e = inner.join(outer, ["file_path", "n"]).select("source_id", "target_id").distinct().withColumn("kind", F.lit("contains"))
    return e.select(edge_id(F.col("source_id"), F.col("target_id"), F.col("kind")).alias("id"), "source_id", "target_id", "kind", F.lit(None).cast("string").alias("metadata"))


def refs(rows: DataFrame) -> DataFrame:
    """References of each declaration, those of the declarations within it included."""
    own = rows.filter("n >= 0").select("file_path", "n", "ancestors", F.explode("refs").alias("r"))
    wide = own.select("file_path", "r", F.explode(F.concat(F.array("n"), "ancestors")).alias("n"))
    wide = wide.join(rows.filter("n >= 0").select("file_path", "n", F.col("id").alias("from_node_id")), ["file_path", "n"])
    named = F.when(F.col("r.kind") == "imports", F.coalesce(code.import_path(F.col("r.name")), F.regexp_extract(F.col("r.name"), r"([\w./:]+)\W*$", 1))).otherwise(F.col("r.name"))
    return wide.select("from_node_id", named.alias("ref_name"), F.col("r.kind").alias("ref_kind"), "file_path").filter("ref_name <> ''").distinct()


def errors(rows: DataFrame) -> DataFrame:
    """Files that could not be parsed, with the reason."""
    return rows.filter("n < 0").select("file_path", "error")
