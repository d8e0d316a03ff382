"""Declared types of source files by one linear pass over their tokens, with brace depth.

The pass knows strings, comments, brackets and braces, and where a member begins and ends; it is no
grammar and does not look into bodies. Files are read by Spark and scanned task by task; a file is
one row.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text

# Words of the language.
KINDS = frozenset("class interface enum record".split())
MODIFIERS = frozenset("public protected private static final abstract synchronized native transient volatile default strictfp sealed non-sealed".split())

_TOKEN = re.compile(
    r"/\*.*?(?:\*/|\Z)|//[^\n]*"  # comments
    r'|"""(?:[^\\]|\\.)*?(?:"""|\Z)|"(?:[^"\\\n]|\\.)*"?|\'(?:[^\'\\\n]|\\.)*\'?'  # literals
    r"|(?P<word>non-sealed\b|[^\W\d][\w$]*)|(?P<dots>\.\.\.)|(?P<sign>[{}()\[\]<>;,=@.])",
    re.S,
)
BATCHES = "spark.sql.execution.arrow.maxRecordsPerBatch"
RUN_CHARS = 1 << 20  # of the sources whose types a task holds at once
BATCH_ROWS = 256  # sources that Spark hands to a task at once
TYPE = "struct<package string, class string, kind string, fields array<struct<type string, dims int, name string>>, methods array<struct<ret string, dims int, name string, params array<struct<type string, dims int, varargs boolean, name string>>>>>"


def _bare(tokens: list[str]) -> list[str]:
    """Without annotations, their arguments, and type arguments."""
    out, i, angle = [], 0, 0
    while i < len(tokens):
        t = tokens[i]
        if t == "@" and i + 1 < len(tokens) and tokens[i + 1] != "interface":
            i += 2
            while i + 1 < len(tokens) and tokens[i] == ".":
                i += 2
            if i < len(tokens) and tokens[i] == "(":
                depth = 0
                while i < len(tokens):
                    depth += (tokens[i] == "(") - (tokens[i] == ")")
                    i += 1
                    if not depth:
                        break
            continue
        if t == "<":
            angle += 1
        elif t == ">" and angle:
            angle -= 1
        elif not angle:
            out.append(t)
        i += 1
    return out


def _typed(tokens: list[str]) -> tuple[str, int]:
    """Last part of a type name, and the brackets behind it."""
    names = [t for t in tokens if t not in "[].,"]
    return (names[-1] if names else ""), tokens.count("[")


def _split(tokens: list[str], at: str) -> list[list[str]]:
    """Parts between ``at`` outside of all brackets."""
    parts, depth = [[]], 0
    for t in tokens:
        depth += (t in "([{") - (t in ")]}")
        if t == at and depth == 0:
            parts.append([])
        else:
            parts[-1].append(t)
    return parts


def _member(tokens: list[str], kind: str, fields: list, methods: list) -> None:
    """One member by the tokens before its ``;`` or body."""
    tokens = [t for t in _bare(tokens) if t not in MODIFIERS]
    head = tokens[: tokens.index("=")] if "=" in tokens else tokens
    if not head or not KINDS.isdisjoint(head[:1]):
        return
    if "(" in head:
        i = head.index("(")
        if i < 2:
            return  # a constructor or an initialiser
        ret, dims = _typed(head[: i - 1])
        params = []
        end = len(head) - 1 - head[::-1].index(")") if ")" in head else len(head)
        for part in _split(head[i + 1 : end], ","):
            part = [t for t in part if t not in MODIFIERS]
            if len(part) > 1:
                varargs = "..." in part
                part = [t for t in part if t != "..."]
                name = next((k for k in range(len(part) - 1, -1, -1) if part[k] not in "[]"), 0)
                kind_, n = _typed(part[:name])
                params.append({"type": kind_, "dims": n + part[name + 1 :].count("["), "varargs": varargs, "name": part[name]})
        methods.append({"ret": ret, "dims": dims, "name": head[i - 1], "params": params})
    elif kind in ("class", "enum", "record"):
        parts = _split(tokens, ",")
        first = parts[0][: parts[0].index("=")] if "=" in parts[0] else parts[0]
        name = next((k for k in range(len(first) - 1, -1, -1) if first[k] not in "[]"), 0)
        type_, dims = _typed(first[:name])
        if type_:
            names = [first[name], *[p[0] for p in parts[1:] if p]]
            fields += [{"type": type_, "dims": dims, "name": n} for n in names]


def declared(content: str) -> list[dict]:
    """Top-level types of one file in the order of their declaration."""
    found: list[dict] = []
    package, held, depth, round_, current = "", [], 0, 0, None
    constants = False  # within the list of names an enum begins with
    for m in _TOKEN.finditer(content):
        t = m["word"] or m["dots"] or m["sign"]
        if t is None:
            continue
        if t == "{":
            if depth == 0 and round_ == 0:
                bare = _bare(held)
                at = next((k for k, w in enumerate(bare) if w in KINDS and k + 1 < len(bare) and bare[k + 1] not in "(.;="), None)
                current = None
                if at is not None:
                    kind = "annotation" if at and bare[at - 1] == "@" else bare[at]
                    current = {"package": package, "class": bare[at + 1], "kind": kind, "fields": [], "methods": []}
                    found.append(current)
                    constants = kind == "enum"
                held = []
            elif depth == 1 and round_ == 0 and current and not constants:
                if "=" not in _bare(held):  # else an initial value, which ends with its semicolon
                    _member(held, current["kind"], current["fields"], current["methods"])
                    held = []
            depth += 1
        elif t == "}":
            depth = max(0, depth - 1)
            if depth == 0:
                current, held, round_ = None, [], 0
        elif depth == 0 or (depth == 1 and current):
            round_ = max(0, round_ + (t == "(") - (t == ")"))
            if t == ";" and round_ == 0:
                if depth == 0:
                    if held[:1] == ["package"]:
                        package = "".join(held[1:])
                elif constants:
                    constants = False
                else:
                    _member(held, current["kind"], current["fields"], current["methods"])
                held = []
            else:
                held.append(t)
    return found


_FIELD = pa.struct([("type", pa.string()), ("dims", pa.int32()), ("name", pa.string())])
_PARAM = pa.struct([("type", pa.string()), ("dims", pa.int32()), ("varargs", pa.bool_()), ("name", pa.string())])
_METHOD = pa.struct([("ret", pa.string()), ("dims", pa.int32()), ("name", pa.string()), ("params", pa.list_(_PARAM))])
_TYPE = pa.struct([("package", pa.string()), ("class", pa.string()), ("kind", pa.string()), ("fields", pa.list_(_FIELD)), ("methods", pa.list_(_METHOD))])


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        begin, size, types = 0, 0, []
        for k, content in enumerate(batch.column("content"), 1):
            c = content.as_py()
            types.append(declared(c) if c else [])
            size += len(c or "")
            if size >= RUN_CHARS or k == batch.num_rows:
                yield pa.RecordBatch.from_arrays([batch.column("path").slice(begin, k - begin), pa.array(types, pa.list_(_TYPE))], ["path", "types"])
                begin, size, types = k, 0, []


def declared_types(files: DataFrame) -> DataFrame:
    """(filename, package, class, kind, fields, methods) of all top-level types of the files (path, content).

    Members need no modifier; nested types and constructors are left out, so are the constants of an
    enum; fields belong to classes, enums and records. Null and empty files give no row.
    """
    conf = files.sparkSession.conf
    if int(conf.get(BATCHES)) > BATCH_ROWS:
        conf.set(BATCHES, str(BATCH_ROWS))
    rows = files.select("path", "content").mapInArrow(_scan, f"path string, types array<{TYPE}>")
    return rows.select(F.col("path").alias("filename"), F.inline("types"))


def entities(files: DataFrame) -> DataFrame:
    """Entity rows (filename, class, attributes, methods) of the declared types, members as text."""
    types = declared_types(files)
    return types.select(
        "filename", "class",
        text.bracketed(F.transform("fields", text.attribute_text)).alias("attributes"),
        text.bracketed(F.transform("methods", text.method_signature)).alias("methods"),
    )


def lexical_documents(files: DataFrame, allowed: DataFrame | None = None) -> DataFrame:
    """(filename, class, document): package, class, attribute and method names split into words.

    ``allowed`` (class) keeps the types that are declared under one of its names.
    """
    types = declared_types(files)
    if allowed is not None:
        types = types.join(allowed.select("class").distinct(), "class", "left_semi")
    names = text.lexical_document(F.col("package"), F.col("class"), F.transform("fields", lambda f: f["name"]), F.transform("methods", lambda m: m["name"]))
    return types.select("filename", "class", names.alias("document"))
