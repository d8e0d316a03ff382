"""Column expressions over names, paths and texts; all of them stay on the JVM side.

``(?U)`` makes ``\\w``, ``\\s`` and ``\\b`` follow Unicode, ``(?d)`` lets ``.`` stop at ``\\n`` only.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import fixed

CAPITALISED_WORD = r"(?U)\b([A-Z][a-zA-Z0-9_]+)\b"
# possessive, so that a long name list is matched in a loop and not on the regex stack
PARENT_CLAUSE = r"(?U)\b(?:extends|implements)\s+(\w++(?:,\s*+\w++)*+)"
NEW_EXPRESSION = r"(?U)\bnew\s+(\w+)\s*\("


def squeeze(c: Column) -> Column:
    """One blank between words, none at the ends."""
    return F.trim(F.regexp_replace(c, r"(?U)\s+", " "))


def capitalised_words(c: Column) -> Column:
    """Words that look like type names, in order, with repeats."""
    return F.regexp_extract_all(c, F.lit(CAPITALISED_WORD), F.lit(1))


def parent_names(c: Column) -> Column:
    """Names listed by the first ``extends`` or ``implements`` clause of the whole text."""
    return F.split(F.regexp_extract(c, PARENT_CLAUSE, 1), r"(?U)[,\s]+")


def constructed_names(c: Column) -> Column:
    """``T`` of every ``new T(``, in order, with repeats."""
    return F.regexp_extract_all(c, F.lit(NEW_EXPRESSION), F.lit(1))


def strip_comments(c: Column) -> Column:
    """Without block comments, then without line comments (inside string literals too)."""
    return F.regexp_replace(F.regexp_replace(c, r"/\*[\s\S]*?\*/", ""), r"(?d)//.*", "")


def split_identifier(c: Column) -> Column:
    """``org.foo.SqlMap2Dao`` -> ``org foo sql map 2 dao``."""
    spaced = F.regexp_replace(c, r"([A-Z]|[0-9]+)", " $1")
    return F.lower(squeeze(F.translate(spaced, "_.", "  ")))


def lexical_document(package: Column, name: Column, attributes: Column, methods: Column) -> Column:
    """All names of a class, split into words; ``attributes`` and ``methods`` are arrays."""

    def present(c: Column) -> Column:
        return F.when(c != "", split_identifier(c))

    return F.trim(
        F.concat_ws(
            " ",
            present(package),
            present(name),
            F.transform(attributes, split_identifier),
            F.transform(methods, split_identifier),
        )
    )


def tokens(c: Column) -> Column:
    words = F.split(squeeze(c), " ")
    return F.filter(words, lambda t: t != "")


def default_stop_words() -> list[str]:
    return sorted(set(fixed.ENGLISH_STOP_WORDS) | set(fixed.CODE_STOP_WORDS))


def clean_tokens(c: Column, stop_words: Sequence[str] | None = None) -> Column:
    """Tokens longer than two characters that are no stop words, as an array."""
    stop = list(stop_words) if stop_words is not None else default_stop_words()
    return F.filter(tokens(c), lambda t: (F.length(t) > 2) & ~t.isin(*stop))


def remove_terms(c: Column, terms: Sequence[str] = tuple(fixed.TECHNICAL_TERMS)) -> Column:
    """Lower-cased text without the technical terms, squeezed, first letter upper."""
    pattern = r"(?U)\b(?:" + "|".join(terms) + r")\b"
    bare = squeeze(F.regexp_replace(F.lower(c), pattern, ""))
    return F.coalesce(F.concat(F.upper(F.left(bare, F.lit(1))), F.substr(bare, F.lit(2))), F.lit(""))


def simple_name(c: Column, parts: Sequence[str] = ("Dao", "Impl")) -> Column:
    """Delete each part anywhere, one after the other (a deletion may create a later match)."""
    for part in parts:
        c = F.replace(c, F.lit(part), F.lit(""))
    return c


def summary_or_fallback(summary: Column, name: Column) -> Column:
    short = simple_name(name)
    return F.coalesce(F.when(summary != "", summary), F.format_string(fixed.SUMMARY_FALLBACK, short, short))


def scenario_or_fallback(scenario: Column) -> Column:
    return F.coalesce(F.when(scenario != "", scenario), F.lit(fixed.SCENARIO_FALLBACK))


def semantic_text(name: Column, summary: Column) -> Column:
    return F.format_string("%s %s", name, summary)


def functional_text(name: Column, scenario: Column, frame: str = fixed.FUNCTIONAL_FRAME) -> Column:
    return F.format_string(frame, name, scenario)


def normal_path(c: Column) -> Column:
    return F.lower(F.translate(c, "\\", "/"))


def file_basename(c: Column, ending: str = ".java") -> Column:
    """``a/b/Foo.java`` -> ``Foo``; empty where the path has another ending."""
    return F.regexp_extract(c, r"([^/\\]+)" + ending.replace(".", r"\.") + "$", 1)


def is_controller(path: Column) -> Column:
    p = F.translate(path, "\\", "/")
    hit = F.lit(False)
    for package in fixed.CONTROLLER_PACKAGES:
        hit = hit | p.contains(package)
    for ending in fixed.CONTROLLER_ENDINGS:
        hit = hit | p.endswith(ending)
    return hit


def truncate(c: Column, n: int) -> Column:
    """First ``n`` characters (7000 and 8000 are the limits of the enrichment service)."""
    return F.left(c, F.lit(n))


def is_core_name(
    name: Column,
    suffixes: Sequence[str] = tuple(fixed.CORE_SUFFIXES),
    prefixes: Sequence[str] = tuple(fixed.CORE_PREFIXES),
) -> Column:
    """Neither a filtered ending nor a filtered beginning, case-sensitive."""
    rule = "^(?:" + "|".join(prefixes) + ")|(?:" + "|".join(suffixes) + r")\z"
    return ~name.rlike(rule)


def typed_name(type_name: Column, dims: Column, varargs: Column | None = None) -> Column:
    """``T`` + ``[]`` per dimension (+ ``...``)."""
    out = F.concat(type_name, F.repeat(F.lit("[]"), dims))
    return out if varargs is None else F.concat(out, F.when(varargs, F.lit("...")).otherwise(F.lit("")))


def method_signature(method: Column) -> Column:
    """``ret name(type p, ...)`` from struct(ret, dims, name, params[type, dims, varargs, name])."""
    ret = F.coalesce(F.when(method["ret"] != "", method["ret"]), F.lit("void"))
    params = F.transform(
        method["params"],
        lambda p: F.concat(typed_name(p["type"], p["dims"], p["varargs"]), F.lit(" "), p["name"]),
    )
    return F.concat(typed_name(ret, method["dims"]), F.lit(" "), method["name"], F.lit("("), F.array_join(params, ", "), F.lit(")"))


def attribute_text(attribute: Column) -> Column:
    """``type name`` from struct(type, dims, name)."""
    return F.concat(typed_name(attribute["type"], attribute["dims"]), F.lit(" "), attribute["name"])


def bracketed(items: Column) -> Column:
    """``[a; b]``."""
    return F.concat(F.lit("["), F.array_join(items, "; "), F.lit("]"))
