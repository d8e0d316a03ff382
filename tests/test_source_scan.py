"""Declarations by brace depth, lexical documents, counts while writing, files and tables there and back."""

import pytest
from pyspark.sql import functions as F

from facetgraph.operators import entities, source_scan
from facetgraph.sources import files, sinks, tables

SOURCE = """
package org.shop.cart; // package no.such;
/* class Hidden { int a; } */
import java.util.*;
@Entity(name = "x{") @Table({"a", "b"})
public abstract class Cart<T extends Comparable<T>> extends Base implements Runnable {
  private static final Map<String, List<Item>> items = new HashMap<>() {{ put("}", null); }};
  int a, b[] = {1, 2}, c = f(1, 2);
  String text = "class Not { int x; }", other = "a;b";
  char brace = '{';
  Runnable task = () -> { int inner = 3; };
  static { int y = 1; }
  Cart(int size) { this.a = size; }
  @Override public void run() { class Local { int z; } if (a < b[0]) { go(); } }
  abstract <R> List<R> find(final @NonNull Map<String, T> by, int[] at, String... rest) throws IOException;
  Item[] all() { return null; }
  java.util.Date when;
  enum Inner { X, Y; int hidden; }
  interface Nested { void no(); }
}
interface Plain { int SIZE = 3; void one(Cart cart); default int two() { return 2; } }
enum Kind { SMALL(1) { int x() { return 1; } }, BIG(2); private final int n; Kind(int n) { this.n = n; } int n() { return n; } }
record Point(int x, int y) { static int count; int sum() { return x + y; } }
@interface Marker { String value() default "x"; }
class Open { int last; void unclosed() { if (true) {
"""


def test_types_of_one_file():
    found = {t["class"]: t for t in source_scan.declared(SOURCE)}
    assert list(found) == ["Cart", "Plain", "Kind", "Point", "Marker", "Open"]
    assert {t["package"] for t in found.values()} == {"org.shop.cart"}
    assert [t["kind"] for t in found.values()] == ["class", "interface", "enum", "record", "annotation", "class"]
    cart = found["Cart"]
    assert [(f["type"], f["dims"], f["name"]) for f in cart["fields"]] == [
        ("Map", 0, "items"), ("int", 0, "a"), ("int", 0, "b"), ("int", 0, "c"), ("String", 0, "text"), ("String", 0, "other"),
        ("char", 0, "brace"), ("Runnable", 0, "task"), ("Date", 0, "when"),
    ]
    assert [(m["ret"], m["dims"], m["name"], len(m["params"])) for m in cart["methods"]] == [("void", 0, "run", 0), ("List", 0, "find", 3), ("Item", 1, "all", 0)]
    assert [(p["type"], p["dims"], p["varargs"], p["name"]) for p in cart["methods"][1]["params"]] == [("Map", 0, False, "by"), ("int", 1, False, "at"), ("String", 0, True, "rest")]
    assert not found["Plain"]["fields"] and [m["name"] for m in found["Plain"]["methods"]] == ["one", "two"]
    assert [f["name"] for f in found["Kind"]["fields"]] == ["n"] and [m["name"] for m in found["Kind"]["methods"]] == ["n"]
    assert [f["name"] for f in found["Point"]["fields"]] == ["count"] and [m["name"] for m in found["Point"]["methods"]] == ["sum"]
    assert [f["name"] for f in found["Open"]["fields"]] == ["last"]


@pytest.mark.parametrize("text", ["", "{", "}", "class", "class {", "class A", "class A {", "}}} class B { int x; }", '"', "/*", "class C { ; ; = ; ( }", "int x;", "@", "class D { @ }", "package ;"])
def test_odd_sources_do_no_harm(text):
    source_scan.declared(text)


def test_entities_and_lexical_documents(spark):
    rows = [("a/Cart.java", SOURCE), ("a/Empty.java", ""), ("a/Null.java", None), ("a/None.java", "int x;")]
    tree = spark.createDataFrame(rows, "path string, content string")
    got = {r["class"]: r for r in source_scan.entities(tree).collect()}
    assert got["Plain"]["methods"] == "[void one(Cart cart); int two()]" and got["Cart"]["methods"].endswith("Item[] all()]")
    allowed = spark.createDataFrame([("Point",), ("Absent",)], "class string")
    assert source_scan.lexical_documents(tree, allowed).collect() == [("a/Cart.java", "Point", "org shop cart point count sum")]
    assert source_scan.lexical_documents(tree).count() == 6


def test_counts_while_writing(spark, tmp_path):
    names = ["Account", "Account", "AccountAction", "BaseDao", "Cart", "Account"]
    df = spark.createDataFrame([(n,) for n in names], "class string")
    assert entities.write_core(df, str(tmp_path / "core")) == {"rows": 6, "filtered": 2, "core_names": 2, "collisions": 2}
    assert sorted(r[0] for r in spark.read.parquet(str(tmp_path / "core")).collect()) == ["Account", "Cart"]
    assert entities.write_core(df.limit(0), str(tmp_path / "none")) == {"rows": 0, "filtered": 0, "core_names": 0, "collisions": 0}


def test_strict_decoding_and_missing_files(spark, tmp_path):
    (tmp_path / "A.java").write_bytes(b"ok \xff")
    assert files.source_files(spark, str(tmp_path)).first()["content"] == "ok "
    with pytest.raises(Exception):
        files.source_files(spark, str(tmp_path), policy="strict").collect()
    with pytest.raises(ValueError):
        files.decode(F.lit(b"x"), "other")
    rows = spark.createDataFrame([("p", "A"), ("q", "B")], "filename string, class string")
    texts = spark.createDataFrame([("p", "text")], "path string, content string")
    assert sorted(files.attach_content(rows, texts).collect()) == [("p", "A", "text"), ("q", "B", "")]
    assert files.attach_content(rows, texts, "drop").collect() == [("p", "A", "text")]


def test_bad_map_literals(spark):
    df = spark.createDataFrame([("a", "{'T': 15}"), ("b", "{broken")], "class string, relations string")
    assert tables.relation_rows(df).collect() == [("a", "T", 15)]
    with pytest.raises(Exception):
        tables.relation_rows(df, bad="raise").collect()


def test_one_summary_per_class(spark):
    core = spark.createDataFrame([("Cart",)], "class string")
    stored = spark.createDataFrame([("Cart", "zz first", 1), ("Cart", "aa last", 2)], "class string, summary string, n int")
    assert [r.concatenated_text for r in entities.enrich_semantic(core, stored, order="n").collect()] == ["Cart Aa last"]
    assert [r.concatenated_text for r in entities.enrich_semantic(core, stored).collect()] == ["Cart Zz first"]


def test_texts_there_and_back(spark, tmp_path):
    rows = [(1, 'a "quoted", b\nnew line'), (2, "back\\slash"), (3, "é;'")]
    sinks.write_csv(spark.createDataFrame(rows, "id int, t string"), str(tmp_path / "t"), ["id"])
    assert sorted(map(tuple, tables.csv_table(spark, str(tmp_path / "t"), "id int, t string").collect())) == rows


def test_types_leave_a_task_in_bounded_batches():
    import pyarrow as pa

    body = "class A { int f; void m(int p) {} }\n" + "// " + "x" * 400_000
    batch = pa.RecordBatch.from_pydict({"path": [f"p{k}" for k in range(10)], "content": [body] * 9 + [None]})
    out = list(source_scan._scan(iter([batch])))
    assert [r for b in out for r in b.column("path").to_pylist()] == [f"p{k}" for k in range(10)]
    assert max(b.num_rows for b in out) <= 4 and sum(len(t) for b in out for t in b.column("types").to_pylist()) == 9
