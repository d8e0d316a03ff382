from itertools import permutations

from pyspark.sql import functions as F

from facetgraph.functions import text
from facetgraph.operators import entities, relations
from facetgraph.sources import files


def one(spark, value, fn):
    return spark.createDataFrame([(value,)], "c string").select(fn(F.col("c"))).first()[0]


def test_text_functions(spark):
    assert one(spark, "org.foo.SqlMap2Dao", text.split_identifier) == "org foo sql map 2 dao"
    assert one(spark, "The SQL  query of Orders, map", text.remove_terms) == "The of orders,"
    assert one(spark, "AccountDaDaooImpl", text.simple_name) == "AccountDao"
    assert one(spark, "", text.remove_terms) == ""
    assert one(spark, "a /* x\ny */ b // c\nd", text.strip_comments) == "a  b \nd"
    assert one(spark, "Église Maison éTude Ab X Caféx", text.capitalised_words) == ["Maison", "Ab"]
    assert one(spark, "the getter of id orders", text.clean_tokens) == ["getter", "orders"]


def test_core_names(spark):
    names = ["Account", "AccountAction", "BaseDao", "Results", "restful", "RestClient", "Contest", "Test"]
    df = spark.createDataFrame([(n,) for n in names], "class string")
    kept = {r[0] for r in entities.core_entities(df).collect()}
    assert kept == {"Account", "restful", "Contest"}
    rules = spark.createDataFrame([("suffix", "Action"), ("prefix", "Base")], "kind string, token string")
    left = {r[0] for r in entities.rule_anti_join(df, rules).collect()}
    assert left == set(names) - {"AccountAction", "BaseDao"}


def test_collisions_keep_the_best_path(spark):
    paths = ["a/jdbc/X.java", "b/jpa/X.java", "c/Morphia/X.java"]
    for order in permutations(paths):
        df = spark.createDataFrame([("X", p) for p in order], "class string, filename string")
        best = entities.resolve_collisions(df, "class", "filename", entities.implementation_priority(F.col("filename")))
        assert best.collect() == [("X", "c/Morphia/X.java")]


SOURCE = """package p;
/* class Old extends Nothing */
public class Aa extends Bb implements Cc {
  private Bb first, second;
  protected static List<Map<String, Cc>> items[] = null;
  public Cc build(final Bb one, Cc[] more, int... rest) { return new Cc(new Cc()); }
  public void run() {}
}
"""


def test_relations_of_one_class(spark):
    rows = [
        ("Aa", "[Bb first]", "[Cc build(Bb one)]", "class Aa extends Bb implements Cc { Bb b; new Cc(new Cc()); }"),
        ("Bb", "[]", "[]", "class Bb extends Bb {}"),
        ("Cc", "[]", "[]", ""),
    ]
    df = spark.createDataFrame(rows, "class string, attributes string, methods string, content string")
    assert {tuple(r) for r in relations.inheritance_edges(df).collect()} == {("Aa", "Bb", 15), ("Bb", "Bb", 15)}
    assert {tuple(r) for r in relations.signature_edges(df).collect()} == {("Aa", "Bb", 5), ("Aa", "Cc", 3)}
    assert relations.instantiation_edges(df).count() == 2
    assert relations.instantiation_edges(df, closed=True).collect() == [("Aa", "Cc", 8)]
    scores = {tuple(r) for r in relations.relation_scores(df).collect()}
    assert scores == {("Aa", "Bb", 20), ("Aa", "Cc", 19), ("Bb", "Bb", 15)}


def test_source_tree(spark, tmp_path):
    (tmp_path / "src/jpa").mkdir(parents=True)
    (tmp_path / "src/jpa/Aa.java").write_text(SOURCE)
    (tmp_path / "src/Bb.java").write_bytes(b"public interface Bb { int size = 3; }\xff\n")
    (tmp_path / "src/Cc.java").write_text("class Cc {}")
    (tmp_path / "src/TestHelper.java").write_text("class TestHelper {}")
    (tmp_path / "src/notes.txt").write_text("class D {}")
    tree = files.source_files(spark, str(tmp_path))
    assert tree.count() == 4
    assert "�" not in tree.filter(F.col("path").endswith("Bb.java")).first()["content"]
    found = {r["class"]: r for r in entities.declarations(tree).collect()}
    assert found["Aa"]["attributes"] == "[Bb first; Bb second; List items]"
    assert found["Aa"]["methods"] == "[Cc build(Bb one, Cc[] more, int... rest); void run()]"
    assert found["Bb"]["attributes"] == "[]"
    full, relation = relations.find_and_score(tree)
    assert {r["class"] for r in full.collect()} == {"Aa", "Bb", "Cc"}
    # inheritance stops at the first clause, which the comment holds
    assert {tuple(r) for r in relation.collect()} == {("Aa", "Cc", 16 + 3), ("Aa", "Bb", 5)}
    by_class = files.files_by_class(spark.createDataFrame([("Aa",), ("Missing",)], "class string"), tree)
    assert [r["class"] for r in by_class.collect()] == ["Aa"]


def test_mentions_use_the_last_controller_of_a_name(spark):
    rows = [
        ("x/web/spring/Cart.java", "Item Item Cart // Order"),
        ("y/web/struts/Cart.java", "Order /* Item */ Product"),
        ("z/web/spring/Cart.java", "nothing here"),
        ("z/other/Plain.java", "Item Order"),
        ("z/LoginAction.java", "Account"),
    ]
    df = spark.createDataFrame(rows, "path string, content string")
    core = spark.createDataFrame([(c,) for c in ("Item", "Order", "Account", "Cart")], "class string")
    assert {tuple(r) for r in relations.mention_pairs(df, core).collect()} == {("Cart", "Order"), ("LoginAction", "Account")}


def test_fallback_texts(spark):
    core = spark.createDataFrame([("OrderDao",), ("Cart",)], "class string")
    stored = spark.createDataFrame([("Cart", "Cart holds the SQL items")], "class string, summary string")
    texts = {r.class_name: r.concatenated_text for r in entities.enrich_semantic(core, stored).collect()}
    assert texts == {"OrderDao": "OrderDao Order represents the business concept of order.", "Cart": "Cart Cart holds the items"}
    scenarios = spark.createDataFrame([("Cart", "Checkout")], "class string, scenario string")
    texts = {r.class_name: r.concatenated_text for r in entities.enrich_functional(core, scenarios).collect()}
    assert texts == {"OrderDao": "OrderDao participates in: General Utility", "Cart": "Cart participates in: Checkout"}


def test_lemmas(spark):
    docs = spark.createDataFrame([(1, ["orders", "of", "orders"]), (2, ["none"])], "id int, words array<string>")
    lemmas = spark.createDataFrame([("orders", "order")], "token string, lemma string")
    out = {r.id: r.words for r in entities.lemmatize(docs, lemmas, "id", "words").collect()}
    assert out == {1: ["order", "of", "order"], 2: ["none"]}
