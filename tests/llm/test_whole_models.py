"""Language models of any size: unseen grams back off, every trusted text is judged by models that left it out."""

import math
import random
from collections import Counter
from pathlib import Path
from urllib.parse import urlparse

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from facetgraph.llm import kneser_ney as kn
from facetgraph.llm import quality, queries
from facetgraph.llm.arrow import ODD, mix
from facetgraph.session import ensure_checkpoint_dir

from .test_models import say


def test_unseen_grams_are_never_taken_for_others(spark):
    rng = random.Random(1)
    frame = spark.createDataFrame([(0, say(rng, lang, 200)) for lang in ("xx", "yy")], "cls int, text string")
    counts = kn.gram_counts(frame, 5, True).cache()
    model = kn.train(counts, 1, 5, True)
    seen = np.array([r.code for r in counts.select("code").distinct().collect()], np.int64)
    symbols = np.unique(seen & 4095)
    new = np.setdiff1d(np.arange(1, 4096), symbols)
    codes = np.zeros(1_000_000, np.int64)
    for _ in range(5):
        codes = (codes << 12) | np.random.default_rng(2).choice(new, len(codes))
    codes |= np.random.default_rng(3).choice(new, len(codes)) << 24
    slot = lambda c: mix(c.view(np.uint64) * ODD + np.uint64(1)) >> np.uint64(42)
    alike = codes[np.isin(slot(codes), slot(seen))]  # same 22 bits as a gram of the model
    assert len(alike) > 3
    logs = model.log_probabilities(alike)
    assert np.allclose(logs, model.log_probabilities(codes[:1]))


def _direct(texts, text, order=5, width=12):
    """Perplexity of one text under modified Kneser-Ney counts of others."""
    grams = {order: Counter()}
    pad = lambda t: " " * (order - 1) + t  # a text is preceded by boundaries
    for t in texts:
        grams[order].update(tuple(pad(t)[k : k + order]) for k in range(len(t)))
    for k in range(order - 1, 0, -1):
        grams[k] = Counter(g[1:] for g in grams[k + 1])
    after = {k: {} for k in grams}
    for k, table in grams.items():
        for g, n in table.items():
            after[k].setdefault(g[:-1], []).append(n)
    cuts = {}
    for k, table in grams.items():
        c = Counter(table.values())
        y = c[1] / (c[1] + 2 * c[2]) if c[1] and c[2] else 0.5
        each = [1 - 2 * y * c[2] / c[1], 2 - 3 * y * c[3] / c[2], 3 - 4 * y * c[4] / c[3]] if c[1] and c[2] and c[3] else [y] * 3
        cuts[k] = [0.0] + [min(max(d, 0.1), r - 0.1) for r, d in enumerate(each, 1)]

    def p(g):
        k = len(g)
        if k == 0:
            return 0.5**width
        rows = after[k].get(g[:-1])
        if not rows:
            return p(g[1:])
        off = lambda n: cuts[k][min(n, 3)]
        n = grams[k][g]
        return (n - off(n)) / sum(rows) + sum(map(off, rows)) / sum(rows) * p(g[1:])

    return math.exp(-sum(math.log(p(tuple(pad(text)[k : k + order]))) for k in range(len(text))) / len(text))


def test_every_trusted_text_is_left_out_of_its_own_model(spark, docs, monkeypatch):
    monkeypatch.setattr(quality, "BLOCK_BYTES", 300)
    rng = random.Random(4)
    texts = [say(rng, "yy", 12) for _ in range(24)]
    share = [r[0] for r in spark.createDataFrame([(t,) for t in texts], "text string").select(F.pmod(F.xxhash64("text"), F.lit(8))).collect()]
    rare = [k for k in range(24) if share[k] != 0][:5]  # none of them in the first share
    assert len({share[k] for k in rare}) > 1
    rows = [(k, texts[k], "yy", None) for k in rare] + [(100 + k, say(rng, "xx", 12), "xx", None) for k in range(20)]
    rows += [(200, "solo text", "qq", None), (201, "solo text", "qq", None)]  # copies only: no model leaves them out
    languages, model = quality.train(docs(rows))
    assert languages == ["xx", "yy"]
    probe = [(300, texts[rare[0]], None, None), (301, "", "yy", None), (302, "Q#%", "yy", None)]
    scored = quality.perplexities(docs(rows + probe), languages, model).cache()
    got = {r.doc_id: r for r in scored.collect()}
    assert len(got) == len(rows) + len(probe)
    for k in rare:
        want = _direct([texts[x] for x in rare if share[x] != share[k]], texts[k])
        assert abs(got[k].perplexity / want - 1) < 1e-3
    assert got[300].read_as == "yy" and math.isclose(got[300].perplexity, got[rare[0]].perplexity, rel_tol=1e-6)
    assert got[200].read_as in languages
    cuts = quality.limits(scored.filter(F.col("doc_id") < 200))
    kept = {r.doc_id: r.keep for r in quality.judged(scored, cuts).collect()}
    assert sum(kept[k] for k in rare) >= 4 and not kept[301]


def test_quality_keeps_only_its_results_on_disk(spark, tmp_path):
    rng = random.Random(5)
    rows = [(k, say(rng, lang, 30), lang) for k, lang in enumerate(["xx", "yy"] * 20)] + [(100, None, "xx"), (101, "", "yy"), (102, "new one", None)]
    spark.createDataFrame(rows, "doc_id bigint, text string, lang string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(k, 1) for k in range(30)], "doc_id bigint, quality int").write.parquet(f"{tmp_path}/labels.parquet")
    root = Path(urlparse(ensure_checkpoint_dir(spark)).path)
    before, tables = set(root.iterdir()), len(spark.catalog.listTables())
    out = queries.op5_quality(spark, str(tmp_path))
    left = sorted(p.name.split("-")[0] for p in set(root.iterdir()) - before)
    assert left == ["limits", "perplexities"] and len(spark.catalog.listTables()) == tables
    got = {r.doc_id: r for r in out.collect()}
    assert len(got) == len(rows) and sum(got[k].keep for k in range(30)) > 20
    assert got[100].perplexity is None and got[101].perplexity is None and got[102].read_as in ("xx", "yy")


def test_a_block_has_one_language_and_may_have_no_gram(spark, docs):
    rng = random.Random(6)
    rows = [(k, say(rng, lang, 30), lang, None) for k, lang in enumerate(["xx", "yy"] * 20)]
    languages, model = quality.train(docs(rows))
    blocks = quality._blocks(docs(rows).withColumn("own", quality._number(languages)))
    owns = [(r.text_block, {o for _, b in quality._unpacked(pa.array([bytes(r.packed)])) for o in b.column("own").to_pylist()}) for r in blocks.collect()]
    assert {b: o for b, o in owns} == {0: {0}, 1: {1}} and all(len(o) == 1 for _, o in owns)
    assert [r.perplexity for r in quality.perplexities(docs([(1, "", "xx", None), (2, None, "xx", None)]), languages, model).collect()] == [None, None]
    assert quality.perplexities(docs([]), languages, model).count() == 0
