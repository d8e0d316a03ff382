"""The whole pipeline against its five stages run one after the other, with a planted case for each of them."""

import random

import corpus_pipeline
from tokenizers import Tokenizer

from facetgraph.llm import packing

from .test_models import say

ITEM = "A farmer named Walter sold 250 kg of wheat to Martha for 900 dollars and then gave Walter another 250 kg for free."


def _rows():
    rng = random.Random(9)
    rows = [(k, say(rng, ("xx", "yy")[k % 2], 120), ("xx", "yy")[k % 2]) for k in range(60)]
    shared = say(rng, "xx", 40)
    rows += [(100, say(rng, "xx", 60) + " " + shared + " " + say(rng, "xx", 20), "xx"), (101, say(rng, "xx", 30) + " " + shared, "xx")]
    rows += [(200, rows[4][1], "xx"), (201, rows[4][1] + " bane", "xx")]  # copies of document 4
    rows += [(300, say(rng, "xx", 50) + " " + ITEM, "xx"), (301, "12 34 ### 56", None), (302, None, "xx"), (303, "", "yy")]
    return rows, shared


def test_pipeline_is_its_stages(spark, tmp_path):
    rows, shared = _rows()
    data = [(i, t, g, f"s{i % 3}", None if t is None else len(t)) for i, t, g in rows]
    spark.createDataFrame(data, "doc_id bigint, text string, lang string, source string, n_chars bigint").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, ITEM)], "item_id bigint, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    got = corpus_pipeline.run(spark, str(tmp_path))

    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    columns, left = docs.columns, []
    for n, (name, stage) in enumerate(corpus_pipeline.STAGES[:-1]):
        path = str(tmp_path / name)
        out = stage(spark, docs, str(tmp_path))
        assert out.columns == columns
        out.write.parquet(path)
        docs = spark.read.parquet(path)
        left.append({r.doc_id: r.text for r in docs.collect()})
    want = corpus_pipeline.STAGES[-1][1](spark, docs, str(tmp_path))
    key = ("doc_id", "start", "length")
    assert sorted(tuple(r[c] for c in key) for r in got.select(*key).collect()) == sorted(tuple(r[c] for c in key) for r in want.select(*key).collect())

    known, unique, trimmed, clean = left
    assert {301, 302, 303}.isdisjoint(known) and set(range(60)) <= set(known)
    assert len({4, 200, 201} & set(unique)) == 1 and len(unique) == len(known) - 2
    assert set(trimmed) == set(unique) and shared in trimmed[100] and shared not in trimmed[101]
    assert set(trimmed) - set(clean) == {300}
    tokenizer = Tokenizer.from_file(packing.public_tokenizers.path("byte_bpe_50k.json"))
    tokens = {i: len(tokenizer.encode(t, add_special_tokens=False).ids) + 1 for i, t in clean.items()}
    packed = {i: 0 for i in clean}
    for r in got.collect():
        packed[r.doc_id] += r.length
    assert packed == tokens
