"""Language models: probabilities against a direct computation, held-out accuracy, odd rows."""

import math
import random
from collections import Counter

import numpy as np
import pyarrow as pa

from facetgraph.llm import kneser_ney as kn
from facetgraph.llm import language_id, quality, toxicity
from facetgraph.llm.arrow import utf8

SYLLABLES = {"xx": "ba ne ti ro su la".split(), "yy": "kro wesh zin tag lup".split(), "zz": "éo ñi çau üm œr".split()}


def say(rng, lang, n):
    return " ".join("".join(rng.choice(SYLLABLES[lang]) for _ in range(rng.randint(1, 4))) for _ in range(n))


def test_probabilities_are_interpolated_kneser_ney(spark):
    texts = ["abra cadabra", "abrac abra", "banana band", "a"]
    frame = spark.createDataFrame([(0, t) for t in texts], "cls int, text string")
    order = 3
    model = kn.train(kn.gram_counts(frame, order, True), 1, order, True)
    data, starts = utf8(pa.array(texts))
    s, begins, codes = model.codes(data, starts)
    got = model.log_probabilities(codes)[:, 0]

    grams = {order: Counter()}
    seqs = []
    for t in texts:
        x = [0] * (order - 1) + [int(v) for v in s[begins[len(seqs)] : begins[len(seqs) + 1]]]
        seqs.append(x)
        grams[order].update(tuple(x[k : k + order]) for k in range(len(x) - order + 1))
    for k in range(order - 1, 0, -1):
        grams[k] = Counter(g[1:] for g in grams[k + 1])

    def p(g):
        k = len(g)
        if k == 0:
            return 2.0**-12
        c = Counter(grams[k].values())
        d = min(max(c[1] / (c[1] + 2 * c[2]) if c[1] and c[2] else 0.5, 0.1), 0.9)
        after = {h: n for h, n in grams[k].items() if h[:-1] == g[:-1]}
        total = sum(after.values())
        if not total:
            return p(g[1:])
        return max(grams[k][g] - d, 0) / total + d * len(after) / total * p(g[1:])

    want = [math.log(p(tuple(x[k : k + order]))) for x in seqs for k in range(len(x) - order + 1)]
    assert np.allclose(got, want, atol=1e-4)


def test_unseen_grams_back_off(spark):
    frame = spark.createDataFrame([(0, "abab abab"), (1, "cdcd cdcd")], "cls int, text string")
    model = kn.train(kn.gram_counts(frame, 3, True), 2, 3, True)
    data, starts = utf8(pa.array(["qqq", "ab", ""]))
    s, begins, codes = model.codes(data, starts)
    logs = model.log_probabilities(codes)
    assert np.isfinite(logs).all() and (logs < 0).all()
    sums = kn.row_sums(logs, begins)
    assert sums[1, 0] > sums[1, 1] and not sums[2].any()


def test_language_identification(spark, docs):
    rng = random.Random(5)
    rows = [(k, say(rng, lang, 40), lang, None) for k, lang in enumerate(list(SYLLABLES) * 40)]
    fitted = language_id.fit(docs(rows))
    odd = [(1, None, None, None), (2, "", None, None), (3, "12 -- 3", None, None), (4, "ba" * 40_000, None, None), (5, "qxqj vvkq jjxq wqxz " * 30, None, None)]
    probe = [(1000 + k, say(rng, lang, 25), None, lang) for k, lang in enumerate(list(SYLLABLES) * 5)]
    got = language_id.identify(docs(odd + probe), fitted).collect()
    assert len(got) == len(odd) + len(probe)
    assert all(r.lang_pred == r.source and not r.rejected and 0 <= r.score <= 1 for r in got if r.doc_id >= 1000)
    by = {r.doc_id: r for r in got}
    assert [by[k].lang_pred for k in (1, 2, 3)] == ["und"] * 3 and [by[k].score for k in (1, 2, 3)] == [0.0] * 3
    assert by[4].lang_pred == "xx" and all(by[k].rejected for k in (1, 2, 3, 5))


def test_language_without_labels(spark, docs):
    rows = [(1, "some text", None, None)]
    got = language_id.identify(docs(rows), language_id.fit(docs(rows))).collect()
    assert [(r.lang_pred, r.score, r.rejected) for r in got] == [("und", 0.0, True)]
    assert language_id.accepted(docs([])).count() == 0


def test_toxicity(spark, docs):
    rng = random.Random(6)

    def text(bad):
        words = say(rng, "xx", 40).split()
        for _ in range(4 if bad else 0):
            words[rng.randrange(40)] = "zork" + rng.choice(SYLLABLES["yy"])
        return " ".join(words)

    known = [(text(k % 4 == 0), int(k % 4 == 0), -1.0) for k in range(400)]
    fitted = toxicity.fit(spark.createDataFrame(known + [("x", None, 0.0), (None, 0, 0.0)], "text string, toxic int, score double"))
    rows = [(k, text(k % 2 == 0), None, None) for k in range(60)] + [(100, None, None, None), (101, "", None, None), (102, "99 !", None, None)]
    got = {r.doc_id: r.score for r in toxicity.judge(docs(rows), fitted).collect()}
    assert sum((got[k] >= 0.3) == (k % 2 == 0) for k in range(60)) >= 57
    assert got[100] == got[101] == got[102] < 0.3


def test_toxicity_without_labels(spark, docs):
    none = toxicity.fit(spark.createDataFrame([], "text string, toxic int"))
    assert [r.score for r in toxicity.judge(docs([(1, "x", None, None)]), none).collect()] == [0.0]


def test_quality(spark, docs):
    rng = random.Random(8)
    trusted = [(k, say(rng, lang, 40), lang, None) for k, lang in enumerate(["xx", "yy"] * 150)]
    languages, model = quality.train(docs(trusted))
    junk = [(900, "$% &&* 77 #@! " * 20, "xx", None)]
    odd = [(902, None, "xx", None), (903, " ", "yy", None), (904, say(rng, "yy", 30), None, None), (905, say(rng, "xx", 30), "qq", None)]
    base = docs(trusted)
    cuts = quality.limits(quality.perplexities(base, languages, model))
    got = {r.doc_id: r for r in quality.judged(quality.perplexities(docs(junk + odd), languages, model), cuts).collect()}
    assert not any(got[k].keep for k in (900, 902, 903)) and got[902].perplexity is None
    assert got[904].read_as == "yy" and got[905].read_as == "xx"
    assert quality.train(docs([])) == ([], None)
    assert [r.keep for r in quality.judged(quality.perplexities(docs(junk), [], None), cuts).collect()] == [False]
