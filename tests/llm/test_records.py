"""Fingerprints, licences, WARC archives and packing: brute force and round trips."""

import glob
import gzip
import hashlib
import math
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from facetgraph.llm import fingerprint, licenses, packing, warc

TEXTS = ["it's we're I'll 's  's\n's don''t a'd'x", "  a \n\n b\t c  ", "日本 語１２3 é'sé  ½ ", "<|endoftext|> a", "'", "a're", "", None, "word " * 4000, "x  ", "same", "same"]


def test_fingerprints(spark, docs):
    rows = [(k * 2, t, None, None) for k, t in enumerate(TEXTS)] + [(None, "zero", None, None)]
    got = {r.doc_id: r for r in fingerprint.fingerprints(docs(rows)).collect()}
    order = sorted(rows, key=lambda r: -1 if r[0] is None else r[0])
    for k, (i, t, *_) in enumerate(order):
        t, n = t or "", order[(k + 1) % len(order)][1] or ""
        cut = len(t) // 4
        e = t[: len(t) - cut] + n[:cut]
        own, its, after = (fingerprint.digest(x.encode()) for x in (t, e, n))
        r = got[i]
        assert (r.n_chars, r.edited, r.fingerprint, r.edited_fingerprint) == (len(t), e, fingerprint.encode(own), fingerprint.encode(its))
        assert (r.near_edited, r.near_next) == (fingerprint.likeness(own, its), fingerprint.likeness(own, after))
        assert 0 <= r.near_edited <= 1 and fingerprint.likeness(own, own) == 1


@pytest.mark.parametrize("rows", [[], [(1, "abc")], [(None, None), (2, "ab"), (2, "ab"), (2, "cd")]])
def test_fingerprints_of_odd_tables(spark, docs, rows):
    got = fingerprint.fingerprints(docs([(i, t, None, None) for i, t in rows])).collect()
    assert sorted(str(r.doc_id) for r in got) == sorted(str(i) for i, _ in rows)


def test_packing_round_trip(spark, docs):
    rows = [(k, t, None, None) for k, t in enumerate(TEXTS)] + [(None, "no id", None, None)]
    got = packing.pack(docs(rows).repartition(3), size=256, windows=3).collect()
    tokenizer = Tokenizer.from_file(packing.public_tokenizers.path("byte_bpe_50k.json"))
    by = {}
    for r in got:
        by.setdefault(r.doc_id, []).append((r.start, np.frombuffer(r.ids, "<u4").tolist(), r.doc_tokens))
    for i, t, *_ in rows:
        pieces = sorted(by[i])
        ids = [x for _, p, _ in pieces for x in p]
        assert ids == [*tokenizer.encode(t or "", add_special_tokens=False).ids, 1]
        assert pieces[0][2] == len(ids)
    windows = {}
    for r in got:
        windows.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for pieces in windows.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at == 256 or at & (at - 1) == 0
    assert packing.pack(docs([])).count() == 0


def test_warc(spark, tmp_path):
    rows = [
        (1, "http://a", "x" * 200, 9), (3, None, "x" * 200, 9), (2, "u\r\nX: y", "x" * 200, 9), (2, "u", "x" * 200, 9), (None, "u", "x" * 200, 9), (5, "u", None, 9),
        (6, "u", "é\r\n\r\nWARC/1.1 \x00\x01" + "y" * 100, 9), (7, "u", "z" * 9_000_000, 9), (8, "u", "short", 9), (9, "u", "short", 9),
    ]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string, record_type int")
    path = str(tmp_path / "archives")
    warc.write(pages, path)
    got = warc.resolved(warc.read(spark, path)).collect()
    assert len(got) == len(rows)
    kinds = sorted((r.page_id or -1, r.record_type, r.refers_to, r.payload_bytes) for r in got)
    revisit = [(-1, "revisit", 1, 200), (2, "revisit", 1, 200), (2, "revisit", 1, 200), (3, "revisit", 1, 200)]
    assert [k for k in kinds if k[1] == "revisit"] == revisit
    payload = {i: (h or "").encode() for i, _, h, _ in rows}
    for r in got:
        assert r.payload_digest == hashlib.sha256(payload[r.page_id]).hexdigest()
        assert r.record_type == "revisit" or bytes(r.payload) == payload[r.page_id]
    whole = b"".join(gzip.open(f).read() for f in glob.glob(f"{path}/part-*"))
    assert whole.count(b"WARC-Record-ID") == len(rows) and whole.count(b"x" * 200) == 1
    assert warc.deduplicated(pages.limit(0)).count() == 0


def test_licences(spark):
    rows = [
        ("a/LICENSE", "Released under the MIT License."), ("a/b/one.txt", "long prose " * 50), ("a/b/c/LICENSE", "Licensed under the Apache License, Version 2.0."),
        ("a/b/c/two.txt", "prose " * 40), ("a/b/c/three.txt", "prose " * 40 + "\nThis work is licensed under the GNU General Public License, version 3.\nmore"),
        ("d/four.txt", "the driver has no licence to speak of whatever " * 3), ("five.txt", None), (None, ""), (None, "Licensed under CC BY-NC 4.0."), ("a/b/c/two.txt", "prose " * 40),
    ]
    files = spark.createDataFrame([(k, p, t, "x") for k, (p, t) in enumerate(rows)], "id bigint, path string, text string, licence string")
    got = {r.id: (r.licence, r.how, r.origin) for r in licenses.scan(spark, files).collect()}
    assert got == {
        0: ("MIT", "header", None), 1: ("MIT", "inherited", "a"), 2: ("Apache-2.0", "header", None), 3: ("Apache-2.0", "inherited", "a/b/c"),
        4: ("GPL-3.0", "header", None), 5: (None, None, None), 6: (None, None, None), 7: (None, None, None), 8: ("CC-BY-NC-4.0", "header", None), 9: ("Apache-2.0", "inherited", "a/b/c"),
    }
    assert licenses.scan(spark, files.limit(0)).count() == 0


def test_lines_over_the_threshold_need_no_trigger_word(spark):
    texts = [
        "This is free and unencumbered software released into the domain", "Some words.\nfree, unencumbered software released into the public\nmore words",
        "To the extent possible under law the author has waived all related rights to this work", "Released under MIT.", None, "",
        "This Source Code Form is subject to the terms of the Mozilla Public", *["prose of no concern " * 20 + f"\nnumber {k}" for k in range(20)],
    ]
    rows = [(k, "p", t) for k, t in enumerate(texts)]
    files = spark.createDataFrame([*rows, (None, "q", texts[0])], "id bigint, path string, text string")
    # brute force: every line against every template
    docs = [t or "" for _, _, t in [*rows, rows[0]]]
    bag = lambda t: Counter(re.findall(r"[^\W\d_]+|\d+", t.lower()))
    df = Counter(w for t in docs for w in bag(t))
    weigh = lambda t: {w: n * (math.log((len(docs) + 1) / (df[w] + 1)) + 1) for w, n in bag(t).items()}
    norm = lambda v: math.sqrt(sum(x * x for x in v.values()))
    want = {}
    for k, _, t in rows:
        for line in (t or "").split("\n"):
            v = weigh(line)
            for name, template in licenses.TEMPLATES:
                u = weigh(template)
                c = round(sum(x * u.get(w, 0) for w, x in v.items()) / ((norm(v) or 1) * norm(u)), 9)
                if c >= 0.6:
                    want[k] = min(want.get(k, (0, "")), (-c, name))
    got = {r.id: (-r.cosine, r.licence) for r in licenses.stated(spark, files.select("id", F.coalesce("text", F.lit("")).alias("text"))).collect()}
    assert {k for k in got if k is not None} == set(want) >= {0, 1, 3, 6}
    for k, (c, name) in want.items():
        assert got[k][1] == name and got[k][0] == pytest.approx(c, abs=1e-8)
