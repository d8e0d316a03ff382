"""Vector codes, page texts and phrases against brute force on small tables, odd rows included."""

import hashlib
import html
import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from facetgraph.llm import collocations, html_text, queries, vector_codes

SMOKE = "/root/testdata/sf0.001"


# --- vector codes -------------------------------------------------------------------------------------


def brute_codes(rows, parts=8, entries=16, rounds=6):
    """rows (id, vector, label) in table order -> {position in rows: (code, error)}, codebooks."""
    fine = [n for n, (_, v, _) in enumerate(rows) if v and all(x is not None and math.isfinite(x) for x in v)]
    if not fine:
        return {}, []
    order = sorted(fine, key=lambda n: (rows[n][0] is None, rows[n][0] or 0, rows[n][1]))
    size = len(rows[order[0]][1])
    cut = {n: [[math.floor(4096 * x) for x in rows[n][1][p * size // parts : (p + 1) * size // parts]] for p in range(parts)] for n in fine if len(rows[n][1]) == size}
    books = [[cut[n][p] for n in order[:entries]] for p in range(parts)]

    def nearest(x, book):
        far = [sum((a - b) ** 2 for a, b in zip(x, c)) for c in book]
        return far.index(min(far)), min(far)

    for _ in range(rounds):
        for p in range(parts):
            held = defaultdict(list)
            for x in cut.values():
                held[nearest(x[p], books[p])[0]].append(x[p])
            books[p] = [[sum(c) // len(held[e]) for c in zip(*held[e])] if held[e] else old for e, old in enumerate(books[p])]
    out = {}
    for n, x in cut.items():
        hits = [nearest(x[p], books[p]) for p in range(parts)]
        out[n] = "".join(f"{e:02x}" for e, _ in hits), sum(d for _, d in hits)
    return out, books


def vectors(seed, n, size=16):
    rng = random.Random(seed)
    rows = [(i, [rng.uniform(-2, 2) for _ in range(size)], rng.choice([0, 1, None])) for i in range(n)]
    hot = rows[5][1]
    rows += [(1000 + i, list(hot), 0) for i in range(n // 2)]  # a third of all rows is one vector
    rows += [(7, list(rows[7][1]), 1), (7, list(rows[8][1]), 1), (None, list(rows[9][1]), None)]
    rows += [(2000, None, 0), (2001, [], 0), (2002, [1.0, None] * (size // 2), 0), (2003, [float("nan")] * size, 0), (2004, [float("inf")] + [0.0] * (size - 1), 0), (2005, [1.0] * (size + 8), 0)]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("seed,n", [(1, 120), (2, 10)])
def test_codes_equal_brute_force(spark, tmp_path, seed, n):
    rows = vectors(seed, n)
    schema = "vec_id bigint, embedding array<double>, label int, row string, code int, error int, of_label int, x int"
    df = spark.createDataFrame([(*r, "r", 1, 2, 3, 4) for r in rows], schema).repartition(3)
    df.write.parquet(str(tmp_path / "embeddings.parquet"))
    got = queries.op11_vector_codes(spark, str(tmp_path)).collect()
    want, books = brute_codes(rows)
    by_label = Counter()
    for k, (_, error) in want.items():
        by_label[rows[k][2]] += error
    digest = hashlib.sha256(",".join(str(x) for book in books for entry in book for x in entry).encode()).hexdigest()
    assert Counter(map(tuple, got)) == Counter((rows[k][0], code, error, by_label[rows[k][2]], digest) for k, (code, error) in want.items())


def test_large_components_stay_exact_and_too_large_ones_are_refused(spark):
    rng = random.Random(3)
    rows = [(i, [rng.uniform(-30000, 30000) for _ in range(8)], 0) for i in range(40)]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>, label int")
    books = vector_codes.codebooks(df)
    want, brute = brute_codes(rows)
    assert books.tolist() == brute
    assert {r["row"]["vec_id"]: (r["code"], r["error"]) for r in vector_codes.encode(df, books).collect()} == {rows[k][0]: v for k, v in want.items()}
    with pytest.raises(Exception, match="too large"):
        vector_codes.integers(pa.array([[1e6] * 8]), 8)
    with pytest.raises(ValueError, match="equal parts"):
        vector_codes.codebooks(spark.createDataFrame([(1, [1.0] * 9)], "vec_id bigint, embedding array<double>"))


def test_codes_of_nothing(spark, tmp_path):
    empty = spark.createDataFrame([(1, None, 2)], "vec_id bigint, embedding array<float>, label int")
    assert vector_codes.codebooks(empty) is None
    empty.write.parquet(str(tmp_path / "embeddings.parquet"))
    assert queries.op11_vector_codes(spark, str(tmp_path)).collect() == []


# --- page texts -----------------------------------------------------------------------------------------

PAGES = [
    ("<body><div class='wrap with-sidebar'><div id=content><h1>T</h1><div class=post><p>One two, three four five six seven eight.<p>More, text, here it goes on for a while.</div></div><div class='sidebar'><p>Buy, this, now, please, do, it</div>",
     "T One two, three four five six seven eight. More, text, here it goes on for a while."),
    ("<div><p>Hi <b>there</b>, a&amp;b &lt;x&gt; caf&eacute;&nbsp;\n x</p><div id=comments><p>I, think, that, this, is, bad, and, more and more and so on for a long while</div></div>", "Hi there, a&b <x> café x"),
    ("<main><header><h1>Title</h1><p>by X</p></header><p>Body text.</p><form><p>Join</p><input></form><aside>x</aside></main><footer>f</footer>", "Title Body text."),
    ("<p>a<!-- x > --> b<script>if(a<b){\"</p>\"}</script> c<style>p{}</style>", "a b c"),
    ("<nav><ul><li><a href=x>a</a></ul></nav>", ""),
    ("just text &amp", "just text &"),
    ("<article><p title=\"a>b\">one<br>two</p><ul><li>first point<li>second point</ul><div class='cookie-notice'>We use cookies</div><table><tr><td>x<td>y</table></article>", "one two first point second point x y"),
    ("<article class=comment><p>nice, post, thanks, for, it all</p></article><article><p>The text itself, with a comma.</p></article>", "The text itself, with a comma."),
    ("<div><p>A first paragraph, of some length, to be kept here.</p></div><div><ul><li><a href=1>one link</a><li><a href=2>two links</a><li><a href=3>three links</a></ul></div>", "A first paragraph, of some length, to be kept here."),
    ("<p hidden>no</p><p style='display: none'>no</p><p>yes</p>", "yes"),
    ("<div " * 2000, ""),
    ("<div>" * 3000 + "deep, text" + "</div>" * 3000, "deep, text"),
    ("<b>" * 3000 + "x</i>" * 3000, "x" * 3000),
    (None, ""),
    ("", ""),
]


def test_main_text_of_made_up_pages(spark):
    df = spark.createDataFrame([(n, source, "t", "r", 1) for n, (source, _) in enumerate(PAGES)] * 2, "page_id int, html string, text string, row string, n_chars int")
    got = html_text.extract(df).collect()
    assert sorted((r["row"]["page_id"], r["text"]) for r in got) == sorted([(n, t) for n, (_, t) in enumerate(PAGES)] * 2)
    assert html_text.extract(df.limit(0)).collect() == []


def test_main_text_of_the_tables_is_their_article(spark):
    for r in html_text.extract(spark.read.parquet(f"{SMOKE}/pages.parquet")).collect():
        article = re.search("<article>(.*)</article>", r["row"]["html"], re.S)[1]
        assert r["text"] == " ".join(html.unescape(re.sub("<[^>]*>", " ", article)).split())


def test_a_long_page_takes_linear_time():
    short, long = ("<p>word, word</p>" * n for n in (1000, 20000))
    assert html_text.main_text(short) == " ".join(["word, word"] * 1000)
    assert html_text.main_text(long).count("word") == 40000


# --- phrases ----------------------------------------------------------------------------------------------


def brute_phrases(rows, longest, least, covered, top):
    f, n = defaultdict(Counter), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split("[.,;:!?\x0a-\x0d]", text):
            words = re.findall("[^\x20\x09]+", piece)
            n[lang] += len(words)
            for k in range(1, longest + 1):
                f[lang].update(tuple(words[i : i + k]) for i in range(len(words) - k + 1))
    out = []
    for lang, counts in f.items():
        candidates = [p for p, a in counts.items() if len(p) > 1 and a >= least]
        rows = []
        for p in candidates:
            a = counts[p]
            if any(100 * counts[q] >= covered * a and any(q[i : i + len(p)] == p for i in range(len(q) - len(p) + 1)) for q in candidates if len(q) > len(p)):
                continue
            cuts = [(2000000 * a // (counts[p[:k]] + counts[p[k:]]), k, counts[p[:k]], counts[p[k:]]) for k in range(1, len(p))]
            score, _, l, r = min(cuts)
            rows.append((-score, -a, " ".join(p).encode(), l, r))
        for rank, (score, a, phrase, l, r) in enumerate(sorted(rows)[:top], 1):
            out.append((lang, rank, phrase.decode(), -a, l, r, n[lang], -score))
    return sorted(out)


def phrase_rows(seed):
    rng = random.Random(seed)
    words = [f"w{x}" for x in range(12)] + ["É", "ÀB", "New", "york", "𝒳", "x y"]

    def text(n):
        return "".join(rng.choice(words) + rng.choice([" ", " ", " ", "\t", "  ", ". ", ",", "\n"]) for _ in range(n))

    rows = [(rng.choice(["en", "en", "de", None, ""]), text(rng.randint(0, 60))) for _ in range(120)]
    rows += [("en", "new york city hall is far") for _ in range(80)]  # copies, and words that stand together always
    rows += [("en", None), (None, None), ("en", ""), ("fr", " .,; "), ("en", text(20000)), ("und", "New York new york"), ("en", "longword" * 2000)]
    return rows


@pytest.mark.parametrize("seed,top", [(1, 2000), (2, 7)])
def test_phrases_equal_brute_force(spark, seed, top):
    rows = phrase_rows(seed)
    schema = "lang string, text string, block int, words string, a int, rank int"
    df = spark.createDataFrame([(*r, 1, "w", 2, 3) for r in rows], schema).repartition(3)
    got = collocations.collocations(df, longest=4, least=3, covered=80, top=top)
    assert sorted(map(tuple, got.collect())) == brute_phrases(rows, 4, 3, 80, top)
    assert collocations.collocations(df.limit(0)).collect() == []


def test_blocks_end_at_piece_borders():
    words = collocations._Words()
    words.add(np.frombuffer(b"a b, c ", np.uint8))
    words.add(np.frombuffer(b"d e", np.uint8))
    names, counts, codes = words.block(False)
    assert names.to_pylist() == ["a", "b"] and counts.tolist() == [1, 1] and words.words == 3
    names, _, codes = words.block(True)
    assert names.to_pylist() == ["c", "d", "e"] and (codes >> 31).tolist() == [1, 0, 0]
    assert words.block(True) is None
    one = collocations._Words()
    one.add(np.frombuffer(b"x y z", np.uint8))
    assert one.block(False) is None and one.words == 3  # no border yet: the piece stays whole


def test_dense_tiles_and_sorted_cells_agree():
    rng = np.random.default_rng(5)
    for size, wide in ((10, 3), (40000, 300), (40000, 100000)):
        codes = rng.integers(0, wide, size) << 32 | rng.integers(0, wide, size)
        weights = rng.integers(1, 9, size)
        for counts in (None, weights):
            found, sums = collocations.summed(codes, counts)
            want = Counter()
            for c, w in zip(codes.tolist(), (weights if counts is not None else np.ones(size, int)).tolist()):
                want[c] += w
            assert dict(zip(found.tolist(), sums.tolist())) == want
