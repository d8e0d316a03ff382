"""SimHash, suffixes and decontamination against brute force."""

import random

import numpy as np
import xxhash

from facetgraph.llm import arrow, decontamination, simhash, suffix_dedup

from .conftest import prose


def corpus(seed: int):
    rng = random.Random(seed)
    texts = [prose(rng, rng.randint(1, 120)) for _ in range(40)]
    passage, odd = prose(rng, 60), "é" * 30 + " über " + "ß" * 20
    texts += [texts[3], texts[3], texts[5] + " end", prose(rng, 20) + " " + passage, passage + prose(rng, 9), passage, passage[5:70], odd, "x" + odd]
    texts += ["a", "", "  \t", None, "z" * 3000, "z" * 2000, "ab " * 700, "same", "same"]
    rng.shuffle(texts)
    return [(i * 3 + 1, t, None, None) for i, t in enumerate(texts)] + [(None, passage, None, None), (None, "alone", None, None)]


def fingerprint(text):
    words = [w for w in "".join(c.lower() if c < "\x80" else c for c in (text or "")).translate({k: 32 for k in range(9, 14)}).split(" ") if w]
    if not words:
        return 0
    grams = [" ".join(words[k : k + 4]) for k in range(max(1, len(words) - 3))]
    h = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_simhash_is_brute_force(spark, docs):
    rows = corpus(1)
    got = simhash.near_duplicates(docs(rows)).withColumn("hex", simhash.hex_of("fp")).collect()
    fps = {(i, f"{fingerprint(t):016x}") for i, t, *_ in rows}
    assert {(r.id, r.hex) for r in got} == fps and len(got) == len(rows)
    nodes = [(i, fingerprint(t)) for i, t, *_ in rows]
    label = list(range(len(nodes)))
    for _ in nodes:
        label = [min(label[b] for b in range(len(nodes)) if (nodes[a][1] ^ nodes[b][1]).bit_count() <= 4) for a in range(len(nodes))]
    least = {}
    for (i, _), l in zip(nodes, label, strict=True):
        if i is not None:
            least[l] = min(i, least.get(l, i))
    want = {(i, f"{fp:016x}", least.get(l)) for (i, fp), l in zip(nodes, label, strict=True)}
    assert {(r.id, r.hex, r.component) for r in got} == want


def test_tiles_of_one_key_find_all_near_pairs():
    rng = np.random.default_rng(3)
    base = rng.integers(0, 1 << 63, 40, dtype=np.uint64)
    fp = np.unique(np.concatenate([base ^ np.uint64(1 << int(k)) for k in rng.integers(0, 60, 60)]))
    a, b = simhash.tile_links(np.zeros(len(fp), np.int64), fp, np.zeros(len(fp), bool), 4)
    mine = simhash._star(np.searchsorted(fp, a), np.searchsorted(fp, b), len(fp))
    i, j = np.nonzero(np.bitwise_count(fp[:, None] ^ fp[None, :]) <= 4)
    assert np.array_equal(mine, simhash._star(i, j, len(fp)))


def test_one_of_each_keeps_the_smallest(spark, docs):
    rows = [(5, "one two three four five six", "a", None), (2, "one two three four five six", "b", None), (9, "quite another text of other words", None, None), (9, "quite another text of other words", None, None), (None, None, None, None)]
    kept = simhash.one_of_each(docs(rows))
    assert kept.columns == docs(rows).columns
    assert sorted((r.doc_id or -1) for r in kept.collect()) == [-1, 2, 9]


def test_empty_tables(spark, docs):
    none = docs([])
    assert simhash.near_duplicates(none).count() == 0
    assert suffix_dedup.remove_repeats(none).count() == 0
    assert suffix_dedup.trimmed(none).columns == none.columns
    bench = spark.createDataFrame([], "item_id bigint, text string")
    assert decontamination.contaminated(none, bench).count() == 0


def brute(rows, length=50):
    big = 1 << 62
    seen, out = {}, {}
    keyed = sorted(((big if i is None else i), (t or "").encode()) for i, t, *_ in rows)
    for i, b in keyed:
        gone = bytearray(len(b))
        for p in range(len(b) - length + 1):
            if seen.setdefault(b[p : p + length], i) < i:
                gone[p : p + length] = b"\1" * length
        out.setdefault(i, (len(b), bytes(c for c, g in zip(b, gone, strict=True) if not g), len([x for x in bytes(gone).split(b"\0") if x])))
    return out


def test_suffixes_are_brute_force(spark, docs, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "RUN_BYTES", 1 << 10)  # long texts in several chunks
    rows = [r for r in corpus(2) if r[0] is not None] + [(None, corpus(2)[-2][1], None, None)]
    want = brute(rows)
    got = suffix_dedup.remove_repeats(docs(rows)).collect()
    assert len(got) == len(rows)
    for r in got:
        n, kept, spans = want[(1 << 62) if r.row.doc_id is None else r.row.doc_id]
        assert (r.n_bytes, bytes(r.kept), len(r.spans)) == (n, kept, spans)


def test_trimmed_text_is_valid(spark, docs):
    a = "é" * 40
    rows = [(1, a + "q", None, None), (2, "xyz" + a + "r", None, None), (3, a, None, None), (4, None, None, None), (5, "", None, None)]
    got = {r.doc_id: (r.text, r.n_chars) for r in suffix_dedup.trimmed(docs(rows)).collect()}
    assert got == {1: (a + "q", 41), 2: ("xyzr", 4), 4: (None, None), 5: ("", 0)}


def test_span_hashes_do_not_depend_on_the_place():
    x = np.frombuffer(b"..abcdef....abcdef", np.uint8)
    h = arrow.span_hashes(x, np.array([2, 12, 3]), np.array([8, 18, 9]))
    assert h[0] == h[1] != h[2]


ITEM = "A farmer named Walter sold 250 kg of wheat to Martha for 900 dollars and then gave Walter another 250 kg for free."


def test_decontamination(spark, docs):
    bench = spark.createDataFrame([(1, ITEM, "e"), (2, "too short", "e"), (3, None, "e"), (None, ITEM, "e")], "item_id int, text string, h string")
    rows = [
        (1, "Filler here. " + ITEM.replace("Walter", "Olga").replace("250 kg", "75 lb").replace("Martha", "Ivan").replace("900 dollars", "60 euros") + " More.", None, None),
        (2, ITEM.replace("another 250 kg", "another 12 lb").replace("gave Walter", "gave Peter").replace("Martha", "Walter").replace("900", "12"), None, None),
        (3, None, None, None), (4, "", None, None), (5, "wheat and farming in general, nothing else to see here", None, None),
        (None, "before " + ITEM.upper() + " after", None, None), (7, ITEM, None, None), (7, ITEM, None, None), (8, "too short", None, None),
    ]
    got = decontamination.contaminated(docs(rows), bench).collect()
    flags = {(None if r.id >= 1 << 62 else r.id): r.reparameterised for r in got}
    assert flags[1] is True and flags[7] is False and flags[None] is False
    assert not {3, 4, 5, 8} & set(flags)
    kept = decontamination.without_benchmark(docs(rows), bench)
    assert {r.doc_id for r in kept.collect()} >= {3, 4, 5, 8} and kept.filter("doc_id in (1, 7) or doc_id is null").count() == 0


def test_windows_match_a_plain_count(spark, docs):
    rng = random.Random(7)
    items = [(k, prose(rng, 25)) for k in range(5)]
    rows = [(k, prose(rng, 50) + " " + items[k % 5][1] + " " + prose(rng, 30), None, None) for k in range(10)] + [(10 + k, prose(rng, 90), None, None) for k in range(10)]
    bench = spark.createDataFrame(items, "item_id int, text string")
    grams = lambda t: {tuple(t.split()[k : k + 5]) for k in range(len(t.split()) - 4)}
    want = {(i, k) for i, t, *_ in rows for k, b in items if len(grams(t) & grams(b)) >= 0.8 * len(grams(b))}
    assert {(r.id, r.item_id) for r in decontamination.contaminated(docs(rows), bench).collect()} == want


def test_rows_of_one_id_lose_what_their_own_texts_repeat(spark, docs):
    rng = random.Random(11)
    passages = [prose(rng, 30) for _ in range(6)]
    rows = [(k // 3, prose(rng, k % 7) + passages[k % 6] + prose(rng, k % 4), None, None) for k in range(24)] + [(None, p, None, None) for p in (passages[0], "x" * 60, "y" + "x" * 60)]
    big = 1 << 62
    earlier = {}
    for i, t, *_ in rows:
        for p in range(len(t) - 49):
            earlier[t[p : p + 50]] = min(earlier.get(t[p : p + 50], big), big if i is None else i)
    want = []
    for i, t, *_ in rows:
        gone = {q for p in range(len(t) - 49) if earlier[t[p : p + 50]] < (big if i is None else i) for q in range(p, p + 50)}
        want.append((str(i), "".join(c for q, c in enumerate(t) if q not in gone)))
    got = suffix_dedup.remove_repeats(docs(rows)).collect()
    assert sorted((str(r.row.doc_id), bytes(r.kept).decode()) for r in got) == sorted(want)


def test_windows_that_share_half_a_hash_are_not_repeats(spark):
    two = np.arange(2)
    blob = suffix_dedup._pack(np.full(2, 5, np.uint64), np.array([1, 2], np.uint64), two, two, two, np.zeros(2, np.uint64))
    sent = spark.createDataFrame([(0, 0, bytearray(blob))], "bucket int, kind tinyint, blob binary")
    assert suffix_dedup._settled(sent, 1, (suffix_dedup.WINDOW, None), 1).count() == 0
