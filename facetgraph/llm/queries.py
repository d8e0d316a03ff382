"""Registered queries of the ten operators over their whole tables, and their SQL where it can say the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import collocations, decontamination, fingerprint, html_text, language_id, licenses, packing, quality, simhash, suffix_dedup, toxicity, vector_codes, warc
from .shared import Scratch, stash, table


def held_out(doc_id: Column) -> Column:
    """crc32 of the id as text leaves 2 when divided by 4."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 4 == 2, F.lit(False))


def op1_language_id(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").withColumn("held_out", held_out(F.col("doc_id")))
    fitted = language_id.fit(docs.filter(~F.col("held_out")))
    return language_id.identify(docs.select("doc_id", "held_out", "text"), fitted).drop("text")


def op2_toxicity(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").select("doc_id", "text").withColumn("held_out", held_out(F.col("doc_id")))
    labels = table(spark, sf, "labels").select("doc_id", "toxic").hint("merge")  # grows with the documents: never broadcast
    known = docs.filter(~F.col("held_out")).join(labels, "doc_id")
    scored = toxicity.judge(docs, toxicity.fit(known.select("text", "toxic")))
    return scored.select("doc_id", "held_out", "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op3_fingerprints(spark: SparkSession, sf: str) -> DataFrame:
    found = fingerprint.fingerprints(table(spark, sf, "documents").select("doc_id", "text"))
    return found.select("doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), "fingerprint", "edited_fingerprint", "near_edited", "near_next")


def op4_license_scan(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents")
    path = F.concat_ws("/", "source", "lang", F.concat(F.col("doc_id").cast("string"), F.lit(".txt")))
    found = licenses.scan(spark, docs.select(F.col("doc_id").alias("id"), path.alias("path"), "text"))
    return found.withColumnRenamed("id", "doc_id")


def op5_quality(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").select("doc_id", "text", "lang")
    trusted = table(spark, sf, "labels").filter("quality = 1").select("doc_id").hint("merge")  # grows with the documents: never broadcast
    languages, model = quality.train(docs.join(trusted, "doc_id", "left_semi"))
    scratch = Scratch(spark, "zstd")
    scored = scratch.last(quality.perplexities(docs, languages, model, scratch, with_text=False), "perplexities")
    cuts = stash(quality.limits(scored.join(trusted, "doc_id", "left_semi")), "limits")
    return quality.judged(scored, cuts).select("doc_id", "lang", "read_as", "perplexity", "lowest", "highest", "keep")


def op6_suffix_dedup(spark: SparkSession, sf: str) -> DataFrame:
    found = suffix_dedup.remove_repeats(table(spark, sf, "documents").select("doc_id", "text"), length=50)
    removed = F.aggregate("spans", F.lit(0).cast("bigint"), lambda n, s: n + s["end"] - s["begin"])
    return found.select(
        F.col("row.doc_id").alias("doc_id"), "n_bytes", removed.alias("n_removed"),
        F.size("spans").cast("bigint").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"),
    )


def op7_decontamination(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").select("doc_id", "text")
    pairs = decontamination.contaminated(docs, table(spark, sf, "benchmark"), similarity=0.8)
    return pairs.select(F.when(F.col("id") < 1 << 62, F.col("id")).alias("doc_id"), *pairs.columns[1:])


def op8_simhash(spark: SparkSession, sf: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf, "documents"), words=4, radius=4)
    return found.select(F.col("id").alias("doc_id"), simhash.hex_of("fp").alias("fingerprint"), F.col("component").alias("component_id"))


def op9_warc(spark: SparkSession, sf: str) -> DataFrame:
    found = warc.deduplicated(table(spark, sf, "pages"), shortest=100)
    return found.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op10_packing(spark: SparkSession, sf: str) -> DataFrame:
    pieces = packing.pack(table(spark, sf, "documents"), size=2048)
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op11_vector_codes(spark: SparkSession, sf: str) -> DataFrame:
    vectors = table(spark, sf, "embeddings").select("vec_id", "embedding", "label")
    books = vector_codes.codebooks(vectors, parts=8, entries=16, rounds=6)
    if books is None:
        return spark.createDataFrame([], "vec_id bigint, code string, error bigint, label_error bigint, codebooks_sha256 string")
    found = vector_codes.encode(vectors, books)
    found = stash(found.select(F.col("row.vec_id").alias("vec_id"), F.col("row.label").alias("label"), "code", "error"), "codes")
    sums = found.groupBy(F.col("label").alias("of_label")).agg(F.sum("error").alias("label_error"))
    joined = found.join(sums, F.col("label").eqNullSafe(F.col("of_label")))
    return joined.select("vec_id", "code", "error", "label_error", F.lit(vector_codes.digest(books)).alias("codebooks_sha256"))


def op12_html_text(spark: SparkSession, sf: str) -> DataFrame:
    found = html_text.extract(table(spark, sf, "pages").select("page_id", "url", "html"))
    return found.select("row.page_id", "row.url", "text", F.length("text").cast("bigint").alias("n_chars"))


def op13_collocations(spark: SparkSession, sf: str) -> DataFrame:
    return collocations.collocations(table(spark, sf, "documents"), longest=4, least=30, covered=80, top=2000)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_language_id": op1_language_id,
    "op2_toxicity": op2_toxicity,
    "op3_fingerprints": op3_fingerprints,
    "op4_license_scan": op4_license_scan,
    "op5_quality": op5_quality,
    "op6_suffix_dedup": op6_suffix_dedup,
    "op7_decontamination": op7_decontamination,
    "op8_simhash": op8_simhash,
    "op9_warc": op9_warc,
    "op10_packing": op10_packing,
    "op11_vector_codes": op11_vector_codes,
    "op12_html_text": op12_html_text,
    "op13_collocations": op13_collocations,
}

def _lloyd_sql(rounds: int) -> str:
    """Rounds of op11 spelled out: parts as rows (v, p, j, x), codebooks as rows (p, e, j, c)."""
    steps = []
    for r in range(rounds + 1):
        steps.append(f"""
        d{r} AS (SELECT v, a.p, e, sum((x - c) * (x - c)) AS d FROM parts a JOIN b{r} b ON a.p = b.p AND a.j = b.j GROUP BY ALL),
        a{r} AS (SELECT v, p, arg_min(e, d * 256 + e) AS e, min(d) AS d FROM d{r} GROUP BY ALL)""")
        if r < rounds:
            steps.append(f"""
        s{r} AS (SELECT a.p, e, j, sum(x) AS s, count(*) AS n FROM a{r} a JOIN parts USING (v, p) GROUP BY ALL),
        b{r + 1} AS (SELECT b.p, b.e, b.j, CASE WHEN n IS NULL THEN c ELSE (s - ((s % n) + n) % n) // n END AS c
            FROM b{r} b LEFT JOIN s{r} s ON b.p = s.p AND b.e = s.e AND b.j = s.j)""")
    return ",".join(steps)


ORACLES: dict[str, str] = {
    "op11_vector_codes": f"""
        WITH kept AS (SELECT row_number() OVER (ORDER BY vec_id) - 1 AS v, vec_id, label, embedding FROM embeddings
            WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
        cells AS (SELECT v, unnest(embedding) AS x, unnest(generate_series(0, len(embedding) - 1)) AS i, len(embedding) // 8 AS w FROM kept),
        parts AS (SELECT v, i // w AS p, i % w AS j, floor(4096 * x::DOUBLE)::BIGINT AS x FROM cells),
        b0 AS (SELECT p, v AS e, j, x AS c FROM parts WHERE v < 16), {_lloyd_sql(6)},
        codes AS (SELECT v, string_agg(printf('%02x', e), '' ORDER BY p) AS code, sum(d)::BIGINT AS error FROM a6 GROUP BY v)
        SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error,
            (SELECT sha256(string_agg(c::BIGINT::VARCHAR, ',' ORDER BY p, e, j)) FROM b6) AS codebooks_sha256
        FROM kept JOIN codes USING (v)
    """,
    "op13_collocations": r"""
        WITH pieces AS (
            SELECT doc_id, coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
        worded AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM pieces),
        runs AS (SELECT lang, len(w) AS size, unnest(w) AS word, w, generate_subscripts(w, 1) AS i FROM worded),
        grams AS (SELECT lang, k, array_to_string(w[i : i + k - 1], ' ') AS phrase FROM runs, (SELECT unnest([1, 2, 3, 4]) AS k) WHERE i + k - 1 <= size),
        f AS (SELECT lang, k, phrase, count(*) AS a FROM grams GROUP BY ALL HAVING count(*) >= 30),
        total AS (SELECT lang, count(*) AS n FROM runs GROUP BY lang),
        c AS (SELECT *, string_split(phrase, ' ') AS w FROM f WHERE k > 1),
        cuts AS (SELECT c.lang, c.phrase, c.a, j, array_to_string(w[1 : j], ' ') AS first, array_to_string(w[j + 1 :], ' ') AS rest
            FROM c, (SELECT unnest([1, 2, 3]) AS j) WHERE j < c.k),
        scores AS (SELECT cuts.lang, cuts.phrase, cuts.a, j, x.a AS l, y.a AS r, (2000000::HUGEINT * cuts.a) // (x.a + y.a) AS score
            FROM cuts JOIN f x ON x.lang = cuts.lang AND x.phrase = first JOIN f y ON y.lang = cuts.lang AND y.phrase = rest),
        best AS (SELECT * FROM scores QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, j) = 1),
        spans AS (SELECT c.lang, array_to_string(w[i : i + k2 - 1], ' ') AS phrase, a FROM c, (SELECT unnest([2, 3]) AS k2), (SELECT unnest([1, 2, 3]) AS i) WHERE k2 < c.k AND i + k2 - 1 <= c.k),
        cover AS (SELECT lang, phrase, max(a) AS most FROM spans GROUP BY ALL),
        free AS (SELECT b.* FROM best b LEFT JOIN cover USING (lang, phrase) WHERE most IS NULL OR 100 * most < 80 * b.a),
        placed AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, encode(phrase)) AS rank FROM free)
        SELECT lang, rank, phrase, a, l, r, n, score::BIGINT AS score FROM placed JOIN total USING (lang) WHERE rank <= 2000
    """,
    # the pages of the tables hold their text in one article, with three named characters in use
    "op12_html_text": r"""
        WITH t AS (SELECT page_id, url, regexp_extract(html, '<article>(.*)</article>', 1, 's') AS a FROM pages),
        u AS (SELECT page_id, url, regexp_replace(regexp_replace(a, '<[^>]*>', ' ', 'g'), '&quot;?', '"', 'g') AS a FROM t),
        r AS (SELECT page_id, url, trim(regexp_replace(regexp_replace(a, '&amp;?', '&', 'g'), '\s+', ' ', 'g')) AS text FROM u)
        SELECT page_id, url, text, length(text) AS n_chars FROM r
    """,
    "op9_warc": """
        WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS b FROM pages),
        d AS (SELECT page_id, octet_length(b)::BIGINT AS payload_bytes, sha256(b) AS payload_digest FROM p),
        f AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS origin FROM d)
        SELECT page_id, payload_bytes, payload_digest,
            CASE WHEN payload_bytes < 100 OR page_id = origin THEN 'response' ELSE 'revisit' END AS record_type,
            CASE WHEN payload_bytes < 100 OR page_id = origin THEN NULL ELSE origin END AS refers_to
        FROM f
    """,
}
