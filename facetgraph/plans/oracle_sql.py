"""The registered queries as DuckDB SQL, for the value checks."""

from __future__ import annotations

from ..functions import fixed, text

# --- shared table expressions ------------------------------------------------------------------

POINTS = "CASE WHEN l_returnflag = 'R' THEN 15 WHEN l_returnflag = 'A' THEN 8 ELSE 3 END"

NATION_REL = f"""
rel AS (
  SELECT cn.n_name AS src, sn.n_name AS dst, CAST(sum({POINTS}) AS BIGINT) AS score
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey
  JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey
  JOIN nation cn ON c_nationkey = cn.n_nationkey JOIN nation sn ON s_nationkey = sn.n_nationkey
  GROUP BY 1, 2)"""
NATION_ASG = """
asg AS (SELECT n_name AS entity, r_name AS cluster FROM nation JOIN region ON n_regionkey = r_regionkey),
dim AS (SELECT r_name AS cluster FROM region)"""
NATION_MEM = """
mem AS (
  SELECT DISTINCT l_orderkey AS grp, n_name AS member
  FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey)"""
NATION_FEAT = """
feat AS (
  SELECT n_name AS i, p_brand || '|' || p_type AS f, CAST(count(*) AS DOUBLE) AS v
  FROM lineitem JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey
  JOIN nation ON s_nationkey = n_nationkey GROUP BY 1, 2)"""

SUPPLIER_REL = f"""
rel AS (
  SELECT sa.s_name AS src, sb.s_name AS dst, CAST(sum({POINTS.replace('l_returnflag', 'a.l_returnflag')}) AS BIGINT) AS score
  FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND a.l_linenumber + 1 = b.l_linenumber
  JOIN supplier sa ON a.l_suppkey = sa.s_suppkey JOIN supplier sb ON b.l_suppkey = sb.s_suppkey
  GROUP BY 1, 2)"""
SUPPLIER_ASG = """
asg AS (SELECT s_name AS entity, n_name AS cluster FROM supplier JOIN nation ON s_nationkey = n_nationkey),
dim AS (SELECT n_name AS cluster FROM nation)"""
SUPPLIER_MEM = """
mem AS (SELECT DISTINCT l_orderkey AS grp, s_name AS member FROM lineitem JOIN supplier ON l_suppkey = s_suppkey)"""
SUPPLIER_FEAT = """
feat AS (
  SELECT s_name AS i, p_brand || '|' || p_type AS f, CAST(count(*) AS DOUBLE) AS v
  FROM lineitem JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey GROUP BY 1, 2)"""

LINKS = """
loc AS (
  SELECT src, dst, score, a.cluster AS cs, b.cluster AS ct
  FROM rel JOIN asg a ON src = a.entity JOIN asg b ON dst = b.entity),
sizes AS (SELECT cluster, count(*) AS m FROM asg GROUP BY 1),
links AS (SELECT cs, ct, count(*) AS edges, sum(score) AS weight FROM loc GROUP BY 1, 2),
kk AS (SELECT count(*) AS k FROM dim)"""

STR_AFTER = """
sym AS (SELECT i, j, sum(w) AS w FROM (
  SELECT src AS i, dst AS j, score AS w FROM rel UNION ALL SELECT dst, src, score FROM rel) GROUP BY 1, 2),
str AS (SELECT i, j, w / (SELECT max(w) FROM sym) AS w FROM sym WHERE i <> j)"""
FUN = """
cooc AS (SELECT a.member AS i, b.member AS j, count(*) AS n FROM mem a JOIN mem b ON a.grp = b.grp AND a.member <> b.member GROUP BY 1, 2),
fun AS (SELECT i, j, CAST(n AS DOUBLE) / (SELECT max(n) FROM cooc) AS w FROM cooc)"""
SEM = """
norm AS (SELECT i, sqrt(sum(v * v)) AS norm FROM feat GROUP BY 1),
unit AS (SELECT i, f, v / norm AS v FROM feat JOIN norm USING (i)),
sem AS (SELECT a.i, b.i AS j, CASE WHEN a.i = b.i THEN 1.0 ELSE sum(a.v * b.v) END AS w FROM unit a JOIN unit b ON a.f = b.f GROUP BY 1, 2)"""
ALL_VIEWS = ",".join([NATION_REL, NATION_MEM, NATION_FEAT, STR_AFTER, FUN, SEM])

# The SQL engine's \w, \s and \b know ASCII only: words and blanks of Unicode are spelled out, and
# word boundaries become the choice of whole words.
DOCS = "docs AS (SELECT doc_id, source, lang, coalesce(text, '') AS text FROM documents)"
_SIGNS = [r"\p{L}", r"\p{M}", r"\p{Nd}", r"\p{Nl}", r"\p{Pc}"]
WORD = "[" + "".join(_SIGNS) + r"\x{200C}\x{200D}]"
BLANK = r"[\s\x{0B}\x{85}\p{Z}]"
START = "(?:^|[^" + WORD[1:] + ")"
FOREIGN = "(" + "|".join(rf"[^\x00-\x7F{sign.replace('p', 'P', 1)}]" for sign in _SIGNS) + ")"


def _caps(c: str) -> str:
    """Whole words that look like type names."""
    return f"list_filter(regexp_extract_all({c}, '{WORD}+'), lambda cap: regexp_full_match(cap, '[A-Z][a-zA-Z0-9_]+'))"


def _spaced(c: str) -> str:
    """A blank behind each bracket, so that a match leaves the next one its left neighbour."""
    return f"replace(replace({c}, '(', '( '), ')', ') ')"


def _without(c: str, terms: list[str]) -> str:
    """Whole words ``terms`` deleted: letters beyond ASCII carry marks while ASCII boundaries are in use."""
    marked = f"regexp_replace({c}, '{FOREIGN}', '_\\1_', 'g')"
    bare = f"regexp_replace({marked}, '\\b(?:{'|'.join(terms)})\\b', '', 'g')"
    return f"regexp_replace({bare}, '_{FOREIGN}_', '\\1', 'g')"


CLASSES = rf"""
{DOCS},
named AS (SELECT *, {_caps('text')} AS words FROM docs),
classes AS (
  SELECT source || '/' || CASE lang WHEN 'en' THEN 'jpa' WHEN 'fr' THEN 'src/main' ELSE 'morphia' END || '/' || doc_id || '.java' AS filename,
    coalesce(words[1], 'Doc' || doc_id) AS class,
    regexp_extract(text, '^([^\n]*)', 1) AS attributes,
    regexp_replace(text, '^[^\n]*', '') AS methods,
    'class ' || coalesce(words[1], 'Doc' || doc_id) || CASE WHEN len(words) > 1 THEN ' extends ' || array_to_string(words[2:3], ', ') ELSE '' END || ' {{' || chr(10)
      || regexp_replace(text, '([A-Z][a-z]+) ', 'new \1( ', 'g') || chr(10) || '}}' AS content
  FROM named)"""
UNIQUE = f"""
{CLASSES},
core AS (
  SELECT class, filename, attributes, methods, content FROM (
    SELECT *, row_number() OVER (PARTITION BY class ORDER BY
      CASE WHEN contains(lower(filename), 'morphia') THEN 0 WHEN contains(lower(filename), 'jpa') THEN 1 ELSE 2 END, filename) AS rn
    FROM classes) WHERE rn = 1)"""


def _with(*parts: str) -> str:
    return "WITH " + ",".join(p.strip() for p in parts) + "\n"


def _list(words: list[str]) -> str:
    return ", ".join("'" + w.replace("'", "''") + "'" for w in words)


def _quality(rel: str, asg: str, tag: str) -> dict[str, str]:
    base = _with(rel, asg, LINKS)

    def sm(measure: str) -> str:
        return base + f"""
          SELECT round(
            (SELECT coalesce(sum({measure} / CAST(m * m AS DOUBLE)), 0) FROM links JOIN sizes ON cs = cluster WHERE cs = ct) / k
            - (SELECT coalesce(sum({measure} / (2.0 * a.m * b.m)), 0) FROM links JOIN sizes a ON cs = a.cluster JOIN sizes b ON ct = b.cluster WHERE cs <> ct)
              / (k * (k - 1) / 2.0), 6) AS sm FROM kk"""

    icp = "SELECT round(sum(CASE WHEN cs <> ct THEN score ELSE 0 END) / CAST(sum(score) AS DOUBLE), 6) AS icp FROM loc"
    ifn = "SELECT round((SELECT count(DISTINCT dst) FROM loc WHERE cs <> ct) / CAST(k AS DOUBLE), 6) AS ifn FROM kk"
    ned = """SELECT round(1 - avg(CASE WHEN coalesce(m, 0) BETWEEN 5 AND 20 THEN 1.0 ELSE 0.0 END), 6) AS ned
             FROM dim LEFT JOIN sizes USING (cluster)"""
    sub = {"SM": sm("edges")[len(base):], "ICP": icp, "IFN": ifn, "NED": ned}
    union = " UNION ALL ".join(f"SELECT '{m}' AS metric, CAST({m.lower()} AS DOUBLE) AS value FROM ({q})" for m, q in sub.items())
    return {
        f"sm_counts{tag}": sm("edges"),
        f"sm_weighted{tag}": sm("weight"),
        f"icp{tag}": base + icp,
        f"ifn{tag}": base + ifn,
        f"ned{tag}": base + ned,
        f"quality_all{tag}": base + union,
    }


def _graph(rel: str, asg: str, mem: str, everyone: str, tag: str) -> dict[str, str]:
    before = """sym AS (SELECT i, j, sum(w) AS w FROM (
      SELECT src AS i, dst AS j, score AS w FROM rel UNION ALL SELECT dst, src, score FROM rel) WHERE i <> j GROUP BY 1, 2)"""
    out = _quality(rel, asg, tag)
    if not tag:
        out["icp_by_region"] = out.pop("icp")
    out |= {
        f"relation_scores{tag}": _with(rel) + "SELECT * FROM rel",
        f"relation_map_isolated{tag}": _with(rel) + f"""
          SELECT e.class, count(src) AS n_edges, CAST(coalesce(sum(score), 0) AS BIGINT) AS total_score
          FROM ({everyone}) e LEFT JOIN rel ON src = e.class GROUP BY 1""",
        f"structural_view{tag}": _with(rel, STR_AFTER) + "SELECT i, j, round(w, 6) AS w FROM str",
        f"structural_view_diag_first{tag}": _with(rel, before) + "SELECT i, j, round(w / (SELECT max(w) FROM sym), 6) AS w FROM sym",
        f"cooccurrence_view{tag}": _with(mem, FUN) + "SELECT i, j, round(w, 6) AS w FROM fun",
        f"view_degrees{tag}": _with(rel, STR_AFTER) + "SELECT i, round(sum(w), 6) AS degree FROM str GROUP BY 1",
    }
    return out


def _laplacian(ctes: str, everyone: str, cells: str, keep_diagonal: bool = False) -> str:
    off = "TRUE" if keep_diagonal else "i <> j"
    factor = "1 / sqrt(CASE WHEN d = 0 THEN 1e-10 ELSE d END)" if keep_diagonal else "CASE WHEN d > 0 THEN 1 / sqrt(d) ELSE 0 END"
    return ctes + f""",
      w AS (SELECT * FROM {cells} WHERE {off}),
      deg AS (SELECT e.class AS i, coalesce(sum(w.w), 0) AS d FROM ({everyone}) e LEFT JOIN w ON w.i = e.class GROUP BY 1),
      fac AS (SELECT i, {factor} AS s FROM deg),
      cells AS (SELECT w.i, w.j, -w.w * a.s * b.s AS w FROM w JOIN fac a ON a.i = w.i JOIN fac b ON b.i = w.j
                UNION ALL SELECT class, class, 1.0 FROM ({everyone}))
      SELECT i, j, round(sum(w), 6) AS w FROM cells GROUP BY 1, 2"""


NATIONS = "SELECT n_name AS class FROM nation"
SUPPLIERS = "SELECT s_name AS class FROM supplier"
ORACLES: dict[str, str] = {}
ORACLES |= _graph(NATION_REL, NATION_ASG, NATION_MEM, NATIONS, "")
ORACLES |= _graph(SUPPLIER_REL, SUPPLIER_ASG, SUPPLIER_MEM, SUPPLIERS, "_suppliers")

ORACLES["relation_map_roundtrip"] = _with(NATION_REL) + "SELECT * FROM rel"
ORACLES["restricted_relation"] = _with(NATION_REL, NATION_ASG) + """
  SELECT rel.* FROM rel WHERE src IN (SELECT entity FROM asg WHERE cluster IN ('ASIA', 'EUROPE'))
    AND dst IN (SELECT entity FROM asg WHERE cluster IN ('ASIA', 'EUROPE'))"""

ORACLES["cooccurrence_large_groups"] = """
  WITH mem AS (SELECT DISTINCT p_brand AS grp, s_name AS member FROM lineitem JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey)
  SELECT x.member AS a, y.member AS b, count(*) AS n FROM mem x JOIN mem y ON x.grp = y.grp AND x.member < y.member GROUP BY 1, 2"""

# --- vectors

VEC = """
vec AS (SELECT vec_id AS i, CAST(embedding AS DOUBLE[]) AS v, label FROM embeddings),
lft AS (SELECT * FROM vec WHERE label < 5), rgt AS (SELECT * FROM vec WHERE label >= 5)"""
SIM = "list_cosine_similarity(a.v, b.v)"
ORACLES["cosine_pairs_over_threshold"] = _with(VEC) + f"""
  SELECT a.i, b.i AS j, round({SIM}, 6) AS w FROM vec a JOIN vec b ON a.i < b.i WHERE {SIM} >= 0.3"""
ORACLES["cosine_row_sums"] = _with(VEC) + f"""
  SELECT a.i, round(sum({SIM}), 6) AS degree FROM vec a JOIN vec b ON a.i <> b.i GROUP BY 1"""
ORACLES["cosine_rectangular_best"] = _with(VEC) + f"""
  SELECT i, j, round(w, 6) AS w FROM (
    SELECT a.i, b.i AS j, {SIM} AS w, row_number() OVER (PARTITION BY a.i ORDER BY {SIM} DESC, b.i) AS rn
    FROM lft a CROSS JOIN rgt b) WHERE rn = 1"""
ORACLES["cosine_rectangular_over_threshold"] = _with(VEC) + f"""
  SELECT a.i, b.i AS j, round({SIM}, 6) AS w FROM lft a JOIN rgt b ON {SIM} >= 0.3"""


_MUTUAL = "row_number() OVER (PARTITION BY i ORDER BY w DESC, j) = 1 AND row_number() OVER (PARTITION BY j ORDER BY w DESC, i) = 1"
ORACLES["mutual_best_match"] = f"""
  WITH RECURSIVE {VEC.strip()},
    pair AS (SELECT a.i, b.i AS j, {SIM} AS w FROM lft a CROSS JOIN rgt b),
    step AS (
      SELECT *, 1 AS round, {_MUTUAL} AS hit FROM pair
      UNION ALL
      SELECT i, j, w, round + 1, {_MUTUAL}
      FROM (SELECT *, max(hit) OVER (PARTITION BY i) OR max(hit) OVER (PARTITION BY j) AS gone FROM step) WHERE NOT gone)
  SELECT i, j, round(w, 6) AS w, CAST(round AS INTEGER) AS round FROM step WHERE hit"""
ORACLES["mean_pool_vectors"] = """
  SELECT label, CAST(p - 1 AS INTEGER) AS pos, round(avg(CAST(x AS DOUBLE)), 6) AS x
  FROM (SELECT label, unnest(embedding) AS x, generate_subscripts(embedding, 1) AS p FROM embeddings) GROUP BY 1, 2"""


def _silhouette(ctes: str, distance: str, n: str = "vec", key: str = "i") -> str:
    """Over all pairs with their distance d: rows (i, own, other, d) come from ``distance``."""
    return ctes + f""",
      pairs AS ({distance}),
      per AS (SELECT i, own, other, sum(d) AS s, count(*) AS c FROM pairs GROUP BY 1, 2, 3),
      ab AS (SELECT i, max(CASE WHEN own = other THEN s / c END) AS a, min(CASE WHEN own <> other THEN s / c END) AS b FROM per GROUP BY 1)
      SELECT round(avg(CASE WHEN a IS NULL OR greatest(a, b) = 0 THEN 0 ELSE (b - a) / greatest(a, b) END), 6) AS silhouette_score FROM ab"""


def _vector_distance(expr: str) -> str:
    return f"SELECT a.i, a.label AS own, b.label AS other, {expr} AS d FROM vec a JOIN vec b ON a.i <> b.i"


ORACLES["silhouette_precomputed"] = _silhouette(_with(VEC).rstrip(), _vector_distance(f"least(greatest(1 - {SIM}, 0), 1)"))
ORACLES["silhouette_unclipped"] = _silhouette(_with(VEC).rstrip(), _vector_distance(f"1 - {SIM}"))
ORACLES["silhouette_suppliers"] = _silhouette(
    _with(SUPPLIER_MEM, SUPPLIER_ASG, FUN).rstrip(),
    """SELECT a.entity AS i, a.cluster AS own, b.cluster AS other, least(greatest(1 - coalesce(w, 0), 0), 1) AS d
       FROM asg a JOIN asg b ON a.entity <> b.entity LEFT JOIN fun ON fun.i = a.entity AND fun.j = b.entity""",
)
ORACLES["calinski_harabasz_suppliers"] = _with(SUPPLIER_MEM, SUPPLIER_ASG, FUN) + """,
  x AS (SELECT a.entity AS i, a.cluster, b.entity AS j, coalesce(w, 0) AS w
        FROM asg a CROSS JOIN asg b LEFT JOIN fun ON fun.i = a.entity AND fun.j = b.entity),
  cm AS (SELECT cluster, j, avg(w) AS m, count(*) AS n FROM x GROUP BY 1, 2),
  gm AS (SELECT j, avg(w) AS g FROM x GROUP BY 1),
  b AS (SELECT sum(n * (m - g) * (m - g)) AS v FROM cm JOIN gm USING (j)),
  wi AS (SELECT sum((w - m) * (w - m)) AS v FROM x JOIN cm USING (cluster, j)),
  nk AS (SELECT count(*) AS n, count(DISTINCT cluster) AS k FROM asg)
  SELECT round(b.v / wi.v * (n - k) / (k - 1), 6) AS calinski_harabasz_score FROM b, wi, nk"""
ORACLES["calinski_harabasz_suppliers"] = ORACLES["calinski_harabasz_suppliers"].replace("\n,\n  x AS", ",\n  x AS")
ORACLES["distance_view"] = _with(ALL_VIEWS) + """
  SELECT i, j, round(CASE WHEN i = j THEN 0 ELSE least(greatest(1 - w, 0), 1) END, 6) AS d FROM sem"""

# --- fusion

ORACLES["semantic_view"] = _with(ALL_VIEWS) + "SELECT i, j, round(w, 6) AS w FROM sem"
ORACLES["semantic_view_sparse"] = _with(SUPPLIER_FEAT, SEM) + "SELECT i, j, round(w, 6) AS w FROM sem WHERE w >= 0.1"
ORACLES["fixed_weight_fusion"] = _with(ALL_VIEWS) + """
  SELECT i, j, round(sum(w), 6) AS w FROM (
    SELECT i, j, 0.5 * w AS w FROM str UNION ALL SELECT i, j, 0.3 * w FROM sem UNION ALL SELECT i, j, 0.2 * w FROM fun) GROUP BY 1, 2"""
ORACLES["fixed_weight_fusion_suppliers"] = _with(SUPPLIER_REL, SUPPLIER_MEM, STR_AFTER, FUN) + """
  SELECT i, j, round(sum(w), 6) AS w FROM (
    SELECT i, j, 0.7 * w AS w FROM str UNION ALL SELECT i, j, 0.3 * w FROM fun) GROUP BY 1, 2"""
LISTS = """
sup AS (SELECT DISTINCT n_name AS i FROM supplier JOIN nation ON s_nationkey = n_nationkey WHERE s_acctbal > 9000),
cus AS (SELECT DISTINCT n_name AS i FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE c_acctbal > 0),
everyone AS (SELECT DISTINCT n_name AS i FROM nation)"""
ORACLES["aligned_keys"] = _with(LISTS) + "SELECT i FROM sup INTERSECT SELECT i FROM cus INTERSECT SELECT i FROM everyone"
ORACLES["alignment_check"] = _with(LISTS) + """
  SELECT i, string_agg(t, ',' ORDER BY t) AS present_in FROM (
    SELECT i, 'sup' AS t FROM sup UNION ALL SELECT i, 'cus' FROM cus UNION ALL SELECT i, 'all' FROM everyone)
  GROUP BY 1 HAVING count(*) < 3"""
ORACLES["aligned_view"] = _with(NATION_REL, STR_AFTER, LISTS, "common AS (SELECT i FROM sup INTERSECT SELECT i FROM cus)") + """
  SELECT i, j, round(w, 6) AS w FROM str WHERE i IN (SELECT i FROM common) AND j IN (SELECT i FROM common)"""
ORACLES["normalized_laplacian"] = _laplacian(_with(NATION_REL, STR_AFTER).rstrip(), NATIONS, "str")
ORACLES["normalized_laplacian_suppliers"] = _laplacian(_with(SUPPLIER_REL, STR_AFTER).rstrip(), SUPPLIERS, "str")
ORACLES["normalized_laplacian_with_diagonal"] = _laplacian(_with(ALL_VIEWS).rstrip(), NATIONS, "sem", keep_diagonal=True)
ORACLES["matrix_norms"] = _with(ALL_VIEWS) + """
  SELECT round((SELECT max(s) FROM (SELECT sum(abs(w)) AS s FROM sem GROUP BY j)), 6) AS l1,
         round(sqrt(sum(w * w)), 6) AS frobenius, round(sum(w) / ((SELECT count(*) FROM nation) * (SELECT count(*) FROM nation)), 6) AS mean FROM sem"""
ORACLES["matrix_expand"] = _with(NATION_REL, STR_AFTER) + """,
  m AS (SELECT sum(w) / 625.0 AS m FROM str),
  placed AS (SELECT a.n_nationkey + 5 AS r, b.n_nationkey + 5 AS c, w FROM str JOIN nation a ON i = a.n_name JOIN nation b ON j = b.n_name),
  grid AS (SELECT a.x AS r, b.x AS c FROM range(30) a(x), range(30) b(x))
  SELECT grid.r, grid.c, round(CASE WHEN coalesce(w, 0) <> 0 THEN w WHEN grid.r = grid.c THEN 1.0
    WHEN grid.r < 25 AND grid.c < 25 THEN m * 0.7 ELSE m * 0.5 END, 6) AS w
  FROM grid LEFT JOIN placed ON grid.r = placed.r AND grid.c = placed.c, m"""
ORACLES["symmetric_unit_range"] = _with(NATION_REL) + """
  SELECT i, j, round(CASE WHEN i = j THEN 1.0 ELSE least(greatest(sum(w), 0.0), 1.0) END, 6) AS w FROM (
    SELECT src AS i, dst AS j, score / 2000.0 AS w FROM rel UNION ALL SELECT dst, src, score / 2000.0 FROM rel
    UNION ALL SELECT n_name, n_name, 0.0 FROM nation) GROUP BY 1, 2"""


_EXPANDED = _with(SUPPLIER_REL, STR_AFTER) + """,
  n AS (SELECT count(*) AS n FROM supplier),
  m AS (SELECT coalesce(sum(w), 0) / CAST(max(n) * max(n) AS DOUBLE) AS m FROM n LEFT JOIN str ON TRUE),
  placed AS (SELECT a.s_suppkey + 5 AS r, b.s_suppkey + 5 AS c, w FROM str JOIN supplier a ON i = a.s_name JOIN supplier b ON j = b.s_name),
  cell AS (SELECT g.r, g.c, CASE WHEN coalesce(w, 0) <> 0 THEN w WHEN g.r = g.c THEN 1.0 WHEN g.r < n AND g.c < n THEN m * 0.7 ELSE m * 0.5 END AS w
    FROM (SELECT a.x AS r, b.x AS c, n FROM n, range(n + 10) a(x), range(n + 10) b(x)) g LEFT JOIN placed ON g.r = placed.r AND g.c = placed.c, m)"""


def _l1(rounds: int) -> str:
    ctes = [ALL_VIEWS, """
      u0 AS (SELECT i, j, a, b, CASE WHEN i = j THEN 1.0 ELSE (a + b) / 2 END AS u FROM (
        SELECT i, j, CASE WHEN i = j THEN 1.0 ELSE least(greatest(sum(a), 0.0), 1.0) END AS a, CASE WHEN i = j THEN 1.0 ELSE least(greatest(sum(b), 0.0), 1.0) END AS b FROM (
          SELECT i, j, w AS a, 0.0 AS b FROM str UNION ALL SELECT i, j, 0.0, w FROM sem UNION ALL SELECT n_name, n_name, 0.0, 0.0 FROM nation) GROUP BY 1, 2))"""]
    for r in range(rounds):
        ctes.append(f"""
          g{r} AS (SELECT max(x) AS x, max(y) AS y FROM (SELECT sum(abs(u - a)) AS x, sum(abs(u - b)) AS y FROM u{r} GROUP BY j)),
          q{r} AS (SELECT CASE WHEN x > 1e-10 THEN 1 / (2 * sqrt(x)) ELSE 1.0 END AS x, CASE WHEN y > 1e-10 THEN 1 / (2 * sqrt(y)) ELSE 1.0 END AS y FROM g{r}),
          p{r} AS (SELECT x / (x + y) AS x, y / (x + y) AS y FROM q{r}),
          u{r + 1} AS (SELECT i, j, a, b, CASE WHEN i = j THEN 1.0 ELSE
            0.7 * (x * (a + 0.1 * (1 - 2 / (exp(20 * (u - a)) + 1))) + y * (b + 0.1 * (1 - 2 / (exp(20 * (u - b)) + 1)))) + 0.3 * u END AS u FROM u{r}, p{r})""")
    return _with(*ctes) + f"SELECT i, j, round(u, 6) AS w FROM u{rounds}"


ORACLES["l1_fusion_3iter"] = _l1(3)

ORACLES["l1_fusion"] = _l1(0).replace("WITH ", "WITH RECURSIVE ", 1).replace("SELECT i, j, round(u, 6) AS w FROM u0", "").rstrip() + """,
  s AS (
    SELECT i, j, a, b, CAST(u AS DOUBLE) AS u, 0 AS n, CAST(1 AS DOUBLE) AS change FROM u0
    UNION ALL
    SELECT i, j, a, b, v, n + 1, sqrt(sum((v - u) * (v - u)) OVER ()) FROM (
      SELECT *, CASE WHEN i = j THEN 1.0 ELSE 0.7 * (x / (x + y) * (a + 0.1 * (1 - 2 / (exp(20 * (u - a)) + 1)))
        + y / (x + y) * (b + 0.1 * (1 - 2 / (exp(20 * (u - b)) + 1)))) + 0.3 * u END AS v FROM (
        SELECT *, CASE WHEN gx > 1e-10 THEN 1 / (2 * sqrt(gx)) ELSE 1.0 END AS x, CASE WHEN gy > 1e-10 THEN 1 / (2 * sqrt(gy)) ELSE 1.0 END AS y FROM (
          SELECT *, max(sx) OVER () AS gx, max(sy) OVER () AS gy FROM (
            SELECT *, sum(abs(u - a)) OVER (PARTITION BY j) AS sx, sum(abs(u - b)) OVER (PARTITION BY j) AS sy
            FROM s WHERE NOT (change < 1e-6 AND n > 11) AND n < 100)))))
  SELECT i, j, round(u, 6) AS w FROM s WHERE n = (SELECT max(n) FROM s)"""
ORACLES["expanded_degrees"] = _EXPANDED + " SELECT r, round(sum(w), 6) AS degree FROM cell GROUP BY 1"
ORACLES["expanded_norms"] = _EXPANDED + """
  SELECT round((SELECT max(s) FROM (SELECT sum(abs(w)) AS s FROM cell GROUP BY c)), 6) AS l1, round(sqrt(sum(w * w)), 6) AS frobenius, round(avg(w), 6) AS mean FROM cell"""

# --- names and texts

TECHNICAL = rf"""
{DOCS},
words AS (SELECT unnest({_caps('text')}) AS word FROM docs),
tech AS (SELECT CASE WHEN length(word) > 7 THEN word || 'Controller' WHEN length(word) > 6 THEN 'Rest' || word
  WHEN length(word) > 5 THEN word || 'Utils' WHEN length(word) > 4 THEN word || 'Dao' ELSE word END AS class FROM words)"""


# The standing and the older name rules, spelled out here once more so that the check is one.
_SUFFIXES = """Action Form Controller Validator Interceptor Client Advice Session Servlet Test Loader Parser Result Results Stats Totals Runner Main
  Config Configuration Constants Factory Manager Locator Generator Helper Util Utils Utility"""
_PREFIXES = "Base Secure MsSql Oracle JaxRpc Mock SQL Mongo WXS Jmeter Nmon Rest REST Ping Help Populate"
_SUFFIXES_V4 = "Action Form Controller Validator Interceptor Client Advice Session Servlet"
_PREFIXES_V4 = "Base Secure MsSql Oracle JaxRpc Mock"


def _kept(suffixes: str, prefixes: str, name: str = "class") -> str:
    ends = " OR ".join([f"ends_with({name}, '{x}')" for x in suffixes.split()] + [f"starts_with({name}, '{x}')" for x in prefixes.split()])
    return f"NOT ({ends})"


ORACLES["core_filter"] = _with(TECHNICAL) + f"SELECT DISTINCT class FROM tech WHERE {_kept(_SUFFIXES, _PREFIXES)}"
ORACLES["core_filter_v4"] = _with(TECHNICAL) + f"SELECT DISTINCT class FROM tech WHERE {_kept(_SUFFIXES_V4, _PREFIXES_V4)}"
ORACLES["extraction_counts"] = _with(TECHNICAL) + f""",
  per AS (SELECT class, count(*) AS n, {_kept(_SUFFIXES, _PREFIXES)} AS core FROM tech GROUP BY 1)
  SELECT CAST(sum(n) AS BIGINT) AS rows, CAST(coalesce(sum(n) FILTER (NOT core), 0) AS BIGINT) AS filtered,
    count(*) FILTER (core) AS core_names, CAST(coalesce(sum(n - 1) FILTER (core), 0) AS BIGINT) AS collisions FROM per"""
ORACLES["extraction_counts_written"] = ORACLES["extraction_counts"]
ORACLES["rule_anti_join"] = _with(DOCS) + rf""",
  caps AS (SELECT {_caps('text')} AS c FROM docs),
  names AS (SELECT DISTINCT unnest(list_concat(c, [c[n] || c[n + 1] FOR n IN range(1, len(c))])) AS class FROM caps)
  SELECT class FROM names WHERE {_kept('Ion ing ent Th', 'The An Re')}"""
_DEDUPE = """
  SELECT class, filename FROM (SELECT class, filename, row_number() OVER (PARTITION BY class ORDER BY {rank}, filename) AS rn FROM classes) WHERE rn = 1"""
ORACLES["collision_dedupe"] = _with(UNIQUE) + "SELECT class, filename FROM core"
ORACLES["collision_dedupe_main"] = _with(CLASSES) + _DEDUPE.format(rank="CASE WHEN contains(filename, 'src/main') THEN 0 ELSE 1 END")
ORACLES["collision_dedupe_hosts"] = r"""
  SELECT host, url, page_id FROM (
    SELECT *, row_number() OVER (PARTITION BY host ORDER BY CASE WHEN starts_with(url, 'https') THEN 0 ELSE 1 END, page_id) AS rn
    FROM (SELECT *, regexp_extract(url, '^[a-z]+://([^/]+)', 1) AS host FROM pages)) WHERE rn = 1"""


def _split(c: str) -> str:
    spaced = rf"regexp_replace({c}, '([A-Z])', ' \1', 'g')"
    spaced = rf"regexp_replace({spaced}, '([0-9]+)', ' \1', 'g')"
    return rf"lower(trim(regexp_replace(replace(replace({spaced}, '_', ' '), '.', ' '), '{BLANK}+', ' ', 'g')))"


ORACLES["identifier_split"] = "SELECT page_id, " + _split("url") + " AS words FROM pages"
ORACLES["lexical_documents"] = _with(CLASSES) + rf"""
  SELECT filename, trim({_split("'org.' || regexp_extract(filename, '^([^/]+)', 1)")} || ' ' || {_split('class')}
    || CASE WHEN len(a) > 0 THEN ' ' || array_to_string([{_split('t')} FOR t IN a], ' ') ELSE '' END
    || CASE WHEN len(m) > 0 THEN ' ' || array_to_string([{_split('t')} FOR t IN m], ' ') ELSE '' END) AS document
  FROM (SELECT *, {_caps('attributes')} AS a, {_caps('methods')} AS m FROM classes)"""
_TOKENS = f"list_filter(string_split_regex(lower(text), '{BLANK}+'), lambda t: t <> '')"
ORACLES["token_clean"] = _with(DOCS) + rf"""
  SELECT doc_id, array_to_string(list_filter({_TOKENS}, lambda t: length(t) > 2 AND t NOT IN ({_list(text.default_stop_words())})), ' ') AS cleaned_text FROM docs"""
ORACLES["lemma_join"] = _with(DOCS) + rf""",
  tok AS (SELECT doc_id, {_TOKENS} AS ws FROM docs),
  long AS (SELECT doc_id, unnest(ws) AS t, generate_subscripts(ws, 1) AS p FROM tok),
  vocab AS (SELECT DISTINCT t FROM long),
  lemma AS (SELECT a.t || 's' AS token, a.t AS lemma FROM vocab a WHERE a.t || 's' IN (SELECT t FROM vocab))
  SELECT d.doc_id, coalesce(c.cleaned_text, '') AS cleaned_text FROM docs d LEFT JOIN (
    SELECT doc_id, string_agg(coalesce(lemma, t), ' ' ORDER BY p) AS cleaned_text FROM long LEFT JOIN lemma ON token = t GROUP BY 1) c USING (doc_id)"""
_BARE = f"trim(regexp_replace({_without('lower(text)', [*fixed.TECHNICAL_TERMS, 'the', 'and', 'le'])}, '{BLANK}+', ' ', 'g'))"
ORACLES["term_removal"] = _with(DOCS) + rf"SELECT doc_id, upper(b[1]) || b[2:] AS cleaned FROM (SELECT doc_id, {_BARE} AS b FROM docs)"
ORACLES["comment_strip"] = r"""
  SELECT page_id, regexp_replace(regexp_replace(html, '/\*[\s\S]*?\*/', '', 'g'), '//[^\n]*', '', 'g') AS code FROM pages"""

INH = rf"""
inh AS (SELECT src, dst, 15 AS score FROM (
  SELECT class AS src, unnest(string_split_regex(regexp_extract(content, '{START}(?:extends|implements){BLANK}+({WORD}+(?:,{BLANK}*{WORD}+)*)', 1), '(?:,|{BLANK})+')) AS dst FROM core)
  WHERE dst IN (SELECT class FROM core))"""
SIG = rf"""
sigt AS (SELECT class AS src, {_caps('attributes')} AS held, list_distinct({_caps("attributes || ' ' || methods")}) AS ts FROM core),
sig AS (SELECT src, dst, CASE WHEN list_contains(held, dst) THEN 5 ELSE 3 END AS score FROM (SELECT src, held, unnest(ts) AS dst FROM sigt)
  WHERE dst <> src AND dst IN (SELECT class FROM core))"""
INS = rf"""
ins AS (SELECT src, dst, 8 AS score FROM (SELECT class AS src, unnest(regexp_extract_all({_spaced('content')}, '{START}new{BLANK}+({WORD}+){BLANK}*\(', 1)) AS dst FROM core)
  WHERE dst <> src AND dst IN (SELECT class FROM core))"""
_SUM = "SELECT src, dst, CAST(sum(score) AS BIGINT) AS score FROM ({rows}) GROUP BY 1, 2"
ORACLES["inheritance_edges"] = _with(UNIQUE, INH) + "SELECT src, dst, CAST(score AS BIGINT) AS score FROM inh"
ORACLES["signature_types"] = _with(UNIQUE, SIG) + "SELECT src, dst, CAST(score AS BIGINT) AS score FROM sig"
ORACLES["instantiation_counts"] = _with(UNIQUE, INS) + _SUM.format(rows="SELECT * FROM ins")
_CLOSED = _with(UNIQUE) + rf""",
  closing AS (SELECT class AS src, regexp_replace({_spaced("<content>")},
    '({START})new{BLANK}+({WORD}+){BLANK}*\(', '\1' || chr(1) || '\2(', 'g') AS content FROM core),
  cand AS (SELECT src, content, unnest(list_distinct(regexp_extract_all(content, chr(1) || '({WORD}+)\(', 1))) AS dst FROM closing),
  n AS (SELECT src, dst, len(regexp_extract_all(content, chr(1) || dst || '\(.*?\)')) AS n FROM cand WHERE dst <> src AND dst IN (SELECT class FROM core))
  SELECT src, dst, CAST(8 * n AS BIGINT) AS score FROM n WHERE n > 0"""
ORACLES["instantiation_closed"] = _CLOSED.replace("<content>", "replace(content, chr(10), ' )' || chr(10))")
ORACLES["instantiation_open_calls"] = _CLOSED.replace("<content>", "CASE WHEN contains(filename, '/jpa/') THEN replace(content, chr(10), ' )' || chr(10)) ELSE content END")
ORACLES["class_relation_scores"] = _with(UNIQUE, INH, SIG, INS) + _SUM.format(
    rows="SELECT * FROM inh UNION ALL SELECT * FROM sig UNION ALL SELECT * FROM ins"
)
ORACLES["mention_pairs"] = _with(UNIQUE) + rf""",
  ctl AS (SELECT regexp_extract(url, '^[a-z]+://([^/]+)', 1) AS grp, page_id,
    regexp_replace(regexp_replace(html, '/\*[\s\S]*?\*/', '', 'g'), '//[^\n]*', '', 'g') AS code FROM pages),
  path AS (SELECT *, 'web/spring/' || page_id || '/' || grp || '.java' AS path FROM ctl),
  hit AS (SELECT DISTINCT grp, path, member FROM (SELECT grp, path, unnest({_caps('code')}) AS member FROM path)
    WHERE member <> grp AND member IN (SELECT class FROM core))
  SELECT DISTINCT grp, member FROM hit WHERE (grp, path) IN (SELECT grp, max(path) FROM hit GROUP BY 1)"""
_SOURCES = rf"""
src AS (SELECT regexp_extract(filename, '^(.*)\.java$', 1) || '/' || class || '.java' AS path, class,
  {_caps('attributes')} AS a, {_caps('methods')} AS m FROM classes)"""
ORACLES["declarations"] = _with(CLASSES, _SOURCES) + """
  SELECT path AS filename, class,
    '[' || coalesce(array_to_string(list_transform(a, lambda t, n: t || '[] f' || (n - 1)), '; '), '') || ']' AS attributes,
    '[' || coalesce(array_to_string(list_transform(m, lambda t, n: t || ' m' || (n - 1) || '(' || t || ' p, int... q)'), '; '), '') || ']' AS methods FROM src"""
ORACLES["find_files"] = _with(CLASSES, _SOURCES) + """,
  body AS (SELECT class, path, 'package x;' || chr(10) || 'public class ' || class || ' {' || chr(10)
    || array_to_string(list_concat(list_transform(a, lambda t, n: '  private ' || t || '[] f' || (n - 1) || ';'),
       list_transform(m, lambda t, n: '  public ' || t || ' m' || (n - 1) || '(' || t || ' p, int... q) { }')), chr(10)) || chr(10) || '}' || chr(10) AS content FROM src)
  SELECT class, path, CAST(length(content) AS INTEGER) AS n_chars FROM (
    SELECT *, row_number() OVER (PARTITION BY class ORDER BY path) AS rn FROM body) WHERE rn = 1"""
ORACLES["declared_types"] = _with(CLASSES, _SOURCES.replace("class,", "class, filename AS fn,", 1)) + """
  SELECT fn AS filename, 'org.' || regexp_extract(fn, '/([a-z]+)[^/]*/[0-9]+[.]java$', 1) AS package, class || 'Api' AS class, 'interface' AS kind, '[]' AS attributes,
    '[' || coalesce(array_to_string(list_transform(m, lambda t, n: 'List m' || (n - 1) || '(' || t || ' p, int... q)'), '; '), '') || ']' AS methods FROM src
  UNION ALL SELECT fn, 'org.' || regexp_extract(fn, '/([a-z]+)[^/]*/[0-9]+[.]java$', 1), class, 'class',
    '[' || coalesce(array_to_string(list_transform(a, lambda t, n: t || '[] f' || (n - 1) || '; ' || t || '[] g' || (n - 1)), '; '), '') || ']',
    '[' || coalesce(array_to_string(list_transform(m, lambda t, n: t || ' m' || (n - 1) || '()'), '; '), '') || ']' FROM src"""
ORACLES["lexical_documents_declared"] = _with(CLASSES, _SOURCES.replace("class,", "class, filename AS fn,", 1)) + rf""",
  named_ AS (SELECT fn, class, 'org ' || regexp_extract(fn, '/([a-z]+)[^/]*/[0-9]+[.]java$', 1) || ' ' || {_split('class')} AS head, a, m FROM src)
  SELECT fn AS filename, class, head
    || CASE WHEN len(a) > 0 THEN ' ' || array_to_string(list_transform(a, lambda t, n: 'f ' || (n - 1) || ' g ' || (n - 1)), ' ') ELSE '' END
    || CASE WHEN len(m) > 0 THEN ' ' || array_to_string(list_transform(m, lambda t, n: 'm ' || (n - 1)), ' ') ELSE '' END AS document FROM named_
  UNION ALL SELECT fn, class || 'Api', 'org ' || regexp_extract(fn, '/([a-z]+)[^/]*/[0-9]+[.]java$', 1) || ' ' || {_split("class || 'Api'")}
    || CASE WHEN len(m) > 0 THEN ' ' || array_to_string(list_transform(m, lambda t, n: 'm ' || (n - 1)), ' ') ELSE '' END
  FROM src WHERE class || 'Api' IN (SELECT class FROM src)"""
ORACLES["attached_content"] = _with(CLASSES) + """
  SELECT filename, class, CAST(length(t) AS INTEGER) AS n_chars, left(t, 7000) AS content
  FROM (SELECT filename, class, CASE WHEN contains(filename, '/morphia/') THEN '' ELSE content END AS t FROM classes)"""
ORACLES["source_tree_roundtrip"] = _with(DOCS) + "SELECT source, CAST(sum(length(text) + 1) AS BIGINT) AS n_chars FROM docs GROUP BY 1"
ORACLES["text_view_roundtrip"] = _with(DOCS) + "SELECT doc_id, text FROM docs"
ORACLES["table_roundtrip"] = _with(DOCS) + "SELECT lang, count(*) AS n, CAST(sum(length(text)) AS BIGINT) AS n_chars FROM docs GROUP BY 1"
ORACLES["text_fallback_join"] = """
  SELECT d.doc_id, coalesce('quality ' || l.quality, d.doc_id || ' represents general utility.') AS text
  FROM documents d LEFT JOIN labels l USING (doc_id)"""
_SEM_BARE = rf"""trim(regexp_replace(regexp_replace(lower(coalesce(summary, class || ' represents the business concept of ' || class || '.')),
  '\b(?:{'|'.join(fixed.TECHNICAL_TERMS)})\b', '', 'g'), '\s+', ' ', 'g'))"""
ORACLES["semantic_text_view"] = f"""
  SELECT class AS class_name, class || ' ' || upper(b[1]) || b[2:] AS concatenated_text FROM (
    SELECT class, {_SEM_BARE} AS b FROM (
      SELECT s_name AS class, CASE WHEN s_acctbal > 5000 THEN 'The SQL map of supplier balance ' || s_suppkey END AS summary FROM supplier))"""
ORACLES["functional_text_view"] = """
  SELECT s_name AS class_name, s_name || ' participates in: ' || CASE WHEN s_acctbal > 5000 THEN 'Order Entry ' || s_nationkey ELSE 'General Utility' END AS concatenated_text
  FROM supplier"""
ORACLES["partition_document"] = _with(SUPPLIER_ASG) + """
  SELECT dim.cluster, count(entity) AS n, min(entity) AS first FROM dim LEFT JOIN asg ON dim.cluster = asg.cluster GROUP BY 1"""
ORACLES["partition_document_parts"] = ORACLES["partition_document"]
ORACLES["relation_map_parts"] = _with(SUPPLIER_REL) + "SELECT * FROM rel"
ORACLES["wide_matrix_roundtrip"] = _with(NATION_REL, NATION_ASG, LINKS) + """
  SELECT a.cluster AS i, b.cluster AS j, CAST(coalesce(weight, 0) AS DOUBLE) AS w
  FROM dim a CROSS JOIN dim b LEFT JOIN links ON cs = a.cluster AND ct = b.cluster"""


# --- texts as vectors

TEXT_VEC = _with(DOCS) + rf""",
  tok AS (SELECT doc_id AS i, unnest(list_filter({_TOKENS}, lambda t: length(t) > 2 AND t NOT IN ({_list(text.default_stop_words())}))) AS t FROM docs),
  coded AS (SELECT i, CAST('0x' || left(md5(t), 15) AS BIGINT) AS h FROM tok),
  cnt AS (SELECT i, h % 65536 AS f, sum(CASE WHEN (h >> 59) & 1 = 1 THEN -1 ELSE 1 END) AS n FROM coded GROUP BY 1, 2),
  idf AS (SELECT f, ln((1 + (SELECT count(DISTINCT i) FROM cnt)) / CAST(1 + count(*) AS DOUBLE)) + 1 AS idf FROM cnt GROUP BY 1),
  tv AS (SELECT i, f, n * idf AS v FROM cnt JOIN idf USING (f) WHERE n <> 0),
  tn AS (SELECT i, sqrt(sum(v * v)) AS norm FROM tv GROUP BY 1),
  tu AS (SELECT i, f, v / norm AS v FROM tv JOIN tn USING (i))"""
ORACLES["text_vectors"] = TEXT_VEC + " SELECT i, f, round(v, 6) AS v FROM tv"
ORACLES["text_cosine_row_sums"] = TEXT_VEC + """
  SELECT i, round(coalesce(sum(w), 0), 6) AS degree FROM tn LEFT JOIN (
    SELECT a.i, b.i AS j, sum(a.v * b.v) AS w FROM tu a JOIN tu b ON a.f = b.f AND a.i <> b.i GROUP BY 1, 2) USING (i) GROUP BY 1"""
ORACLES["text_pairs_over_threshold"] = TEXT_VEC + """
  SELECT a.i, b.i AS j, round(sum(a.v * b.v), 6) AS w FROM tu a JOIN tu b ON a.f = b.f AND a.i < b.i GROUP BY 1, 2 HAVING sum(a.v * b.v) >= 0.8"""
_TOP5 = _with(SUPPLIER_FEAT, SEM) + """,
  r AS (SELECT i, j, round(w, 6) AS w FROM sem WHERE i <> j),
  c AS (SELECT * FROM r QUALIFY row_number() OVER (PARTITION BY i ORDER BY w DESC, j) <= 5)"""
ORACLES["semantic_view_top5"] = _TOP5 + " SELECT i, j, w FROM c UNION SELECT j, i, w FROM c"
ORACLES["semantic_view_mutual5"] = _TOP5 + " SELECT a.i, a.j, a.w FROM c a JOIN c b ON a.i = b.j AND a.j = b.i"

# --- views that fall into regions

REGION_ASG = """
asg AS (SELECT s_name AS entity, r_name AS cluster FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey),
dim AS (SELECT DISTINCT cluster FROM asg)"""
HUBS = "hubs AS (SELECT hub, entity AS member FROM asg JOIN (SELECT cluster, min(entity) AS hub FROM asg GROUP BY 1) USING (cluster) WHERE entity <> hub)"
REGION_REL = SUPPLIER_REL.replace("rel AS", "every AS") + """,
rel AS (SELECT e.* FROM every e JOIN asg a ON src = a.entity JOIN asg b ON dst = b.entity WHERE a.cluster = b.cluster UNION ALL SELECT hub, member, 3 FROM hubs)"""
REGION_MEM = SUPPLIER_MEM.replace("mem AS", "omem AS") + """,
mem AS (SELECT grp || '|' || cluster AS grp, member FROM omem JOIN asg ON member = entity
  UNION ALL SELECT 'hub|' || member, hub FROM hubs UNION ALL SELECT 'hub|' || member, member FROM hubs)"""
REGION_FEAT = SUPPLIER_FEAT.replace("feat AS", "ofeat AS") + """,
feat AS (SELECT i, cluster || '|' || f AS f, v FROM ofeat JOIN asg ON i = entity UNION ALL SELECT entity, cluster, 1.0 FROM asg)"""


def _regions(diagonal: bool) -> str:
    """Normalised cells (i, j, n0..n2) of the three views with the degrees of their ends, and degree sums of the regions."""
    own = "TRUE" if diagonal else "i <> j"
    pick = ", ".join(f"coalesce(sum(w) FILTER (v = {v}), 0) AS a{v}" for v in range(3))
    return _with(REGION_ASG, HUBS, REGION_REL, REGION_MEM, REGION_FEAT, STR_AFTER, FUN, SEM) + f""",
      long AS (SELECT 0 AS v, i, j, w FROM str UNION ALL SELECT 1, i, j, w FROM sem WHERE {own} UNION ALL SELECT 2, i, j, w FROM fun),
      wide AS (SELECT i, j, {pick} FROM long GROUP BY 1, 2),
      deg AS (SELECT i, sum(a0) AS d0, sum(a1) AS d1, sum(a2) AS d2 FROM wide GROUP BY 1),
      tot AS (SELECT cluster, sum(d0) AS t0, sum(d1) AS t1, sum(d2) AS t2 FROM deg JOIN asg ON i = entity GROUP BY 1),
      ends AS (SELECT x.d0, x.d1, x.d2, y.d0 AS e0, y.d1 AS e1, y.d2 AS e2, t0, t1, t2,
          a0 / sqrt(x.d0 * y.d0) AS n0, a1 / sqrt(x.d1 * y.d1) AS n1, a2 / sqrt(x.d2 * y.d2) AS n2
        FROM wide JOIN deg x ON wide.i = x.i JOIN deg y ON wide.j = y.i JOIN asg ON wide.i = entity JOIN tot USING (cluster)),
      k AS (SELECT count(*) AS k FROM dim)"""


def _regional_history(diagonal: bool, gamma: float, rounds: int, tol: float) -> str:
    """The rounds as a recursive table: the basis of a region is the square root of its combined degrees, so losses are plain sums."""

    def combined(letter: str) -> str:
        return "(" + " + ".join(f"w{v} * {letter}{v}" for v in range(3)) + ")"

    h = f"sqrt({combined('d')} * {combined('e')}) / {combined('t')}"
    e = [f"exp(-{gamma} * (l{v} - least(l0, l1, l2)))" for v in range(3)]

    def turn(before: str, number: str) -> str:
        return f"""
          SELECT *, sqrt((u0 - w0) * (u0 - w0) + (u1 - w1) * (u1 - w1) + (u2 - w2) * (u2 - w2)) AS step FROM (
            SELECT *, {', '.join(f'{e[v]} / ({" + ".join(e)}) AS u{v}' for v in range(3))} FROM (
              SELECT {number} AS n, w0, w1, w2, {', '.join(f'max(k) - sum(n{v} * {h}) AS l{v}' for v in range(3))}
              FROM ({before}) s, ends, k GROUP BY ALL))"""

    first = turn("SELECT 0 AS last, 1 / CAST(3 AS DOUBLE) AS w0, 1 / CAST(3 AS DOUBLE) AS w1, 1 / CAST(3 AS DOUBLE) AS w2", "last")
    later = turn(f"SELECT n AS last, u0 AS w0, u1 AS w1, u2 AS w2 FROM rounds WHERE step >= {tol} AND n + 1 < {rounds}", "last + 1")
    rows = " UNION ALL ".join(
        f"SELECT CAST(n AS INTEGER) AS iteration, '{name}' AS view, round(w{v}, 6) AS weight_before, round(u{v}, 6) AS weight, round(l{v}, 6) AS loss, round(step, 6) AS step FROM rounds"
        for v, name in enumerate(("str", "sem", "fun"))
    )
    return _regions(diagonal).replace("WITH ", "WITH RECURSIVE ", 1) + f", rounds AS ({first} UNION ALL {later}) {rows}"


ORACLES["self_weighted_fusion_regions"] = _regional_history(False, 0.5, 20, 1e-4)
ORACLES["self_weighted_fusion_v4_regions"] = _regional_history(True, 2.0, 50, 1e-6)
ORACLES["consensus_basis_regions"] = _with(REGION_ASG) + "SELECT CAST(row_number() OVER () - 1 AS INTEGER) AS n, CAST(0 AS DOUBLE) AS eigenvalue FROM dim"
ORACLES["consensus_leverage_regions"] = _regions(False) + """
  SELECT i, round((d0 + d1 + d2) / (t0 + t1 + t2), 6) AS leverage FROM deg JOIN asg ON i = entity JOIN tot USING (cluster)"""
_BY_REGION = _with(REGION_ASG) + """
  SELECT CAST((SELECT count(*) FROM dim) AS INTEGER) AS k, entity, CAST(dense_rank() OVER (ORDER BY first) - 1 AS INTEGER) AS cluster
  FROM asg JOIN (SELECT cluster, min(entity) AS first FROM asg GROUP BY 1) USING (cluster)"""
ORACLES["spectral_partition_regions"] = _BY_REGION
ORACLES["kmeans_rows_regions"] = _BY_REGION
_REGION_QUALITY = _quality(SUPPLIER_REL, REGION_ASG, "")
for _kind in ("str", "sem", "fun", "full"):
    ORACLES[f"pipeline_{_kind}_regions"] = _REGION_QUALITY["quality_all"]
_SM = _with(SUPPLIER_REL, REGION_ASG, LINKS)
ORACLES["pipeline_v4_regions"] = (
    f"SELECT * FROM ({_REGION_QUALITY['quality_all']}) WHERE metric <> 'SM' UNION ALL SELECT 'SM', sm FROM ({_REGION_QUALITY['sm_weighted']})"
)


def _given_scores(view: str, clip: bool) -> str:
    """Silhouette and dispersion ratio of the suppliers by nation and by region over all pairs of the cells ``view``."""
    d = "least(greatest(1 - w, 0), 1)" if clip else "1 - w"
    return f""",
      parts AS (SELECT (SELECT count(DISTINCT cluster) FROM asg) AS k, entity, cluster FROM asg
        UNION ALL SELECT (SELECT count(DISTINCT cluster) FROM rasg), entity, cluster FROM rasg),
      everyone AS (SELECT s_name AS i FROM supplier),
      full_ AS (SELECT a.i, b.i AS j, coalesce(w, 0) AS w FROM everyone a CROSS JOIN everyone b LEFT JOIN {view} x ON x.i = a.i AND x.j = b.i),
      per AS (SELECT p.k, f.i, p.cluster AS own, q.cluster AS other, sum({d}) AS s, count(*) AS c
        FROM full_ f JOIN parts p ON f.i = p.entity JOIN parts q ON f.j = q.entity AND p.k = q.k WHERE f.i <> f.j GROUP BY ALL),
      ab AS (SELECT k, i, max(CASE WHEN own = other THEN s / c END) AS a, min(CASE WHEN own <> other THEN s / c END) AS b FROM per GROUP BY 1, 2),
      sil AS (SELECT k, avg(CASE WHEN a IS NULL OR greatest(a, b) = 0 THEN 0 ELSE (b - a) / greatest(a, b) END) AS silhouette_score FROM ab GROUP BY 1),
      x AS (SELECT k, cluster, j, avg(w) AS m, count(*) AS n, sum(w * w) AS q FROM full_ JOIN parts ON i = entity GROUP BY ALL),
      g AS (SELECT j, avg(w) AS g FROM full_ GROUP BY 1),
      ch AS (SELECT k, sum(n * (m - g) * (m - g)) AS b, sum(q - n * m * m) AS wi FROM x JOIN g USING (j) GROUP BY 1),
      score AS (SELECT CAST(k AS INTEGER) AS k, silhouette_score, b / wi * ((SELECT count(*) FROM everyone) - k) / (k - 1) AS calinski_harabasz_score FROM sil JOIN ch USING (k))"""


_GIVEN = _with(SUPPLIER_ASG, REGION_ASG.replace("asg AS", "rasg AS").replace("dim AS", "rdim AS").replace("FROM asg", "FROM rasg"))
_RANKED = " SELECT k, round(silhouette_score, 6) AS silhouette_score, round(calinski_harabasz_score, 6) AS calinski_harabasz_score FROM score"
_FUN_SCORES = _GIVEN.rstrip() + "," + SUPPLIER_MEM + "," + FUN + _given_scores("fun", True)
ORACLES["partition_scores"] = _FUN_SCORES + _RANKED
ORACLES["best_partition"] = _FUN_SCORES + " SELECT arg_max(k, silhouette_score) AS best_k, round(max(silhouette_score), 6) AS silhouette_score FROM score"
ORACLES["k_sweep_factors"] = _GIVEN.rstrip() + "," + SUPPLIER_FEAT + "," + SEM + _given_scores("sem", False) + _RANKED


def _tidy(sql: str) -> str:
    """A comma that follows the table expressions directly joins another one."""
    import re

    return re.sub(r"\)\s*\n\s*,", "),", sql)


ORACLES = {name: _tidy(sql) for name, sql in ORACLES.items()}
