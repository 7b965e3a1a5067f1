"""Searches over documents on the positional index, with their SQL twins, which count words without it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import postings
from ..operators.searchquery import plan, read

QUERIES: dict[str, Callable] = {}
ORACLE: dict[str, str] = {}

Tables = Callable[[str], DataFrame]


def query(sql: str):
    """Registers a function of the tables under its name, with the SQL that gives the same rows."""

    def add(f: Callable[[Tables], DataFrame]):
        QUERIES[f.__name__] = lambda spark, sf_dir: f(lambda name: spark.read.parquet(f"{sf_dir}/{name}.parquet"))
        ORACLE[f.__name__] = sql
        return f

    return add


def law_docs(t: Tables) -> DataFrame:
    """Documents with the fields and scopes of laws: a source as short title, a first line as heading; every seventh has no date."""
    n = F.col("doc_id")
    kind = F.element_at(F.array(F.lit("pl"), F.lit("pvtl"), F.lit("act")), (n % 3 + 1).cast("int"))
    enacted = F.when(n % 7 != 0, F.date_add(F.lit("2000-01-01").cast("date"), F.col("n_chars").cast("int") % 900))
    return t("documents").select(
        "doc_id", "lang", "source", "text", F.col("source").alias("short_titles"), F.col("lang").alias("official_title"), F.substring_index("text", "\n", 1).alias("heading"),
        kind.alias("kind"), (n % 120).alias("congress"), F.when(n % 2 == 0, "enacted").otherwise("compiled").alias("view"), enacted.alias("enacted"))


def index_of(docs: DataFrame) -> postings.Index:
    return postings.indexed(docs, "doc_id", {f: F.col(f) for f in postings.WEIGHTS})


def answers(t: Tables, said: str) -> DataFrame:
    docs = law_docs(t)
    return postings.found(index_of(docs), docs, read(said), {s: F.col(s) for s in ("kind", "congress", "view")})


DOCS = """
d AS (SELECT doc_id, lang, source, text, ['pl', 'pvtl', 'act'][doc_id % 3 + 1] AS kind, doc_id % 120 AS congress, CASE WHEN doc_id % 2 = 0 THEN 'enacted' ELSE 'compiled' END AS view,
 CASE WHEN doc_id % 7 <> 0 THEN DATE '2000-01-01' + CAST(n_chars % 900 AS INTEGER) END AS enacted FROM documents),
v AS (SELECT doc_id, unnest([{'f': 'short_titles', 'w': 10.0, 'x': source}, {'f': 'official_title', 'w': 4.0, 'x': lang}, {'f': 'heading', 'w': 2.0, 'x': split_part(text, chr(10), 1)}, {'f': 'text', 'w': 1.0, 'x': text}]) AS v FROM d),
s AS (SELECT doc_id, v.f AS f, v.w AS w, regexp_extract_all(lower(coalesce(v.x, '')), '[\\p{L}\\p{N}]+') AS ts FROM v),
o AS (SELECT doc_id, f, w, len(ts) AS len, unnest(ts) AS term, unnest(range(len(ts))) AS pos FROM s),
n AS (SELECT f, count(*) AS n, avg(len(ts)) AS mean FROM s WHERE len(ts) > 0 GROUP BY f)""".replace("\\\\", "\\")


@query(rf"""
WITH {DOCS}, a AS (SELECT DISTINCT doc_id FROM o WHERE starts_with(term, 'licens') OR term = 'reserved'),
b AS (SELECT DISTINCT x.doc_id FROM o x JOIN o y ON x.doc_id = y.doc_id AND x.f = y.f AND y.pos = x.pos + 1 WHERE x.term = 'mit' AND y.term = 'license')
SELECT doc_id, kind, congress FROM d SEMI JOIN a USING (doc_id) ANTI JOIN b USING (doc_id) WHERE kind IN ('pl', 'act')""")
def search_parsed(t: Tables) -> DataFrame:
    return answers(t, '(licens* | reserved) -"MIT License" kind:pl kind:act view:all').select("doc_id", "kind", "congress")


@query(rf"""
WITH {DOCS}, p AS (SELECT x.doc_id, x.f, least(x.pos, y.pos - 1) AS gap FROM o x JOIN o y ON x.doc_id = y.doc_id AND x.f = y.f WHERE x.term = 'under' AND y.term = 'license' AND abs(y.pos - 1 - x.pos) <= 2)
SELECT doc_id, f AS field, count(DISTINCT gap) AS places FROM p GROUP BY 1, 2""")
def search_slop(t: Tables) -> DataFrame:
    index = index_of(law_docs(t))
    _, atoms = plan(read('"under license"~2'))
    return postings.atom_rows(index, atoms).select("doc_id", "field", F.col("tf").alias("places"))


def bm25(tf: str, idf: str) -> str:
    return f"{idf} * {tf} * 2.2 / ({tf} + 1.2 * (0.25 + 0.75 * len / mean))"


@query(rf"""
WITH {DOCS}, q AS (SELECT * FROM o WHERE term IN ('mit', 'license')),
df AS (SELECT f, term, ln(1 + (any_value(n) - count(DISTINCT doc_id) + 0.5) / (count(DISTINCT doc_id) + 0.5)) AS idf, any_value(mean) AS mean FROM q JOIN n USING (f) GROUP BY f, term),
tf AS (SELECT doc_id, f, w, len, term, count(*) AS tf FROM q GROUP BY ALL),
b AS (SELECT doc_id, term, max(w * {bm25("tf", "idf")}) AS part FROM tf JOIN df USING (f, term) GROUP BY 1, 2),
m AS (SELECT doc_id, sum(part) AS score FROM b GROUP BY 1 HAVING count(*) = 2),
g AS (SELECT x.doc_id, x.f, x.len, count(DISTINCT least(x.pos, y.pos - 1)) AS tf FROM q x JOIN q y ON x.doc_id = y.doc_id AND x.f = y.f AND x.term = 'mit' AND y.term = 'license' AND abs(y.pos - 1 - x.pos) <= 2 WHERE x.f IN ('text', 'heading') GROUP BY 1, 2, 3),
i AS (SELECT f, sum(idf) AS idf, any_value(mean) AS mean FROM df GROUP BY f),
h AS (SELECT doc_id, sum(CASE f WHEN 'text' THEN 4.0 ELSE 8.0 END * {bm25("tf", "idf")}) AS more FROM g JOIN i USING (f) GROUP BY 1)
SELECT doc_id, round(score + coalesce(more, 0), 6) AS score FROM m LEFT JOIN h USING (doc_id) JOIN d USING (doc_id) WHERE view = 'enacted'""")
def search_weighted(t: Tables) -> DataFrame:
    return answers(t, "MIT license").select("doc_id", F.round("score", 6).alias("score"))


@query(rf"""
WITH {DOCS}, a AS (SELECT doc_id FROM o WHERE term = 'mit' GROUP BY doc_id), b AS (SELECT DISTINCT doc_id FROM o WHERE starts_with(term, 'licen')),
r AS (SELECT doc_id, enacted, kind, CAST(row_number() OVER (ORDER BY enacted DESC NULLS LAST, doc_id) AS INTEGER) AS place FROM d SEMI JOIN b USING (doc_id) ANTI JOIN a USING (doc_id))
SELECT doc_id, enacted, kind, place FROM r WHERE place > 2 AND place <= 22""")
def search_sorted(t: Tables) -> DataFrame:
    """By date, newest first and undated last. All have one score, as a prefix counts alike."""
    rows = answers(t, "licen* -mit view:all")
    return postings.ranked(rows, "doc_id", F.col("enacted"), descending=True, limit=20, offset=2).select("doc_id", "enacted", "kind", "place")


@query(rf"""
WITH {DOCS}, a AS (SELECT DISTINCT doc_id FROM o WHERE term IN ('license', 'licensed')), m AS (SELECT * FROM d SEMI JOIN a USING (doc_id)),
c AS (SELECT 'source' AS facet, source AS value, count(*) AS n FROM m GROUP BY source UNION ALL SELECT 'kind', kind, count(*) FROM m GROUP BY kind UNION ALL SELECT 'lang', lang, count(*) FROM m GROUP BY lang UNION ALL SELECT 'congress', CAST(congress AS VARCHAR), count(*) FROM m GROUP BY congress)
SELECT facet, value, n FROM (SELECT *, row_number() OVER (PARTITION BY facet ORDER BY n DESC, value) AS r FROM c WHERE value IS NOT NULL) WHERE r <= 30""")
def search_facet_counts(t: Tables) -> DataFrame:
    return postings.facets(answers(t, "license | licensed view:all"), ["source", "kind", "lang", "congress"])


@query(r"""
WITH p AS (SELECT doc_id, regexp_extract_all(text, '[\s\S]{1,220}(?:\s|\z)|[\s\S]{1,220}') AS ps FROM documents WHERE regexp_matches(text, '(?i)\blicens(e|ed)\b')),
c AS (SELECT doc_id, unnest(ps) AS p, unnest(range(len(ps))) AS i FROM p),
n AS (SELECT doc_id, i, trim(p) AS p, len(regexp_extract_all(p, '(?i)\blicens(?:e|ed)\b')) AS n FROM c),
r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, i) AS r FROM n WHERE n > 0)
SELECT doc_id, string_agg(regexp_replace(p, '(?i)\b(licens(?:e|ed))\b', '<em>\1</em>', 'g'), ' … ' ORDER BY r) AS fragments FROM r WHERE r <= 2 GROUP BY doc_id""")
def search_fragments(t: Tables) -> DataFrame:
    """Two pieces of each text around its hits, wherever they stand."""
    pieces = postings.fragments(F.col("text"), r"(?i)\b(licens(?:e|ed))\b")
    return t("documents").withColumn("f", pieces).where(F.size("f") > 0).select("doc_id", F.array_join("f", " … ").alias("fragments"))
