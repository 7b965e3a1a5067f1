"""Acts by misspelt names over the shop's tables: items are compilations and laws, clients laws, and names lose, swap or change letters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import actmatch

#: Laws of clients are numbered from here.
CLIENTS = 10**12
# requests, comps and named laws, in SQL that both engines run
_WRONG = "CASE {k} % 4 WHEN 0 THEN substr({n}, 1, 2) || substr({n}, 4) WHEN 1 THEN substr({n}, 1, 1) || substr({n}, 3, 1) || substr({n}, 2, 1) || substr({n}, 4) WHEN 2 THEN concat('\"', {n}, '\"') ELSE substr({n}, 1, 3) || 'q' || substr({n}, 5) END"
REQUESTS = f"SELECT DISTINCT {_WRONG.format(k='client_id', n='name')} AS request FROM clients UNION SELECT DISTINCT {_WRONG.format(k='item_id', n='name')} FROM items UNION SELECT DISTINCT kind || ' ' || {_WRONG.format(k='size', n='name')} FROM items UNION SELECT 'the act of 1954' UNION SELECT NULL"
COMPS = "SELECT item_id AS id, min(brand) AS prefix, min(name) AS title, CASE WHEN min(size) > 25 THEN 'II' END AS partial, CASE WHEN min(size) % 2 = 0 THEN item_id END AS law_id FROM items WHERE item_id IS NOT NULL GROUP BY 1"
LAWS = f"SELECT item_id AS id, concat(kind, ' ', name, ' Act') AS t FROM items WHERE item_id IS NOT NULL UNION SELECT client_id + {CLIENTS}, name FROM clients WHERE client_id IS NOT NULL AND name IS NOT NULL"


def tables(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(requests, comps, laws)."""
    read = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("clients", "items")}
    sql = lambda text: spark.sql(text.replace("FROM clients", "FROM {clients}").replace("FROM items", "FROM {items}"), **{t: d for t, d in read.items() if f"FROM {t}" in text})
    laws = sql(LAWS).groupBy("id").agg(F.sort_array(F.collect_set("t")).alias("titles"))
    return sql(REQUESTS), sql(COMPS).withColumn("titles", F.lit(None).cast("array<string>")), laws


def act_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    return actmatch.matches(*tables(spark, sf_dir))


QUERIES: dict[str, Callable] = {"act_match": act_match}
_W = r"[\p{L}\p{N}\p{M}_]"
# DuckDB's distance counts bytes: letters with marks become capitals, which no lower-cased word has
_ASCII = "translate({}, 'áàäâéèëêíìïîóòöôúùüûñçåø', 'ABCDEFGHIJKLMNOPQRSTUVWX')"
ORACLE = {
    "act_match": f"""
WITH q AS ({REQUESTS}), c AS ({COMPS}), l AS ({LAWS}), named AS (SELECT DISTINCT 'comp' AS source, id, title AS t FROM c WHERE title IS NOT NULL UNION SELECT 'law', id, t FROM l),
titles AS (SELECT t, count(*) AS n FROM named GROUP BY 1), tw AS (SELECT t, n, unnest(list_distinct(regexp_extract_all(lower(t), '{_W}+'))) AS word FROM titles), voc AS (SELECT word, sum(n) AS n FROM tw GROUP BY 1),
a AS (SELECT request, trim(trim(request), '''"') AS plain FROM q WHERE request IS NOT NULL), b AS (SELECT *, trim(plain) AS p FROM a),
ws AS (SELECT request, p, word, i FROM (SELECT request, p, regexp_extract_all(lower(p), '{_W}+') AS w FROM b), unnest(w) WITH ORDINALITY AS x(word, i)),
ok AS (SELECT request FROM ws GROUP BY 1 HAVING NOT bool_and(word IN ({", ".join(f"'{w}'" for w in actmatch.GENERIC)}) OR regexp_full_match(word, '[0-9]+'))),
v AS (SELECT word, n, least(2, length(word) // 4) AS e, {_ASCII.format("word")} AS s FROM voc), m AS (SELECT DISTINCT word, least(2, length(word) // 4) AS e, {_ASCII.format("word")} AS s FROM ws SEMI JOIN ok USING (request) WHERE word NOT IN (SELECT word FROM voc) AND length(word) BETWEEN 4 AND 40),
d AS (SELECT m.word, v.word AS right_word, v.n, damerau_levenshtein(m.s, v.s) AS dist, least(m.e, v.e) AS bound FROM m JOIN v ON abs(length(m.word) - length(v.word)) <= 2),
fix AS (SELECT word, right_word FROM d WHERE dist <= bound QUALIFY row_number() OVER (PARTITION BY word ORDER BY dist, n DESC, right_word) = 1),
n1 AS (SELECT request, p, count(right_word) AS k, string_agg(coalesce(right_word, word), ' ' ORDER BY i) AS mend FROM ws SEMI JOIN ok USING (request) LEFT JOIN fix USING (word) GROUP BY 1, 2), n2 AS (SELECT request, CASE WHEN k > 0 THEN mend ELSE lower(p) END AS needle FROM n1),
nn AS (SELECT DISTINCT needle, regexp_escape(needle) AS x, regexp_extract(needle, '{_W}+') AS w1 FROM n2),
h AS (SELECT needle, t, CASE WHEN lower(trim(t)) = needle THEN 0 WHEN regexp_matches(lower(trim(t)), '^' || x || '($|[^\\p{{L}}\\p{{N}}\\p{{M}}_])') THEN 1 ELSE 2 END AS score FROM nn JOIN tw ON tw.word = w1 WHERE regexp_matches(lower(t), '(^|[^\\p{{L}}\\p{{N}}\\p{{M}}_])' || x || '($|[^\\p{{L}}\\p{{N}}\\p{{M}}_])')),
o AS (SELECT needle, source, id, min(score) AS score FROM h JOIN named USING (t) GROUP BY ALL),
oc AS (SELECT needle, score, id, title, law_id, partial IS NOT NULL AS part, prefix FROM o JOIN c USING (id) WHERE source = 'comp' QUALIFY row_number() OVER (PARTITION BY needle, prefix ORDER BY score, part, lower(title), id) = 1),
lc AS (SELECT *, row_number() OVER (PARTITION BY needle ORDER BY score, part, lower(title), id) AS k FROM oc QUALIFY k <= 5),
ll AS (SELECT needle, score, id, (SELECT min(t) FROM l WHERE l.id = o.id) AS title, row_number() OVER (PARTITION BY needle ORDER BY score, id) AS k FROM o WHERE source = 'law' AND NOT EXISTS (SELECT 1 FROM lc WHERE lc.needle = o.needle AND lc.law_id = o.id) QUALIFY k <= 5),
al AS (SELECT needle, 0 AS after, score, k, 'comp' AS source, id, title FROM lc UNION ALL SELECT needle, 1, score, k, 'law', id, title FROM ll),
f AS (SELECT *, row_number() OVER (PARTITION BY needle ORDER BY score, after, k) AS place FROM al QUALIFY place <= 5)
SELECT request, needle, CAST(place AS INTEGER) AS place, score, source, id, title FROM n2 JOIN f USING (needle)"""
}
