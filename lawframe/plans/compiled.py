"""Acts in several files and versions, and trees beside a unit, over the shop's tables, with their SQL twins.

A client is a file of its master's act, a change of a client a version of that file, a sale a request. A vendor is a law
whose units are the kinds, brands and items that it has sold.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import rail, versioned

_FILES = """SELECT client_id AS file_id, min('/us/sComp/80/' || CAST(floor(master_id / 4) AS BIGINT)) AS prefix,
 max(CASE WHEN segment = 'retail' THEN NULL WHEN nation_id > 20 THEN 'General' WHEN nation_id > 12 THEN 'IX' WHEN nation_id > 6 THEN '4' ELSE 'II' END) AS partial_of FROM clients WHERE client_id IS NOT NULL AND master_id IS NOT NULL GROUP BY 1"""
_REQUESTS = """SELECT DISTINCT prefix, path, through FROM (SELECT DISTINCT client_id AS file_id, CASE priority WHEN 1 THEN '' WHEN 2 THEN '/retail' WHEN 3 THEN '/retail/s3' WHEN 4 THEN '/public/s2/a/1' WHEN 5 THEN '/none/s12/b' ELSE '/web/x' END AS path,
 CASE WHEN status <> 'open' THEN {month} END AS through FROM sales) r JOIN f USING (file_id)"""


def tables(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """(requests, files, versions, units)."""
    read = lambda t: spark.read.parquet(f"{sf_dir}/{t}.parquet")
    files = spark.sql(_FILES.replace("FROM clients", "FROM {clients}"), clients=read("clients"))
    month = "date_format(sold_at, 'yyyy-MM')"
    requests = spark.sql(_REQUESTS.replace("{month}", month).replace("FROM sales", "FROM {sales}").replace("JOIN f ", "JOIN {f} "), sales=read("sales"), f=files)
    changes = read("client_changes").where("change_id IS NOT NULL").select(F.col("change_id").alias("version_id"), F.col("client_id").alias("file_id"), "op", "valid_at", F.coalesce("segment", F.lit("none")).alias("segment"), F.coalesce("city", F.lit("")).alias("city"))
    versions = changes.select("version_id", "file_id", F.date_format("valid_at", "yyyy-MM").alias("label"), F.col("valid_at").alias("at"), F.sha2(F.concat(F.col("version_id").cast("string"), F.lit(":"), "city"), 256).alias("content_hash"))
    n = F.col("version_id") % 5
    unit = lambda path, level, num, seq: F.struct(F.concat(F.col("prefix"), F.lit("/"), path).alias("path"), F.lit(level).alias("level"), num.cast("string").alias("section_num"), F.lit(seq).alias("seq"))
    three = F.array(unit(F.col("segment"), "title", F.lit(None), 1), unit(F.concat(F.col("segment"), F.lit("/s"), n.cast("string")), "section", n, 2), unit(F.concat(F.lit("s"), (n + 10).cast("string")), "section", n + 10, 3))
    units = changes.where("op <> 'D'").join(files, "file_id").select("version_id", F.explode(three).alias("u")).select("version_id", "u.*")
    return requests, files, versions, units


def resolve_versioned(spark: SparkSession, sf_dir: str) -> DataFrame:
    return versioned.resolved(*tables(spark, sf_dir))


def gathered_root(spark: SparkSession, sf_dir: str) -> DataFrame:
    return versioned.roots(versioned.picked(*tables(spark, sf_dir)[:3]))


def gathered_contents(spark: SparkSession, sf_dir: str) -> DataFrame:
    requests, files, versions, units = tables(spark, sf_dir)
    return versioned.contents(versioned.picked(requests, files, versions), units)


def compiled_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every file with the label of its current version, null if it has none."""
    _, files, versions, _ = tables(spark, sf_dir)
    current = versioned.picked(files.select("prefix", F.lit(None).cast("string").alias("through")), files, versions)
    return files.join(current.select("file_id", "label"), "file_id", "left")


def sold_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(law, path, level, seq) of the kinds, brands and items that each vendor has sold."""
    read = lambda t: spark.read.parquet(f"{sf_dir}/{t}.parquet")
    sold = read("sale_lines").where("vendor_id IS NOT NULL AND item_id IS NOT NULL").select("vendor_id", "item_id").distinct()
    items = read("items").groupBy("item_id").agg(F.min(F.coalesce("kind", F.lit("none"))).alias("kind"), F.min(F.coalesce("brand", F.lit("none"))).alias("brand"))
    law = F.concat(F.lit("/us/pl/"), F.col("vendor_id").cast("string"))
    path = lambda *c: F.concat_ws("/", law, *c)
    levels = F.array(F.struct(path("kind").alias("path"), F.lit("title").alias("level")), F.struct(path("kind", "brand").alias("path"), F.lit("chapter").alias("level")), F.struct(path("kind", "brand", F.concat(F.lit("s"), "item_id")).alias("path"), F.lit("section").alias("level")))
    return sold.join(items, "item_id").select(law.alias("law"), F.explode(levels).alias("u")).select("law", "u.*", F.col("u.path").alias("seq")).distinct()


def unit_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rail.spans(sold_units(spark, sf_dir))


def rail_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tree beside the last section of each vendor's kinds."""
    units = sold_units(spark, sf_dir)
    kind = F.substring_index("path", "/", 5)
    asked = units.where("level = 'section'").groupBy("law", kind.alias("kind")).agg(F.max("path").alias("current"))
    return rail.beside(rail.spans(units), asked)


QUERIES: dict[str, Callable] = {"resolve_versioned": resolve_versioned, "gathered_root": gathered_root, "gathered_contents": gathered_contents, "compiled_titles": compiled_titles, "unit_spans": unit_spans, "rail_tree": rail_tree}

_V = f"""WITH f AS ({_FILES}), q AS ({_REQUESTS.replace("{month}", "strftime(sold_at, '%Y-%m')")}),
c AS (SELECT change_id AS version_id, client_id AS file_id, op, valid_at, coalesce(segment, 'none') AS segment, coalesce(city, '') AS city, change_id % 5 AS n, strftime(valid_at, '%Y-%m') AS label FROM client_changes WHERE change_id IS NOT NULL),
v AS (SELECT DISTINCT version_id, file_id, label, valid_at, sha256(version_id || ':' || city) AS content_hash FROM c),
w AS (SELECT DISTINCT prefix, through FROM q),
p AS (SELECT prefix, through, file_id, partial_of, version_id, label, content_hash FROM (SELECT *, row_number() OVER (PARTITION BY prefix, through, file_id ORDER BY CASE WHEN through IS NULL THEN valid_at END DESC, version_id DESC, label DESC, content_hash DESC) AS r
 FROM w JOIN f USING (prefix) JOIN v USING (file_id) WHERE through IS NULL OR through = label) WHERE r = 1),
o AS (SELECT *, CASE partial_of WHEN 'II' THEN 2 WHEN '4' THEN 4 WHEN 'IX' THEN 9 ELSE 1000000 END AS number, coalesce(partial_of, '') AS designator FROM p),
r AS (SELECT prefix, through, count(*) AS n, min(CASE WHEN partial_of IS NULL THEN file_id END) AS whole, list({{'f': file_id, 'v': version_id, 'h': content_hash}} ORDER BY number, designator, file_id) AS l FROM o GROUP BY ALL),
g AS (SELECT *, list_filter(l, lambda x: whole IS NULL OR x.f = whole) AS s FROM r),
u AS (SELECT version_id, prefix || '/' || segment AS path, 'title' AS level, NULL AS num, 1 AS seq FROM c JOIN f USING (file_id) WHERE op <> 'D' UNION ALL SELECT version_id, prefix || '/' || segment || '/s' || n, 'section', n, 2 FROM c JOIN f USING (file_id) WHERE op <> 'D'
 UNION ALL SELECT version_id, prefix || '/s' || (n + 10), 'section', n + 10, 3 FROM c JOIN f USING (file_id) WHERE op <> 'D')"""
_PIN = "CASE WHEN through IS NULL THEN '' ELSE '=' || through END AS pin"
_U = """WITH i AS (SELECT item_id, min(coalesce(kind, 'none')) AS kind, min(coalesce(brand, 'none')) AS brand FROM items GROUP BY 1),
s AS (SELECT DISTINCT '/us/pl/' || vendor_id AS law, kind, brand, item_id FROM sale_lines JOIN i USING (item_id) WHERE vendor_id IS NOT NULL),
u AS (SELECT law, law || '/' || kind AS path, 'title' AS level, NULL AS parent, 1 AS depth, count(*) + count(DISTINCT brand) AS below, count(*) AS sections, max(law || '/' || kind || '/' || brand || '/s' || item_id) AS last FROM s GROUP BY law, kind
 UNION ALL SELECT law, law || '/' || kind || '/' || brand, 'chapter', law || '/' || kind, 2, count(*), count(*), max(law || '/' || kind || '/' || brand || '/s' || item_id) FROM s GROUP BY law, kind, brand
 UNION ALL SELECT law, law || '/' || kind || '/' || brand || '/s' || item_id, 'section', law || '/' || kind || '/' || brand, 3, 0, 0, law || '/' || kind || '/' || brand || '/s' || item_id FROM s)"""
ORACLE = {
    # each way of answering tried for each request, in order
    "resolve_versioned": _V
    + """, k AS (SELECT q.prefix, q.path, q.through, t.rank, t.key FROM q, (VALUES ('/retail', 1, '/retail'), ('/retail/s3', 1, '/retail/s3'), ('/retail/s3', 2, '/retail'), ('/public/s2/a/1', 1, '/public/s2/a/1'), ('/public/s2/a/1', 2, '/public/s2/a'), ('/public/s2/a/1', 3, '/public/s2'),
 ('/public/s2/a/1', 4, '/public'), ('/none/s12/b', 1, '/none/s12/b'), ('/none/s12/b', 2, '/none/s12'), ('/none/s12/b', 3, '/none'), ('/web/x', 1, '/web/x'), ('/web/x', 2, '/web')) t(path, rank, key) WHERE q.path = t.path),
n AS (SELECT q.prefix, q.path, q.through, t.num, t.rest FROM q, (VALUES ('/retail/s3', 3, ''), ('/public/s2/a/1', 2, '/a/1'), ('/none/s12/b', 12, '/b')) t(path, num, rest) WHERE q.path = t.path),
m AS (SELECT k.prefix, k.path, k.through, rank, u.version_id, u.seq, u.path AS served, u.level, NULL AS rest FROM k JOIN p ON p.prefix = k.prefix AND p.through IS NOT DISTINCT FROM k.through JOIN u ON u.version_id = p.version_id AND u.path = k.prefix || k.key
 UNION ALL SELECT n.prefix, n.path, n.through, 9, u.version_id, u.seq, u.path, u.level, rest FROM n JOIN p ON p.prefix = n.prefix AND p.through IS NOT DISTINCT FROM n.through JOIN u ON u.version_id = p.version_id AND u.level = 'section' AND u.num = n.num),
b AS (SELECT * FROM m QUALIFY row_number() OVER (PARTITION BY prefix, path, through ORDER BY rank, version_id, seq, served) = 1)
SELECT q.prefix, q.path, q.through, CASE WHEN g.n IS NULL THEN 'miss' WHEN q.path = '' THEN 'exact' WHEN rank IS NULL THEN 'prefix' WHEN rank = 9 THEN 'section_number' WHEN rank = 1 OR level = 'section' THEN 'exact' ELSE 'prefix' END AS resolution,
 CASE WHEN g.n IS NOT NULL THEN coalesce(served, q.prefix) END AS served, coalesce(version_id, s[1].v) AS version_id, CASE WHEN rank = 9 THEN CASE WHEN rest <> '' THEN served || rest END WHEN rank > 1 AND level = 'section' THEN q.prefix || q.path END AS provision, q.through IS NOT NULL AS pinned
FROM q LEFT JOIN b ON b.prefix = q.prefix AND b.path = q.path AND b.through IS NOT DISTINCT FROM q.through LEFT JOIN g ON g.prefix = q.prefix AND g.through IS NOT DISTINCT FROM q.through""",
    "gathered_root": _V + f" SELECT prefix, {_PIN}, s[1].f AS file_id, s[1].v AS version_id, CAST(len(s) AS INTEGER) AS n_files, CASE WHEN whole IS NOT NULL THEN s[1].h ELSE sha256(array_to_string(list_transform(s, lambda x: x.h), ':')) END AS content_hash FROM g",
    "gathered_contents": _V + f" SELECT DISTINCT o.prefix, {_PIN.replace('through', 'o.through')}, number, designator, file_id, seq, path, level FROM o JOIN g ON g.prefix = o.prefix AND g.through IS NOT DISTINCT FROM o.through JOIN u USING (version_id) WHERE whole IS NULL OR whole = file_id",
    "compiled_titles": f"WITH f AS ({_FILES}) SELECT file_id, prefix, partial_of, label FROM f LEFT JOIN (SELECT client_id AS file_id, strftime(arg_max(valid_at, (valid_at, change_id)), '%Y-%m') AS label FROM client_changes WHERE change_id IS NOT NULL GROUP BY 1) USING (file_id)",
    "unit_spans": _U + " SELECT law, path, level, path AS seq, last, below, sections, parent, depth FROM u",
    "rail_tree": _U
    + """, n AS (SELECT law, count(*) > 300 AS large FROM u GROUP BY 1), a AS (SELECT law, array_to_string(string_split(path, '/')[1:5], '/') AS kind, max(path) AS current FROM u WHERE level = 'section' GROUP BY 1, 2)
SELECT u.law, current, path, level, path AS seq, depth, below, CASE WHEN large AND level = 'section' THEN false ELSE current = path OR starts_with(current, path || '/') END AS open FROM a JOIN n USING (law) JOIN u USING (law)
WHERE NOT large OR parent IS NULL OR starts_with(current, parent || '/')""",
}
