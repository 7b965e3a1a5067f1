"""Queries that apply the package's DataFrame operators, with their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import identifiers as ids
from ..functions.citations import cite_parse, osa_distance
from ..functions.markup import Links, ShredXml, visible_text
from ..operators import load, resolve, search, sequence, summary
from ..session import shares

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}

Tables = Callable[[str], DataFrame]


def query(sql: str | None = None):
    """Registers a function of the tables under its name, with the SQL that gives the same rows."""

    def add(f: Callable[[Tables], DataFrame]):
        QUERIES[f.__name__] = lambda spark, sf_dir: f(lambda name: spark.read.parquet(f"{sf_dir}/{name}.parquet"))
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


def path_of() -> Column:
    """/us/pl/{year}/{order}."""
    return F.concat(F.lit("/us/pl/"), F.year("o_orderdate"), F.lit("/"), F.col("o_orderkey"))


# summaries


@query("""
WITH k AS (SELECT CAST(unnest(generate_series(1995, 2001)) AS INTEGER) AS year),
o AS (SELECT CAST(year(o_orderdate) AS INTEGER) AS year, count(*) AS laws, count(*) FILTER (WHERE o_orderstatus = 'F') AS final, count(DISTINCT o_custkey) AS holders, min(o_orderdate) AS first_day, max(o_orderdate) AS last_day FROM orders GROUP BY 1),
l AS (SELECT CAST(year(l_shipdate) AS INTEGER) AS year, count(*) AS units, count(DISTINCT l_suppkey) AS origins FROM lineitem GROUP BY 1)
SELECT k.year, coalesce(laws, 0) AS laws, coalesce(final, 0) AS final, coalesce(holders, 0) AS holders, first_day, last_day, coalesce(units, 0) AS units, coalesce(origins, 0) AS origins
FROM k LEFT JOIN o ON k.year = o.year LEFT JOIN l ON k.year = l.year""")
def dense_summary(t: Tables) -> DataFrame:
    orders = t("orders").groupBy(F.year("o_orderdate").alias("year")).agg(
        F.count("*").alias("laws"), F.count_if(F.col("o_orderstatus") == "F").alias("final"), F.countDistinct("o_custkey").alias("holders"),
        F.min("o_orderdate").alias("first_day"), F.max("o_orderdate").alias("last_day"))
    lines = t("lineitem").groupBy(F.year("l_shipdate").alias("year")).agg(F.count("*").alias("units"), F.countDistinct("l_suppkey").alias("origins"))
    keys = summary.spine(t("region"), "year", 1995, 2001)
    return summary.dense(keys, "year", [orders, lines], ["laws", "final", "holders", "units", "origins"])


@query("""SELECT p_partkey, max(CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END) = 1 AS has_r, max(CASE WHEN l_returnflag = 'A' THEN 1 ELSE 0 END) = 1 AS has_a
FROM part JOIN lineitem ON p_partkey = l_partkey GROUP BY p_partkey""")
def bool_flags(t: Tables) -> DataFrame:
    flags = t("lineitem").groupBy("l_partkey").agg(F.bool_or(F.col("l_returnflag") == "R").alias("has_r"), F.bool_or(F.col("l_returnflag") == "A").alias("has_a"))
    return t("part").join(flags, F.col("p_partkey") == F.col("l_partkey")).select("p_partkey", "has_r", "has_a")


@query("SELECT '{' || string_agg('\"' || k || '\":' || n, ',' ORDER BY k) || '}' AS counts FROM (SELECT l_returnflag AS k, count(*) AS n FROM lineitem GROUP BY 1)")
def load_report(t: Tables) -> DataFrame:
    return summary.count_maps(t("lineitem"), F.col("l_returnflag"))


# sequences


@query("""
WITH d AS (SELECT l_orderkey, l_linenumber, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_shipdate) AS seq FROM lineitem),
c AS (SELECT *, count(*) OVER (PARTITION BY l_orderkey, l_linenumber) AS claims FROM d),
n AS (SELECT *, last_value(CASE WHEN claims = 1 THEN l_linenumber END IGNORE NULLS) OVER (PARTITION BY l_orderkey ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS b,
 first_value(CASE WHEN claims = 1 THEN l_linenumber END IGNORE NULLS) OVER (PARTITION BY l_orderkey ORDER BY seq ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS a FROM c),
f AS (SELECT *, coalesce(b < l_linenumber, true) AND coalesce(a > l_linenumber, true) AS fits FROM n)
SELECT l_orderkey, l_linenumber, seq, claims, fits, row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY fits DESC, seq) = 1 AS kept, claims = 1 AND NOT fits AS out_of_sequence FROM f""")
def number_conflicts(t: Tables) -> DataFrame:
    order = ["l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_shipdate"]
    claims = sequence.numbered(t("lineitem"), ["l_orderkey"], order, "seq").select("l_orderkey", "l_linenumber", "seq")
    return sequence.number_conflicts(claims, "l_orderkey", "l_linenumber", "seq")


@query("""
WITH s AS (SELECT o_custkey, o_orderkey, coalesce(CAST(o_orderkey - lag(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) <> 1 AS INTEGER), 0) AS s FROM orders)
SELECT o_custkey, o_orderkey, CAST(sum(s) OVER (PARTITION BY o_custkey ORDER BY o_orderkey ROWS UNBOUNDED PRECEDING) AS BIGINT) AS island FROM s""")
def gaps_islands(t: Tables) -> DataFrame:
    return sequence.islands(t("orders").select("o_custkey", "o_orderkey"), ["o_custkey"], "o_orderkey")


@query("""SELECT event_id, last_value(CASE WHEN event_type = 'purchase' THEN event_id END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS last_purchase FROM events""")
def forward_fill(t: Tables) -> DataFrame:
    value = F.when(F.col("event_type") == "purchase", F.col("event_id"))
    return sequence.filled_forward(t("events"), ["user_id"], ["ts", "event_id"], value, "last_purchase").select("event_id", "last_purchase")


@query("""SELECT event_id, CAST(sum(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS island FROM events""")
def marker_islands(t: Tables) -> DataFrame:
    return sequence.marked_islands(t("events"), ["user_id"], ["ts", "event_id"], F.col("event_type") == "error").select("event_id", "island")


@query("""SELECT o_custkey, o_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS r FROM orders) WHERE r = 1""")
def first_occurrence(t: Tables) -> DataFrame:
    return sequence.first_of(t("orders").select("o_custkey", "o_orderkey", "o_orderdate"), ["o_custkey"], ["o_orderdate", "o_orderkey"]).select("o_custkey", "o_orderkey")


@query("""SELECT o_orderkey FROM (SELECT o_orderkey, CAST(sum(CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END) OVER (ORDER BY o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) AS used, o_orderstatus FROM orders) WHERE o_orderstatus = 'F' AND used <= 25""")
def budgeted_limit(t: Tables) -> DataFrame:
    """The running sum at a row that counts is its number among such rows; Spark keeps the first 25 of each partition before one task sees them."""
    due = t("orders").where("o_orderstatus = 'F'").select("o_orderkey")
    return due.withColumn("used", F.row_number().over(Window.orderBy(F.col("o_orderkey").asc_nulls_last()))).where("used <= 25").select("o_orderkey")


@query("""WITH t AS (SELECT l_orderkey, l_partkey, CAST(year(o_orderdate) AS INT) AS y FROM lineitem JOIN orders ON l_orderkey = o_orderkey) SELECT a.l_partkey, count(DISTINCT b.l_orderkey) AS later FROM t a JOIN t b ON a.l_partkey = b.l_partkey AND (b.y > a.y OR (b.y = a.y AND b.l_orderkey > a.l_orderkey)) GROUP BY a.l_partkey""")
def later_amendments(t: Tables) -> DataFrame:
    """Without the self-join, whose rows grow with the square of a part's: every order of a part but its first is later than that one.

    An order given twice with years lo < hi is later than itself, so the first counts too where its years differ.
    """
    n = shares(t("lineitem"))
    lines = t("lineitem").where("l_partkey IS NOT NULL").select("l_orderkey", "l_partkey").repartition(n, "l_orderkey")
    years = t("orders").select("o_orderkey", F.year("o_orderdate").alias("y")).where("y IS NOT NULL").repartition(n, "o_orderkey")
    orders = lines.join(years, F.col("l_orderkey") == F.col("o_orderkey")).groupBy("l_partkey", "l_orderkey").agg(F.min("y").alias("lo"), F.max("y").alias("hi"))
    # a part's orders first meet in 16 places, so that a frequent part isn't one task's
    some = orders.withColumn("way", F.pmod(F.xxhash64("l_orderkey"), F.lit(16))).repartition(n, "l_partkey", "way").groupBy("l_partkey", "way").agg(F.count("*").alias("n"), F.min(F.struct("lo", "l_orderkey", "hi")).alias("first"))
    parts = some.repartition(n, "l_partkey").groupBy("l_partkey").agg(F.sum("n").alias("n"), F.min("first").alias("first"))
    later = F.col("n") - (F.col("first.lo") == F.col("first.hi")).cast("int")
    return parts.select("l_partkey", later.alias("later")).where("later > 0")


@query()
def cited_by(t: Tables) -> DataFrame:
    """The SQL of relational.SHARED with partitions that grow with the table: pairs of part and supplier with their flags, then parts."""
    n, flags = shares(t("lineitem")), ["A", "N", "R"]
    held = [F.coalesce(F.max((F.col("l_returnflag") == x).cast("long")), F.lit(0)).alias(x) for x in flags]
    pairs = t("lineitem").select("l_partkey", "l_suppkey", "l_returnflag").repartition(n, "l_partkey", "l_suppkey").groupBy("l_partkey", "l_suppkey").agg(*held)
    return pairs.repartition(n, "l_partkey").groupBy("l_partkey").agg(F.count("l_suppkey").alias("sections"), *(F.sum(x).alias(x.lower()) for x in flags))


@query("""SELECT user_id, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id) AS r FROM events) WHERE r = 1""")
def newest_fold(t: Tables) -> DataFrame:
    return t("events").groupBy("user_id").agg(sequence.newest(F.col("ts"), F.col("event_id"), F.col("event_id")).alias("event_id"))


@query("""SELECT e.event_id, (SELECT max(o_orderkey) FROM orders o WHERE o.o_custkey = e.user_id AND o.o_orderdate = (SELECT max(o_orderdate) FROM orders p WHERE p.o_custkey = e.user_id AND p.o_orderdate <= e.ts)) AS o_orderkey FROM events e""")
def asof_last(t: Tables) -> DataFrame:
    """The last order of the user at or before each event: both sides in one sorted run per user, carried forward."""
    e = t("events").select(F.col("user_id").alias("k"), F.col("ts").alias("at"), "event_id", F.lit(None).cast("long").alias("o_orderkey"))
    o = t("orders").select(F.col("o_custkey").alias("k"), F.col("o_orderdate").alias("at"), F.lit(None).cast("long").alias("event_id"), "o_orderkey")
    both = sequence.filled_forward(e.unionByName(o), ["k"], ["at", F.col("event_id").asc_nulls_first(), "o_orderkey"], F.col("o_orderkey"), "last")
    return both.where("event_id IS NOT NULL").select("event_id", F.col("last").alias("o_orderkey"))


# resolution


@query("""
WITH tree AS (SELECT DISTINCT '/r' || n_regionkey AS path FROM nation UNION SELECT '/r' || n_regionkey || '/n' || n_nationkey FROM nation),
q AS (SELECT DISTINCT '/r' || (c_nationkey % 7) || '/n' || c_nationkey || '/c' || c_custkey AS request FROM customer)
SELECT request, (SELECT path FROM tree WHERE request = path OR starts_with(request, path || '/') ORDER BY length(path) DESC LIMIT 1) AS matched, false AS exact FROM q""")
def longest_prefix(t: Tables) -> DataFrame:
    n = t("nation").select(F.concat(F.lit("/r"), "n_regionkey").alias("r"), F.concat(F.lit("/r"), "n_regionkey", F.lit("/n"), "n_nationkey").alias("n"))
    tree = n.select(F.explode(F.array("r", "n")).alias("path")).distinct()
    asked = t("customer").select(F.concat(F.lit("/r"), F.col("c_nationkey") % 7, F.lit("/n"), "c_nationkey", F.lit("/c"), "c_custkey").alias("request")).distinct()
    return resolve.longest_prefix(asked, "request", tree, "path")


@query("""
WITH one AS (SELECT s_nationkey, min(s_suppkey) AS by_nation FROM supplier GROUP BY 1), r AS (SELECT n_regionkey, min(s_suppkey) AS by_region FROM supplier JOIN nation ON s_nationkey = n_nationkey GROUP BY 1)
SELECT c_custkey, coalesce(s.s_suppkey, by_nation, by_region) AS supplier FROM customer JOIN nation n ON c_nationkey = n.n_nationkey
LEFT JOIN supplier s ON s.s_suppkey = c_custkey LEFT JOIN one ON one.s_nationkey = c_nationkey LEFT JOIN r ON r.n_regionkey = n.n_regionkey""")
def cascade_lookup(t: Tables) -> DataFrame:
    asked = t("customer").join(t("nation"), F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", "c_nationkey", "n_regionkey")
    own = t("supplier").select(F.col("s_suppkey").alias("c_custkey"), F.col("s_suppkey").alias("own"))
    nation = t("supplier").groupBy(F.col("s_nationkey").alias("c_nationkey")).agg(F.min("s_suppkey").alias("by_nation"))
    region = t("supplier").join(t("nation"), F.col("s_nationkey") == F.col("n_nationkey")).groupBy("n_regionkey").agg(F.min("s_suppkey").alias("by_region"))
    found = resolve.cascade(asked, [(own, ["c_custkey"], "own"), (nation, ["c_nationkey"], "by_nation"), (region, ["n_regionkey"], "by_region")], "supplier")
    return found.select("c_custkey", "supplier")


@query("SELECT DISTINCT p_partkey, s_suppkey FROM part JOIN supplier ON p_partkey = s_suppkey OR p_size = s_nationkey")
def or_join(t: Tables) -> DataFrame:
    p, s = t("part"), t("supplier")
    return resolve.any_of(p, s, [(p["p_partkey"], s["s_suppkey"]), (p["p_size"], s["s_nationkey"])], ["p_partkey", "s_suppkey"])


@query("""SELECT o_orderkey, unnest(['/us', '/us/pl', '/us/pl/' || year(o_orderdate), '/us/pl/' || year(o_orderdate) || '/' || o_orderkey]) AS prefix FROM orders""")
def path_prefixes(t: Tables) -> DataFrame:
    return t("orders").select("o_orderkey", F.explode(resolve.path_prefixes(path_of())).alias("prefix"))


@query("SELECT o_orderkey, 'pl' AS kind, CAST(year(o_orderdate) AS INTEGER) AS congress, CAST(o_orderkey AS VARCHAR) AS number FROM orders")
def parse_ident(t: Tables) -> DataFrame:
    return t("orders").select("o_orderkey", ids.parsed(path_of()).alias("p")).select("o_orderkey", "p.kind", "p.congress", "p.number")


@query("""SELECT l_orderkey, l_linenumber, CAST(l_linenumber AS VARCHAR) AS section, 'a/1' AS below FROM lineitem""")
def path_parts(t: Tables) -> DataFrame:
    path = F.concat(F.lit("/us/pl/1/"), "l_orderkey", F.lit("/tI/s"), "l_linenumber", F.lit("/a/1"))
    return t("lineitem").select("l_orderkey", "l_linenumber", ids.section_number(path).alias("section"), ids.below_section(path).alias("below"))


# loading


@query("""
WITH b AS (SELECT o_orderkey, 1 AS rank, o_orderdate, 0 AS i FROM orders WHERE year(o_orderdate) <= 1998 UNION ALL SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN 2 ELSE 0 END, o_orderdate, 1 FROM orders WHERE year(o_orderdate) >= 1997),
m AS (SELECT *, row_number() OVER (PARTITION BY o_orderkey ORDER BY rank DESC, o_orderdate DESC, i DESC) AS r, min(i) OVER (PARTITION BY o_orderkey) = 0 AS was, max(i) OVER (PARTITION BY o_orderkey) = 1 AS came FROM b)
SELECT o_orderkey, CAST(rank AS INTEGER) AS rank, CASE WHEN NOT came THEN 'stored' WHEN NOT was THEN 'new' WHEN i = 1 THEN 'replaced' ELSE 'kept' END AS outcome FROM m WHERE r = 1""")
def precedence_upsert(t: Tables) -> DataFrame:
    o = t("orders")
    stored = o.where(F.year("o_orderdate") <= 1998).select("o_orderkey", F.lit(1).alias("rank"), "o_orderdate")
    incoming = o.where(F.year("o_orderdate") >= 1997).select("o_orderkey", F.when(F.col("o_orderstatus") == "F", 2).otherwise(0).alias("rank"), "o_orderdate")
    return load.upsert(stored, incoming, "o_orderkey", "rank", "o_orderdate").select("o_orderkey", "rank", "outcome")


@query("""
WITH o AS (SELECT user_id, sha256(event_type) AS content_hash, min(ts) AS first_seen, max(ts) AS last_seen FROM events GROUP BY 1, 2)
SELECT user_id, content_hash, first_seen, last_seen, CAST(row_number() OVER (PARTITION BY user_id ORDER BY first_seen, content_hash) AS INTEGER) AS version,
 row_number() OVER (PARTITION BY user_id ORDER BY last_seen DESC, content_hash DESC) = 1 AS is_current FROM o""")
def scd_versions(t: Tables) -> DataFrame:
    return load.versions(t("events"), "user_id", "event_type", "ts")


@query("""SELECT o_orderkey, CASE WHEN year(o_orderdate) > 1998 THEN 'loaded' WHEN o_orderkey % 3 <> 0 THEN 'skipped' WHEN o_orderkey % 2 <> 0 THEN 'unchanged' ELSE 'loaded' END AS outcome FROM orders""")
def change_detect_3way(t: Tables) -> DataFrame:
    o = t("orders")
    stored = o.where(F.year("o_orderdate") <= 1998).select("o_orderkey", F.col("o_orderkey").alias("size"), F.col("o_orderkey").alias("hash"))
    third, even = (F.col("o_orderkey") % 3 == 0).cast("int"), ((F.col("o_orderkey") % 6) == 0).cast("int")
    listed = o.select("o_orderkey", (F.col("o_orderkey") + third).alias("size"), (F.col("o_orderkey") + even).alias("hash"))
    return load.changes(stored, listed, "o_orderkey", ["size"], "hash")


@query("SELECT l_orderkey, sha256(string_agg(CAST(l_partkey AS VARCHAR), chr(10) ORDER BY l_linenumber, l_partkey)) AS digest FROM lineitem GROUP BY l_orderkey")
def ordered_digest(t: Tables) -> DataFrame:
    return t("lineitem").groupBy("l_orderkey").agg(load.digest(F.struct("l_linenumber", "l_partkey"), F.col("l_partkey")).alias("digest"))


@query("SELECT doc_id, sha256(text) AS content_hash FROM documents")
def content_hash(t: Tables) -> DataFrame:
    return t("documents").select("doc_id", F.sha2("text", 256).alias("content_hash"))


# expressions


@query("""SELECT l_orderkey, l_linenumber, ['I', 'II', 'III', 'IV', 'V', 'VI', 'VII'][l_linenumber] AS numeral, l_linenumber AS value FROM lineitem""")
def roman_sort(t: Tables) -> DataFrame:
    numeral = F.element_at(F.array(*map(F.lit, ["I", "II", "III", "IV", "V", "VI", "VII"])), F.col("l_linenumber"))
    return t("lineitem").select("l_orderkey", "l_linenumber", numeral.alias("numeral")).withColumn("value", ids.roman(F.col("numeral")))


@query("""SELECT o_orderkey, CAST(floor((CASE WHEN y < 1935 THEN y WHEN md < 103 AND y % 2 = 1 THEN y - 1 ELSE y END - 1789) / 2.0) AS INTEGER) + 1 AS term FROM (SELECT o_orderkey, year(o_orderdate) AS y, month(o_orderdate) * 100 + day(o_orderdate) AS md FROM orders)""")
def term_of_date(t: Tables) -> DataFrame:
    return t("orders").select("o_orderkey", ids.congress_of(F.col("o_orderdate")).alias("term"))


@query("""SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, lpad(CAST(l_orderkey % 9999 AS VARCHAR), 4, '0') || '|A' || lpad(CAST(l_linenumber AS VARCHAR), 6, '0') || '-2|' || lpad(CAST(l_suppkey AS VARCHAR), 6, '0') AS key FROM lineitem""")
def citation_sort(t: Tables) -> DataFrame:
    page = F.concat(F.lit("A"), "l_linenumber", F.lit("-2"))
    return t("lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", ids.padded_page(F.col("l_orderkey") % 9999, page, F.col("l_suppkey")).alias("key"))


@query("""SELECT p_partkey, CASE WHEN lower(p_name) = 'red' THEN 0 WHEN lower(p_name) LIKE 'red %' THEN 1 WHEN ' ' || lower(p_name) || ' ' LIKE '% red %' THEN 2 WHEN lower(p_name) LIKE '%red%' THEN 3 ELSE 4 END AS score FROM part""")
def title_score(t: Tables) -> DataFrame:
    return t("part").select("p_partkey", ids.title_score("red", F.col("p_name")).alias("score"))


@query("SELECT l_orderkey, l_linenumber, l_quantity, CAST(l_quantity AS INTEGER) BETWEEN 1 AND 5 OR CAST(l_quantity AS INTEGER) BETWEEN 40 AND 50 OR CAST(l_quantity AS INTEGER) = 17 AS inside FROM lineitem")
def range_cover(t: Tables) -> DataFrame:
    spans = F.array(*map(F.lit, ["1-5", "x", "40-50", "17"]))
    return t("lineitem").select("l_orderkey", "l_linenumber", "l_quantity", ids.in_ranges(F.col("l_quantity").cast("int"), spans).alias("inside"))


@query("SELECT p_brand, CAST(row_number() OVER (ORDER BY CAST(regexp_extract(p_brand, '([0-9]+)', 1) AS INTEGER), p_brand) AS INTEGER) AS place FROM (SELECT DISTINCT p_brand FROM part)")
def natural_sort(t: Tables) -> DataFrame:
    return t("part").select("p_brand").distinct().withColumn("place", F.row_number().over(Window.orderBy(ids.natural_key(F.col("p_brand")))))


@query("SELECT event_id, try_cast(props->>'$.k' AS INTEGER) AS k FROM events")
def variant_get(t: Tables) -> DataFrame:
    return t("events").select("event_id", F.get_json_object("props", "$.k").try_cast("int").alias("k"))


@query("SELECT o_orderkey, CAST(o_orderdate AS DATE) AS day FROM orders")
def safe_date(t: Tables) -> DataFrame:
    return t("orders").select("o_orderkey", ids.safe_date(F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm")).alias("day"))


@query("""
WITH w AS (SELECT o_orderkey, o_orderdate AS d, '/us/pl/' || (year(o_orderdate) - 1900) || '/' || (o_orderkey + 1) AS law, o_custkey AS c FROM orders)
SELECT o_orderkey, CASE o_orderkey % 6 WHEN 3 THEN 'act' WHEN 4 THEN 'stat' WHEN 5 THEN 'usc' ELSE 'pl' END AS kind,
 CASE o_orderkey % 6 WHEN 0 THEN law WHEN 1 THEN law || '/s' || c || '/a/1' WHEN 2 THEN law || '/tIV' WHEN 3 THEN '/us/act/' || strftime(d, '%Y-%m-%d') || '/ch' || c || '/s2' WHEN 4 THEN '/us/stat/' || (year(d) - 1900) || '/' || c ELSE '/us/usc/t42/s' || c END AS identifier,
 o_orderkey % 6 = 5 AS note FROM w""")
def cite_parsed(t: Tables) -> DataFrame:
    n, c = F.concat(F.year("o_orderdate") - 1900, F.lit("-"), F.col("o_orderkey") + 1), F.col("o_custkey")
    forms = [
        F.concat(F.lit("P.L. "), n),
        F.concat(F.lit("section "), c, F.lit("(a)(1) of Public Law "), n),
        F.concat(F.lit("Pub. L. No. "), n, F.lit(", title IV, 110 Stat. 4196")),
        F.concat(F.lit("Act of "), F.date_format("o_orderdate", "MMM. d, yyyy"), F.lit(", ch. "), c, F.lit(", § 2")),
        F.concat(F.lit("ch. 12, "), F.year("o_orderdate") - 1900, F.lit(" Stat. "), c),
        F.concat(F.lit("42 U.S.C. "), c, F.lit(" note")),
    ]
    written = F.element_at(F.array(*forms), (F.col("o_orderkey") % 6 + 1).cast("int"))
    return t("orders").select("o_orderkey", cite_parse(written).alias("c")).select("o_orderkey", "c.*")


@query("""
WITH m AS (SELECT p_partkey, p_name AS a, CASE p_partkey % 4 WHEN 0 THEN substr(p_name, 2, 1) || substr(p_name, 1, 1) || substr(p_name, 3) WHEN 1 THEN substr(p_name, 1, 1) || substr(p_name, 3) WHEN 2 THEN '#' || p_name || '#' ELSE upper(p_name) END AS b FROM part),
d AS (SELECT p_partkey, CAST(damerau_levenshtein(a, b) AS INTEGER) AS distance, greatest(length(a), length(b)) AS n FROM m)
SELECT p_partkey, distance, 1 - CAST(distance AS DOUBLE) / n AS similarity FROM d WHERE 1 - CAST(distance AS DOUBLE) / n >= 0.6""")
def fuzzy_pages(t: Tables) -> DataFrame:
    """Names against a misspelling of each (neighbours swapped, a letter lost, letters added, all letters changed), cut at a similarity of 0.6."""
    name, kind = F.col("p_name"), F.col("p_partkey") % 4
    misspelt = F.when(kind == 0, F.expr("substr(p_name, 2, 1) || substr(p_name, 1, 1) || substr(p_name, 3)")).when(kind == 1, F.expr("substr(p_name, 1, 1) || substr(p_name, 3)")).when(kind == 2, F.concat(F.lit("#"), name, F.lit("#"))).otherwise(F.upper(name))
    pairs = t("part").select("p_partkey", osa_distance(name, misspelt).alias("distance"), F.greatest(F.length(name), F.length(misspelt)).alias("n"))
    return pairs.select("p_partkey", "distance", (1 - F.col("distance").cast("double") / F.col("n")).alias("similarity")).where("similarity >= 0.6")


# markup


@query()
def html_links(t: Tables) -> DataFrame:
    p = t("pages")
    return p.lateralJoin(Links(F.col("html").outer())).select("page_id", "pos", "href", "container")


@query()
def html_text(t: Tables) -> DataFrame:
    return t("pages").select("page_id", visible_text("html").alias("text"))


@query("""SELECT o_orderkey, '/us/pl/1/' || o_orderkey || '/s1' AS identifier, '1' AS num, 'Order ' || o_orderkey AS heading FROM orders""")
def xml_shred(t: Tables) -> DataFrame:
    xml = F.format_string('<pLaw><main><section identifier="/us/pl/1/%d/s1"><num value="1">Sec. 1</num><heading>Order %d</heading></section></main></pLaw>', "o_orderkey", "o_orderkey")
    o = t("orders").select("o_orderkey", xml.alias("xml"))
    return o.lateralJoin(ShredXml(F.col("xml").outer())).where("tag = 'section'").select("o_orderkey", "identifier", "num", "heading")


# search

_TOKENS = "SELECT doc_id, unnest(regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9]+')) AS term FROM documents"


@query(f"SELECT term, count(*) AS n, count(DISTINCT doc_id) AS docs FROM ({_TOKENS}) GROUP BY term")
def tokenize(t: Tables) -> DataFrame:
    return search.tokens(t("documents"), "doc_id", "text").groupBy("term").agg(F.sum("tf").alias("n"), F.count("*").alias("docs"))


@query(f"SELECT doc_id FROM ({_TOKENS}) WHERE term IN ('license', 'the') GROUP BY doc_id HAVING count(DISTINCT term) = 2")
def search_and(t: Tables) -> DataFrame:
    return search.holding_all(search.tokens(t("documents"), "doc_id", "text"), "doc_id", ["license", "the"])


@query("SELECT doc_id FROM documents WHERE regexp_matches(lower(text), '(^|[^a-z0-9])all[^a-z0-9]+rights[^a-z0-9]+reserved($|[^a-z0-9])')")
def search_phrase(t: Tables) -> DataFrame:
    return search.holding_phrase(t("documents"), "text", ["all", "rights", "reserved"]).select("doc_id")


@query(f"""
WITH t AS ({_TOKENS}), f AS (SELECT doc_id, term, count(*) AS tf FROM t GROUP BY 1, 2), l AS (SELECT doc_id, sum(tf) AS dl FROM f GROUP BY 1),
s AS (SELECT count(*) AS n, avg(dl) AS mean FROM l), df AS (SELECT term, count(*) AS df FROM f GROUP BY 1)
SELECT doc_id, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / mean))), 6) AS score
FROM f JOIN l USING (doc_id) JOIN df USING (term) CROSS JOIN s WHERE term IN ('license', 'rights') GROUP BY doc_id""")
def search_bm25(t: Tables) -> DataFrame:
    return search.bm25(t("documents"), "doc_id", "text", ["license", "rights"]).select("doc_id", F.round("score", 6).alias("score"))


# time


@query("SELECT date_trunc('hour', ts) AS hour, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def tumbling_window(t: Tables) -> DataFrame:
    return t("events").groupBy(F.window("ts", "1 hour").start.cast("timestamp_ntz").alias("hour"), "event_type").agg(F.count("*").alias("n"))
