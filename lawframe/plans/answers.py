"""Queries on the DataFrame operators for resolution, nesting, runs, dates, texts and keyed state; each SQL twin is written on its own."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import identifiers as ids
from ..operators import load, resolve
from ..session import shares
from ..streaming import buckets, polls

QUERIES: dict[str, Callable] = {}
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


def law_path() -> Column:
    return F.concat(F.lit("/us/pl/"), F.year("o_orderdate"), F.lit("/"), F.col("o_orderkey"))


LAWS = "l AS (SELECT o_orderkey, o_custkey, '/us/pl/' || year(o_orderdate) || '/' || o_orderkey AS path FROM orders)"

# resolution


@query(f"""
WITH {LAWS}, a AS (SELECT '/act/' || o_custkey AS alias, min(o_orderkey) AS k FROM orders GROUP BY 1),
r AS (SELECT DISTINCT CASE l_linenumber % 5 WHEN 0 THEN l.path WHEN 1 THEN '/act/' || l_partkey WHEN 2 THEN l.path || '/x/' || l_linenumber WHEN 3 THEN '/us/sec/' || l_orderkey || '/s' || l_linenumber ELSE '/none/' || l_orderkey END AS request, l_linenumber % 5 AS kind, l.path, l_partkey, l_orderkey FROM lineitem JOIN l ON l_orderkey = o_orderkey),
s AS (SELECT DISTINCT l_orderkey, l_linenumber FROM lineitem)
SELECT DISTINCT r.request, CASE kind WHEN 0 THEN 'exact' WHEN 1 THEN CASE WHEN a.k IS NULL THEN 'miss' ELSE 'alias' END WHEN 2 THEN 'prefix' WHEN 3 THEN 'number' ELSE 'miss' END AS rule,
 CASE kind WHEN 0 THEN r.path WHEN 1 THEN l.path WHEN 2 THEN r.path WHEN 3 THEN r.path END AS path
FROM r LEFT JOIN a ON kind = 1 AND a.alias = r.request LEFT JOIN l ON l.o_orderkey = a.k""")
def resolve_unit(t: Tables) -> DataFrame:
    laws = t("orders").select("o_orderkey", "o_custkey", law_path().alias("path"))
    parts = shares(t("lineitem"))
    lines = t("lineitem").select("l_orderkey", "l_partkey", "l_linenumber").repartition(parts, "l_orderkey").join(laws.select("o_orderkey", "path").repartition(parts, "o_orderkey"), F.col("l_orderkey") == F.col("o_orderkey"))
    n, k = F.col("l_linenumber") % 5, F.col("l_orderkey")
    say = F.when(n == 0, F.col("path")).when(n == 1, F.concat(F.lit("/act/"), "l_partkey")).when(n == 2, F.concat("path", F.lit("/x/"), "l_linenumber")).when(n == 3, F.concat(F.lit("/us/sec/"), k, F.lit("/s"), "l_linenumber")).otherwise(F.concat(F.lit("/none/"), k))
    aliases = laws.repartition(parts, F.concat(F.lit("/act/"), "o_custkey")).groupBy(F.concat(F.lit("/act/"), "o_custkey").alias("alias")).agg(F.min_by("path", "o_orderkey").alias("path"))
    numbered = lines.select(F.concat(F.lit("/us/sec/"), k, F.lit("/s"), "l_linenumber").alias("key"), "path").repartition(parts, "key").distinct()
    return resolve.resolved(lines.select(say.alias("request")), laws.select("path"), aliases, numbered, parts)


@query(f"""
WITH {LAWS}, u AS (SELECT path AS p, 1 AS lv FROM l UNION SELECT DISTINCT path || '/s' || l_linenumber, 2 FROM l JOIN lineitem ON l_orderkey = o_orderkey UNION SELECT DISTINCT '/us/pl/' || year(o_orderdate), 0 FROM orders)
SELECT p AS path, CASE lv WHEN 0 THEN NULL ELSE regexp_replace(p, '/[^/]+$', '') END AS parent FROM u""")
def toc_parent(t: Tables) -> DataFrame:
    laws = t("orders").select("o_orderkey", "o_orderdate", law_path().alias("path"))
    parts = shares(t("lineitem"))
    sections = laws.select("o_orderkey", "path").repartition(parts, "o_orderkey").join(t("lineitem").select("l_orderkey", "l_linenumber").repartition(parts, "l_orderkey"), F.col("l_orderkey") == F.col("o_orderkey")).select(F.concat("path", F.lit("/s"), "l_linenumber").alias("path"))
    years = laws.select(F.concat(F.lit("/us/pl/"), F.year("o_orderdate")).alias("path"))
    return resolve.parents(laws.select("path").unionByName(sections).unionByName(years.distinct()), parts)


@query("""
WITH s AS (SELECT DISTINCT l_orderkey, l_linenumber FROM lineitem)
SELECT o_orderkey, count(l_linenumber) AS sections, coalesce(string_agg('s' || l_linenumber, ' ' ORDER BY l_linenumber), '') AS toc, CASE WHEN count(l_linenumber) = 1 THEN min(l_linenumber) END AS only_section
FROM orders LEFT JOIN s ON l_orderkey = o_orderkey GROUP BY o_orderkey""")
def law_toc(t: Tables) -> DataFrame:
    of = t("lineitem").groupBy("l_orderkey").agg(F.sort_array(F.collect_set("l_linenumber")).alias("s"))
    s = F.coalesce("s", F.array().cast("array<int>"))
    return t("orders").join(of, F.col("l_orderkey") == F.col("o_orderkey"), "left").select("o_orderkey", F.size(s).cast("long").alias("sections"), F.array_join(F.transform(s, lambda n: F.concat(F.lit("s"), n)), " ").alias("toc"), F.when(F.size(s) == 1, F.get(s, F.lit(0))).alias("only_section"))


@query("""
SELECT l_suppkey AS volume, l_partkey % 40 AS page, count(*) AS units, min(l_orderkey) AS head, count(DISTINCT l_orderkey) AS laws FROM lineitem GROUP BY 1, 2""")
def page_docs(t: Tables) -> DataFrame:
    return t("lineitem").groupBy(F.col("l_suppkey").alias("volume"), (F.col("l_partkey") % 40).alias("page")).agg(F.count("*").alias("units"), F.min("l_orderkey").alias("head"), F.countDistinct("l_orderkey").alias("laws"))


# loading and runs


@query("""
SELECT o_custkey % 200 AS alias, arg_min(o_orderkey, (CASE WHEN year(o_orderdate) = 1995 THEN 0 ELSE 1 END) * 1000000000 + o_orderkey) AS owner, count(*) - 1 AS dropped FROM orders GROUP BY 1""")
def alias_first_wins(t: Tables) -> DataFrame:
    claims = t("orders").select((F.col("o_custkey") % 200).alias("alias"), "o_orderkey", (F.year("o_orderdate") == 1995).alias("stored"))
    kept = load.first_wins(claims, "alias", [F.desc("stored"), "o_orderkey"])
    return kept.groupBy("alias").agg(F.max(F.when(F.col("kept"), F.col("o_orderkey"))).alias("owner"), F.count_if(~F.col("kept")).alias("dropped"))


def runs_of_lines(t: Tables) -> DataFrame:
    """Runs of consecutive line numbers of an order, with the first line with each of two flags."""
    one = t("lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.max(F.col("l_returnflag") == "A").alias("named"), F.max(F.col("l_returnflag") == "R").alias("stat"))
    run = F.col("l_linenumber") - F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_linenumber"))
    first = lambda c: F.min(F.when(F.col(c), F.col("l_linenumber")))
    return one.withColumn("run", run).groupBy("l_orderkey", "run").agg(F.min("l_linenumber").alias("start"), F.max("l_linenumber").alias("stop"), (first("named") < F.coalesce(first("stat"), F.lit(2**31 - 1))).alias("before"))


RUNS = """
o AS (SELECT l_orderkey, l_linenumber, bool_or(l_returnflag = 'A') AS named, bool_or(l_returnflag = 'R') AS stat FROM lineitem GROUP BY 1, 2),
m AS (SELECT *, CASE WHEN lag(l_linenumber) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber) = l_linenumber - 1 THEN 0 ELSE 1 END AS new FROM o),
g AS (SELECT *, sum(new) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber) AS run FROM m),
r AS (SELECT l_orderkey, min(l_linenumber) AS start, max(l_linenumber) AS stop, min(l_linenumber) FILTER (WHERE named) AS a, min(l_linenumber) FILTER (WHERE stat) AS s FROM g GROUP BY l_orderkey, run)"""


@query(f"WITH {RUNS} SELECT l_orderkey, start, stop, a IS NOT NULL AND (s IS NULL OR a < s) AS before FROM r")
def before_first(t: Tables) -> DataFrame:
    return runs_of_lines(t).select("l_orderkey", "start", "stop", F.coalesce("before", F.lit(False)).alias("before"))


@query(f"WITH {RUNS} SELECT l_orderkey, min(start) AS start, arg_min(stop, start) AS stop FROM r WHERE a IS NOT NULL AND (s IS NULL OR a < s) GROUP BY 1")
def first_run(t: Tables) -> DataFrame:
    return runs_of_lines(t).where("before").groupBy("l_orderkey").agg(F.min("start").alias("start"), F.min_by("stop", "start").alias("stop"))


# nested answers


@query("""
SELECT l_suppkey, l_returnflag, count(*) AS pairs, string_agg(lpad(CAST(l_orderkey AS VARCHAR), 9, '0') || ':' || l_linenumber || ':' || l_partkey, ' ' ORDER BY l_orderkey, l_linenumber, l_partkey) AS refs FROM lineitem GROUP BY 1, 2""")
def nest_groups(t: Tables) -> DataFrame:
    ref = F.struct("l_orderkey", "l_linenumber", "l_partkey")
    g = t("lineitem").groupBy("l_suppkey", "l_returnflag").agg(F.count("*").alias("pairs"), F.sort_array(F.collect_list(ref)).alias("refs"))
    said = F.transform("refs", lambda x: F.concat(F.lpad(x["l_orderkey"].cast("string"), 9, "0"), F.lit(":"), x["l_linenumber"], F.lit(":"), x["l_partkey"]))
    return g.withColumn("refs", F.array_join(said, " "))


@query("""
WITH e AS (SELECT DISTINCT l_partkey, year(l_shipdate) AS release, l_orderkey FROM lineitem WHERE l_returnflag = 'R')
SELECT l_partkey, CAST(release AS INTEGER) AS release, count(*) AS pairs, string_agg(CAST(l_orderkey AS VARCHAR), ',' ORDER BY l_orderkey) AS laws FROM e GROUP BY 1, 2""")
def credit_evidence(t: Tables) -> DataFrame:
    g = t("lineitem").where("l_returnflag = 'R'").groupBy("l_partkey", F.year("l_shipdate").alias("release")).agg(F.sort_array(F.collect_set("l_orderkey")).alias("x"))
    return g.select("l_partkey", "release", F.size("x").cast("long").alias("pairs"), F.array_join("x", ",").alias("laws"))


@query("""SELECT l_orderkey, string_agg(CAST(n AS VARCHAR), ',' ORDER BY n) AS numbers FROM (SELECT DISTINCT l_orderkey, l_linenumber AS n FROM lineitem) GROUP BY 1""")
def agg_collect_set(t: Tables) -> DataFrame:
    return t("lineitem").groupBy("l_orderkey").agg(F.array_join(F.sort_array(F.collect_set("l_linenumber")), ",").alias("numbers"))


@query("""
WITH c AS (SELECT o_custkey, o_orderpriority AS v, 0 AS src, min(o_orderkey) AS k FROM orders GROUP BY 1, 2 UNION ALL SELECT o_custkey, o_orderstatus, 1, min(o_orderkey) FROM orders GROUP BY 1, 2),
n AS (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY src, k, v) AS r FROM c)
SELECT o_custkey, string_agg(v, '|' ORDER BY r) AS links FROM n WHERE r <= 6 GROUP BY 1""")
def capped_union(t: Tables) -> DataFrame:
    first = lambda c, src: t("orders").groupBy("o_custkey", F.col(c).alias("v")).agg(F.min("o_orderkey").alias("k")).withColumn("src", F.lit(src))
    both = first("o_orderpriority", 0).unionByName(first("o_orderstatus", 1))
    lists = both.groupBy("o_custkey").agg(F.sort_array(F.collect_list(F.struct("src", "k", "v"))).alias("x"))
    return lists.select("o_custkey", F.array_join(F.slice(F.col("x.v"), 1, 6), "|").alias("links"))


@query("""
WITH w AS (SELECT p_partkey, string_split(p_name || ' ' || p_brand || ' ' || p_name, ' ') AS l FROM part)
SELECT p_partkey, array_to_string(list_filter(l, lambda x, i: list_position(l, x) = i), ' ') AS words FROM w""")
def array_dedupe(t: Tables) -> DataFrame:
    return t("part").select("p_partkey", F.array_join(F.array_distinct(F.split(F.concat_ws(" ", "p_name", "p_brand", "p_name"), " ")), " ").alias("words"))


@query("""
WITH f AS (SELECT o.* FROM orders o WHERE o_orderstatus = 'F' AND o_totalprice >= 1000 AND EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_returnflag = 'R'))
SELECT o_orderkey, o_custkey, (SELECT count(*) FROM f) AS total FROM f ORDER BY o_orderdate DESC, o_orderkey LIMIT 20 OFFSET 40""")
def filtered_list(t: Tables) -> DataFrame:
    return listing(t("orders"), t("lineitem"), status="F", least=1000, flag="R", limit=20, offset=40)


def listing(orders: DataFrame, lines: DataFrame, status: str | None = None, least: float | None = None, flag: str | None = None, limit: int = 20, offset: int = 0) -> DataFrame:
    """A page of the orders that meet every filter given, newest first, with their total. limit is held to 100, offset to 1000."""
    d = orders
    if status is not None:
        d = d.where(F.col("o_orderstatus") == status)
    if least is not None:
        d = d.where(F.col("o_totalprice") >= least)
    if flag is not None:
        d = d.join(lines.where(F.col("l_returnflag") == flag), F.col("l_orderkey") == F.col("o_orderkey"), "left_semi")
    total = d.agg(F.count("*").alias("total"))
    page = d.orderBy(F.desc("o_orderdate"), "o_orderkey").limit(min(limit, 100) + min(offset, 1000)).offset(min(offset, 1000))
    return page.crossJoin(F.broadcast(total)).select("o_orderkey", "o_custkey", "total")  # one row


@query("""
WITH q AS (SELECT unnest(['red', 'ring', 'small widget']) AS needle),
s AS (SELECT needle, p_partkey, p_name, CASE WHEN p_name = needle THEN 0 WHEN starts_with(p_name, needle || ' ') THEN 1 WHEN contains(' ' || p_name || ' ', ' ' || needle || ' ') THEN 2 WHEN contains(p_name, needle) THEN 3 ELSE 4 END AS score FROM q, part)
SELECT needle, rank, p_partkey, score FROM (SELECT needle, p_partkey, CAST(score AS INTEGER) AS score, CAST(row_number() OVER (PARTITION BY needle ORDER BY score, p_name, p_partkey) AS INTEGER) AS rank FROM s WHERE score < 4) WHERE rank <= 5""")
def ranked_topk(t: Tables) -> DataFrame:
    """A few needles, in the query's text, against all titles: a top list per needle by partial aggregation."""
    needles = ["red", "ring", "small widget"]
    scores = t("part").select("p_partkey", "p_name", F.explode(F.array(*(F.struct(F.lit(n).alias("needle"), ids.title_score(n, F.col("p_name")).alias("score")) for n in needles))).alias("s")).select("p_partkey", "p_name", "s.*").where("score < 4")
    rank = F.row_number().over(Window.partitionBy("needle").orderBy("score", "p_name", "p_partkey"))
    return scores.withColumn("rank", rank).where("rank <= 5").select("needle", "rank", "p_partkey", "score")


# dates


@query("""
WITH s AS (SELECT unnest(range(103, 109)) AS n),
b AS (SELECT n, make_date(CAST(1789 + 2 * (n - 1) AS INTEGER), 1, 3) AS lo, make_date(CAST(1789 + 2 * n AS INTEGER), 1, 3) + INTERVAL 31 DAY AS hi FROM s)
SELECT CAST(n AS INTEGER) AS term, count(o_orderkey) AS laws, min(o_orderdate) AS first_day, max(o_orderdate) AS last_day FROM b JOIN orders ON o_orderdate >= lo AND o_orderdate < hi GROUP BY n""")
def date_in_term(t: Tables) -> DataFrame:
    """Terms run to 31 days after the next begins, so a day is in one or two: both are tried, without a range join."""
    n = ids.congress_of(F.col("o_orderdate"))
    lo = lambda k: F.make_date(1787 + 2 * k, F.lit(1), F.lit(3))
    d = t("orders").select("o_orderkey", "o_orderdate", F.explode(F.array(n, n - 1)).alias("term"))
    d = d.where((F.col("o_orderdate") >= lo(F.col("term"))) & (F.col("o_orderdate") < F.date_add(lo(F.col("term") + 1), 31)))
    return d.groupBy("term").agg(F.count("*").alias("laws"), F.min("o_orderdate").alias("first_day"), F.max("o_orderdate").alias("last_day"))


@query("""SELECT o_orderkey, CASE WHEN o_orderstatus = 'P' THEN NULL ELSE o_orderdate + INTERVAL 30 MINUTE END AS at FROM orders""")
def safe_ts(t: Tables) -> DataFrame:
    said = F.when(F.col("o_orderstatus") == "P", "no time").when(F.col("o_orderstatus") == "F", F.date_format(F.col("o_orderdate") + F.expr("INTERVAL 30 MINUTES"), "yyyy-MM-dd'T'HH:mm:ss'Z'")).otherwise(F.date_format(F.col("o_orderdate") + F.expr("INTERVAL 30 MINUTES"), "yyyy-MM-dd HH:mm:ss"))
    return t("orders").select("o_orderkey", said.try_cast("timestamp").cast("timestamp_ntz").alias("at"))


@query("""SELECT o_orderkey, CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE o_orderdate + INTERVAL 75 MINUTE END AS at FROM orders""")
def parse_custom_ts(t: Tables) -> DataFrame:
    said = F.when(F.col("o_orderkey") % 7 == 0, "32-Foo-2026").otherwise(F.date_format(F.col("o_orderdate") + F.expr("INTERVAL 75 MINUTES"), "dd-MMM-yyyy HH:mm"))
    return t("orders").select("o_orderkey", F.try_to_timestamp(said, F.lit("dd-MMM-yyyy HH:mm")).cast("timestamp_ntz").alias("at"))


@query("""SELECT o_orderkey, strftime(o_orderdate, '%B %-d, %Y') AS long_date, CAST(year(o_orderdate) AS INTEGER) AS year, strftime(o_orderdate, '%Y-%m-%dT%H:%M:%SZ') AS iso FROM orders""")
def fmt_date(t: Tables) -> DataFrame:
    return t("orders").select("o_orderkey", F.date_format("o_orderdate", "MMMM d, yyyy").alias("long_date"), F.year("o_orderdate").alias("year"), F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("iso"))


# JSON


@query("""SELECT event_id, CAST(regexp_extract(props, '"k": *([0-9]+)', 1) AS INTEGER) AS k, event_type AS kind, place FROM events, (VALUES (0), (1)) AS v(place) WHERE place = 0 OR event_type = 'click'""")
def json_explode(t: Tables) -> DataFrame:
    item = F.concat(F.lit('{"kind":"'), "event_type", F.lit('","props":'), "props", F.lit("}"))
    page = F.concat(F.lit('{"items":['), item, F.when(F.col("event_type") == "click", F.concat(F.lit(","), item)).otherwise(F.lit("")), F.lit("]}"))
    read = F.from_json(page, "items array<struct<kind:string,props:struct<k:int>>>")
    return t("events").select("event_id", F.posexplode(read["items"]).alias("place", "i")).select("event_id", "i.props.k", "i.kind", "place")


@query("""SELECT o_orderkey, CAST(year(o_orderdate) AS INTEGER) AS year, o_orderstatus AS status, 2 AS depth, o_orderpriority AS last FROM orders""")
def json_structs(t: Tables) -> DataFrame:
    node = lambda value, level: F.struct(value.cast("string").alias("value"), F.lit(level).alias("level"))
    text = F.to_json(F.array(node(F.year("o_orderdate"), "year"), node(F.col("o_orderstatus"), "status"), node(F.col("o_orderpriority"), "priority")))
    a = F.from_json(text, "array<struct<value:string,level:string>>")
    return t("orders").select("o_orderkey", a[0]["value"].cast("int").alias("year"), a[1]["value"].alias("status"), (F.size(a) - 1).alias("depth"), F.element_at(a, -1)["value"].alias("last"))


@query("""SELECT o_orderkey, o_custkey, CAST(o_orderdate AS DATE) AS day, true AS same FROM orders""")
def json_roundtrip(t: Tables) -> DataFrame:
    whole = F.struct("o_orderkey", "o_custkey", F.to_date("o_orderdate").alias("day"))
    back = F.from_json(F.to_json(whole), "o_orderkey long, o_custkey long, day date")
    return t("orders").select(whole.alias("w"), back.alias("b")).select("b.*", (F.col("w") == F.col("b")).alias("same"))


@query("""SELECT p_partkey FROM part WHERE p_name ILIKE '%red%' OR p_brand ILIKE '%red%'""")
def array_ilike(t: Tables) -> DataFrame:
    return t("part").where(F.to_json(F.array("p_name", "p_brand")).ilike("%red%")).select("p_partkey")


# texts


@query("""SELECT p_partkey FROM part WHERE contains(lower(p_name), 'red') AND contains(lower(p_name), 'ring')""")
def word_and(t: Tables) -> DataFrame:
    has = F.forall(F.split(F.lit("Red RING"), " "), lambda w: F.contains(F.lower("p_name"), F.lower(w)))
    return t("part").where(has).select("p_partkey")


@query("""SELECT p_partkey, NOT regexp_full_match(lower(p_name), '((small|large|[0-9]+) ?)+') AS searchable FROM part""")
def generic_guard(t: Tables) -> DataFrame:
    generic = lambda w: w.isin("small", "large") | w.rlike("^[0-9]+$")
    return t("part").select("p_partkey", F.exists(F.split(F.lower("p_name"), " "), lambda w: ~generic(w)).alias("searchable"))


@query("""SELECT page_id, nullif(regexp_extract(html, '<a [^>]*href="([^"]*)"', 1), '') AS first_href, CAST(len(regexp_extract_all(html, '<a ')) AS INTEGER) AS n FROM pages""")
def regex_first(t: Tables) -> DataFrame:
    return t("pages").select("page_id", F.nullif(F.regexp_extract("html", '<a [^>]*href="([^"]*)"', 1), F.lit("")).alias("first_href"), F.regexp_count("html", F.lit("<a ")).alias("n"))


@query("""SELECT doc_id, array_to_string(regexp_extract_all(text, '[A-Z][a-z]+'), ' ') AS capitals FROM documents WHERE text IS NOT NULL""")
def regex_all(t: Tables) -> DataFrame:
    return t("documents").where("text IS NOT NULL").select("doc_id", F.array_join(F.regexp_extract_all("text", F.lit("([A-Z][a-z]+)")), " ").alias("capitals"))


@query(r"""SELECT doc_id, regexp_matches(text, '\p{Ll}') AND NOT regexp_matches(text, '\p{Lu}') AS small_caps FROM documents WHERE text IS NOT NULL""")
def regex_unicode(t: Tables) -> DataFrame:
    return t("documents").where("text IS NOT NULL").select("doc_id", (F.col("text").rlike(r"\p{Ll}") & ~F.col("text").rlike(r"\p{Lu}")).alias("small_caps"))


@query("""SELECT page_id, replace(replace(replace(replace(replace(html, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '&lt;em&gt;', '<em>'), '&lt;/em&gt;', '</em>') AS safe FROM pages""")
def escape_html(t: Tables) -> DataFrame:
    safe = F.regexp_replace(F.regexp_replace(F.regexp_replace("html", "&", "&amp;"), "<", "&lt;"), ">", "&gt;")
    return t("pages").select("page_id", F.regexp_replace(safe, "&lt;(/?em)&gt;", "<$1>").alias("safe"))


@query(r"""SELECT doc_id, len(regexp_extract_all(text, '(?i)\bthe\b')) AS hits, regexp_replace(text[1:220], '(?i)\b(the)\b', '<em>\1</em>', 'g') AS fragment FROM documents WHERE regexp_matches(text, '(?i)\bthe\b')""")
def search_highlight(t: Tables) -> DataFrame:
    return t("documents").where(F.col("text").rlike(r"(?i)\bthe\b")).select("doc_id", F.regexp_count("text", F.lit(r"(?i)\bthe\b")).cast("long").alias("hits"), F.regexp_replace(F.substring("text", 1, 220), r"(?i)\b(the)\b", "<em>$1</em>").alias("fragment"))


@query("""SELECT p_partkey, 'pl' AS scope_kind, p_size AS scope_congress, p_name AS phrase, p_brand AS excluded FROM part""")
def query_parse(t: Tables) -> DataFrame:
    said = F.concat(F.lit("kind:pl congress:"), "p_size", F.lit(' "'), "p_name", F.lit('" -'), "p_brand")
    return t("part").select("p_partkey", F.regexp_extract(said, r"(?:^| )kind:(\S+)", 1).alias("scope_kind"), F.regexp_extract(said, r"(?:^| )congress:([0-9]+)", 1).cast("int").alias("scope_congress"), F.regexp_extract(said, '"([^"]*)"', 1).alias("phrase"), F.regexp_extract(said, r"(?:^| )-(\S+)", 1).alias("excluded"))


@query("""SELECT l_orderkey, l_linenumber, l_partkey, CASE l_linenumber % 3 WHEN 0 THEN 'Sec. ' WHEN 1 THEN 'Title ' ELSE 'Chapter ' END || l_linenumber AS designator,
 l_partkey || CASE WHEN l_partkey % 100 IN (11, 12, 13) THEN 'th' WHEN l_partkey % 10 = 1 THEN 'st' WHEN l_partkey % 10 = 2 THEN 'nd' WHEN l_partkey % 10 = 3 THEN 'rd' ELSE 'th' END || ' law, section ' || l_linenumber AS label FROM lineitem""")
def label_build(t: Tables) -> DataFrame:
    level = F.element_at(F.create_map(F.lit(0), F.lit("Sec. "), F.lit(1), F.lit("Title "), F.lit(2), F.lit("Chapter ")), F.col("l_linenumber") % 3)
    return t("lineitem").select("l_orderkey", "l_linenumber", "l_partkey", F.concat(level, "l_linenumber").alias("designator"), F.concat(ids.ordinal(F.col("l_partkey")), F.lit(" law, section "), "l_linenumber").alias("label"))


@query("""SELECT o_orderkey AS id, 'enacted' AS view, '/us/pl/' || year(o_orderdate) || '/' || o_orderkey AS identifier, o_orderpriority AS heading FROM orders UNION ALL SELECT p_partkey, 'compiled', '/us/comp/' || p_partkey, p_name FROM part""")
def doc_build(t: Tables) -> DataFrame:
    enacted = t("orders").select(F.col("o_orderkey").alias("id"), F.lit("enacted").alias("view"), law_path().alias("identifier"), F.col("o_orderpriority").alias("heading"))
    return enacted.unionByName(t("part").select(F.col("p_partkey").alias("id"), F.lit("compiled").alias("view"), F.concat(F.lit("/us/comp/"), "p_partkey").alias("identifier"), F.col("p_name").alias("heading")))


# windows and keyed state


@query("""
WITH b AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 10 MINUTE THEN 0 ELSE 1 END AS new FROM events),
g AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS s FROM b)
SELECT user_id, min(ts) AS start, max(ts) + INTERVAL 10 MINUTE AS stop, count(*) AS n FROM g GROUP BY user_id, s""")
def session_windows(t: Tables) -> DataFrame:
    return polls.sessions(t("events"), "user_id", "ts", "10 minutes")


@query("""
WITH w AS (SELECT unnest([time_bucket(INTERVAL 30 MINUTE, ts), time_bucket(INTERVAL 30 MINUTE, ts) - INTERVAL 30 MINUTE]) AS start FROM events)
SELECT start, start + INTERVAL 1 HOUR AS stop, count(*) AS n FROM w GROUP BY 1""")
def sliding_windows(t: Tables) -> DataFrame:
    return polls.counted(t("events"), "ts", "1 hour", "30 minutes")


@query("""SELECT event_type, round(quantile_cont(value, 0.5), 6) AS middle, round(quantile_cont(value, 0.9), 6) AS high FROM events GROUP BY 1""")
def percentiles(t: Tables) -> DataFrame:
    return t("events").groupBy("event_type").agg(F.round(F.percentile("value", 0.5), 6).alias("middle"), F.round(F.percentile("value", 0.9), 6).alias("high"))


@query("""SELECT user_id, event_type, min(ts) AS ts FROM events GROUP BY 1, 2""")
def stream_dedupe(t: Tables) -> DataFrame:
    return polls.once(t("events").select("user_id", "event_type", "ts"), ["user_id", "event_type"], "ts")


@query()
def rate_limit(t: Tables) -> DataFrame:
    """Each user's events against a bucket of 5 tokens that fills at one in 20 minutes; no SQL: the fold depends on its own past."""
    return buckets.limited(t("events").select(F.col("user_id").alias("key"), F.col("ts").alias("at"), F.col("event_id").alias("id")), 5.0, 1 / 1200)


@query("""
WITH r AS (SELECT event_id, CASE WHEN event_id % 7 = 0 THEN left(props, length(props) - 1) WHEN event_id % 11 = 0 THEN replace(props, '"k"', '"x"') ELSE props END AS raw FROM events),
p AS (SELECT event_id, raw, CASE WHEN json_valid(raw) THEN CAST(json_extract_string(raw, '$.k') AS BIGINT) END AS k FROM r)
SELECT event_id, CASE WHEN k IS NULL THEN 'bad' ELSE 'good' END AS side, k, CASE WHEN NOT json_valid(raw) THEN 'malformed' WHEN k IS NULL THEN 'no key' END AS reason FROM p""")
def error_split(t: Tables) -> DataFrame:
    """Records read one by one, each failure held apart with its reason; every seventh is cut short and every eleventh lacks its key."""
    n, props = F.col("event_id"), F.col("props")
    raw = F.when(n % 7 == 0, F.expr("left(props, length(props) - 1)")).when(n % 11 == 0, F.replace(props, F.lit('"k"'), F.lit('"x"'))).otherwise(props)
    read = t("events").select("event_id", F.try_parse_json(raw).alias("v")).withColumn("k", F.try_variant_get("v", "$.k", "long"))
    reason = F.when(F.col("v").isNull(), "malformed").when(F.col("k").isNull(), "no key")
    return read.select("event_id", F.when(reason.isNull(), "good").otherwise("bad").alias("side"), "k", reason.alias("reason"))
