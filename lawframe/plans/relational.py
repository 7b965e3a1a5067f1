"""Relational queries whose one SQL text runs on Spark and on DuckDB: scans, predicates, joins, aggregates, sorts, sets."""

from __future__ import annotations

Y = "CAST(year(o_orderdate) AS INT)"
DEC = "CAST({} AS DECIMAL(18, 2))"
PRICE = DEC.format("o_totalprice")
LINE = "l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_shipdate"

SHARED: dict[str, str] = {
    # scans and predicates
    "scan_project": "SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, l_returnflag FROM lineitem",
    "filter_eq": "SELECT o_orderkey, o_custkey FROM orders WHERE o_orderstatus = 'F' AND o_orderpriority = '1-URGENT'",
    "filter_in": "SELECT o_orderkey, o_orderpriority FROM orders WHERE o_orderpriority IN ('1-URGENT', '2-HIGH')",
    "filter_null": "SELECT d.doc_id, l.quality FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id WHERE l.quality IS NULL",
    "filter_or": "SELECT o_orderkey FROM orders WHERE o_orderstatus = 'P' OR o_totalprice > 400000 OR o_custkey < 10",
    "semi_in_subquery": "SELECT o_orderkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')",
    "semi_exists": "SELECT c_custkey FROM customer c WHERE EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey AND o.o_totalprice > 300000)",
    "tuple_gt": f"SELECT o_orderkey, {Y} AS y FROM orders WHERE {Y} > 1998 OR ({Y} = 1998 AND o_orderkey > 5000)",
    "ilike_multi": "SELECT p_partkey, p_name FROM part WHERE p_name ILIKE '%RED%' OR p_brand ILIKE '%#2%' OR p_type ILIKE 'eco%'",
    "path_like": "WITH t AS (SELECT c_custkey, concat('/', r_name, '/', n_name, '/', c_custkey) AS path FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey) SELECT c_custkey, path FROM t WHERE path LIKE '/ASIA/%' OR path LIKE '%/NATION_3/%' OR path LIKE '%/7'",
    "nonblank": "SELECT doc_id FROM documents WHERE length(trim(coalesce(text, ''))) > 0",
    "staleness": "WITH m AS (SELECT max(ts) AS now FROM events), u AS (SELECT user_id, ts, event_type, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r FROM events) SELECT user_id, (ts < now - INTERVAL 7 DAY OR event_type = 'error') AS stale FROM u CROSS JOIN m WHERE r = 1",
    "incremental_since": "SELECT event_id FROM events WHERE ts >= TIMESTAMP '2024-01-10 00:00:00'",
    "overlap_since": "SELECT event_id FROM events WHERE ts >= (SELECT max(ts) - INTERVAL 1 DAY FROM events)",
    # joins
    "join_alias": "WITH a AS (SELECT o_orderkey AS law, concat('/us/pl/', CAST(year(o_orderdate) AS INT), '/', o_orderkey) AS alias, true AS is_primary FROM orders UNION ALL SELECT o_orderkey, concat('/us/act/', CAST(CAST(o_orderdate AS DATE) AS VARCHAR(10)), '/ch', o_custkey), false FROM orders) SELECT alias, is_primary, o_orderstatus FROM a JOIN orders ON law = o_orderkey",
    "join_page": "SELECT s_suppkey, n_name FROM supplier JOIN nation ON s_nationkey = n_nationkey",
    "join_units": "SELECT l_orderkey, l_linenumber, l_partkey, o_orderstatus FROM lineitem JOIN orders ON l_orderkey = o_orderkey",
    "join_composite": "SELECT a.l_orderkey, a.l_linenumber, count(*) AS n FROM lineitem a JOIN (SELECT DISTINCT l_orderkey, l_linenumber FROM lineitem WHERE l_returnflag = 'R') b ON a.l_orderkey = b.l_orderkey AND a.l_linenumber = b.l_linenumber GROUP BY a.l_orderkey, a.l_linenumber",
    "join_chain_left": "SELECT l_orderkey, l_linenumber, l_partkey, p_name, c_name, n_name FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey LEFT JOIN customer ON o_custkey = c_custkey AND c_acctbal > 0 LEFT JOIN nation ON c_nationkey = n_nationkey",
    "left_join_flag": "SELECT p_partkey, count(l_orderkey) AS current_lines FROM part LEFT JOIN lineitem ON l_partkey = p_partkey AND l_returnflag = 'R' GROUP BY p_partkey",
    "cited_counts": "SELECT n_name, count(DISTINCT o_orderkey) AS orders, count(DISTINCT c_custkey) AS customers FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY n_name",
    "enacting_credit": "SELECT l_partkey, min(CASE WHEN l_returnflag = 'A' THEN l_orderkey END) AS credit, coalesce(min(CASE WHEN l_returnflag = 'A' THEN l_orderkey END) < coalesce(min(CASE WHEN l_returnflag = 'R' THEN l_orderkey END), 9223372036854775807), false) AS before FROM lineitem GROUP BY l_partkey",
    "pending_anti": "SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND year(o_orderdate) = 1996)",
    "stale_anti_join": "SELECT p_partkey FROM part LEFT ANTI JOIN lineitem ON l_partkey = p_partkey AND l_shipdate >= DATE '2001-01-01'",
    "due_files": "WITH s AS (SELECT user_id, max(ts) AS last_ts FROM events GROUP BY user_id), h AS (SELECT c_custkey AS id, TIMESTAMP '2024-01-05 00:00:00' AS stored FROM customer WHERE c_custkey % 3 = 0) SELECT user_id FROM s LEFT JOIN h ON user_id = id WHERE stored IS NULL OR last_ts > stored",
    "counterpart": "SELECT a.l_orderkey AS o1, b.l_orderkey AS o2, a.l_linenumber, count(*) AS pairs FROM lineitem a JOIN orders x ON a.l_orderkey = x.o_orderkey JOIN orders y ON x.o_custkey = y.o_custkey AND x.o_orderkey < y.o_orderkey JOIN lineitem b ON b.l_orderkey = y.o_orderkey AND a.l_linenumber = b.l_linenumber GROUP BY a.l_orderkey, b.l_orderkey, a.l_linenumber",
    "fill_dates": "SELECT e.user_id, e.event_id, coalesce(CASE WHEN e.event_type <> 'click' THEN e.ts END, o.first_date) AS dated FROM events e LEFT JOIN (SELECT o_custkey, min(o_orderdate) AS first_date FROM orders GROUP BY o_custkey) o ON e.user_id = o.o_custkey",
    "page_units": "SELECT l_orderkey, l_linenumber, l_partkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY CASE WHEN l_linenumber = 3 THEN 0 ELSE 1 END, " + LINE + ") AS position FROM lineitem",
    # aggregates
    "agg_count": "SELECT count(*) AS n FROM lineitem",
    "agg_distinct": "SELECT count(DISTINCT l_partkey) AS parts, count(DISTINCT l_suppkey) AS suppliers FROM lineitem WHERE l_returnflag = 'A'",
    "agg_group": "SELECT l_returnflag, l_linestatus, count(*) AS n FROM lineitem GROUP BY l_returnflag, l_linestatus",
    "agg_conditional": f"SELECT {Y} AS y, count(*) AS n, count(CASE WHEN o_orderstatus = 'F' THEN 1 END) AS f, count(CASE WHEN o_orderstatus = 'O' THEN 1 END) AS o, count(CASE WHEN o_orderstatus = 'P' THEN 1 END) AS p, count(CASE WHEN o_totalprice > 200000 THEN 1 END) AS large FROM orders GROUP BY {Y}",
    "agg_minmax": "SELECT o_custkey, min(o_orderdate) AS first_date, max(o_orderdate) AS last_date, min(o_orderkey) AS first_key FROM orders GROUP BY o_custkey",
    "agg_multi": "SELECT l_suppkey, count(*) AS n, min(l_shipdate) AS first_ship FROM lineitem WHERE l_quantity > 10 GROUP BY l_suppkey",
    "agg_sum": f"SELECT o_custkey, CAST(sum({PRICE}) AS DOUBLE) AS total FROM orders GROUP BY o_custkey",
    "numeric_min": "SELECT p_type, min(try_cast(regexp_extract(p_brand, '([0-9]+)', 1) AS INT)) AS lowest FROM part GROUP BY p_type",
    "sort_by_count": "SELECT c_custkey, coalesce(n, 0) AS n, row_number() OVER (ORDER BY coalesce(n, 0) DESC, c_custkey) AS position FROM customer LEFT JOIN (SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey) ON o_custkey = c_custkey",
    "sort_nulls": "SELECT c_custkey, last_date, row_number() OVER (ORDER BY last_date ASC NULLS LAST, c_custkey) AS position FROM customer LEFT JOIN (SELECT o_custkey, max(o_orderdate) AS last_date FROM orders WHERE o_orderstatus = 'P' GROUP BY o_custkey) ON o_custkey = c_custkey",
    "overview_totals": f"WITH y AS (SELECT {Y} AS y, count(*) AS n, CAST(sum({PRICE}) AS DOUBLE) AS total FROM orders GROUP BY {Y}) SELECT y, n, total, CAST(sum(n) OVER () AS BIGINT) AS all_orders, n / CAST(max(n) OVER () AS DOUBLE) AS share_of_max FROM y",
    "coverage_flags": "SELECT p_partkey, coalesce(bool_or(l_returnflag = 'R'), false) AS returned, coalesce(bool_or(l_linestatus = 'O'), false) AS open, count(l_orderkey) > 0 AS sold FROM part LEFT JOIN lineitem ON l_partkey = p_partkey GROUP BY p_partkey",
    "letter_groups": "SELECT CASE WHEN upper(substring(p_name, 1, 1)) BETWEEN 'A' AND 'Z' THEN upper(substring(p_name, 1, 1)) ELSE '#' END AS letter, count(*) AS n, min(p_name) AS first_name FROM part GROUP BY 1",
    "subtree_counts": "SELECT concat('/', r_name) AS prefix, count(*) AS n FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY 1 UNION ALL SELECT concat('/', r_name, '/', n_name), count(*) FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY 1",
    "rollup": "SELECT l_returnflag, l_linestatus, count(*) AS n, CAST(grouping(l_linestatus) AS INT) AS g FROM lineitem GROUP BY ROLLUP (l_returnflag, l_linestatus)",
    "cube": "SELECT l_returnflag, l_linestatus, count(*) AS n FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus)",
    "grouping_sets": "SELECT l_returnflag, l_linestatus, count(*) AS n FROM lineitem GROUP BY GROUPING SETS ((l_returnflag), (l_linestatus), ())",
    "interval_join": "SELECT a.event_id, count(b.event_id) AS within FROM events a JOIN events b ON a.user_id = b.user_id AND b.ts > a.ts AND b.ts <= a.ts + INTERVAL 1 HOUR GROUP BY a.event_id",
    # windows
    "latest_per_key": "SELECT user_id, event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r FROM events) WHERE r = 1",
    "first_per_key": "SELECT event_type, event_id FROM (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) AS r FROM events) WHERE r = 1",
    "default_first": f"SELECT l_orderkey, {LINE.split(', ', 1)[1]}, CASE WHEN l_returnflag = 'N' THEN CASE WHEN row_number() OVER (PARTITION BY l_orderkey, l_returnflag ORDER BY {LINE}) = 1 THEN 1 END ELSE l_linenumber END AS number FROM lineitem",
    "occurrence_num": f"SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY {LINE}) AS occurrence FROM lineitem",
    "renumber": f"SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY {LINE}) AS seq FROM lineitem WHERE l_returnflag <> 'N'",
    "dup_counts": f"SELECT {LINE}, count(*) OVER (PARTITION BY l_orderkey, l_linenumber) AS claims FROM lineitem",
    "lead_pair": "SELECT event_id, CASE WHEN next_ts <= ts + INTERVAL 1 MINUTE THEN next_id END AS paired FROM (SELECT event_id, ts, lead(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS next_ts, lead(event_id) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS next_id FROM events)",
    "neighbours": "SELECT o_orderkey, lag(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS previous, lead(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS following FROM orders",
    "rank_functions": "SELECT c_custkey, rank() OVER (PARTITION BY c_mktsegment ORDER BY c_nationkey) AS r, dense_rank() OVER (PARTITION BY c_mktsegment ORDER BY c_nationkey) AS d, ntile(4) OVER (PARTITION BY c_mktsegment ORDER BY c_custkey) AS q, cume_dist() OVER (PARTITION BY c_mktsegment ORDER BY c_nationkey) AS cd FROM customer",
    "running_max": "SELECT user_id, event_id, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY value DESC, ts, event_id) AS r FROM events) WHERE r = 1",
    # sorts and limits
    "page_total": "SELECT o_orderkey, o_totalprice, n_total FROM (SELECT o_orderkey, o_totalprice, count(*) OVER () AS n_total, row_number() OVER (ORDER BY o_totalprice DESC, o_orderkey) AS r FROM orders WHERE o_orderstatus = 'O') WHERE r > 40 AND r <= 60",
    "distinct_page": "SELECT DISTINCT l_partkey FROM lineitem WHERE l_returnflag = 'R' ORDER BY l_partkey LIMIT 20 OFFSET 10",
    "top1": "SELECT o_orderkey, o_orderdate FROM orders ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 1",
    "diverse_topk": "WITH s AS (SELECT p_brand, p_partkey, p_name, CASE WHEN p_name = 'red widget' THEN 0 WHEN p_name LIKE 'red %' THEN 1 WHEN p_name LIKE '%red%' THEN 2 ELSE 4 END AS score FROM part), r AS (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY score, p_name, p_partkey) AS r FROM s WHERE score <= 2) SELECT p_brand, p_partkey, score FROM r WHERE r = 1 ORDER BY score, p_name, p_partkey LIMIT 5",
    # sets
    "set_union": "SELECT o_custkey FROM orders WHERE o_orderstatus = 'F' UNION SELECT c_custkey FROM customer WHERE c_acctbal < 0",
    "set_except": f"SELECT DISTINCT o_custkey FROM orders WHERE {Y} = 1997 EXCEPT SELECT o_custkey FROM orders WHERE {Y} = 1996",
    "set_intersect": f"SELECT o_custkey FROM orders WHERE {Y} = 1997 INTERSECT SELECT o_custkey FROM orders WHERE {Y} = 1996",
    "set_compare": f"WITH a AS (SELECT DISTINCT o_custkey, o_orderstatus AS level FROM orders WHERE {Y} = 1996), b AS (SELECT DISTINCT o_custkey, o_orderstatus AS level FROM orders WHERE {Y} = 1997) SELECT coalesce(a.level, b.level) AS level, count(CASE WHEN a.o_custkey IS NOT NULL AND b.o_custkey IS NOT NULL THEN 1 END) AS common, count(CASE WHEN b.o_custkey IS NULL THEN 1 END) AS only_a, count(CASE WHEN a.o_custkey IS NULL THEN 1 END) AS only_b FROM a FULL OUTER JOIN b ON a.o_custkey = b.o_custkey AND a.level = b.level GROUP BY 1",
    "snapshot_diff": "WITH a AS (SELECT o_orderkey, o_orderstatus FROM orders), b AS (SELECT o_orderkey, CASE WHEN o_orderkey % 100 = 0 THEN 'X' ELSE o_orderstatus END AS o_orderstatus FROM orders) (SELECT 'gone' AS side, * FROM (SELECT * FROM a EXCEPT ALL SELECT * FROM b)) UNION ALL (SELECT 'new' AS side, * FROM (SELECT * FROM b EXCEPT ALL SELECT * FROM a))",
    "norm_dedupe": "SELECT p_partkey, p_name FROM (SELECT p_partkey, p_name, row_number() OVER (PARTITION BY lower(replace(p_name, '.', '')) ORDER BY p_partkey) AS r FROM part) WHERE r = 1",
    "union_views": "SELECT CAST(doc_id AS BIGINT) AS id, 'document' AS kind, CAST(lang AS VARCHAR(20)) AS lang FROM documents UNION ALL SELECT page_id, 'page', NULL FROM pages",
    # expressions
    "doc_ids": "SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CASE WHEN n > 1 THEN concat('/us/', l_orderkey, '/s', l_linenumber, '~', n) ELSE concat('/us/', l_orderkey, '/s', l_linenumber) END AS id FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY " + LINE + ") AS n FROM lineitem)",
    "ordinal": "SELECT c_custkey, concat(c_custkey, CASE WHEN c_custkey % 100 BETWEEN 11 AND 13 THEN 'th' WHEN c_custkey % 10 = 1 THEN 'st' WHEN c_custkey % 10 = 2 THEN 'nd' WHEN c_custkey % 10 = 3 THEN 'rd' ELSE 'th' END) AS label FROM customer",
    "map_lookup": "SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 'final' WHEN 'O' THEN 'open' ELSE 'other' END AS status FROM orders",
    "rule_cascade": "SELECT c_custkey, CASE WHEN c_acctbal IS NULL THEN 'unknown' WHEN c_acctbal < 0 THEN 'debit' WHEN c_mktsegment = 'BUILDING' THEN 'builder' WHEN c_nationkey < 5 THEN 'near' ELSE 'far' END AS rule FROM customer",
    "note_text": "SELECT o_orderkey, concat('Order ', o_orderkey, ' is ', CASE WHEN o_orderstatus = 'F' THEN 'complete' ELSE 'not complete' END, '.') AS note FROM orders",
    "norm_text": "SELECT p_partkey, trim(lower(concat('  ', p_name, ' '))) AS name FROM part",
    "norm_path": "SELECT page_id, concat('/', lower(trim(regexp_extract(url, '//[^/]*/([^?]*)', 1)))) AS path FROM pages",
    "strip_suffix": "SELECT p_partkey, regexp_replace(p_name, ' (widget|ring)$', '') AS stem FROM part",
    "redact": "SELECT page_id, regexp_replace(url, '[?].*$', '') AS url FROM pages",
    "regex_extract": "SELECT page_id, regexp_extract(url, '^https?://([^/]+)', 1) AS host FROM pages",
    "content_hash": None,
    "safe_int": "SELECT p_partkey, try_cast(regexp_replace(p_brand, 'Brand#', '') AS INT) AS brand, try_cast(p_name AS INT) AS bad FROM part",
    "fallback_attr": "SELECT p_partkey, coalesce(CASE WHEN p_size > 20 THEN p_type END, b.p_type_max) AS kind FROM part LEFT JOIN (SELECT p_brand AS brand, max(p_type) AS p_type_max FROM part GROUP BY p_brand) b ON p_brand = brand",
    "ref_targets": "SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CASE WHEN p_partkey IS NULL THEN 'missing' WHEN p_size > 40 THEN 'page' WHEN l_returnflag = 'R' THEN 'history' ELSE 'unit' END AS target FROM lineitem LEFT JOIN part ON l_partkey = p_partkey",
    "collection_status": "SELECT o_orderstatus AS package, count(*) AS laws, max(o_orderdate) AS latest, count(DISTINCT o_custkey) AS holders FROM orders GROUP BY o_orderstatus",
    "index_status": "SELECT count(*) AS edges, count(DISTINCT l_partkey) AS targets, count(DISTINCT l_suppkey) AS origins, max(l_shipdate) AS loaded FROM lineitem",
    "law_sources": "SELECT o_orderkey, CASE WHEN year(o_orderdate) < 1997 THEN 'volumes' WHEN year(o_orderdate) < 1999 THEN 'slips' ELSE 'files' END AS package, EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey) AS loaded FROM orders",
    "section_by_number": f"SELECT l_orderkey, l_linenumber, l_partkey FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY {LINE}) AS r FROM lineitem) WHERE r = 1 AND l_linenumber = 2",
    "cite_resolve": "WITH c AS (SELECT o_orderkey, concat(CAST(year(o_orderdate) AS INT), '-', o_orderkey) AS cite FROM orders), q AS (SELECT concat(1995 + c_custkey % 7, '-', c_custkey) AS asked FROM customer) SELECT asked, o_orderkey, o_orderkey IS NOT NULL AS found FROM q LEFT JOIN c ON asked = cite",
    "listing_parse": "SELECT page_id, regexp_extract(name, '^([A-Z]+)-([0-9]+)', 1) AS collection, try_cast(regexp_extract(name, '-([0-9]+)publ', 1) AS INT) AS congress, try_cast(regexp_extract(name, 'publ([0-9]+)', 1) AS INT) AS number FROM (SELECT page_id, concat('PLAW-', 113 + page_id % 7, 'publ', page_id, '.xml') AS name FROM pages)",
    "bounded_tree": "WITH n AS (SELECT n_regionkey, count(*) AS c FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY n_regionkey) SELECT c_custkey FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN n ON nation.n_regionkey = n.n_regionkey WHERE c <= 300 OR n_nationkey = 7",
    "cited_by": "WITH e AS (SELECT DISTINCT l_suppkey, l_partkey, l_returnflag FROM lineitem) SELECT l_partkey, count(DISTINCT l_suppkey) AS sections, count(CASE WHEN l_returnflag = 'A' THEN 1 END) AS a, count(CASE WHEN l_returnflag = 'N' THEN 1 END) AS n, count(CASE WHEN l_returnflag = 'R' THEN 1 END) AS r FROM e GROUP BY l_partkey",
    "currency_status": "WITH c AS (SELECT l_partkey, o_orderkey, o_orderdate, 1 AS kind FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE l_returnflag = 'A' UNION ALL SELECT l_partkey, o_orderkey, o_orderdate, 2 FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE l_returnflag = 'R' AND NOT (o_orderstatus IS NOT DISTINCT FROM 'P')), f AS (SELECT c.* FROM c JOIN part ON p_partkey = l_partkey WHERE o_orderdate > TIMESTAMP '2000-06-01 00:00:00') SELECT p_partkey, CASE WHEN count(f.kind) > 0 THEN 'known_amended' WHEN p_size > 25 THEN 'no_record' ELSE 'unknown' END AS status, coalesce(bool_or(f.kind = 1), false) AS by_credit, coalesce(bool_or(f.kind = 2), false) AS by_classification, max(f.o_orderdate) AS latest FROM part LEFT JOIN f ON f.l_partkey = p_partkey GROUP BY p_partkey, p_size",
    "search_facets": "SELECT lang, source, count(*) AS n FROM documents WHERE lower(text) LIKE '%license%' GROUP BY lang, source",
    "search_filter": "SELECT doc_id FROM documents WHERE lang IN ('en', 'fr') AND source = 'src3'",
}
SHARED = {k: v for k, v in SHARED.items() if v}
