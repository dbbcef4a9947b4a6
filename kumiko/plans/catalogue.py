"""Queries q01 to q76: Spark plans on the operators, and the same in SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import expand, groups, layout, lookup, pages, quality, records, recover, search, sequence, spatial, versioning

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


class Tables:
    def __init__(self, spark: SparkSession, root: str):
        self._spark, self._root = spark, root

    def __getattr__(self, name: str) -> DataFrame:
        return self._spark.read.parquet(f"{self._root}/{name}.parquet")


def query(sql: str):
    def take(f: Callable[[Tables], DataFrame]):
        name = f.__name__
        QUERIES[name] = lambda spark, root: f(Tables(spark, root))
        ORACLES[name] = sql
        return f

    return take


L = lambda c: F.col(c).cast("long").alias(c)
n_rows = lambda: F.count("*").alias("n")


@query("SELECT strftime(o_orderdate, '%Y%m') AS version, count(*) AS n FROM orders GROUP BY 1")
def q01_catalog_versions(t):
    return t.orders.groupBy(F.date_format("o_orderdate", "yyyyMM").alias("version")).agg(n_rows())


@query("SELECT o_orderkey, o_custkey, strftime(o_orderdate, '%Y%m') AS version FROM orders WHERE strftime(o_orderdate, '%Y%m') = (SELECT max(strftime(o_orderdate, '%Y%m')) FROM orders)")
def q02_latest_snapshot(t):
    return lookup.latest(t.orders.select("o_orderkey", "o_custkey", F.date_format("o_orderdate", "yyyyMM").alias("version")))


@query("SELECT p_brand || CASE WHEN coalesce(p_type, '') = '' THEN '' ELSE ' / ' || p_type END AS title, count(*) AS n FROM part GROUP BY 1")
def q03_listing(t):
    return t.part.groupBy(lookup.listing(t.part, "p_brand", "p_type").alias("title")).agg(n_rows())


@query("SELECT o_orderkey, EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey) AS has_lines FROM orders")
def q04_summary_has_children(t):
    return lookup.with_children(t.orders.select("o_orderkey"), t.lineitem, "o_orderkey", "l_orderkey", "has_lines")


@query("SELECT l_orderkey, l_partkey, l_linenumber FROM lineitem WHERE l_linenumber = 3")
def q05_point_lookup_all(t):
    return lookup.all_of(t.lineitem, "l_linenumber", 3).select("l_orderkey", "l_partkey", "l_linenumber")


@query("SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_partkey, l_suppkey, l_shipdate, l_extendedprice) AS rn FROM lineitem) WHERE rn = 1")
def q06_point_lookup_first(t):
    return lookup.first_of(t.lineitem, ["l_orderkey", "l_linenumber"], ["l_partkey", "l_suppkey", "l_shipdate", "l_extendedprice"]).select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")


@query("SELECT n_nationkey, r_name, translate(CAST(n_regionkey AS VARCHAR), '0123456789', '０１２３４５６７８９') AS wide FROM nation JOIN region ON n_regionkey = r_regionkey")
def q07_normalized_code_lookup(t):
    wide = t.nation.withColumn("wide", T.wide_digits(F.col("n_regionkey").cast("string")))
    codes = t.region.withColumn("code", F.col("r_regionkey").cast("string"))
    return wide.join(codes, T.code_key(F.col("wide")) == F.col("code")).select("n_nationkey", "r_name", "wide")


@query("""WITH w AS (SELECT DISTINCT CAST(n_nationkey AS INT) AS wanted FROM nation),
tg AS (SELECT wanted, r_regionkey AS g, 'target' AS match FROM region JOIN w ON r_regionkey = wanted),
sr AS (SELECT DISTINCT wanted, n_regionkey AS g, 'source' AS match FROM nation JOIN w ON n_nationkey = wanted)
SELECT * FROM tg UNION ALL SELECT * FROM sr WHERE NOT EXISTS (SELECT 1 FROM tg WHERE tg.wanted = sr.wanted AND tg.g = sr.g)""")
def q08_bidirectional_group_lookup(t):
    groups = t.region.select(F.col("r_regionkey").alias("g"), F.col("r_regionkey").alias("target_code"))
    sources = t.nation.select(F.col("n_regionkey").alias("g"), F.col("n_nationkey").alias("code"))
    return lookup.group_lookup(groups, sources, "g", None, t.nation.select(F.col("n_nationkey").alias("wanted")).distinct()).select("wanted", "g", "match")


def _snippet_sql(text: str, keyword: str) -> str:
    flat, n = f"replace({text}, chr(10), ' ')", len(keyword)
    at, trim = f"(instr(lower({flat}), '{keyword}') - 1)", r"'^\s+|\s+$', '', 'g'"
    start, stop = f"greatest({at} - 30, 0)", f"least(length({flat}), {at} + {n} + 30)"
    return f"(CASE WHEN {start} > 0 THEN '…' ELSE '' END || regexp_replace(substr({flat}, CAST({start} + 1 AS INT), CAST({stop} - {start} AS INT)), {trim}) || CASE WHEN {stop} < length({flat}) THEN '…' ELSE '' END)"


@query(f"SELECT doc_id, {_snippet_sql('text', 'license')} AS snippet FROM documents WHERE contains(lower(text), 'license')")
def q09_keyword_search_snippet(t):
    return t.documents.filter(T.contains_keyword(F.col("text"), "license")).select("doc_id", T.snippet(F.col("text"), "license").alias("snippet"))


@query(f"""SELECT 'document' AS type, CAST(doc_id AS VARCHAR) AS key, source AS title, 'text' AS "where", {_snippet_sql('text', 'the')} AS snippet FROM documents WHERE contains(lower(text), 'the')
UNION ALL SELECT 'part', CAST(p_partkey AS VARCHAR), p_brand, concat_ws(',', CASE WHEN contains(lower(p_name), 'the') THEN 'name' END, CASE WHEN contains(lower(p_type), 'the') THEN 'type' END),
CASE WHEN contains(lower(p_name), 'the') THEN {_snippet_sql('p_name', 'the')} ELSE {_snippet_sql('p_type', 'the')} END FROM part WHERE contains(lower(p_name), 'the') OR contains(lower(p_type), 'the')
UNION ALL SELECT 'page', CAST(page_id AS VARCHAR), url, 'url', {_snippet_sql('url', 'the')} FROM pages WHERE contains(lower(url), 'the')""")
def q10_cross_corpus_search(t):
    d = search.hits(t.documents, "document", F.col("doc_id").cast("string"), {"text": F.col("text")}, "the", F.col("source"))
    p = search.hits(t.part, "part", F.col("p_partkey").cast("string"), {"name": F.col("p_name"), "type": F.col("p_type")}, "the", F.col("p_brand"))
    g = search.hits(t.pages, "page", F.col("page_id").cast("string"), {"url": F.col("url")}, "the", F.col("url"))
    return search.search([d, p, g])


@query("SELECT doc_id, total, total > 10 AS truncated FROM (SELECT doc_id, count(*) OVER () AS total FROM documents WHERE contains(lower(text), 'license')) ORDER BY doc_id LIMIT 10")
def q11_search_limit_truncated(t):
    return lookup.limited(t.documents.filter(T.contains_keyword(F.col("text"), "license")).select("doc_id"), ["doc_id"], 10)


@query("SELECT p_size FROM (SELECT DISTINCT p_size FROM part WHERE p_size IS NOT NULL) ORDER BY abs(p_size - 60), p_size LIMIT 5")
def q12_nearest_topk(t):
    return lookup.nearest(t.part, "p_size", 60)


_GAPS = """WITH r AS (SELECT l_orderkey, min(l_linenumber) AS lo, max(l_linenumber) AS hi FROM lineitem GROUP BY 1),
a AS (SELECT l_orderkey, lo, hi, unnest(generate_series(lo, hi)) AS k FROM r),
m AS (SELECT a.* FROM a WHERE NOT EXISTS (SELECT 1 FROM lineitem l WHERE l.l_orderkey = a.l_orderkey AND l.l_linenumber = a.k))"""


@query(_GAPS + " SELECT l_orderkey, string_agg(CAST(k AS VARCHAR), ',' ORDER BY k) AS missing FROM m GROUP BY 1")
def q13_seq_gaps(t):
    out = sequence.missing_numbers(t.lineitem, ["l_orderkey"], "l_linenumber").filter(F.size("missing") > 0)
    return out.select("l_orderkey", F.array_join(F.array_sort("missing"), ",").alias("missing"))


@query(_GAPS + " SELECT l_orderkey, CAST(max(hi) - max(lo) + 1 AS BIGINT) AS expected, count(*) AS missing_count, CASE WHEN count(*) >= 20 OR count(*) * 5 >= max(hi) - max(lo) + 1 THEN 'error' ELSE 'warning' END AS severity FROM m GROUP BY 1")
def q14_seq_gap_severity(t):
    return quality.missing_issues(t.lineitem, ["l_orderkey"], "l_linenumber").select("l_orderkey", L("expected"), L("missing_count"), "severity")


_POS = "row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_shipdate, l_extendedprice, l_quantity)"


@query(f"SELECT l_orderkey, l_linenumber, pos, first_pos FROM (SELECT *, min(pos) OVER (PARTITION BY l_orderkey, l_linenumber) AS first_pos FROM (SELECT *, {_POS} AS pos FROM lineitem)) WHERE pos > first_pos")
def q15_duplicate_keys_first_index(t):
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_shipdate", "l_extendedprice", "l_quantity")
    rows = t.lineitem.withColumn("pos", F.row_number().over(w).cast("long"))
    return quality.duplicates(rows, ["l_orderkey", "l_linenumber"], "pos").select("l_orderkey", "l_linenumber", "pos", "first_pos")


@query("SELECT min(doc_id) AS doc_id, source FROM documents GROUP BY text, source")
def q16_first_wins_dedup(t):
    # the text's group is found by the text itself; the sum keeps the smallest id before the shuffle
    return t.documents.groupBy("text", "source").agg(F.min("doc_id").alias("doc_id")).select("doc_id", "source")


@query("SELECT doc_id, CASE WHEN coalesce(text, '') = '' THEN 'empty' WHEN contains(text, chr(10)) THEN 'newline' WHEN (ends_with(list_extract(string_split(text, '/'), -1), 'グルー') OR ends_with(list_extract(string_split(text, '/'), -1), 'コ') OR ends_with(list_extract(string_split(text, '/'), -1), 'ロ')) AND length(text) <= 12 THEN 'cut' END AS rule FROM documents")
def q17_name_rule_chain(t):
    return t.documents.select("doc_id", quality.name_rule(F.col("text")).alias("rule"))


@query("SELECT 'event' AS kind, CAST(event_id AS VARCHAR) AS id FROM events WHERE event_type NOT IN ('click', 'view', 'purchase') UNION ALL SELECT 'order', CAST(o_orderkey AS VARCHAR) FROM orders WHERE NOT regexp_matches(o_orderpriority, '^[0-9]+$')")
def q18_enum_domain_check(t):
    a = quality.not_in_domain(t.events, "event_type", ("click", "view", "purchase")).select(F.lit("event").alias("kind"), F.col("event_id").cast("string").alias("id"))
    return a.union(quality.not_digits(t.orders, "o_orderpriority").select(F.lit("order"), F.col("o_orderkey").cast("string")))


@query("SELECT conv_id, turn, CAST(length(text) AS BIGINT) AS n_chars FROM conversations WHERE length(text) > 200")
def q19_overlong_text(t):
    return quality.too_long(t.conversations, "text", 200).select("conv_id", "turn", F.length("text").cast("long").alias("n_chars"))


_YEARS = """n AS (SELECT o_custkey AS k, count(*) AS c FROM orders WHERE year(o_orderdate) = 1998 GROUP BY 1), b AS (SELECT o_custkey AS k, count(*) AS c FROM orders WHERE year(o_orderdate) = 1997 GROUP BY 1)"""


def _years(t):
    per = lambda y: t.orders.filter(F.year("o_orderdate") == y).groupBy(F.col("o_custkey").alias("k")).agg(F.count("*").alias("c"))
    return per(1998), per(1997)


@query(f"WITH {_YEARS} SELECT n.k, n.c, b.c AS baseline, n.c - b.c AS delta, CASE WHEN b.c IS NULL THEN 'added' WHEN n.c <> b.c THEN 'changed' ELSE 'same' END AS status, coalesce(abs(n.c - b.c) * 5 > b.c, false) AS large FROM n LEFT JOIN b ON n.k = b.k")
def q20_baseline_diff(t):
    return versioning.diff_counts(*_years(t), "k", "c")


@query(f"WITH {_YEARS} SELECT k, 'added' AS change FROM (SELECT k FROM n EXCEPT SELECT k FROM b) UNION ALL SELECT k, 'removed' FROM (SELECT k FROM b EXCEPT SELECT k FROM n)")
def q21_baseline_added_removed(t):
    return versioning.added_removed(*_years(t), "k")


@query("""WITH i AS (SELECT 'lineitem' AS id, 'warning' AS severity FROM lineitem WHERE l_discount > 0.09 UNION ALL SELECT 'orders', 'error' FROM orders WHERE o_totalprice < 1000 UNION ALL SELECT 'customer', 'error' FROM customer WHERE c_acctbal < -999999)
SELECT e.id AS entity_id, count(i.id) AS n_issues, CAST(coalesce(sum(CASE WHEN severity = 'error' THEN 1 ELSE 0 END), 0) AS BIGINT) AS n_errors, coalesce(sum(CASE WHEN severity = 'error' THEN 1 ELSE 0 END), 0) = 0 AS ok FROM (VALUES ('lineitem'), ('orders'), ('customer')) e(id) LEFT JOIN i ON i.id = e.id GROUP BY 1""")
def q22_verify_report(t):
    parts = [
        quality.issue(t.lineitem.filter("l_discount > 0.09"), "table", F.lit("lineitem"), "warning", "discount", ""),
        quality.issue(t.orders.filter("o_totalprice < 1000"), "table", F.lit("orders"), "error", "price", ""),
        quality.issue(t.customer.filter("c_acctbal < -999999"), "table", F.lit("customer"), "error", "balance", ""),
    ]
    names = t.region.sparkSession.createDataFrame([("lineitem",), ("orders",), ("customer",)], "entity_id string")
    return quality.report(names, quality.all_issues(parts))


@query("SELECT event_id, last_value(CASE WHEN event_type = 'purchase' THEN event_id END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS last_purchase FROM events")
def q23_forward_fill_label(t):
    return sequence.forward_fill(t.events, ["user_id"], ["ts", "event_id"], F.when(F.col("event_type") == "purchase", F.col("event_id")), "last_purchase").select("event_id", "last_purchase")


@query("""WITH a AS (SELECT *, CASE WHEN lag(event_type) OVER w = event_type THEN 0 ELSE 1 END AS c FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
b AS (SELECT *, sum(c) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) - 1 AS i FROM a)
SELECT user_id, CAST(i AS BIGINT) AS island, event_type, count(*) AS n FROM b GROUP BY ALL""")
def q24_islands(t):
    return sequence.islands(t.events, ["user_id"], ["ts", "event_id"], "event_type").select("user_id", L("island"), "event_type", "n")


@query("SELECT o_custkey, o_orderkey, coalesce(lead(CAST(o_orderdate AS DATE)) OVER (PARTITION BY o_custkey ORDER BY CAST(o_orderdate AS DATE), o_orderkey) - 1, DATE '9999-12-31') AS stop FROM orders")
def q25_end_from_next_start(t):
    days = t.orders.select("o_custkey", "o_orderkey", F.to_date("o_orderdate").alias("start"))
    return sequence.end_from_next(days, ["o_custkey"], "start", F.to_date(F.lit("9999-12-31")), F.expr("interval 1 day"), order=("o_orderkey",)).select("o_custkey", "o_orderkey", F.to_date("stop").alias("stop"))


_EDGES = "e AS (SELECT DISTINCT user_id, CAST(floor(value / 10) * 10 AS BIGINT) AS lo FROM events), b AS (SELECT user_id, lo, coalesce(lead(lo) OVER (PARTITION BY user_id ORDER BY lo), 1000000) AS hi FROM e)"


def _bands(t):
    edges = t.events.select("user_id", (F.floor(F.col("value") / 10) * 10).cast("long").alias("edge"))
    return sequence.bands(edges, ["user_id"], "edge", F.lit(1000000).cast("long"))


@query(f"WITH {_EDGES} SELECT user_id, lo, hi FROM b WHERE hi - lo BETWEEN 5 AND 40")
def q26_bands_from_boundaries(t):
    return _bands(t).filter("hi - lo between 5 and 40")


@query(f"WITH {_EDGES} SELECT event_id, lo, hi FROM events JOIN b USING (user_id) WHERE value >= lo AND value < hi")
def q27_band_join_half_open(t):
    return spatial.band_join(t.events.select("event_id", "user_id", "value"), _bands(t), ["user_id"], "value").select("event_id", "lo", "hi")


_BOXES = [(1, 1.0, 10.0, 900.0, 1200.0), (2, 10.0, 20.0, 1000.0, 1100.0), (3, 45.0, 50.0, 0.0, 2000.0)]


@query("WITH b(id, x_lo, x_hi, y_lo, y_hi) AS (VALUES " + ", ".join(map(str, _BOXES)) + ") SELECT CAST(id AS INT) AS id, string_agg(p_name, '|' ORDER BY p_retailprice, p_size, p_name) AS names FROM part JOIN b ON p_size BETWEEN x_lo AND x_hi AND p_retailprice BETWEEN y_lo AND y_hi GROUP BY 1")
def q28_box_join_ordered_text(t):
    boxes = t.part.sparkSession.createDataFrame(_BOXES, "id int, x_lo double, x_hi double, y_lo double, y_hi double")
    return spatial.box_text(spatial.box_join(t.part, boxes, "p_size", "p_retailprice"), ["id"], "p_retailprice", "p_size", "p_name", "|", "names")


@query("SELECT s_suppkey, s_name FROM supplier WHERE s_nationkey NOT IN (SELECT n_nationkey FROM nation WHERE n_regionkey = 1) UNION ALL SELECT s_suppkey, 'recovered ' || n_name FROM supplier JOIN nation ON s_nationkey = n_nationkey WHERE n_regionkey = 1")
def q29_replace_rows(t):
    found = t.supplier.join(t.nation.filter("n_regionkey = 1"), F.col("s_nationkey") == F.col("n_nationkey")).select("s_suppkey", F.concat(F.lit("recovered "), "n_name").alias("s_name"))
    return versioning.replace_recovered(t.supplier.select("s_suppkey", "s_name"), found, ["s_suppkey"])


@query("SELECT c_custkey, CASE WHEN c_acctbal < 0 THEN 'updated' ELSE c_mktsegment END AS c_mktsegment FROM customer UNION ALL SELECT -c_custkey - 1, 'new' FROM customer WHERE c_acctbal > 9000")
def q30_upsert_by_key(t):
    old = t.customer.select("c_custkey", "c_mktsegment")
    new = t.customer.filter("c_acctbal < 0").select("c_custkey", F.lit("updated").alias("c_mktsegment")).union(t.customer.filter("c_acctbal > 9000").select(-F.col("c_custkey") - 1, F.lit("new")))
    return versioning.upsert(old, new, ["c_custkey"])


@query("SELECT o_orderkey, '2999' AS version FROM orders WHERE year(o_orderdate) = (SELECT max(year(o_orderdate)) FROM orders) AND o_orderstatus <> 'P'")
def q31_snapshot_seed(t):
    rows = t.orders.select("o_orderkey", "o_orderstatus", F.date_format("o_orderdate", "yyyy").alias("version"))
    return versioning.seed_snapshot(rows, "version", None, "2999", F.col("o_orderstatus") != "P").select("o_orderkey", "version")


@query("""WITH p AS (SELECT p_partkey, string_split(p_name, ' ') AS a, string_split(p_type, ' ') AS b FROM part), x AS (SELECT *, unnest(generate_series(0, greatest(1, len(a), len(b)) - 1)) AS pos FROM p)
SELECT p_partkey, CAST(pos AS BIGINT) AS pos, coalesce(a[pos + 1], a[-1], '') AS a, coalesce(b[pos + 1], b[-1], '') AS b FROM x""")
def q32_zip_expand_index_or_last(t):
    rows = t.part.select("p_partkey", F.split("p_name", " ").alias("x"), F.split("p_type", " ").alias("y"))
    return expand.zip_expand(rows, {"a": F.col("x"), "b": F.col("y")}).select("p_partkey", L("pos"), "a", "b")


@query("""WITH p AS (SELECT p_partkey, p_size AS n, 1 + p_partkey % 4 AS k FROM part WHERE p_size % (1 + p_partkey % 4) = 0 AND p_size > 0), c AS (SELECT *, unnest(generate_series(0, n // k - 1)) AS cycle FROM p), s AS (SELECT *, unnest(generate_series(0, k - 1)) AS sub FROM c)
SELECT p_partkey, CAST(cycle AS BIGINT) AS cycle, CAST(sub AS BIGINT) AS sub, CAST(10 + cycle * k + sub AS BIGINT) AS number FROM s""")
def q33_range_expand_nxm(t):
    hi = F.col("p_size") + 9
    return expand.range_expand(t.part.select("p_partkey", "p_size"), F.lit(10), hi, (F.col("p_partkey") % 4 + 1).cast("int")).select("p_partkey", L("cycle"), L("sub"), L("number"))


@query("SELECT r_regionkey, substr('①②③④⑤', i, 1) AS label FROM (SELECT r_regionkey, unnest(generate_series(1, r_regionkey + 1)) AS i FROM region WHERE r_regionkey < 5)")
def q34_label_expand(t):
    name = F.concat(F.lit("項目①～"), F.substr(F.lit(T.CIRCLED), F.col("r_regionkey") + 1, F.lit(1)))
    rows = t.region.filter("r_regionkey < 5").select("r_regionkey", name.alias("name"))
    return rows.select("r_regionkey", F.explode(T.group_labels(F.col("name"), F.col("r_regionkey") + 1)).alias("label"))


@query("SELECT n_regionkey, CAST(n_nationkey AS VARCHAR) AS code, n_name AS name FROM nation WHERE n_regionkey IN (SELECT n_regionkey FROM nation GROUP BY 1 HAVING count(*) >= 2)")
def q35_code_lines_roundtrip(t):
    lines = t.nation.select("n_regionkey", "n_nationkey", F.concat(T.wide_digits(F.col("n_nationkey").cast("string")), F.lit("："), "n_name").alias("line"))
    texts = sequence.joined_text(lines, ["n_regionkey"], ["n_nationkey"], "line")
    return texts.select("n_regionkey", F.explode(T.code_lines(F.col("text"))).alias("c")).select("n_regionkey", "c.code", "c.name")


@query(r"""WITH l AS (SELECT doc_id, unnest(string_split('1:first' || chr(10) || '2:second' || chr(10) || text, chr(10))) AS raw, generate_subscripts(string_split('1:first' || chr(10) || '2:second' || chr(10) || text, chr(10)), 1) AS pos FROM documents WHERE text IS NOT NULL),
s AS (SELECT doc_id, pos, regexp_replace(raw, '^\s+|\s+$', '', 'g') AS line FROM l),
k AS (SELECT *, regexp_matches(line, '^[0-9A-Za-z]{1,3}[:：]') AS code FROM s),
g AS (SELECT *, sum(CASE WHEN code THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY pos ROWS UNBOUNDED PRECEDING) AS grp FROM k),
p AS (SELECT *, CASE WHEN code THEN regexp_extract(line, '^([0-9A-Za-z]{1,3})[:：]', 1) END AS c, CASE WHEN code THEN regexp_replace(regexp_replace(line, '^[0-9A-Za-z]{1,3}[:：]', ''), '^\s+|\s+$', '', 'g') ELSE line END AS part FROM g WHERE grp > 0),
n AS (SELECT *, coalesce(sum(length(part)) OVER (PARTITION BY doc_id, grp ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before, lag(part) OVER (PARTITION BY doc_id, grp ORDER BY pos) AS prev FROM p),
z AS (SELECT *, max(CASE WHEN NOT code AND (line = '' OR before >= 80 OR regexp_matches(prev, '[。．]$') OR regexp_matches(line, '^(""" + "|".join(T.EXPLANATIONS) + r""")')) THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id, grp ORDER BY pos ROWS UNBOUNDED PRECEDING) AS ended FROM n)
SELECT doc_id, max(c) AS code, string_agg(part, '' ORDER BY pos) AS name FROM z WHERE ended = 0 GROUP BY doc_id, grp""")
def q36_code_lines_terminators(t):
    text = F.concat(F.lit("1:first\n2:second\n"), "text")
    return t.documents.filter("text is not null").select("doc_id", F.explode(T.code_lines(text)).alias("c")).select("doc_id", "c.code", "c.name")


@query("""WITH l AS (SELECT page_id, regexp_extract_all(html, '<a href="([^"]*)">([^<]*)</a>', 1) AS h, regexp_extract_all(html, '<a href="([^"]*)">([^<]*)</a>', 2) AS x FROM pages)
SELECT page_id, CAST(pos AS BIGINT) AS pos, h[pos] AS href, x[pos] AS label FROM (SELECT *, unnest(generate_series(1, len(h))) AS pos FROM l)""")
def q37_html_pairs(t):
    pattern = F.lit('<a href="([^"]*)">([^<]*)</a>')
    both = F.arrays_zip(F.regexp_extract_all("html", pattern, F.lit(1)).alias("href"), F.regexp_extract_all("html", pattern, F.lit(2)).alias("label"))
    return t.pages.select("page_id", F.posexplode(both).alias("pos", "p")).select("page_id", (F.col("pos") + 1).cast("long").alias("pos"), F.col("p.href").alias("href"), F.col("p.label").alias("label"))


@query("""WITH h AS (SELECT page_id, list_transform(regexp_extract_all(html, '<([a-z0-9]+)', 1), lambda x: x) AS tags FROM pages)
SELECT page_id, CAST(list_position(tags, 'title') - 1 AS BIGINT) AS title_at, CAST(list_position(tags, 'p') - 1 AS BIGINT) AS p_at, list_contains(tags, 'nav') AND list_contains(tags, 'p') AS header FROM h""")
def q38_header_column_map(t):
    # column_map keeps the last of equal headers: from the end backwards that is the first
    tags = F.regexp_extract_all("html", F.lit("<([a-z0-9]+)"), F.lit(1))
    rows = t.pages.select("page_id", tags.alias("tags"), expand.column_map(F.reverse(tags), {"title": "title_at", "p": "p_at"}).alias("m"))
    at = lambda name: (F.size("tags") - 1 - F.try_element_at("m", F.lit(name))).cast("long").alias(name)
    return rows.select("page_id", at("title_at"), at("p_at"), (F.array_contains("tags", "nav") & F.array_contains("tags", "p")).alias("header"))


_PATH = "list_filter(string_split(regexp_replace(url, '^https?://', ''), '/'), lambda x: true)"


@query(f"""WITH p AS (SELECT page_id, {_PATH} AS c FROM pages), i AS (SELECT *, list_position(list_transform(c, lambda x: regexp_matches(x, '^[0-9]+$')), true) AS k FROM p)
SELECT page_id, c[k] AS code, coalesce(list_filter(c[k + 1:], lambda x: x <> '')[1], '') AS name FROM i WHERE k > 0""")
def q39_first_number_then_name(t):
    cells = F.split(F.regexp_replace("url", "^https?://", ""), "/")
    return t.pages.select("page_id", T.first_number_and_name(cells).alias("p")).filter("p is not null").select("page_id", "p.code", "p.name")


@query("""SELECT page_id, CASE WHEN page_id % 4 IN (0, 1) THEN 'master' WHEN page_id % 4 = 2 THEN 'appendix' END AS kind, CASE WHEN page_id % 3 = 0 THEN 'unknown' ELSE '20260' || CAST(101 + page_id % 9 AS VARCHAR) END AS version FROM pages""")
def q40_kind_version_inference(t):
    version = F.concat(F.lit("20260"), (F.col("page_id") % 9 + 101).cast("string"))
    name = F.concat(F.lit("master_"), (F.col("page_id") % 4).cast("string"), F.lit("_"), version, F.lit(".pdf"))
    return t.pages.select("page_id", T.kind_from_file(name).alias("kind"), T.version_from_file(F.when(F.col("page_id") % 3 != 0, name).otherwise("no number")).alias("version"))


@query("SELECT p_partkey, CASE p_partkey % 3 WHEN 2 THEN NULL ELSE p_size END AS size, p_partkey % 3 = 0 AS sub, CASE WHEN p_partkey % 3 = 2 THEN CAST(p_size AS VARCHAR) || '以内' END AS raw FROM part")
def q41_size_parse(t):
    n, k = F.col("p_size").cast("string"), F.col("p_partkey") % 3
    raw = F.when(k == 0, F.concat(F.lit("（"), T.wide_digits(n), F.lit("）"))).when(k == 1, n).otherwise(F.concat(n, F.lit("以内")))
    return t.part.select("p_partkey", T.byte_size(raw).alias("s")).select("p_partkey", "s.size", "s.sub", "s.raw")


_LINES = r"list_filter(list_transform(string_split(text, chr(10)), lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')), lambda x: x <> '')"


@query(f"SELECT doc_id, CAST(len({_LINES}) AS BIGINT) AS n_lines, ({_LINES})[1] AS head FROM documents")
def q42_split_lines_count(t):
    return t.documents.select("doc_id", F.size(T.split_lines(F.col("text"))).cast("long").alias("n_lines"), T.first_line(F.col("text")).alias("head"))


@query("SELECT lineage, count(*) AS n FROM (SELECT CASE WHEN EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id) THEN 'label' WHEN source = 'src0' THEN 'source' ELSE 'default' END AS lineage FROM documents d) GROUP BY 1")
def q43_lineage_counts(t):
    docs = t.documents.select("doc_id", "source")
    parts = [("label", docs.join(t.labels, "doc_id", "left_semi")), ("source", docs.filter("source = 'src0'")), ("default", docs)]
    return versioning.by_priority(parts, ["doc_id"], []).groupBy("lineage").agg(n_rows())


@query("SELECT doc_id, sha256(text) AS digest FROM documents")
def q44_content_sha256(t):
    return t.documents.select("doc_id", F.sha2(F.encode("text", "UTF-8"), 256).alias("digest"))


@query("SELECT event_id, key, json_extract_string(props, '$.' || key) AS value FROM (SELECT event_id, props, unnest(json_keys(props)) AS key FROM events) WHERE json_extract_string(props, '$.' || key) <> ''")
def q45_flags_map(t):
    return t.events.select("event_id", F.explode(records.filled(F.from_json("props", records.FLAGS))).alias("key", "value"))


@query("""WITH a AS (SELECT *, sum(CASE WHEN role = 'user' THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) AS r FROM conversations) SELECT conv_id, CAST(r AS BIGINT) AS record, string_agg(text, chr(10) ORDER BY turn) AS text FROM a GROUP BY 1, 2""")
def q46_continuation_concat(t):
    rows = sequence.continued(t.conversations, ["conv_id"], ["turn"], F.col("role") == "user")
    return sequence.joined_text(rows, ["conv_id", "record"], ["turn"], "text").select("conv_id", L("record"), "text")


@query("""WITH a AS (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS k FROM events), b AS (SELECT *, max(CASE WHEN k > 1 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS s FROM a) SELECT user_id, event_id, event_type FROM b WHERE s = 0""")
def q47_cycle_stop(t):
    return sequence.until_repeat(t.events, ["user_id"], ["ts", "event_id"], "event_type").select("user_id", "event_id", "event_type")


@query("SELECT event_id, arg_min(x, y) AS next_purchase FROM (SELECT a.event_id, b.event_id AS x, b.rn AS y FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn FROM events) a LEFT JOIN (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn FROM events) b ON a.user_id = b.user_id AND b.rn > a.rn AND b.rn <= a.rn + 59 AND b.event_type = 'purchase') GROUP BY 1")
def q48_bounded_lookahead(t):
    return sequence.look_ahead(t.events, ["user_id"], ["ts", "event_id"], F.col("event_type") == "purchase", F.col("event_id"), 59, "next_purchase").select("event_id", "next_purchase")


_ALL = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents"]


@query(" UNION ALL ".join(f"SELECT '{n}' AS name, count(*) AS n FROM {n}" for n in _ALL))
def q49_catalog_info(t):
    return search.search([getattr(t, n).agg(n_rows()).select(F.lit(n).alias("name"), "n") for n in _ALL])


@query("SELECT conv_id, turn, role = 'assistant' AND coalesce(lag(role) OVER (PARTITION BY conv_id ORDER BY turn) <> 'assistant', false) AS parent FROM conversations")
def q50_sibling_pairing(t):
    return sequence.paired(t.conversations, ["conv_id"], ["turn"], F.col("role") == "assistant").select("conv_id", "turn", "parent")


@query(_GAPS + ", r2 AS (SELECT l_orderkey, count(*) AS overlap FROM m WHERE k BETWEEN 2 AND 6 GROUP BY 1) SELECT l_orderkey, overlap FROM r2 WHERE overlap >= 2")
def q51_interval_overlap_trigger(t):
    gaps = sequence.missing_numbers(t.lineitem, ["l_orderkey"], "l_linenumber")
    defects = gaps.select(F.col("l_orderkey").alias("section"), F.explode("missing").alias("seq"))
    ranges = t.lineitem.select(F.col("l_orderkey").alias("section"), F.lit(2).alias("lo"), F.lit(6).alias("hi")).distinct()
    return pages.recoverable(ranges, defects).select(F.col("section").alias("l_orderkey"), L("overlap"))


@query("SELECT DISTINCT p_brand FROM part WHERE p_size <= 25 EXCEPT SELECT DISTINCT p_brand FROM part WHERE p_size > 49")
def q52_stale_partitions(t):
    return versioning.stale(t.part.filter("p_size <= 25"), t.part.filter("p_size > 49"), "p_brand")


@query("SELECT n_nationkey AS code, n_name AS name, 'code' AS match, CASE WHEN starts_with(r_name, 'A') THEN 'a' WHEN starts_with(r_name, 'E') THEN 'e' ELSE 'other' END AS kind FROM nation JOIN region ON n_regionkey = r_regionkey WHERE n_nationkey = 7")
def q53_pair_lookup_and_listing(t):
    kind = F.coalesce(pages.kind_by_prefix(F.col("r_name"), {"A": "a", "E": "e"}), F.lit("other"))
    hit = lookup.pair_lookup(t.nation.select(F.col("n_nationkey").alias("code"), F.col("n_name").alias("name"), "n_regionkey"), "code", 7)
    return hit.join(t.region, F.col("n_regionkey") == F.col("r_regionkey")).select("code", "name", "match", kind.alias("kind"))


@query("""WITH s AS (SELECT n_regionkey, n_name, row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) AS k FROM nation), g AS (SELECT r_regionkey, r_name, bool_or(contains(lower(n_name), 'a')) AS hit, string_agg(n_name, ',' ORDER BY k) FILTER (k <= 5) AS first FROM region JOIN s ON n_regionkey = r_regionkey GROUP BY 1, 2)
SELECT r_regionkey, concat_ws(',', CASE WHEN contains(lower(r_name), 'a') THEN 'target' END, CASE WHEN hit THEN 'sources' END) AS "where", first AS first_sources FROM g WHERE hit OR contains(lower(r_name), 'a')""")
def q54_group_search_where(t):
    return _region_groups(t, "a").select(F.col("pos").alias("r_regionkey"), F.array_join(F.transform("where", lambda w: F.when(w == "targetName", "target").otherwise(w)), ",").alias("where"), F.array_join(F.transform("first", lambda x: x["name"]), ",").alias("first_sources"))


def _region_groups(t, keyword):
    """Hits among regions as groups of nations; `first` has the group's first five sources."""
    members = F.transform(F.array_sort(F.collect_list(F.struct("n_nationkey", F.col("n_name").alias("name")))), lambda m: F.struct(F.lit("").alias("code"), m["name"].alias("name")))
    of = t.nation.groupBy("n_regionkey").agg(members.alias("sources")).join(t.region, F.col("n_regionkey") == F.col("r_regionkey"))
    rows = of.select(F.lit(0).alias("entity_pos"), F.col("r_regionkey").alias("group_pos"), F.lit("t").alias("table_id"), F.lit("T").alias("table_name"), F.lit("nayoseGroups").alias("kind"), F.lit("").alias("target_code"), F.col("r_name").alias("target_name"), F.lit(None).cast("string").alias("note"), "sources")
    return search.group_hits(rows, keyword).withColumnRenamed("sources", "matching").join(rows.select(F.col("group_pos").alias("pos"), F.slice("sources", 1, search.SHOWN).alias("first")), "pos")


@query("SELECT CAST(c_custkey AS VARCHAR) AS entity_id, 'error' AS severity, 'no rows' AS rule FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 100000)")
def q55_missing_right_side(t):
    large = t.orders.filter("o_totalprice > 100000").select(F.col("o_custkey").alias("k"))
    return quality.without_rows(t.customer.select(F.col("c_custkey").alias("k")), large, "k", "customer").select("entity_id", "severity", "rule")


@query("""SELECT CAST(doc_id AS VARCHAR) AS entity_id, 'empty text' AS rule, 'error' AS severity FROM documents WHERE coalesce(text, '') = '' UNION ALL SELECT CAST(doc_id AS VARCHAR), 'no label', 'warning' FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id) UNION ALL SELECT CAST(p_partkey AS VARCHAR), 'unknown brand', 'warning' FROM part WHERE coalesce(p_brand, '') NOT IN ('Brand#11', 'Brand#12')""")
def q56_empty_value_rules(t):
    docs = t.documents
    parts = [
        quality.issue(docs.filter(F.coalesce("text", F.lit("")) == ""), "document", F.col("doc_id"), "error", "empty text", ""),
        quality.issue(docs.join(t.labels, "doc_id", "left_anti"), "document", F.col("doc_id"), "warning", "no label", ""),
        quality.issue(t.part.filter(~F.coalesce("p_brand", F.lit("")).isin("Brand#11", "Brand#12")), "part", F.col("p_partkey"), "warning", "unknown brand", ""),
    ]
    return quality.all_issues(parts).select("entity_id", "rule", "severity")


@query("SELECT l_orderkey, string_agg(DISTINCT CAST(l_linenumber AS VARCHAR), ',' ORDER BY CAST(l_linenumber AS VARCHAR)) AS numbers, min(l_linenumber) AS lo, max(l_linenumber) AS hi FROM lineitem GROUP BY 1")
def q57_distinct_min_max(t):
    return t.lineitem.groupBy("l_orderkey").agg(F.array_join(F.array_sort(F.collect_set(F.col("l_linenumber").cast("string"))), ",").alias("numbers"), F.min("l_linenumber").alias("lo"), F.max("l_linenumber").alias("hi"))


@query(_GAPS + " SELECT DISTINCT l_orderkey AS k FROM m UNION SELECT p_partkey FROM part WHERE coalesce(p_name, '') = ''")
def q58_defect_union(t):
    a = sequence.number_gaps(t.lineitem, ["l_orderkey"], "l_linenumber").select(F.col("l_orderkey").alias("k"))
    return a.union(t.part.filter(F.coalesce("p_name", F.lit("")) == "").select("p_partkey")).distinct()


@query(r"SELECT p_partkey, regexp_replace(concat_ws('/', nullif(p_name, ''), nullif(p_type, '')), '\s+', '', 'g') AS name FROM part")
def q59_composite_name_squash(t):
    return t.part.select("p_partkey", T.squash_space(T.composite_name(F.col("p_name"), F.col("p_type"))).alias("name"))


@query("SELECT event_id, first_value(CASE WHEN event_type = 'purchase' THEN event_id END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS nxt FROM events")
def q60_first_marker_after(t):
    return sequence.first_after(t.events, ["user_id"], ["ts", "event_id"], F.col("event_type") == "purchase", F.col("event_id"), "nxt").select("event_id", "nxt")


@query("SELECT event_type, n FROM (SELECT event_type, count(*) AS n, row_number() OVER (ORDER BY count(*) DESC, event_type) AS k FROM events GROUP BY 1) WHERE k <= 2")
def q61_occupancy_topn(t):
    return sequence.occupancy(t.events, ["event_type"], 2)


@query(f"""WITH p AS (SELECT page_id, {_PATH} AS c FROM pages), i AS (SELECT *, list_position(list_transform(c, lambda x: regexp_matches(x, '^[0-9]+$')), true) AS k FROM p),
r AS (SELECT page_id, c[k] AS code, coalesce(list_filter(c[k + 1:], lambda x: x <> '')[1], '') AS name FROM i WHERE k > 0) SELECT code, arg_min(name, page_id) AS name FROM r WHERE regexp_matches(code, '^[0-9]{{1,5}}$') GROUP BY 1""")
def q62_first_number_pairs_dedup(t):
    cells = t.pages.select(F.lit("t").alias("table_id"), F.col("page_id").alias("page"), F.lit(0).alias("table_no"), F.lit(0).alias("row_no"), F.split(F.regexp_replace("url", "^https?://", ""), "/").alias("cells"))
    return expand.pairs_first_wins(cells).filter(F.col("code").rlike("^[0-9]{1,5}$")).select("code", "name")


# From here on: rows as an extraction gives them, made of the tables' own.


def _fields(t):
    """Orders as versions of masters (a customer's orders of a year), their lines as fields; some names and modes are broken."""
    lines = t.lineitem.join(t.orders.select("o_orderkey", "o_orderdate"), F.col("l_orderkey") == F.col("o_orderkey"))
    pos = F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_shipdate", "l_extendedprice", "l_quantity"))
    name = F.when(F.col("l_partkey") % 7 == 0, "").when(F.col("l_partkey") % 7 == 1, "a\nb").when(F.col("l_partkey") % 7 == 2, "x/グルー").otherwise(F.concat(F.lit("part "), F.col("l_partkey").cast("string")))
    return lines.select(F.date_format("o_orderdate", "yyyy").alias("version"), F.col("l_orderkey").alias("master_id"), pos.alias("field_pos"), F.col("l_linenumber").alias("seq"), name.alias("name"), F.when(F.col("l_returnflag") == "R", "roman").otherwise("text").alias("mode"), F.array().cast("array<struct<code:string,name:string>>").alias("codes"))


@query("""WITH f AS (SELECT strftime(o_orderdate, '%Y') AS version, l_orderkey AS id, l_linenumber AS seq, l_partkey % 7 AS k, l_returnflag AS m FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
g AS (SELECT version, id, max(seq) - min(seq) + 1 AS e, max(seq) - min(seq) + 1 - count(DISTINCT seq) AS c FROM f GROUP BY ALL),
i AS (SELECT version, CASE WHEN c >= 20 OR c * 5 >= e THEN 'error' ELSE 'warning' END AS severity, 'missing' AS rule FROM g WHERE c > 0 UNION ALL SELECT version, 'error', 'empty name' FROM f WHERE k = 0 UNION ALL SELECT version, 'warning', 'line break in name' FROM f WHERE k = 1 UNION ALL SELECT version, 'warning', 'name may be cut' FROM f WHERE k = 2 UNION ALL SELECT version, 'warning', 'unknown mode' FROM f WHERE m = 'R')
SELECT version, severity, rule, count(*) AS n FROM i GROUP BY ALL""")
def q63_field_rules(t):
    return quality.field_issues(_fields(t)).groupBy("version", "severity", "rule").agg(n_rows())


@query("""WITH p AS (SELECT p_size % 3 AS v, p_brand AS tid, p_partkey AS pos, CASE p_partkey % 5 WHEN 0 THEN '' WHEN 1 THEN 'x' || p_size ELSE CAST(p_size AS VARCHAR) END AS code, CASE WHEN p_partkey % 11 = 0 THEN NULL ELSE p_name END AS name FROM part),
i AS (SELECT v, 'empty code' AS rule, 'error' AS severity FROM p WHERE code = '' UNION ALL SELECT v, 'code isn''t a number', 'warning' FROM p WHERE code LIKE 'x%' UNION ALL SELECT v, 'empty name', 'error' FROM p WHERE coalesce(name, '') = '' UNION ALL SELECT v, 'code repeats', 'warning' FROM (SELECT *, min(pos) OVER (PARTITION BY v, tid, code) AS f FROM p) WHERE pos > f)
SELECT CAST(v AS VARCHAR) AS version, rule, severity, count(*) AS n FROM i GROUP BY ALL""")
def q64_pair_rules(t):
    code = F.when(F.col("p_partkey") % 5 == 0, "").when(F.col("p_partkey") % 5 == 1, F.concat(F.lit("x"), F.col("p_size").cast("string"))).otherwise(F.col("p_size").cast("string"))
    rows = t.part.select((F.col("p_size") % 3).cast("string").alias("version"), F.col("p_brand").alias("table_id"), F.col("p_partkey").alias("pos"), code.alias("code"), F.when(F.col("p_partkey") % 11 != 0, F.col("p_name")).alias("name"))
    return quality.pair_issues(rows).groupBy("version", "rule", "severity").agg(n_rows())


@query("""WITH g AS (SELECT c_nationkey % 2 AS v, c_custkey AS id, CASE WHEN c_custkey % 4 = 0 THEN '' ELSE 'c' END AS tc, CASE WHEN c_custkey % 5 = 0 THEN NULL ELSE c_name END AS tn, (SELECT count(*) FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 150000) AS ns FROM customer),
i AS (SELECT v, id, 'empty target code' AS rule FROM g WHERE tc = '' UNION ALL SELECT v, id, 'empty target name' FROM g WHERE coalesce(tn, '') = '' UNION ALL SELECT v, id, 'no sources' FROM g WHERE ns = 0)
SELECT CAST(v AS VARCHAR) AS version, id AS idx, rule FROM i""")
def q65_group_rules(t):
    sources = t.orders.filter("o_totalprice > 150000").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("n_sources"))
    rows = t.customer.join(sources, "c_custkey", "left").select((F.col("c_nationkey") % 2).cast("string").alias("version"), F.lit("g").alias("table_id"), F.col("c_custkey").alias("group_pos"), F.when(F.col("c_custkey") % 4 == 0, "").otherwise("c").alias("target_code"), F.when(F.col("c_custkey") % 5 != 0, F.col("c_name")).alias("target_name"), "n_sources")
    return quality.group_issues(rows).select("version", F.col("place").alias("idx"), "rule")


@query("""SELECT CAST(p_partkey AS INT) AS pos, p_name AS name, concat_ws(',', CASE WHEN contains(lower(p_name), 'pa') THEN 'name' END, CASE WHEN contains(lower(p_type), 'pa') THEN 'description' END, CASE WHEN NOT contains(lower(p_name), 'pa') AND NOT contains(lower(p_type), 'pa') THEN 'code' END) AS "where",
CASE WHEN contains(lower(p_brand), 'pa') OR contains(lower(p_brand), '#1') THEN 1 ELSE 0 END AS n FROM part WHERE contains(lower(p_name), 'pa') OR contains(lower(p_type), 'pa')""")
def q66_field_search(t):
    codes = F.array(F.struct(F.lit("1").alias("code"), F.when(F.contains("p_brand", F.lit("#1")), "a Pan").otherwise("none").alias("name")))
    rows = t.part.select(F.lit(0).alias("entity_pos"), F.col("p_partkey").cast("int").alias("field_pos"), F.lit("m").alias("master_id"), F.lit("M").alias("master_name"), F.lit(1).alias("seq"), F.col("p_name").alias("name"), F.lit(None).cast("string").alias("short_name"), F.col("p_type").alias("description"), codes.alias("codes"))
    hits = search.master_hits(rows, "pa")
    return hits.filter(~F.array_contains("where", "code")).select("pos", "name", F.array_join("where", ",").alias("where"), F.size("codes").alias("n"))


@query("""SELECT p_partkey AS pos, CAST(p_size AS VARCHAR) AS code, p_name AS name FROM part WHERE contains(lower(p_name), '1') OR contains(CAST(p_size AS VARCHAR), '1')""")
def q67_pair_search(t):
    rows = t.part.select(F.lit(0).alias("entity_pos"), F.col("p_partkey").alias("pos"), F.lit("t").alias("table_id"), F.lit("T").alias("table_name"), F.lit("codeNamePairs").alias("kind"), F.col("p_size").cast("string").alias("code"), F.col("p_name").alias("name"))
    return search.pair_hits(rows, "1").select("pos", "code", "name")


@query("""WITH f AS (SELECT l_orderkey AS m, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_shipdate, l_extendedprice, l_quantity) AS pos, l_linenumber AS seq, CAST(l_quantity % 10 AS INT) AS code, l_partkey AS p FROM lineitem),
first AS (SELECT m, min(pos) AS pos FROM f WHERE seq = 3 GROUP BY 1) SELECT f.m AS master_id, p AS name FROM f JOIN first USING (m, pos) WHERE code = 5""")
def q68_code_lookup(t):
    pos = F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_shipdate", "l_extendedprice", "l_quantity"))
    rows = t.lineitem.select(F.col("l_orderkey").alias("master_id"), pos.alias("field_pos"), F.col("l_linenumber").alias("seq"), T.half_digits((F.col("l_quantity") % 10).cast("int").cast("string")).alias("code_norm"), F.col("l_partkey").alias("name"))
    return lookup.code_lookup(rows.select("master_id", "field_pos", "seq"), rows, ["master_id", "field_pos"], "seq", 3, "5").select("master_id", "name")


@query("""WITH r AS (SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS k, role, text FROM conversations),
s AS (SELECT *, sum(CASE WHEN role = 'user' THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) AS rec FROM r)
SELECT conv_id AS section, CAST(min(turn) + 1 AS INT) AS seq, count(*) - 1 AS more FROM s WHERE rec > 0 GROUP BY conv_id, rec""")
def q69_continued_fields(t):
    user = F.col("role") == "user"
    texts = F.concat(F.lit("<"), F.col("turn").cast("string"), F.lit(">"))
    empty = lambda c: F.lit("").alias(c)
    raw = t.conversations.select(F.col("conv_id").alias("section"), F.col("turn").alias("pos"), F.when(user, (F.col("turn") + 1).cast("string")).otherwise("").alias("seq_raw"), F.when(user, "name").otherwise("").alias("name"), empty("sub_name"), empty("mode_raw"), empty("max_bytes_raw"), empty("item_format_raw"), texts.alias("content"), F.lit(None).cast(records.FLAGS).alias("flags"))
    got = records.normalized(raw)
    return got.select("section", "seq", (F.size(F.split("description", "\n")) - 1).cast("long").alias("more"))


@query("""WITH k AS (SELECT p_partkey, 1 + p_partkey % 3 AS k, 2 + p_size % 4 AS c FROM part), r AS (SELECT *, unnest(generate_series(0, k * c - 1)) AS i FROM k)
SELECT p_partkey AS section, CAST(10 + i AS INT) AS seq, CASE WHEN k = 1 AND c = 1 THEN 'x' ELSE 'n' || substr('①②③④⑤⑥⑦⑧⑨⑩', CAST(i // k + 1 AS INT), 1) || '/' || 's' || CAST(i % k AS VARCHAR) END AS name FROM r""")
def q70_parent_child_fields(t):
    k, c = F.col("p_partkey") % 3 + 1, F.col("p_size") % 4 + 2
    rows = t.part.select("p_partkey", k.alias("k"), c.alias("c"))
    label = F.concat(F.lit("n①～"), F.substr(F.lit(T.CIRCLED), F.col("c"), F.lit(1)))
    subs = F.array_join(F.transform(F.sequence(F.lit(0).cast("long"), F.col("k") - 1), lambda i: F.concat(F.lit("s"), i.cast("string"))), "\n")
    span = F.concat(F.lit("10～"), (F.col("k") * F.col("c") + 9).cast("string"))
    none = F.lit("")
    row = lambda pos, seq, name, sub: F.struct(F.lit(pos).alias("pos"), seq.alias("seq_raw"), name.alias("name"), sub.alias("sub_name"))
    both = rows.select(F.col("p_partkey").alias("section"), F.explode(F.array(row(0, span, label, none), row(1, none, none, subs))).alias("r")).select("section", "r.*")
    raw = both.select("*", *(none.alias(x) for x in ("mode_raw", "max_bytes_raw", "item_format_raw", "content")), F.lit(None).cast(records.FLAGS).alias("flags"))
    return records.normalized(raw).select("section", "seq", "name")


@query("""SELECT p_partkey AS section, CAST(1 + p_partkey % 90 AS INT) AS seq, replace(p_name, ' ', '_') AS name, CAST(p_size AS VARCHAR) AS max_bytes_raw, CASE WHEN p_size % 2 = 0 THEN 'more' ELSE '' END AS content FROM part""")
def q71_layout_rows(t):
    head = F.concat(F.lit("  "), (F.col("p_partkey") % 90 + 1).cast("string"), F.lit("  "), F.translate("p_name", " ", "_"), F.lit("  数字  "), F.col("p_size").cast("string"), F.lit("  固定"))
    after = F.array(F.when(F.col("p_size") % 2 == 0, "      more").otherwise(""))
    lines = t.part.select(F.col("p_partkey").alias("section"), F.posexplode(F.concat(F.array(F.lit("項番 項 目 名"), head), after)).alias("line_no", "line"))
    return layout.text_records(lines).select("section", "seq", "name", "max_bytes_raw", F.regexp_replace("content", r"\s", "").alias("content"))


@query("""WITH d AS (SELECT l_orderkey AS section, l_linenumber AS seq FROM lineitem), e AS (SELECT section, min(seq) AS lo, max(seq) AS hi FROM d GROUP BY 1), a AS (SELECT section, unnest(generate_series(lo, hi)) AS seq FROM e)
SELECT section, CAST(seq AS INT) AS seq FROM a WHERE NOT EXISTS (SELECT 1 FROM d WHERE d.section = a.section AND d.seq = a.seq) UNION SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_partkey % 7 = 0""")
def q72_defects(t):
    rows = _fields(t).select(F.col("master_id").alias("section"), "seq", "name")
    return recover.defects(rows)


@query("""WITH h AS (SELECT conv_id, turn AS page FROM conversations WHERE role = 'user'), n AS (SELECT *, lead(page) OVER (PARTITION BY conv_id ORDER BY page) AS nxt FROM h), m AS (SELECT conv_id, max(turn) AS last FROM conversations GROUP BY 1)
SELECT conv_id AS doc, CAST(page AS BIGINT) AS start, coalesce(nxt - 1, last) AS stop FROM n JOIN m USING (conv_id)""")
def q73_sections(t):
    text = F.when(F.col("role") == "user", "（１） 甲マスター").otherwise(F.lit("x"))
    rows = t.conversations.select(F.col("conv_id").alias("doc"), F.col("turn").cast("int").alias("page"), text.alias("text"))
    found = pages.headings(rows, {"甲マスター": "ko"}).withColumn("section", F.concat(F.lit("s"), F.col("page").cast("string")))
    return pages.sections(rows, found).select("doc", F.col("start").cast("long").alias("start"), F.col("stop").cast("long").alias("stop"))


_RULED = """WITH r AS (SELECT p_partkey % 50 AS page, min(p_partkey) OVER (PARTITION BY p_partkey % 50) AS lo, row_number() OVER (PARTITION BY p_partkey % 50 ORDER BY p_partkey) AS k, p_partkey AS id FROM part)"""


def _ruled(t):
    """Parts as groups of a ruled document: 50 pages, each part a band of 20 units with a code, a name and one source."""
    at = F.row_number().over(Window.partitionBy(F.col("p_partkey") % 50).orderBy("p_partkey"))
    rows = t.part.select(F.lit("d").alias("doc"), (F.col("p_partkey") % 50).alias("page"), (at * 20 + 100).cast("double").alias("y"), F.col("p_partkey").alias("id"))
    word = lambda x, dy, text: F.struct(text.alias("text"), F.lit(x).alias("x0"), (F.col("y") + dy).alias("top"), (F.col("y") + dy + 8).alias("bottom"))
    code = F.lpad(F.col("id").cast("string"), 4, "0")
    words = rows.select("doc", "page", F.explode(F.array(word(60.0, 2, T.wide_digits(code)), word(120.0, 4, F.concat(F.lit("name "), code)), word(210.0, 3, (F.col("id") % 1000).cast("string")), word(300.0, 3, F.lit("src")))).alias("w")).select("doc", "page", "w.*")
    rule = lambda a, b: F.struct(F.lit(a).alias("x0"), F.lit(b).alias("x1"))
    rects = rows.select("doc", "page", F.explode(F.array(rule(56.0, 98.0), rule(206.0, 258.0))).alias("r"), F.col("y").alias("top"), F.lit(0.5).alias("height")).select("doc", "page", "r.*", "top", "height")
    ends = rows.groupBy("doc", "page").agg((F.max("y") + 20).alias("height"))
    last = ends.select("doc", "page", F.lit(206.0).alias("x0"), F.lit(258.0).alias("x1"), F.col("height").alias("top"), F.lit(0.5).alias("h")).withColumnRenamed("h", "height")
    return words, rects.unionByName(last), ends


@query(_RULED + """ SELECT lpad(CAST(id AS VARCHAR), 4, '0') AS target_code, 'name' || lpad(CAST(id AS VARCHAR), 4, '0') AS target_name, CAST(id % 1000 AS VARCHAR) || ':src' AS sources FROM r""")
def q74_ruled_groups(t):
    got = groups.grouped_codes(*_ruled(t))
    return got.select("target_code", "target_name", F.array_join(F.transform("sources", lambda s: F.concat(s["code"], F.lit(":"), s["name"])), ",").alias("sources"))


@query("""SELECT p_partkey AS page, CAST(p_size AS VARCHAR) AS seq_raw, p_name AS name, p_type AS mode_raw, CASE WHEN p_size % 2 = 0 THEN 'f' ELSE NULL END AS flag FROM part""")
def q75_two_row_headers(t):
    cell = lambda *c: F.array(*(F.lit(x) if isinstance(x, str) else x for x in c))
    rows = F.array(cell("項 番", "項目名", "形式", "内容", "区分"), cell("", "", "ﾓｰﾄﾞ", "", ""), cell("", " ", "", "", ""), cell(F.col("p_size").cast("string"), F.col("p_name"), F.col("p_type"), "", F.when(F.col("p_size") % 2 == 0, "f").otherwise("")))
    cells = t.part.select(F.lit("d").alias("doc"), F.col("p_partkey").alias("page"), F.lit(0).alias("table_no"), F.posexplode(rows).alias("row_no", "cells"))
    return expand.field_rows(cells).select("page", "seq_raw", "name", "mode_raw", F.try_element_at("flags", F.lit("区分")).alias("flag"))


@query("SELECT doc_id, CAST(len(string_split(text, chr(10))) - CASE WHEN ends_with(text, chr(10)) OR text = '' THEN 1 ELSE 0 END AS BIGINT) AS n FROM documents WHERE text IS NOT NULL")
def q76_layout_lines(t):
    return t.documents.filter("text is not null").select("doc_id", F.size(pages.page_lines(F.col("text"))).cast("long").alias("n"))
