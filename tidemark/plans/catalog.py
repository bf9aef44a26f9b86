"""Registered queries: the operators over the driver's tables, with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import scalar as S
from tidemark.functions import text as T
from tidemark.operators import changes, graph, grouping, incremental, matching, projects, ranking
from tidemark.operators import statistics as st

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def _query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def _t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@_query("""SELECT o_custkey, o_orderkey, CAST(o_orderdate AS DATE) AS day FROM orders WHERE o_orderdate <= TIMESTAMP '1998-06-30 00:00:00'
QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY CASE WHEN o_orderstatus = 'F' THEN 0 ELSE 1 END, o_orderdate DESC, o_orderkey DESC) = 1""")
def asof_latest_order(spark, sf_dir):
    """JN2, JN3, WN3: the latest order before a date, finished ones first."""
    rows = _t(spark, sf_dir, "orders").where(F.col("o_orderdate") <= F.lit("1998-06-30").cast("timestamp"))
    order = [F.when(F.col("o_orderstatus") == "F", 0).otherwise(1), F.desc("o_orderdate"), F.desc("o_orderkey")]
    return ranking.best_per_key(rows, ["o_custkey"], order).select("o_custkey", "o_orderkey", F.to_date("o_orderdate").alias("day"))


@_query("""WITH p AS (SELECT DISTINCT o_custkey, date_trunc('year', o_orderdate) AS y FROM orders)
SELECT p.o_custkey, CAST(p.y AS DATE) AS cutoff, o.o_orderkey FROM p LEFT JOIN orders o ON o.o_custkey = p.o_custkey AND o.o_orderdate <= p.y
QUALIFY row_number() OVER (PARTITION BY p.o_custkey, p.y ORDER BY o.o_orderdate DESC, o.o_orderkey DESC) = 1""")
def asof_join_by_year(spark, sf_dir):
    """JN2: for every customer and year the last order at its start, if any."""
    orders = _t(spark, sf_dir, "orders")
    dates = orders.select("o_custkey", F.date_trunc("year", "o_orderdate").alias("cutoff")).distinct()
    out = matching.as_of(dates, orders.select("o_custkey", "o_orderkey", "o_orderdate"), ["o_custkey"], "o_orderdate", "cutoff", [F.desc("o_orderdate"), F.desc("o_orderkey")])
    return out.select("o_custkey", F.to_date("cutoff").alias("cutoff"), "o_orderkey")


_SNAPSHOTS = """WITH o AS (SELECT l_partkey, CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS q FROM lineitem WHERE l_shipdate < TIMESTAMP '1996-01-01' GROUP BY 1),
n AS (SELECT l_partkey, CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS q FROM lineitem WHERE l_shipdate >= TIMESTAMP '1996-01-01' AND l_shipdate < TIMESTAMP '1997-01-01' GROUP BY 1)
"""


@_query(_SNAPSHOTS + """SELECT coalesce(o.l_partkey, n.l_partkey) AS l_partkey, o.q AS old_q, n.q AS new_q,
CASE WHEN o.l_partkey IS NULL THEN 'added' WHEN n.l_partkey IS NULL THEN 'removed' ELSE 'changed' END AS change
FROM o FULL OUTER JOIN n ON o.l_partkey = n.l_partkey WHERE o.q IS DISTINCT FROM n.q""")
def snapshot_diff_parts(spark, sf_dir):
    """JN1: parts added, removed or changed between two periods."""
    items = _t(spark, sf_dir, "lineitem")
    day = lambda d: F.lit(d).cast("timestamp")
    total = lambda df: df.groupBy("l_partkey").agg(F.sum(F.col("l_quantity").cast("long")).alias("q"))
    old = total(items.where(F.col("l_shipdate") < day("1996-01-01")))
    new = total(items.where((F.col("l_shipdate") >= day("1996-01-01")) & (F.col("l_shipdate") < day("1997-01-01"))))
    return matching.snapshot_diff(old, new, ["l_partkey"], ["q"])


@_query("""SELECT p_brand, p_type, n.p_partkey, n.p_name, occurrences FROM (SELECT p_brand, p_type, min({'l': length(p_name), 'p_name': p_name, 'p_partkey': p_partkey}) AS n, count(*) AS occurrences FROM part GROUP BY 1, 2)""")
def group_representative(spark, sf_dir):
    """AG1: one part for each brand and type, the shortest name first."""
    parts = _t(spark, sf_dir, "part").withColumn("l", F.length("p_name"))
    return grouping.representative(parts, ["p_brand", "p_type"], ["l", "p_name", "p_partkey"], ["p_partkey", "p_name"])


@_query("""WITH d AS (SELECT doc_id, md5(lower(text)) AS k FROM documents), r AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY doc_id) AS r, count(*) OVER (PARTITION BY k) AS n FROM d)
SELECT k, CAST(min(doc_id) AS VARCHAR) AS path, max(n) AS occurrences, array_to_string(list(CAST(doc_id AS VARCHAR) ORDER BY r) FILTER (WHERE r BETWEEN 2 AND 6), ',') AS also FROM r GROUP BY k""")
def collapse_duplicates(spark, sf_dir):
    """AG2, SO9: equal texts collapsed to the first, with the next five."""
    docs = _t(spark, sf_dir, "documents").select("doc_id", F.md5(F.lower("text").cast("binary")).alias("k"), F.col("doc_id").cast("string").alias("path"))
    out = grouping.collapse(docs, ["k"], "path", [F.asc("doc_id")])
    return out.withColumn("also", F.when(F.size("also") > 0, F.array_join("also", ",")))


@_query("""WITH p AS (SELECT s_nationkey, l_returnflag, count(*) AS n, bool_and(l_quantity >= 1) AS ok FROM lineitem JOIN supplier ON l_suppkey = s_suppkey WHERE l_discount > 0.09 AND l_tax < 0.01 GROUP BY 1, 2),
t AS (SELECT *, count(*) OVER (PARTITION BY s_nationkey) AS targets FROM p) SELECT s_nationkey, l_returnflag, n, targets FROM t WHERE ok AND (n >= 3 OR n >= 2 AND targets = 1)""")
def moved_groups_having(spark, sf_dir):
    """AG3: pairs with three members, or two and a sole target."""
    items = _t(spark, sf_dir, "lineitem").where("l_discount > 0.09 and l_tax < 0.01")
    rows = items.join(_t(spark, sf_dir, "supplier"), F.col("l_suppkey") == F.col("s_suppkey"))
    return grouping.grouped_moves(rows, "s_nationkey", "l_returnflag", F.col("l_quantity") >= 1)


@_query("""SELECT event_type, count(*) FILTER (WHERE value > 50) AS high, count(*) FILTER (WHERE value <= 50) AS low, count(*) FILTER (WHERE user_id % 2 = 0) AS even FROM events GROUP BY 1""")
def conditional_counts(spark, sf_dir):
    """AG4, AG5, AG8, AG16."""
    v = F.col("value")
    return grouping.conditional_counts(_t(spark, sf_dir, "events"), ["event_type"], {"high": v > 50, "low": v <= 50, "even": F.col("user_id") % 2 == 0})


@_query("""SELECT p_brand, p_partkey, p_size FROM part QUALIFY row_number() OVER (PARTITION BY p_brand ORDER BY CASE WHEN p_size <= 10 THEN 0 ELSE 1 END, p_retailprice DESC, p_partkey) = 1""")
def forked_pick(spark, sf_dir):
    """AG6: the highest among the rows that match, else among all."""
    order = [F.when(F.col("p_size") <= 10, 0).otherwise(1), F.desc("p_retailprice"), "p_partkey"]
    return ranking.best_per_key(_t(spark, sf_dir, "part"), ["p_brand"], order).select("p_brand", "p_partkey", "p_size")


@_query("""SELECT count(*) AS n, count(DISTINCT user_id) AS users, string_agg(DISTINCT event_type, ',' ORDER BY event_type) AS types, CAST(max(ts) AS DATE) AS last_day FROM events""")
def global_summary(spark, sf_dir):
    """AG7."""
    types = F.array_join(F.array_sort(F.collect_set("event_type")), ",").alias("types")
    return _t(spark, sf_dir, "events").agg(F.count("*").alias("n"), F.count_distinct("user_id").alias("users"), types, F.to_date(F.max("ts")).alias("last_day"))


@_query("""WITH c AS (SELECT user_id, event_type, count(*) AS n, count(*) FILTER (WHERE value > 50) AS fixed FROM events GROUP BY 1, 2)
SELECT event_type, count(*) AS users, sum(CAST(2 * fixed > n AS BIGINT))::BIGINT AS improved FROM c GROUP BY 1""")
def two_phase_majority(spark, sf_dir):
    """AG10, AG11: majority by user, then a count of users."""
    first = grouping.majority(_t(spark, sf_dir, "events"), ["user_id", "event_type"], F.col("value") > 50)
    return first.groupBy("event_type").agg(F.count("*").alias("users"), F.count_if("majority").alias("improved"))


@_query("""SELECT name, min(p_brand) AS p_brand FROM (SELECT p_name || ' ' || CAST(p_size AS VARCHAR) AS name, p_brand FROM part) GROUP BY 1 HAVING count(DISTINCT p_brand) = 1""")
def having_unique_name(spark, sf_dir):
    """AG12, AG13: names that one brand alone has."""
    name = F.concat_ws(" ", "p_name", F.col("p_size").cast("string"))
    return grouping.unique_names(_t(spark, sf_dir, "part").select(name.alias("name"), "p_brand"), "name", "p_brand")


@_query("""SELECT source, substr(sha256(string_agg(DISTINCT lang || '==' || CAST(doc_id % 7 AS VARCHAR), chr(10) ORDER BY lang || '==' || CAST(doc_id % 7 AS VARCHAR))), 1, 12) AS fingerprint FROM documents GROUP BY 1""")
def fingerprint_set(spark, sf_dir):
    """AG18, AG28."""
    item = F.concat_ws("==", "lang", (F.col("doc_id") % 7).cast("string"))
    return grouping.set_fingerprint(_t(spark, sf_dir, "documents"), ["source"], item)


@_query("""SELECT l_returnflag, p_brand, CAST(sum(CAST(l_quantity AS BIGINT) * p_size) AS BIGINT) AS cost FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1, 2""")
def weighted_cost_lookup(spark, sf_dir):
    """AG19: cost by a price table."""
    rows = _t(spark, sf_dir, "lineitem").join(_t(spark, sf_dir, "part"), F.col("l_partkey") == F.col("p_partkey"))
    return rows.groupBy("l_returnflag", "p_brand").agg(F.sum(F.col("l_quantity").cast("long") * F.col("p_size")).alias("cost"))


@_query("""WITH m AS (SELECT user_id, median(value) FILTER (WHERE event_type = 'click') AS a, median(value) FILTER (WHERE event_type = 'view') AS b FROM events GROUP BY 1)
SELECT count(*) AS users, round(exp(avg(ln(a / b))), 6) AS ratio, round(stddev_samp(ln(a / b)), 6) AS spread FROM m WHERE a > 0 AND b > 0""")
def geo_mean_of_median_ratio(spark, sf_dir):
    """AG20, ST9: geometric mean of ratios of medians."""
    med = lambda kind: F.median(F.when(F.col("event_type") == kind, F.col("value")))
    m = _t(spark, sf_dir, "events").groupBy("user_id").agg(med("click").alias("a"), med("view").alias("b")).where("a > 0 and b > 0")
    ratio = F.ln(F.col("a") / F.col("b"))
    return m.agg(F.count("*").alias("users"), F.round(F.exp(F.avg(ratio)), 6).alias("ratio"), F.round(F.stddev_samp(ratio), 6).alias("spread"))


@_query("""SELECT l_returnflag, min(l_extendedprice) AS low, round(quantile_cont(l_extendedprice, 0.25), 4) AS q1, round(median(l_extendedprice), 4) AS middle, round(quantile_cont(l_extendedprice, 0.75), 4) AS q3, max(l_extendedprice) AS high FROM lineitem GROUP BY 1""")
def five_number_summary(spark, sf_dir):
    """AG21, ST4."""
    x = F.col("l_extendedprice")
    q = lambda p: F.round(F.percentile(x, F.lit(p)), 4)
    return _t(spark, sf_dir, "lineitem").groupBy("l_returnflag").agg(F.min(x).alias("low"), q(0.25).alias("q1"), q(0.5).alias("middle"), q(0.75).alias("q3"), F.max(x).alias("high"))


@_query("""SELECT user_id, count(*) AS n FROM events GROUP BY 1 ORDER BY n DESC, user_id LIMIT 15""")
def top15_frequencies(spark, sf_dir):
    """AG22: the fifteen commonest."""
    return _t(spark, sf_dir, "events").groupBy("user_id").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "user_id").limit(15)


@_query("""SELECT conv_id, max(turn) AS turns, bool_or(length(text) > 300) AS any_long FROM conversations GROUP BY 1""")
def session_rollup_max(spark, sf_dir):
    """AG23."""
    return _t(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.max("turn").alias("turns"), F.bool_or(F.char_length("text") > 300).alias("any_long"))


@_query("""SELECT l_returnflag, kind, CAST(sum(v) AS BIGINT) AS total FROM (SELECT l_returnflag, 'quantity' AS kind, CAST(l_quantity AS BIGINT) AS v FROM lineitem UNION ALL SELECT l_returnflag, 'lines', l_linenumber FROM lineitem UNION ALL SELECT l_returnflag, 'rows', 1 FROM lineitem) GROUP BY 1, 2""")
def unpivot_decomposition(spark, sf_dir):
    """AG25: totals by kind as rows; sums come before the unpivot."""
    sums = _t(spark, sf_dir, "lineitem").groupBy("l_returnflag").agg(F.sum(F.col("l_quantity").cast("long")).alias("quantity"), F.sum("l_linenumber").alias("lines"), F.count("*").alias("rows"))
    return sums.unpivot(["l_returnflag"], ["quantity", "lines", "rows"], "kind", "total")


@_query("""SELECT o_custkey FROM orders GROUP BY 1 HAVING count(DISTINCT o_orderstatus) = (SELECT count(DISTINCT o_orderstatus) FROM orders)""")
def relational_division(spark, sf_dir):
    """AG29: customers with orders in every status."""
    orders = _t(spark, sf_dir, "orders")
    return grouping.divide(orders, "o_custkey", orders, ["o_orderstatus"])


_TURNS = "SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY value DESC, event_id) AS turn FROM events"


@_query(f"""SELECT event_id, event_type, CAST(turn AS INTEGER) AS turn FROM ({_TURNS}) ORDER BY turn, event_type LIMIT 40""")
def round_robin_budget(spark, sf_dir):
    """WN1, WN2: events taken in turns from each type."""
    out = ranking.round_robin(_t(spark, sf_dir, "events"), "event_type", [F.desc("value"), "event_id"], [F.asc("event_type")], 40)
    return out.select("event_id", "event_type", "turn")


@_query("""SELECT l_suppkey, l_orderkey, l_linenumber, CAST(rank AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber) AS rank FROM lineitem) WHERE rank <= 5""")
def top_n_per_group(spark, sf_dir):
    """WN6."""
    out = ranking.top_n(_t(spark, sf_dir, "lineitem"), ["l_suppkey"], [F.desc("l_extendedprice"), "l_orderkey", "l_linenumber"], 5)
    return out.select("l_suppkey", "l_orderkey", "l_linenumber", "rank")


@_query("""SELECT p_partkey, p_size, rank() OVER (ORDER BY p_size) + (count(*) OVER (PARTITION BY p_size) - 1) / 2.0 AS r FROM part""".replace("/ 2.0 AS r", "/ CAST(2 AS DOUBLE) AS r"))
def fractional_ranks(spark, sf_dir):
    """WN7: average ranks with ties, from value frequencies."""
    return ranking.fractional_rank(_t(spark, sf_dir, "part").select("p_partkey", "p_size"), "p_size", name="r").withColumn("r", F.col("r").cast("double"))


@_query("""WITH r AS (SELECT s_suppkey, rank() OVER (ORDER BY s_nationkey) + (count(*) OVER (PARTITION BY s_nationkey) - 1) / CAST(2 AS DOUBLE) AS a, rank() OVER (ORDER BY s_acctbal) + (count(*) OVER (PARTITION BY s_acctbal) - 1) / CAST(2 AS DOUBLE) AS b FROM supplier), o AS (SELECT corr(a, b) AS rho FROM r),
m AS (SELECT *, unnest(range(1, 100)) AS m FROM r), l AS (SELECT m, a, row_number() OVER (PARTITION BY m ORDER BY s_suppkey) AS i FROM m), x AS (SELECT m, b, row_number() OVER (PARTITION BY m ORDER BY md5('3:' || CAST(m AS VARCHAR) || ':' || CAST(s_suppkey AS VARCHAR)), s_suppkey) AS i FROM m), e AS (SELECT m, corr(a, b) AS r FROM l JOIN x USING (m, i) GROUP BY 1)
SELECT round(rho, 6) AS rho, (1 + count(*) FILTER (WHERE abs(r) >= abs(rho) - 1e-12)) / CAST(100 AS DOUBLE) AS p FROM e, o GROUP BY rho""")
def spearman(spark, sf_dir):
    """ST7: rank correlation with a permutation test."""
    out = st.spearman(_t(spark, sf_dir, "supplier"), "s_suppkey", "s_nationkey", "s_acctbal", permutations=99, seed=3)
    return out.select(F.round("rho", 6).alias("rho"), "p")


@_query("""WITH p AS (SELECT user_id, 1.0::DOUBLE / (1 + count(*) FILTER (WHERE value > 50)) AS p FROM events GROUP BY 1), s AS (SELECT *, (count(*) OVER () - row_number() OVER (ORDER BY p, user_id) + 1) * p AS step FROM p)
SELECT user_id, round(least(1.0, max(step) OVER (ORDER BY p, user_id ROWS UNBOUNDED PRECEDING)), 9) AS p_holm FROM s""")
def holm_adjust(spark, sf_dir):
    """WN8."""
    p = _t(spark, sf_dir, "events").groupBy("user_id").agg((1.0 / (1 + F.count_if(F.col("value") > 50))).alias("p"))
    return ranking.holm(p, "p").select("user_id", F.round("p_holm", 9).alias("p_holm"))


@_query("""SELECT p_partkey, round(10 - 1.5 * (p_size % 6) + 3 * (p_partkey % 3) + CAST(p_brand LIKE '%1' AS INTEGER) * 2 + greatest(0, 3 - 0.75 * (length(p_type) - length(replace(p_type, '.', '')))) + least(2, log2(p_size + 1) - 1) + 1 - 4 * CAST(p_size > 45 AS INTEGER), 6)::DOUBLE AS score FROM part ORDER BY score DESC, p_partkey""")
def composite_score_order(spark, sf_dir):
    """SL1, SL2, SL3: the weighted score, then the id."""
    size = F.col("p_size")
    score = ranking.change_score(size % 6, F.col("p_partkey") % 3, F.col("p_brand").like("%1"), F.col("p_type"), size, F.lit(True), F.lit(False), size > 45, F.lit(0.0), F.lit(False))
    return _t(spark, sf_dir, "part").select("p_partkey", F.round(score, 6).alias("score")).orderBy(F.desc("score"), "p_partkey")


@_query("""WITH e AS (SELECT p_brand, p_partkey, p_size, p_retailprice, sum(p_size) OVER (PARTITION BY p_brand) AS total, coalesce(sum(p_size) OVER (PARTITION BY p_brand ORDER BY p_retailprice, p_partkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS freed FROM part)
SELECT p_brand, p_partkey, CAST(freed AS BIGINT) AS freed FROM e WHERE total - freed > 500""")
def lru_evict(spark, sf_dir):
    """SL8, IN5: oldest entries until the rest fits."""
    parts = _t(spark, sf_dir, "part").withColumn("p_size", F.col("p_size").cast("long"))
    return ranking.lru_evict(parts, "p_size", "p_retailprice", 500, "p_partkey", keys=["p_brand"]).select("p_brand", "p_partkey", "freed")


@_query("""SELECT doc_id FROM documents ORDER BY sha256('s' || CAST(doc_id AS VARCHAR)) LIMIT 50""")
def hash_sample(spark, sf_dir):
    """SL10, SL11, SL12: a stable sample (the limit is the operator)."""
    return ranking.hash_sample(_t(spark, sf_dir, "documents").select("doc_id"), "doc_id", 50, "s")


@_query("""SELECT DISTINCT l_partkey FROM lineitem WHERE l_shipdate < TIMESTAMP '1996-01-01' AND l_returnflag = 'R' EXCEPT SELECT l_partkey FROM lineitem WHERE l_shipdate >= TIMESTAMP '1998-01-01' AND l_returnflag = 'R'""")
def except_requirements(spark, sf_dir):
    """SO1, SO5: dropped between two sets."""
    items = _t(spark, sf_dir, "lineitem").where("l_returnflag = 'R'")
    day = lambda d: F.lit(d).cast("timestamp")
    return items.where(F.col("l_shipdate") < day("1996-01-01")).select("l_partkey").subtract(items.where(F.col("l_shipdate") >= day("1998-01-01")).select("l_partkey"))


@_query("""WITH m AS (SELECT DISTINCT s_nationkey AS k, CAST(floor(s_acctbal / 1000) AS BIGINT) AS v FROM supplier), z AS (SELECT k, count(*) AS n FROM m GROUP BY 1), s AS (SELECT a.k, b.k AS other, count(*) AS kept FROM m a JOIN m b ON a.v = b.v AND a.k <> b.k GROUP BY 1, 2)
SELECT k, other, kept, n FROM s JOIN z USING (k) WHERE kept >= 0.5 * n""")
def overlap_similarity(spark, sf_dir):
    """SO3, JN11, JN12: keys that share half their members."""
    members = _t(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("k"), F.floor(F.col("s_acctbal") / 1000).alias("v")).distinct()
    return matching.overlap_pairs(members, "k", "v", 0.5).select("k", "other", "kept", "n")


@_query("""SELECT c_custkey, EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey) AS used FROM customer""")
def semi_anti(spark, sf_dir):
    """JN4, SO6."""
    orders = _t(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c_custkey"))
    return matching.semi_anti(_t(spark, sf_dir, "customer").select("c_custkey"), orders, ["c_custkey"])


_HOST = "regexp_extract(url, '^[a-z]+://([^/?#]+)', 1)"


@_query(f"""WITH p AS (SELECT page_id, {_HOST} AS host, url FROM pages), s AS (SELECT page_id, unnest(range(1, len(string_split(host, '.')) + 1)) AS n, string_split(host, '.') AS parts FROM p), x AS (SELECT page_id, n, array_to_string(parts[1:n], '.') AS prefix FROM s), t AS (SELECT DISTINCT string_split(host, '.')[1] AS prefix FROM p UNION SELECT DISTINCT string_split(host, '.')[1] || '.' || string_split(host, '.')[2] FROM p WHERE url LIKE 'https:%')
SELECT page_id, prefix FROM x JOIN t USING (prefix) QUALIFY row_number() OVER (PARTITION BY page_id ORDER BY n DESC) = 1""")
def longest_prefix_join(spark, sf_dir):
    """JN23."""
    pages = _t(spark, sf_dir, "pages").select("page_id", "url", F.regexp_extract("url", "^[a-z]+://([^/?#]+)", 1).alias("host"))
    part = lambda n: F.substring_index("host", ".", n)
    table = pages.select(part(1).alias("prefix")).union(pages.where("url like 'https:%'").select(part(2))).distinct()
    return matching.longest_prefix(pages, F.col("host"), table, "prefix", ["page_id"]).select("page_id", "prefix")


@_query("""SELECT d.doc_id, coalesce(l.quality, CAST(d.n_chars % 2 AS INTEGER)) AS quality FROM documents d LEFT JOIN labels l USING (doc_id)""")
def override_merge(spark, sf_dir):
    """JN16, JN24: labels win over a rule."""
    base = _t(spark, sf_dir, "documents").select("doc_id", (F.col("n_chars") % 2).cast("int").alias("quality"))
    return matching.override(base, _t(spark, sf_dir, "labels"), ["doc_id"], ["quality"])


@_query("""SELECT d.lang, count(*) AS n, CAST(sum(toxic) AS BIGINT) AS hits, round((sum(toxic) / n + 1.96 * 1.96 / (2 * n) - 1.96 * sqrt((sum(toxic) / n) * (1 - sum(toxic) / n) / n + 1.96 * 1.96 / (4 * n * n))) / (1 + 1.96 * 1.96 / n), 9) AS low,
round((sum(toxic) / n + 1.96 * 1.96 / (2 * n) + 1.96 * sqrt((sum(toxic) / n) * (1 - sum(toxic) / n) / n + 1.96 * 1.96 / (4 * n * n))) / (1 + 1.96 * 1.96 / n), 9) AS high FROM labels JOIN documents d USING (doc_id) GROUP BY 1""")
def wilson_by_lang(spark, sf_dir):
    """ST1, AG9, AG24."""
    rows = _t(spark, sf_dir, "labels").join(_t(spark, sf_dir, "documents").select("doc_id", "lang"), "doc_id")
    counts = rows.groupBy("lang").agg(F.count("*").alias("n"), F.sum("toxic").alias("hits"))
    low, high = st.wilson(F.col("hits"), F.col("n"))
    return counts.select("lang", "n", "hits", F.round(low, 9).alias("low"), F.round(high, 9).alias("high"))


_TAIL = "least(1.0, 2 * list_sum(list_transform(range(0, least(up, down) + 1), lambda i: exp(lgamma(up + down + 1) - lgamma(i + 1) - lgamma(up + down - i + 1) - (up + down) * ln(2)))))"


@_query(f"""WITH c AS (SELECT count(*) FILTER (WHERE quality = 1 AND toxic = 0) AS up, count(*) FILTER (WHERE quality = 0 AND toxic = 1) AS down, count(*) FILTER (WHERE quality = 1 AND toxic = 1) AS two FROM labels)
SELECT up AS only_quality, down AS only_toxic, two AS "both", round({_TAIL}, 9) AS p FROM c""")
def mcnemar_counts(spark, sf_dir):
    """ST5, JN14: the discordant pairs and McNemar's exact test."""
    q, t = F.col("quality") == 1, F.col("toxic") == 1
    counts = _t(spark, sf_dir, "labels").agg(F.count_if(q & ~t).alias("only_quality"), F.count_if(~q & t).alias("only_toxic"), F.count_if(q & t).alias("both"))
    return counts.withColumn("p", F.round(st.sign_test("only_quality", "only_toxic"), 9))


@_query(f"""WITH c AS (SELECT user_id, count(*) FILTER (WHERE value > 50) AS up, count(*) FILTER (WHERE value < 50) AS down FROM events GROUP BY 1)
SELECT user_id, up, down, round({_TAIL}, 9) AS p FROM c""")
def sign_test_by_user(spark, sf_dir):
    """ST2: exact sign tests of values above and below 50."""
    v = F.col("value")
    counts = _t(spark, sf_dir, "events").groupBy("user_id").agg(F.count_if(v > 50).alias("up"), F.count_if(v < 50).alias("down"))
    return counts.withColumn("p", F.round(st.sign_test("up", "down"), 9))


_WAYS = "lgamma(a + b + 1) - lgamma(x + 1) - lgamma(a + b - x + 1) + lgamma(c + d + 1) - lgamma(a + c - x + 1) - lgamma(d - a + x + 1)"


@_query(f"""WITH t AS (SELECT lang, count(*) FILTER (WHERE quality = 1 AND toxic = 1) AS a, count(*) FILTER (WHERE quality = 1 AND toxic = 0) AS b, count(*) FILTER (WHERE quality = 0 AND toxic = 1) AS c, count(*) FILTER (WHERE quality = 0 AND toxic = 0) AS d FROM labels JOIN documents USING (doc_id) GROUP BY 1),
x AS (SELECT *, unnest(range(greatest(0, a - d), least(a + b, a + c) + 1)) AS x FROM t), w AS (SELECT *, {_WAYS} AS w FROM x), o AS (SELECT *, max(w) FILTER (WHERE x = a) OVER (PARTITION BY lang) AS own FROM w)
SELECT lang, a, b, c, d, round(least(1.0, sum(exp(w - own)) FILTER (WHERE w <= own + 1e-9) / sum(exp(w - own))), 7) AS p FROM o GROUP BY lang, a, b, c, d""")
def fisher_by_lang(spark, sf_dir):
    """ST8: quality against toxicity in each language."""
    rows = _t(spark, sf_dir, "labels").join(_t(spark, sf_dir, "documents").select("doc_id", "lang"), "doc_id")
    cell = lambda q, t: F.count_if((F.col("quality") == q) & (F.col("toxic") == t))
    table = rows.groupBy("lang").agg(cell(1, 1).alias("a"), cell(1, 0).alias("b"), cell(0, 1).alias("c"), cell(0, 0).alias("d"))
    return table.withColumn("p", F.round(st.fisher("a", "b", "c", "d"), 7))


_DRAWS = """c AS (SELECT lang, source, CAST(sum(quality - toxic) AS BIGINT) AS net, count(*) AS pairs FROM labels JOIN documents USING (doc_id) GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY source) - 1 AS i, count(*) OVER (PARTITION BY lang) AS n FROM c),
d AS (SELECT lang, i AS place, n, unnest(range(1, 501)) AS s FROM r), p AS (SELECT d.lang, d.n, d.s, r.net, r.pairs FROM d JOIN r ON r.lang = d.lang AND r.i = CAST('0x' || substr(md5('7:' || CAST(s AS VARCHAR) || ':' || CAST(place AS VARCHAR)), 1, 8) AS BIGINT) % d.n), e AS (SELECT lang, n, s, sum(net) / sum(pairs) AS v FROM p GROUP BY 1, 2, 3)"""


@_query(f"""WITH {_DRAWS}, o AS (SELECT lang, sum(pairs)::BIGINT AS pairs, sum(net) / sum(pairs) AS rate FROM c GROUP BY 1)
SELECT lang, pairs, round(rate, 9) AS rate, n AS clusters, round(CASE WHEN n > 1 THEN quantile_cont(v, 0.025) END, 9) AS low, round(CASE WHEN n > 1 THEN quantile_cont(v, 0.975) END, 9) AS high FROM e JOIN o USING (lang) GROUP BY lang, pairs, rate, n""")
def cluster_bootstrap(spark, sf_dir):
    """ST3: quality less toxicity by language, sources as clusters."""
    rows = _t(spark, sf_dir, "labels").join(_t(spark, sf_dir, "documents").select("doc_id", "lang", "source"), "doc_id")
    out = st.cluster_bootstrap(rows, ["lang"], "source", F.col("quality") - F.col("toxic"), resamples=500, seed=7)
    return out.select("lang", "pairs", "clusters", *[F.round(c, 9).alias(c) for c in ("rate", "low", "high")])


@_query("""WITH v AS (SELECT s_nationkey, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey) - 1 AS i, round(s_acctbal) - 4500 AS v FROM supplier WHERE s_suppkey <= 250), n AS (SELECT s_nationkey, count(*) AS n, sum(v) AS own FROM v GROUP BY 1), m AS (SELECT *, unnest(range(0, CAST(2 ** n AS BIGINT))) AS mask FROM n),
f AS (SELECT m.s_nationkey, n, own, mask, sum(v * (1 - 2 * ((mask >> i) & 1))) AS s FROM m JOIN v USING (s_nationkey) GROUP BY 1, 2, 3, 4)
SELECT s_nationkey, n, round(avg(CAST(abs(s) >= abs(own) AS INTEGER)), 9) AS p, round(avg(CAST(s >= own AS INTEGER)), 9) AS p_greater, round(avg(CAST(s <= own AS INTEGER)), 9) AS p_less FROM f GROUP BY 1, 2""".replace(" WHERE s_suppkey <= 250", ""))
def sign_flip_by_nation(spark, sf_dir):
    """ST6, ST11: exact tests that balances lie around 4500."""
    rows = _t(spark, sf_dir, "supplier").where("s_nationkey is not null")
    tests = st.sign_flip(rows, ["s_nationkey"], F.round("s_acctbal") - 4500).drop("n")  # n counts zeros and nulls too
    out = rows.groupBy("s_nationkey").agg(F.count("*").alias("n")).join(tests, "s_nationkey", "left")
    return out.select("s_nationkey", "n", *[F.round(c, 9).alias(c) for c in ("p", "p_greater", "p_less")])


@_query("""SELECT l_returnflag, round(avg(ln(l_extendedprice)) FILTER (WHERE l_tax > 0.04) - avg(ln(l_extendedprice)) FILTER (WHERE l_tax <= 0.04), 9) AS gap,
round(sqrt(var_samp(ln(l_extendedprice)) FILTER (WHERE l_tax > 0.04) / count(*) FILTER (WHERE l_tax > 0.04) + var_samp(ln(l_extendedprice)) FILTER (WHERE l_tax <= 0.04) / count(*) FILTER (WHERE l_tax <= 0.04)), 9) AS error FROM lineitem GROUP BY 1""")
def welch_by_flag(spark, sf_dir):
    """ST9: ratio of geometric means as a difference of logarithms, with Welch's error."""
    out = st.welch(_t(spark, sf_dir, "lineitem"), ["l_returnflag"], F.ln("l_extendedprice"), F.col("l_tax") > 0.04)
    return out.select("l_returnflag", F.round("gap", 9).alias("gap"), F.round("error", 9).alias("error"))


@_query("""WITH v AS (SELECT s_nationkey, s_suppkey, CASE WHEN s_acctbal > 4500 THEN 1 ELSE 0 END AS v FROM supplier), r AS (SELECT *, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey) - 1 AS i, count(*) OVER (PARTITION BY s_nationkey) AS n FROM v),
d AS (SELECT s_nationkey, i AS place, n, unnest(range(1, 201)) AS s FROM r), p AS (SELECT d.s_nationkey, s, avg(v) AS m FROM d JOIN r ON r.s_nationkey = d.s_nationkey AND r.i = CAST('0x' || substr(md5('0:' || CAST(s AS VARCHAR) || ':' || CAST(place AS VARCHAR)), 1, 8) AS BIGINT) % d.n GROUP BY 1, 2)
SELECT s_nationkey, round(quantile_cont(m, 0.05), 9) AS low, round(quantile_cont(m, 0.95), 9) AS high, quantile_cont(m, 0.05) > -0.9 AND quantile_cont(m, 0.95) < 0.9 AS equivalent FROM p GROUP BY 1""")
def equivalence_by_nation(spark, sf_dir):
    """ST11: two one-sided tests by resampling."""
    out = st.equivalent(_t(spark, sf_dir, "supplier"), ["s_nationkey"], (F.col("s_acctbal") > 4500).cast("int"), "s_suppkey", 0.9, resamples=200)
    return out.select("s_nationkey", F.round("low", 9).alias("low"), F.round("high", 9).alias("high"), "equivalent")


@_query("""WITH s AS (SELECT p_partkey, p_name FROM part WHERE lower(p_name) = 'no such part'), l AS (SELECT p_partkey, p_name FROM part WHERE p_name LIKE '%widget%') SELECT * FROM s UNION ALL SELECT * FROM l WHERE NOT EXISTS (SELECT 1 FROM s)""")
def strict_loose_search(spark, sf_dir):
    """PF15: the loose search only when the strict one finds nothing."""
    parts = _t(spark, sf_dir, "part").select("p_partkey", "p_name")
    return matching.strict_or_loose(parts.where(F.lower("p_name") == "no such part"), parts.where(F.col("p_name").contains("widget")))


@_query("""SELECT o_orderkey, last_day(o_orderdate) AS month_end, make_date(CAST(year(o_orderdate) AS BIGINT), 12, 31) AS year_end, CAST(last_day(o_orderdate) - INTERVAL 30 DAY AS DATE) AS compared FROM orders""")
def partial_date_end(spark, sf_dir):
    """SF1, SF2."""
    month, year = F.date_format("o_orderdate", "yyyy-MM"), F.date_format("o_orderdate", "yyyy")
    return _t(spark, sf_dir, "orders").select("o_orderkey", S.parse_cutoff(month).alias("month_end"), S.parse_cutoff(year).alias("year_end"), S.compare_date(S.parse_cutoff(month)).alias("compared"))


@_query("""SELECT p_partkey, lower(regexp_replace(replace(p_name, ' ', '_.'), '[-_.]+', '-', 'g')) AS name FROM part""")
def canonical_name(spark, sf_dir):
    """SF5."""
    return _t(spark, sf_dir, "part").select("p_partkey", S.canonical_name(F.replace("p_name", F.lit(" "), F.lit("_."))).alias("name"))


@_query(f"""WITH p AS (SELECT page_id, string_split({_HOST}, '.') AS parts FROM pages), s AS (SELECT page_id, parts, unnest(range(1, len(parts) + 1)) AS n FROM p) SELECT page_id, array_to_string(parts[1:n], '.') AS prefix FROM s""")
def prefix_explode(spark, sf_dir):
    """SF8."""
    host = F.regexp_extract("url", "^[a-z]+://([^/?#]+)", 1)
    return _t(spark, sf_dir, "pages").select("page_id", F.explode_outer(S.prefixes(host)).alias("prefix"))


@_query("""SELECT doc_id, CAST(greatest(1, round_even(length(text) / 4.0, 0)) AS INTEGER) AS tokens FROM documents""")
def token_estimate(spark, sf_dir):
    """SF25, SF26."""
    return _t(spark, sf_dir, "documents").select("doc_id", S.estimate_tokens(F.col("text")).alias("tokens"))


@_query("""WITH RECURSIVE e AS (SELECT n_nationkey AS c, n_nationkey // 2 AS p FROM nation WHERE n_nationkey > 0), w AS (SELECT c AS node, p AS ancestor, 1 AS depth FROM e UNION ALL SELECT w.node, e.p, w.depth + 1 FROM w JOIN e ON e.c = w.ancestor) SELECT CAST(node AS INTEGER) AS node, CAST(ancestor AS INTEGER) AS ancestor, CAST(min(depth) AS INTEGER) AS depth FROM w GROUP BY 1, 2""")
def closure_bfs(spark, sf_dir):
    """REC1, REC3, REC4: ancestors with their least depth."""
    edges = _t(spark, sf_dir, "nation").where("n_nationkey > 0").select(F.col("n_nationkey").alias("c"), F.expr("cast(n_nationkey div 2 as int)").alias("p"))
    return graph.closure(edges, "c", "p")


@_query("""WITH s AS (SELECT o_custkey, max(o_orderstatus) AS v FROM orders WHERE o_orderdate < TIMESTAMP '1998-01-01' GROUP BY 1), n AS (SELECT o_custkey, max(o_orderstatus) AS v FROM orders WHERE o_orderdate >= TIMESTAMP '1998-01-01' GROUP BY 1)
SELECT s.o_custkey, CASE WHEN n.o_custkey IS NULL THEN 'orphan' WHEN n.v IS NULL THEN 'unpinned' WHEN n.v = s.v THEN 'current' ELSE 'out_of_date' END AS state FROM s LEFT JOIN n ON n.o_custkey = s.o_custkey""")
def state_compare(spark, sf_dir):
    """IN1, JN18."""
    orders = _t(spark, sf_dir, "orders")
    day = F.lit("1998-01-01").cast("timestamp")
    last = lambda df: df.groupBy("o_custkey").agg(F.max("o_orderstatus").alias("v"))
    return incremental.compare_state(last(orders.where(F.col("o_orderdate") < day)), last(orders.where(F.col("o_orderdate") >= day)), "o_custkey", "v").select("o_custkey", "state")


@_query("""SELECT DISTINCT l_partkey FROM lineitem WHERE l_discount > 0.08 AND l_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_tax > 0.07)""")
def missing_cache_keys(spark, sf_dir):
    """IN4."""
    items = _t(spark, sf_dir, "lineitem")
    return incremental.missing_keys(items.where("l_discount > 0.08"), items.where("l_tax > 0.07"), ["l_partkey"])


@_query("""WITH s AS (SELECT user_id, count(*) FILTER (WHERE event_type = 'click' AND value > 50) > 0 AS a, count(*) FILTER (WHERE event_type = 'view' AND value > 50) > 0 AS b, count(*) FILTER (WHERE event_type = 'click') AS n FROM events GROUP BY 1)
SELECT count(*) AS pairs, count(*) FILTER (WHERE NOT a AND b) AS fixed, count(*) FILTER (WHERE a AND NOT b) AS broken FROM s WHERE n > 0""")
def pairing_with_exclusions(spark, sf_dir):
    """JN15, AG10: pairs by user, those without a first arm left out."""
    hit = lambda kind: F.count_if((F.col("event_type") == kind) & (F.col("value") > 50)) > 0
    pairs = _t(spark, sf_dir, "events").groupBy("user_id").agg(hit("click").alias("a"), hit("view").alias("b"), F.count_if(F.col("event_type") == "click").alias("n")).where("n > 0")
    return pairs.agg(F.count("*").alias("pairs"), F.count_if(~F.col("a") & F.col("b")).alias("fixed"), F.count_if(F.col("a") & ~F.col("b")).alias("broken"))


@_query("""WITH s AS (SELECT n_nationkey, s_suppkey, 0 AS tier, s_acctbal AS b FROM nation JOIN supplier ON s_nationkey = n_nationkey WHERE s_acctbal > 9000 UNION ALL SELECT n_nationkey, s_suppkey, 1, s_acctbal FROM nation JOIN supplier ON s_nationkey = n_nationkey WHERE s_acctbal <= 9000)
SELECT n_nationkey, s_suppkey, tier FROM s QUALIFY row_number() OVER (PARTITION BY n_nationkey ORDER BY tier, b DESC, s_suppkey) = 1""")
def priority_lookup(spark, sf_dir):
    """JN5, JN17, JN25: the best of the first tier that has a match."""
    found = _t(spark, sf_dir, "nation").join(_t(spark, sf_dir, "supplier"), F.col("s_nationkey") == F.col("n_nationkey"))
    tiers = matching.priority_union([found.where("s_acctbal > 9000"), found.where("s_acctbal <= 9000")], ["n_nationkey"])
    return ranking.best_per_key(tiers, ["n_nationkey"], [F.desc("s_acctbal"), "s_suppkey"]).select("n_nationkey", "s_suppkey", "tier")


@_query("""WITH b AS (SELECT p_partkey AS path, CASE WHEN p_partkey % 10 = 3 THEN p_partkey - 1 END AS al, CAST(p_size AS BIGINT) AS n FROM part), a AS (SELECT * FROM b WHERE al IN (SELECT path FROM b))
SELECT b.path, CAST(b.n + coalesce((SELECT sum(n) FROM a WHERE a.al = b.path), 0) AS BIGINT) AS n FROM b WHERE b.path NOT IN (SELECT path FROM a)""")
def alias_self_merge(spark, sf_dir):
    """JN8: rows absorbed by the row that they alias."""
    key = F.col("p_partkey")
    parts = _t(spark, sf_dir, "part").select(key.alias("path"), F.when(key % 10 == 3, key - 1).alias("al"), F.col("p_size").cast("long").alias("n"))
    return matching.merge_aliases(parts, "path", "al", "n").select("path", "n")


@_query("""WITH m AS (SELECT DISTINCT c_mktsegment AS g, c_nationkey AS k, CAST(floor(c_acctbal / 1500) AS BIGINT) AS v FROM customer), o AS (SELECT * FROM m WHERE k < 12), n AS (SELECT * FROM m WHERE k >= 20), z AS (SELECT g, k, count(*) AS n FROM o GROUP BY 1, 2),
s AS (SELECT o.g, o.k, n.k AS other, count(*) AS kept FROM o JOIN n ON o.g = n.g AND o.v = n.v GROUP BY 1, 2, 3) SELECT s.g, s.k, other, kept, n FROM s JOIN z ON s.g = z.g AND s.k = z.k WHERE n >= 2 AND 5 * kept >= 4 * n QUALIFY count(*) OVER (PARTITION BY s.g, s.k) = 1""")
def unique_containment_match(spark, sf_dir):
    """JN12: the only fresh key that holds 80 percent of a gone key's members."""
    m = _t(spark, sf_dir, "customer").select(F.col("c_mktsegment").alias("g"), F.col("c_nationkey").alias("k"), F.floor(F.col("c_acctbal") / 1500).alias("v")).distinct()
    return matching.unique_containment(m, m.where("k < 12"), m.where("k >= 20"), "k", "v", ["g"], least=2).select("g", "k", "other", "kept", "n")


@_query("""SELECT o_orderpriority, o_custkey, o_orderkey FROM orders QUALIFY row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_orderdate DESC, o_orderkey DESC) = 1""")
def latest_in_family(spark, sf_dir):
    """WN4, WN9."""
    return ranking.best_per_key(_t(spark, sf_dir, "orders"), ["o_orderpriority"], [F.desc("o_orderdate"), F.desc("o_orderkey")]).select("o_orderpriority", "o_custkey", "o_orderkey")


@_query("""SELECT CAST(O AS INTEGER) AS o, CAST(k AS INTEGER) AS k, round(CASE WHEN k >= O THEN 0 ELSE least(1, (O - k) / CAST(10 - k AS DOUBLE)) END, 9) AS share FROM range(1, 10) a(O), range(0, 6) b(k)""")
def break_even_grid(spark, sf_dir):
    """ST13: over a grid of fixed costs and gains."""
    grid = spark.range(1, 10).select(F.col("id").cast("int").alias("o")).crossJoin(spark.range(0, 6).select(F.col("id").cast("int").alias("k")))
    return grid.select("o", "k", F.round(st.break_even(F.col("o"), F.lit(10.0), F.col("k")), 9).alias("share"))


@_query("""SELECT event_type, count(*) FILTER (WHERE value > 25) AS over25, count(*) FILTER (WHERE value > 50) AS over50, count(*) FILTER (WHERE value > 75) AS over75 FROM events GROUP BY 1""")
def threshold_histogram(spark, sf_dir):
    """AG22, SF30: counts over each threshold."""
    return grouping.conditional_counts(_t(spark, sf_dir, "events"), ["event_type"], {f"over{x}": F.col("value") > x for x in (25, 50, 75)})


@_query("""SELECT source, count(*) AS files, CAST(sum(strlen(text)) AS BIGINT) AS bytes, min(doc_id) AS oldest FROM documents GROUP BY 1""")
def namespace_stats(spark, sf_dir):
    """AG17."""
    return _t(spark, sf_dir, "documents").groupBy("source").agg(F.count("*").alias("files"), F.sum(F.octet_length("text")).alias("bytes"), F.min("doc_id").alias("oldest"))


@_query("""WITH o AS (SELECT DISTINCT o_custkey % 50 AS k, o_orderstatus AS v FROM orders WHERE o_orderdate < TIMESTAMP '1996-01-01'), n AS (SELECT DISTINCT o_custkey % 50 AS k, o_orderstatus AS v FROM orders WHERE o_orderdate >= TIMESTAMP '2001-07-01')
SELECT (SELECT count(*) FROM (SELECT * FROM o UNION SELECT * FROM n)) AS either, (SELECT count(*) FROM (SELECT * FROM o INTERSECT SELECT * FROM n)) AS both""")
def strata_union_intersection(spark, sf_dir):
    """SO8, SO12."""
    orders = _t(spark, sf_dir, "orders").select((F.col("o_custkey") % 50).alias("k"), F.col("o_orderstatus").alias("v"), "o_orderdate")
    day = lambda d: F.lit(d).cast("timestamp")
    old, new = orders.where(F.col("o_orderdate") < day("1996-01-01")).select("k", "v"), orders.where(F.col("o_orderdate") >= day("2001-07-01")).select("k", "v")
    either = old.union(new).distinct().agg(F.count("*").alias("either"))
    return either.crossJoin(old.intersect(new).agg(F.count("*").alias("both")))


@_query("""SELECT lang, array_to_string(list(source ORDER BY source)[1:3], ', ') || CASE WHEN count(*) > 3 THEN ' and ' || CAST(count(*) - 3 AS VARCHAR) || ' more' ELSE '' END AS head FROM (SELECT DISTINCT lang, source FROM documents) GROUP BY 1""")
def display_truncation(spark, sf_dir):
    """SL14, AG27: the first three and how many more."""
    names = _t(spark, sf_dir, "documents").groupBy("lang").agg(F.array_sort(F.collect_set("source")).alias("s"))
    more = F.when(F.size("s") > 3, F.concat(F.lit(" and "), (F.size("s") - 3).cast("string"), F.lit(" more"))).otherwise(F.lit(""))
    return names.select("lang", F.concat(F.array_join(F.slice("s", 1, 3), ", "), more).alias("head"))


@_query("""SELECT url, page_id FROM (SELECT page_id, url, lower(regexp_replace(url, '[^a-zA-Z]+', ' ', 'g')) AS k FROM pages) QUALIFY row_number() OVER (PARTITION BY k ORDER BY page_id) = 1""")
def distinct_by_normal_form(spark, sf_dir):
    """SO9, SO11: the first of texts that are equal in normal form."""
    pages = _t(spark, sf_dir, "pages").select("page_id", "url", F.lower(F.regexp_replace("url", "[^a-zA-Z]+", " ")).alias("k"))
    return ranking.best_per_key(pages, ["k"], [F.asc("page_id")]).select("url", "page_id")


@_query("""WITH l AS (SELECT p_partkey AS k, p_size AS v FROM part WHERE p_size <= 17), i AS (SELECT p_partkey AS k, p_size + 1 AS v FROM part WHERE p_retailprice >= 950), d AS (SELECT p_partkey AS k, p_size + 2 AS v FROM part WHERE p_brand < 'Brand#2')
SELECT CAST(coalesce(l.k, i.k, d.k) AS VARCHAR) AS name, CAST(coalesce(l.v, i.v, d.v) AS VARCHAR) AS version, CASE WHEN l.k IS NOT NULL THEN 'lock' WHEN i.k IS NOT NULL THEN 'installed' ELSE 'pinned' END AS source, d.k IS NOT NULL AS direct FROM l FULL JOIN i ON l.k = i.k FULL JOIN d ON d.k = coalesce(l.k, i.k)""")
def merged_dependencies(spark, sf_dir):
    """JN26: versions by precedence lock, installed, pinned."""
    parts = _t(spark, sf_dir, "part")

    def some(held: str, add: int) -> DataFrame:
        return parts.where(held).select(F.col("p_partkey").cast("string").alias("name"), (F.col("p_size") + add).cast("string").alias("version"))

    return projects.merged(some("p_size <= 17", 0).withColumn("direct", F.lit(False)), some("p_retailprice >= 950", 1), some("p_brand < 'Brand#2'", 2))


@_query("""WITH g AS (SELECT p_brand AS origin, p_type AS name, list(DISTINCT p_name) AS l FROM part GROUP BY 1, 2), o AS (SELECT origin, name, [y.x for y in list_sort([{'n': length(x), 'x': x} for x in l])] AS p FROM g)
SELECT origin, name, p[1] AS path, CAST(len(p) AS INTEGER) AS occurrences, array_to_string(p[2:6], ',') AS also FROM o""")
def fold_inherited(spark, sf_dir):
    """AG14: one row for each origin and name, the shortest path first, with the next five."""
    lost = _t(spark, sf_dir, "part").select(F.col("p_name").alias("class"), F.col("p_type").alias("name"), F.col("p_brand").alias("origin"))
    return changes.fold_inherited(lost).withColumn("also", F.array_join("also", ","))


@_query("""WITH RECURSIVE up AS (SELECT c_custkey AS k, c_custkey // 2 AS a FROM customer WHERE c_custkey > 1 UNION SELECT k, a // 2 FROM up WHERE a > 1)
SELECT k AS class, bool_or(coalesce(c.c_acctbal, -1) < 0) AS unresolved FROM up LEFT JOIN customer c ON c.c_custkey = up.a GROUP BY 1""")
def unresolved_ancestors(spark, sf_dir):
    """REC6: whether any ancestor is not among the known ones."""
    customers = _t(spark, sf_dir, "customer")
    bases = customers.where("c_custkey > 1").select(F.col("c_custkey").alias("class"), F.expr("c_custkey div 2").alias("base"))
    return changes.unresolved_ancestor(bases, customers.where("c_acctbal >= 0").select(F.col("c_custkey").alias("class")))


_NOTES = """SELECT o_custkey, o_orderpriority, max(CAST(year(o_orderdate) AS INTEGER)) AS version FROM orders"""


@_query(f"""WITH f AS ({_NOTES} GROUP BY 1, 2), s AS ({_NOTES} WHERE o_orderstatus = 'F' GROUP BY 1, 2)
SELECT f.o_custkey, f.o_orderpriority, f.version, CASE WHEN s.version = f.version THEN 'checked' ELSE 'diff' END AS text FROM f LEFT JOIN s USING (o_custkey, o_orderpriority)""")
def keep_checked_notes(spark, sf_dir):
    """JN19, IN2: stored rows stay while their version is the fresh one."""
    orders, keys = _t(spark, sf_dir, "orders"), ["o_custkey", "o_orderpriority"]
    last = lambda df, text: df.groupBy(*keys).agg(F.max(F.year("o_orderdate")).alias("version")).withColumn("text", F.lit(text))
    return changes.keep_checked(last(orders, "diff"), last(orders.where("o_orderstatus = 'F'"), "checked"), keys)


@_query(f"""WITH h AS (SELECT DISTINCT {_HOST} AS host FROM pages), k AS (SELECT string_split(host, '.')[-1] AS root, host FROM h)
SELECT root, host, CAST(row_number() OVER (PARTITION BY root ORDER BY len(string_split(host, '.')), host) AS INTEGER) AS rank FROM k QUALIFY rank <= 64""")
def shortest_paths(spark, sf_dir):
    """WN5: the paths of each object, fewest segments first (the 64 are the operator's)."""
    hosts = _t(spark, sf_dir, "pages").select(F.regexp_extract("url", "^[a-z]+://([^/?#]+)", 1).alias("host")).distinct()
    return changes.shortest_paths(hosts.withColumn("root", F.substring_index("host", ".", -1)), ["root"], "host").select("root", "host", "rank")


@_query("""SELECT user_id, count(*) AS n, count(*) FILTER (WHERE event_type = 'purchase') AS passed, count(*) FILTER (WHERE event_type = 'error') AS stale, count(*) FILTER (WHERE event_type = 'purchase') / count(*) AS pass_rate, count(*) FILTER (WHERE event_type = 'error') / count(*) AS stale_rate FROM events GROUP BY 1""")
def pass_rates(spark, sf_dir):
    """AG26."""
    outcome = F.when(F.col("event_type") == "purchase", "pass").when(F.col("event_type") == "error", "stale").otherwise("other")
    return changes.pass_rates(_t(spark, sf_dir, "events").withColumn("outcome", outcome), ["user_id"])


@_query("""WITH s AS (SELECT user_id, list(DISTINCT event_type) FILTER (WHERE value > 80) AS p, list(DISTINCT event_type) FILTER (WHERE value < 20) AS a FROM events GROUP BY 1)
SELECT user_id, CASE WHEN a IS NULL THEN '' ELSE coalesce(array_to_string(list_sort([x for x in p if NOT list_contains(a, x)]), ','), '') END AS unknown FROM s""")
def unknown_keywords(spark, sf_dir):
    """SO4, SO5: what is passed and not accepted; a null set accepts anything."""
    kinds = lambda c: F.collect_set(F.when(c, F.col("event_type")))
    sets = _t(spark, sf_dir, "events").groupBy("user_id").agg(kinds(F.col("value") > 80).alias("p"), kinds(F.col("value") < 20).alias("a"))
    accepted = F.when(F.size("a") > 0, F.col("a"))
    return sets.select("user_id", F.array_join(changes.unknown_keywords(F.col("p"), accepted), ",").alias("unknown"))


@_query("""WITH e AS (SELECT DISTINCT l_suppkey AS session, l_partkey AS api FROM lineitem WHERE l_returnflag = 'R'), h AS (SELECT DISTINCT l_suppkey AS session, l_partkey AS api FROM lineitem WHERE l_returnflag = 'N'), s AS (SELECT session, api FROM e EXCEPT SELECT session, api FROM h)
SELECT e.session, CAST(count(s.api) AS INTEGER) AS n, min(s.api) AS first_api FROM e LEFT JOIN s ON s.session = e.session AND s.api = e.api GROUP BY 1""")
def edited_not_listed(spark, sf_dir):
    """JN22: for each session what it edits beyond the listed."""
    items = _t(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("session"), F.col("l_partkey").alias("api"), "l_returnflag")
    out = changes.edited_not_listed(items.where("l_returnflag = 'R'"), items.where("l_returnflag = 'N'").withColumn("api", F.col("api")))
    return out.select("session", F.size("apis").alias("n"), F.get("apis", F.lit(0)).alias("first_api"))


@_query("""SELECT l_returnflag AS path, l_linestatus AS parameter, CAST(year(l_shipdate) AS INTEGER) AS context, array_to_string(list_sort(list(DISTINCT CAST(l_linenumber AS VARCHAR))), ',') AS types, count(*) AS n FROM lineitem GROUP BY 1, 2, 3""")
def reference_sites(spark, sf_dir):
    """AG15: sites by three keys with the set of their types."""
    sites = _t(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("path"), F.col("l_linestatus").alias("parameter"), F.year("l_shipdate").alias("context"), F.col("l_linenumber").cast("string").alias("type"))
    return changes.reference_sites(sites).withColumn("types", F.array_join("types", ","))


@_query("""SELECT doc_id, CASE WHEN regexp_matches(text, '[a-z0-9]+@[a-z0-9]+') THEN 'address' WHEN regexp_matches(text, '[Ll]icense') THEN 'license' WHEN regexp_matches(text, '[0-9]{4,}') THEN 'number' END AS label FROM documents""")
def first_label(spark, sf_dir):
    """PF16: the first label that fits."""
    rules = [("[a-z0-9]+@[a-z0-9]+", "address"), ("[Ll]icense", "license"), ("[0-9]{4,}", "number")]
    return _t(spark, sf_dir, "documents").select("doc_id", T.first_label(F.col("text"), rules).alias("label"))


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As-of selection, snapshot diff, collapse and ranking in one plan: each customer's
    latest order before two dates, what changed, and the changes in score order."""
    orders = _t(spark, sf_dir, "orders")

    def current(day: str) -> DataFrame:
        rows = orders.where(F.col("o_orderdate") <= F.lit(day).cast("timestamp"))
        return ranking.best_per_key(rows, ["o_custkey"], [F.desc("o_orderdate"), F.desc("o_orderkey")]).select("o_custkey", "o_orderkey", "o_orderpriority")

    changed = matching.snapshot_diff(current("1997-12-31"), current("1998-12-31"), ["o_custkey"], ["o_orderkey", "o_orderpriority"])
    kinds = changed.groupBy("change", F.coalesce("new_o_orderpriority", "old_o_orderpriority").alias("priority")).agg(F.count("*").alias("occurrences"), F.min("o_custkey").alias("first_key"))
    return kinds.withColumn("score", F.round(10 + F.least(F.lit(2.0), F.log2(F.col("occurrences") + 1) - 1), 6)).orderBy(F.desc("score"), "change", "priority")
