"""Registered queries of release, change, project and note operators, with their SQL.

The driver's tables stand in for the domain's: orders for releases, parts for changes and dependencies,
lines for uses, events for runs and answers."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions import markers, scalar as S
from tidemark.functions import text as T
from tidemark.functions.versions import is_final, satisfies, version_key
from tidemark.operators import calls, changes, experiments, grouping, incremental, matching, notes, projects, ranking
from tidemark.operators import statistics as st
from tidemark.plans import experiment, release_diff
from tidemark.plans.catalog import _query, _t
from tidemark.sources import environments, files, records, registry


@_query("""SELECT CAST(o_custkey AS VARCHAR) AS package, o_orderpriority AS version, min(o_orderdate) AS uploaded, bool_and(o_orderstatus = 'F') AS yanked FROM orders GROUP BY 1, 2""")
def release_rows(spark, sf_dir):
    """SC2, SF3: a document of files by version becomes one row a release."""
    iso = F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss'Z'")
    file = F.struct(iso.alias("upload_time_iso_8601"), (F.col("o_orderstatus") == "F").alias("yanked"))
    versions = _t(spark, sf_dir, "orders").groupBy(F.col("o_custkey").cast("string").alias("package"), "o_orderpriority").agg(F.collect_list(file).alias("f"))
    docs = versions.groupBy("package").agg(F.map_from_entries(F.collect_list(F.struct("o_orderpriority", "f"))).alias("releases"))
    return files.releases(docs)


_RELEASES = """WITH r AS (SELECT o_custkey AS p, o_orderkey % 4 AS a, o_orderkey % 11 AS b, o_orderkey % 3 = 1 AS pre, o_orderpriority LIKE '1%' AS yanked, CAST(o_orderdate AS DATE) AS day FROM orders),
v AS (SELECT *, CAST(a AS VARCHAR) || '.' || CAST(b AS VARCHAR) || CASE WHEN pre THEN 'rc1' ELSE '' END AS version FROM r), c AS (SELECT DISTINCT o_custkey AS p FROM orders)
"""


def _release_table(spark, sf_dir):
    orders = _t(spark, sf_dir, "orders")
    key = F.col("o_orderkey")
    version = F.concat((key % 4).cast("string"), F.lit("."), (key % 11).cast("string"), F.when(key % 3 == 1, "rc1").otherwise(""))
    return orders.select(F.col("o_custkey").cast("string").alias("package"), version.alias("version"), F.col("o_orderdate").alias("uploaded"), F.col("o_orderpriority").like("1%").alias("yanked"))


@_query(_RELEASES + """SELECT CAST(c.p AS VARCHAR) AS package, v.version FROM c LEFT JOIN v ON v.p = c.p AND NOT yanked AND day <= DATE '1999-06-30' QUALIFY row_number() OVER (PARTITION BY c.p ORDER BY CASE WHEN pre THEN 1 ELSE 0 END, a DESC, b DESC) = 1""")
def current_releases(spark, sf_dir):
    """PF2, JN2, JN3, WN3, SF4: the version current at a cutoff, final ones first, by version order."""
    releases = _release_table(spark, sf_dir)
    cutoffs = releases.select("package").distinct().withColumn("cutoff", F.lit("1999-06-30").cast("date"))
    return release_diff.current_releases(releases, cutoffs).select("package", "version")


@_query(_RELEASES + """SELECT DISTINCT version, NOT pre AS final, (a > 1 OR a = 1 AND b >= 2) AND a < 3 AND NOT (a = 1 AND b = 2 AND pre) AS fits, CAST(dense_rank() OVER (ORDER BY a, b, NOT pre) AS INTEGER) AS place FROM v""")
def version_order(spark, sf_dir):
    """SF4: finality, specifiers and order of versions."""
    versions = _release_table(spark, sf_dir).select("version").distinct()
    fits = satisfies(F.col("version"), F.lit(">=1.2,<3"))
    placed = versions.withColumn("k", version_key(F.col("version")))
    return placed.select("version", is_final(F.col("version")).alias("final"), fits.alias("fits"), F.dense_rank().over(ranking.Window.orderBy("k")).alias("place"))


@_query("""SELECT p_partkey AS id, p_brand AS name, p_size < 30 OR p_brand IN ('Brand#13', 'Brand#21') AS kept FROM part WHERE (p_size < 30 OR p_brand IN ('Brand#13', 'Brand#21')) AND p_brand <> 'Brand#11'""")
def scanned_dependencies(spark, sf_dir):
    """PF1: direct, imported or named dependencies, less the excluded."""
    deps = _t(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.col("p_brand").alias("name"), (F.col("p_size") < 30).alias("direct"))
    imported = spark.range(1).select(F.lit("BRAND#13").alias("name")).unionByName(spark.range(1).select(F.lit("Brand#21").alias("name")))
    return projects.scanned(deps, imported, exclude=["brand#11"]).select("id", "name", F.lit(True).alias("kept"))


@_query("""WITH d AS (SELECT p_partkey AS k, CAST(p_size AS VARCHAR) AS v FROM part WHERE p_size % 2 = 0), l AS (SELECT p_partkey AS k, CAST(p_size - p_size % 3 AS VARCHAR) AS v FROM part)
SELECT CAST(d.k AS VARCHAR) AS name, d.v AS pinned, l.v AS locked FROM d JOIN l USING (k) WHERE d.v <> l.v""")
def pin_conflicts(spark, sf_dir):
    """JN20: pins that the lock doesn't keep."""
    name, size = F.col("p_partkey").cast("string").alias("name"), F.col("p_size")
    parts = _t(spark, sf_dir, "part")
    return projects.pin_conflicts(parts.where(size % 2 == 0).select(name, size.cast("string").alias("version")), parts.select(name, (size - size % 3).cast("string").alias("version")))


@_query("""WITH d AS (SELECT p_brand AS name, CASE WHEN p_size % 3 = 0 THEN p_size END AS v, p_partkey % 4 <> 0 AS applies, p_partkey AS o FROM part), s AS (SELECT *, max(applies) OVER (PARTITION BY name) AS any_one FROM d), k AS (SELECT * FROM s WHERE applies OR NOT any_one)
SELECT name, CAST(max(v) AS VARCHAR) AS version, CASE WHEN max(v) IS NULL THEN count(*) END AS ranges FROM k GROUP BY 1""")
def declared_once(spark, sf_dir):
    """SC8, AG6: of several declarations the highest pin that applies."""
    size, key = F.col("p_size"), F.col("p_partkey")
    rows = _t(spark, sf_dir, "part").select(F.col("p_brand").alias("name"), F.when(size % 3 == 0, size.cast("string")).alias("version"), F.when(size % 3 == 0, "").otherwise(">=1").alias("specifier"), (key % 4 != 0).alias("applies"), key.alias("ordinal"))
    out = projects.declared_once(rows, version_key(F.col("version")))
    return out.select("name", "version", F.when(F.col("version").isNull(), F.size(F.split("specifier", ",")).cast("long")).alias("ranges"))


_CLASSES = "(SELECT c_custkey AS k, c_custkey // 2 AS p FROM customer WHERE c_custkey > 1)"


@_query(f"""WITH RECURSIVE up AS (SELECT k, p AS a, 1 AS d FROM {_CLASSES} UNION ALL SELECT up.k, a // 2, d + 1 FROM up WHERE a > 1), m AS (SELECT DISTINCT o_custkey AS k, o_orderpriority AS name FROM orders WHERE o_custkey <= (SELECT max(c_custkey) FROM customer)),
i AS (SELECT up.k, m.name, up.a, row_number() OVER (PARTITION BY up.k, m.name ORDER BY d) AS r FROM up JOIN m ON m.k = up.a WHERE NOT EXISTS (SELECT 1 FROM m o WHERE o.k = up.k AND o.name = m.name))
SELECT k AS class, name, a AS origin FROM i WHERE r = 1""")
def inherited_members(spark, sf_dir):
    """JN9, REC1: members from the nearest ancestor that has them, without those a class has of its own."""
    customers = _t(spark, sf_dir, "customer").select(F.col("c_custkey").alias("class"))
    bases = customers.where("class > 1").select("class", F.expr("class div 2").alias("base"), F.lit(0).alias("place"))
    members = _t(spark, sf_dir, "orders").select(F.col("o_custkey").alias("class"), F.col("o_orderpriority").alias("name")).distinct()
    return changes.inherited_members(customers, bases, members.join(customers, "class", "left_semi"))


@_query("""WITH s AS (SELECT l_orderkey AS path, l_linenumber AS parameter, l_shipdate < TIMESTAMP '1997-01-01' AS old, 's' || CAST(l_suppkey % 5 AS VARCHAR) AS root, l_linestatus AS name FROM lineitem),
o AS (SELECT DISTINCT path, parameter, root, name FROM s WHERE old AND root IN ('s0', 's1')), n AS (SELECT DISTINCT path, parameter % 3 + 1 AS parameter, root, name FROM s WHERE NOT old AND root IN ('s2', 's3', 's4'))
SELECT o.root AS gone, n.root AS fresh, count(*) AS sites, count(*) FILTER (WHERE o.name = n.name) AS same_name FROM o JOIN n ON o.path = n.path AND o.parameter = n.parameter GROUP BY 1, 2 HAVING 2 * count(*) FILTER (WHERE o.name = n.name) >= count(*)""")
def switched_dependencies(spark, sf_dir):
    """JN13: dropped requirements whose sites name an added one now."""
    rows = _t(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("path"), F.col("l_linenumber").alias("parameter"), F.lit("x").alias("context"), (F.col("l_shipdate") < F.lit("1997-01-01").cast("timestamp")).alias("old"),
        F.concat(F.lit("s"), (F.col("l_suppkey") % 5).cast("string")).alias("root"), F.col("l_linestatus").alias("name"),
    )
    old = rows.where("old and root in ('s0', 's1')").drop("old").distinct()
    new = rows.where("not old and root in ('s2', 's3', 's4')").drop("old").withColumn("parameter", F.col("parameter") % 3 + 1).distinct()
    return changes.switched_dependencies(old, new, old.select("root").distinct(), new.select("root").distinct())


@_query("""WITH b AS (SELECT p_brand AS package, p_type AS name, CASE WHEN p_size > 25 THEN 'fast' END AS extra, p_partkey % 3 AS r FROM part), o AS (SELECT DISTINCT package, name, extra FROM b WHERE r <> 1), n AS (SELECT DISTINCT package, name, extra FROM b WHERE r <> 0)
SELECT package, name, extra FROM o WHERE extra IS NULL AND NOT EXISTS (SELECT 1 FROM n WHERE n.package = o.package AND n.name = o.name AND n.extra IS NULL)
UNION ALL SELECT package, name, extra FROM o WHERE extra IS NOT NULL AND EXISTS (SELECT 1 FROM n WHERE n.package = o.package AND n.extra = o.extra) AND NOT EXISTS (SELECT 1 FROM n WHERE n.package = o.package AND n.name = o.name AND (n.extra IS NULL OR n.extra = o.extra))""")
def dropped_requirements(spark, sf_dir):
    """SO1: requirements that a release dropped, by extra."""
    rows = _t(spark, sf_dir, "part").select(F.col("p_brand").alias("package"), F.col("p_type").alias("name"), F.when(F.col("p_size") > 25, "fast").alias("extra"), (F.col("p_partkey") % 3).alias("r"))
    return changes.dropped_requirements(rows.where("r <> 1").drop("r"), rows.where("r <> 0").drop("r"))


@_query("""WITH r AS (SELECT DISTINCT l_suppkey AS package, l_partkey % 60 AS name FROM lineitem WHERE l_linenumber = 1), l1 AS (SELECT package AS root, name, row_number() OVER (PARTITION BY package ORDER BY name) AS place FROM r WHERE name <> package),
l2 AS (SELECT l1.root, r.name, min(l1.place * 1000 + r.name) AS k FROM l1 JOIN r ON r.package = l1.name WHERE r.name <> l1.root AND NOT EXISTS (SELECT 1 FROM l1 o WHERE o.root = l1.root AND o.name = r.name) GROUP BY 1, 2),
n AS (SELECT root, max(place) AS n FROM l1 GROUP BY 1), e AS (SELECT root, name, 1 AS level, place FROM l1 UNION ALL SELECT l2.root, l2.name, 2, n + row_number() OVER (PARTITION BY l2.root ORDER BY k) FROM l2 JOIN n ON n.root = l2.root)
SELECT root, name, CAST(level AS INTEGER) AS level, CAST(place AS BIGINT) AS place FROM e WHERE place <= 40""")
def requirements_within(spark, sf_dir):
    """JN21: requirements of requirements, breadth first, to depth two (the 40 are the operator's)."""
    needs = _t(spark, sf_dir, "lineitem").where("l_linenumber = 1").select(F.col("l_suppkey").alias("package"), (F.col("l_partkey") % 60).alias("name")).distinct().withColumn("ordinal", F.col("name"))
    return changes.requirements_within(needs.select(F.col("package").alias("root")).distinct(), needs)


@_query("""WITH RECURSIVE e AS (SELECT s_suppkey AS a, s_suppkey // 3 AS b FROM supplier WHERE s_suppkey >= 3), up AS (SELECT a, b FROM e UNION SELECT up.a, e.b FROM up JOIN e ON e.a = up.b)
SELECT a AS root, b AS file FROM up UNION SELECT s_suppkey, s_suppkey FROM supplier""")
def included_files(spark, sf_dir):
    """REC7: a file and all it includes."""
    key = F.col("s_suppkey")
    rows = _t(spark, sf_dir, "supplier").select(key.alias("file"), F.when(key >= 3, F.expr("s_suppkey div 3")).alias("target"))
    return environments.included_files(rows)


@_query("""SELECT p_partkey, CASE WHEN p_size % 5 = 0 THEN 'removed' WHEN p_size % 5 = 1 THEN 'param_removed' ELSE 'deprecated' END AS kind FROM part
WHERE NOT (p_brand LIKE 'Brand#1%') AND NOT (p_size % 5 <> 1 AND p_partkey % 2 = 0 AND EXISTS (SELECT 1 FROM part q WHERE q.p_size % 5 = 1 AND q.p_name = part.p_name AND q.p_brand NOT LIKE 'Brand#1%'))""")
def changes_worth_a_note(spark, sf_dir):
    """PF5, PF6: without what a decorator marks and what mirrors a parameter that went."""
    size = F.col("p_size")
    kind = F.when(size % 5 == 0, "removed").when(size % 5 == 1, "param_removed").otherwise("deprecated")
    rows = _t(spark, sf_dir, "part").select(
        "p_partkey", F.lit("p").alias("package"), kind.alias("kind"), F.concat("p_type", F.when(F.col("p_partkey") % 2 == 0, "Params").otherwise("")).alias("owner"), F.when(kind == "param_removed", F.col("p_name")).alias("parameter"),
        F.col("p_name").alias("name"), F.when(F.col("p_brand").like("Brand#1%"), "x").otherwise("").alias("deprecated_by"), F.lit("f(a: int)").alias("old_signature"), F.lit("f()").alias("new_signature"),
    )
    return changes.worth_a_note(changes.probeable(rows)).select("p_partkey", "kind")


@_query("""SELECT p_partkey, coalesce(CASE WHEN p_size % 3 = 0 THEN 'internal' WHEN p_size % 3 = 1 THEN 'public' END, 'public') AS tier FROM part""")
def changes_by_tier(spark, sf_dir):
    """PF7: public and internal changes apart."""
    size = F.col("p_size")
    rows = _t(spark, sf_dir, "part").select("p_partkey", F.when(size % 3 == 0, "internal").when(size % 3 == 1, "public").alias("tier"))
    public, internal = changes.by_tier(rows)
    return public.withColumn("tier", F.lit("public")).unionByName(internal)


_KINDS = ["removed", "moved", "param_removed", "param_required", "kind_changed", "deprecated", "param_keyword_only", "param_positional_only"]


def _changes(spark, sf_dir):
    """Parts as changes: path brand.type.part, eight kinds by size."""
    size = F.col("p_size")
    path = F.concat(F.lit("lib."), F.lower(F.regexp_replace("p_brand", "[^A-Za-z0-9]", "_")), F.when(size % 7 == 0, ".compat").when(size % 7 == 1, ".cli").otherwise(""), F.lit(".f"), F.col("p_partkey").cast("string"))
    kind = F.element_at(F.array(*[F.lit(k) for k in _KINDS]), (size % 8).cast("int") + 1)
    none = F.lit(None).cast("string")
    return _t(spark, sf_dir, "part").select(
        F.lit("lib").alias("package"), path.alias("path"), F.concat(F.lit("f"), F.col("p_partkey").cast("string")).alias("name"), none.alias("owner"), kind.alias("kind"),
        F.when(kind.startswith("param_"), F.lit("x")).alias("parameter"), none.alias("moved_to"), F.when(size > 40, F.lit("Use g.")).alias("deprecation"), none.alias("origin"),
        F.lit("f(x)").alias("old_signature"), (size % 2 == 0).alias("documented"), F.col("p_partkey").alias("k"),
    )


_CHANGES = """c AS (SELECT p_partkey AS k, 'lib.' || lower(regexp_replace(p_brand, '[^A-Za-z0-9]', '_', 'g')) || CASE WHEN p_size % 7 = 0 THEN '.compat' WHEN p_size % 7 = 1 THEN '.cli' ELSE '' END || '.f' || CAST(p_partkey AS VARCHAR) AS path,
['removed', 'moved', 'param_removed', 'param_required', 'kind_changed', 'deprecated', 'param_keyword_only', 'param_positional_only'][p_size % 8 + 1] AS kind, [0, 0, 1, 2, 3, 4, 5, 5][p_size % 8 + 1] AS priority, p_size AS s FROM part)"""


@_query(f"""WITH {_CHANGES}
SELECT path, kind, round(10 - 1.5 * priority + greatest(0, 3 - 0.75 * (length(path) - length(replace(path, '.', '')))) + least(2, log2(2) - 1) + CAST(s % 2 = 0 AS INTEGER) + CASE WHEN s > 40 THEN 0.5 ELSE 0 END - CASE WHEN s % 7 = 0 THEN 3 WHEN s % 7 = 1 THEN 2 ELSE 0 END, 6)::DOUBLE AS score FROM c""")
def ranked_change_scores(spark, sf_dir):
    """PF8, SL1, SL2, SF6: the score of each change, by kind, depth, documentation and place."""
    out = release_diff.ranked_changes(_changes(spark, sf_dir))
    return out.select("path", "kind", F.round("score", 6).alias("score"))


@_query(f"""WITH {_CHANGES}, f AS (SELECT l_partkey AS k, l_linenumber AS n, l_returnflag AS r, l_linestatus AS t FROM lineitem), u AS (
SELECT c.path, c.kind, n, CASE WHEN kind LIKE 'param_%' AND r = 'R' THEN 0 WHEN r = 'N' THEN 1 WHEN kind LIKE 'param_%' AND r = 'A' THEN 3 END AS tier FROM c JOIN f ON f.k = c.k), b AS (SELECT path, n, min(tier) AS tier FROM u WHERE tier IS NOT NULL GROUP BY 1, 2)
SELECT path, 'file' || CAST(n AS VARCHAR) AS file, ['keyword', 'path', 'member', 'keyword_name', 'name_only'][tier + 1] AS how FROM b""")
def uses_of_changes(spark, sf_dir):
    """JN5, PF11: where files use a change: by the passed parameter, the path, or names alone."""
    change = _changes(spark, sf_dir)
    lines = _t(spark, sf_dir, "lineitem").join(change.select("k", "path", "name"), F.col("l_partkey") == F.col("k"))
    file, flag = F.concat(F.lit("file"), F.col("l_linenumber").cast("string")).alias("file"), F.col("l_returnflag")
    row = lambda fact, a, b: F.struct(F.lit(fact).alias("fact"), a.alias("a"), (F.lit(b) if b else F.lit(None).cast("string")).alias("b"))
    fact = F.when(flag == "R", row("keyword_path", F.col("path"), "x")).when(flag == "N", row("path", F.col("path"), None)).otherwise(row("keyword", F.col("name"), "x"))
    facts = lines.select(file, fact.alias("f")).select("file", "f.fact", "f.a", "f.b", F.lit(1).alias("pos")).distinct()
    imports = lines.select(file).distinct().select("file", F.lit("path").alias("fact"), F.lit("lib").alias("a"), F.lit(None).cast("string").alias("b"), F.lit(1).alias("pos"))
    return release_diff.uses(change, facts.unionByName(imports)).select("path", "file", "how")


@_query("""WITH u AS (SELECT l_suppkey AS package, l_partkey AS api, min(CASE l_returnflag WHEN 'R' THEN 0 WHEN 'A' THEN 1 ELSE 2 END) AS t, max(CAST(l_tax > 0.05 AS INTEGER)) AS old FROM lineitem WHERE l_suppkey <= 20 GROUP BY 1, 2)
SELECT package, api, ['path', 'name', 'name_only'][t + 1] AS match, CAST(old AS INTEGER) AS old, CAST(max(old) OVER (PARTITION BY package) AS INTEGER) AS packages_first FROM u""".replace(" WHERE l_suppkey <= 20", ""))
def used_apis(spark, sf_dir):
    """WN10, SL5: the best use of each API."""
    how = F.when(F.col("l_returnflag") == "R", "path").when(F.col("l_returnflag") == "A", "name").otherwise("name_only")
    uses = _t(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("package"), F.col("l_suppkey").alias("ordinal"), F.col("l_partkey").alias("api"), F.col("l_partkey").alias("position"), how.alias("how"), F.when(F.col("l_tax") > 0.05, "old").otherwise("uses").alias("form"))
    return changes.used_apis(uses).select("package", "api", "match", "old", "packages_first")


@_query("""SELECT p_partkey, CASE WHEN p_size % 4 = 0 AND p_type LIKE '%E%' THEN 'old' WHEN p_size % 4 = 1 THEN 'uses' WHEN p_size % 4 = 2 AND p_size % 3 = 0 THEN 'old' WHEN p_size % 4 = 3 THEN 'old' ELSE 'uses' END AS form FROM part""")
def use_forms(spark, sf_dir):
    """SF36: whether a use is of the form that went."""
    size = F.col("p_size")
    kind = F.when(size % 4 == 0, "dependency_switched").when(size % 4 == 1, "param_required").when(size % 4 == 2, "param_removed").otherwise("removed")
    names = F.when(size % 4 == 0, F.array(F.lit("f"), F.when(F.col("p_type").contains("E"), "except E").otherwise("g"))).when((size % 4 == 2) & (size % 3 == 0), F.array(F.lit("f"), F.lit("x"))).otherwise(F.array(F.lit("f")))
    parameter = F.when(size % 4 == 2, "x")
    return _t(spark, sf_dir, "part").select("p_partkey", changes.use_form(kind, parameter, names).alias("form"))


@_query("""SELECT c.p_partkey AS id, u.p_partkey AS used_id FROM part c JOIN part u ON c.p_type = u.p_type AND c.p_name = u.p_name AND c.p_size % 2 = u.p_size % 2 WHERE c.p_size < 10 AND u.p_size > 45""")
def suffix_join(spark, sf_dir):
    """JN6: changes and used paths with the same root and last segment, beta only with beta."""
    name, beta = F.replace("p_name", F.lit(" "), F.lit("_")), F.when(F.col("p_size") % 2 == 1, ".v1beta1").otherwise("")
    path = F.concat("p_type", beta, F.lit("."), name)
    parts = _t(spark, sf_dir, "part").select("p_partkey", "p_size", path.alias("path"), name.alias("name"), F.lit(None).cast("string").alias("owner"))
    used = parts.where("p_size > 45").select(F.col("p_partkey").alias("used_id"), F.col("path").alias("used"))
    return changes.by_suffix(parts.where("p_size < 10"), used).select(F.col("p_partkey").alias("id"), "used_id")


@_query("""WITH c AS (SELECT l_orderkey % 50 AS file, l_suppkey AS callee, CASE WHEN l_returnflag = 'R' THEN l_linestatus END AS keyword, l_linenumber AS position FROM lineitem), w AS (SELECT s_suppkey AS callee, CASE WHEN s_nationkey % 2 = 0 THEN 'O' ELSE 'F' END AS parameter, s_nationkey % 7 AS position FROM supplier)
SELECT file, c.callee, string_agg(DISTINCT parameter, ',' ORDER BY parameter) AS parameters FROM c JOIN w ON c.callee = w.callee AND (keyword = parameter OR keyword IS NULL AND c.position = w.position) GROUP BY 1, 2""")
def passed_on(spark, sf_dir):
    """JN7: calls that pass a switched parameter by keyword or by position."""
    calls_ = _t(spark, sf_dir, "lineitem").select((F.col("l_orderkey") % 50).alias("file"), F.col("l_suppkey").alias("callee"), F.when(F.col("l_returnflag") == "R", F.col("l_linestatus")).alias("keyword"), F.col("l_linenumber").cast("int").alias("position"))
    switched = _t(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("callee"), F.when(F.col("s_nationkey") % 2 == 0, "O").otherwise("F").alias("parameter"), (F.col("s_nationkey") % 7).cast("int").alias("position"))
    return changes.passed_on(calls_, switched).withColumn("parameters", F.array_join("parameters", ","))


@_query("""SELECT o_custkey, o_orderkey, CASE WHEN o_orderstatus = 'O' THEN 0 ELSE 1 END AS tier FROM orders QUALIFY CASE WHEN o_orderstatus = 'O' THEN 0 ELSE 1 END = min(CASE WHEN o_orderstatus = 'O' THEN 0 ELSE 1 END) OVER (PARTITION BY o_custkey)""")
def old_wins_union(spark, sf_dir):
    """SO2: two sources as one, the first wins by key."""
    orders = _t(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_orderstatus")
    return matching.priority_union([orders.where("o_orderstatus = 'O'"), orders.where("o_orderstatus <> 'O'")], ["o_custkey"]).drop("o_orderstatus")


_TEXT = "'Deprecated since 2.0. Use ' || chr(96) || replace(p_name, ' ', '_') || chr(96) || ' instead of it. See the guide.'"


@_query(f"""SELECT p_partkey, replace(p_name, ' ', '_') AS replacement, 'Use ' || replace(p_name, ' ', '_') || ' instead of it. See the guide.' AS quoted, CAST(3 AS INTEGER) AS n, p_size % 2 = 0 AS grounded, p_size % 5 = 0 AS leaks, 'a, ' || lower(p_brand) AS tags FROM (SELECT *, {_TEXT} AS t FROM part)""".replace("lower(p_brand)", "'b' || CAST(p_size AS VARCHAR)"))
def evidence_of_texts(spark, sf_dir):
    """SF15, SF16, SF17, SF19, SF20, SF21: replacement, quote, sentences, grounding, leaks and tags of a text."""
    name = F.replace("p_name", F.lit(" "), F.lit("_"))
    text = F.concat(F.lit("Deprecated since 2.0. Use `"), name, F.lit("` instead of it. See the guide."))
    rows = _t(spark, sf_dir, "part").select("p_partkey", "p_size", name.alias("name"), text.alias("t"))
    known = F.when(F.col("p_size") % 2 == 0, F.array("name")).otherwise(F.array(F.lit("other")))
    forbidden = F.when(F.col("p_size") % 5 == 0, F.array(F.upper("name"))).otherwise(F.array(F.lit("nothing_like_it")))
    plain = T.plain(F.col("t"))
    tags = T.decode_tags(F.concat(F.col("t"), F.lit(" "), T.encode_tags(F.array(F.lit("a"), F.concat(F.lit("b"), F.col("p_size").cast("string")), F.lit("a")))))
    limit = F.char_length(plain)
    whole = F.when(limit > 0, T.quote(F.substring(plain, 23, 1000), 1000))
    return rows.select("p_partkey", T.named_replacement(F.col("t")).alias("replacement"), whole.alias("quoted"), F.size(T.sentences(plain)).alias("n"), T.is_grounded(F.col("t"), known).alias("grounded"), T.leaks(F.col("t"), forbidden).alias("leaks"), F.array_join(tags, ", ").alias("tags"))


@_query("""SELECT o_orderkey, 'x = ' || CAST(o_custkey AS VARCHAR) || chr(10) || 'y = 1' || chr(10) AS code, '{"k": ' || CAST(o_orderkey AS VARCHAR) || '}' AS object FROM orders""")
def answers_to_code(spark, sf_dir):
    """SF22, SF23: the longest code block of an answer without checker comments, and its first JSON object."""
    orders = _t(spark, sf_dir, "orders")
    code = F.concat(F.lit("x = "), F.col("o_custkey").cast("string"), F.lit("  # type: ignore[x]\ny = 1\n"))
    answer = F.concat(F.lit("Try {this:\n```\nz\n```\nor\n```python\n"), code, F.lit("```\nwith {\"k\": "), F.col("o_orderkey").cast("string"), F.lit("} set."))
    rows = orders.select("o_orderkey", answer.alias("a"))
    return rows.select("o_orderkey", T.without_control_comments(T.longest_code(F.col("a"))).alias("code"), T.first_json_object(F.col("a")).alias("object"))


@_query("""SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN 'https://x.org/log' WHEN o_orderkey % 3 = 1 THEN 'https://x.org/news' ELSE 'https://github.com/o' || CAST(o_custkey AS VARCHAR) || '/r/releases' END AS link, 'https://host/' || CAST(o_custkey AS VARCHAR) AS bare FROM orders""")
def project_links(spark, sf_dir):
    """SF28, SF33: the link to the changes of a project, and links without credentials."""
    key = F.col("o_orderkey") % 3
    repository = F.concat(F.lit("https://github.com/o"), F.col("o_custkey").cast("string"), F.lit("/r"))
    urls = F.when(key == 0, F.create_map(F.lit("News"), F.lit("https://x.org/news"), F.lit("Change-Log"), F.lit("https://x.org/log")))
    urls = urls.when(key == 1, F.create_map(F.lit("Source"), repository, F.lit("News"), F.lit("https://x.org/news"))).otherwise(F.create_map(F.lit("Funding"), F.lit("https://github.com/sponsors/x"), F.lit("Home Page"), repository))
    bare = S.without_credentials(F.concat(F.lit("https://user:secret@host/"), F.col("o_custkey").cast("string")))
    return _t(spark, sf_dir, "orders").select("o_orderkey", T.changelog_link(urls).alias("link"), bare.alias("bare"))


@_query("""SELECT p_partkey, 'import' || CAST(p_size % 3 AS VARCHAR) || ',lib.sub' AS modules FROM part""")
def imports_of_fragments(spark, sf_dir):
    """SF35: modules that a fragment imports."""
    code = F.concat(F.lit("from lib.sub import x\nimport import"), (F.col("p_size") % 3).cast("string"), F.lit(" as y\nif ("))
    return _t(spark, sf_dir, "part").select("p_partkey", F.array_join(T.imported_modules(code), ",").alias("modules"))


@_query("""SELECT p_partkey, 'lib.core' AS module, p_size % 2 = 0 AS private, p_size % 3 = 0 AS beta, true AS same, 'get,part,' || CAST(p_size AS VARCHAR) AS words, CASE WHEN p_size % 4 = 0 THEN 'a.b,c.d' ELSE 'a.b' END AS paths, 'Client' AS owner FROM part""")
def names_and_paths(spark, sf_dir):
    """SF6, SF7, SF9, SF11, SF34, PF3, SO7: derived names, private and beta segments, words and paths."""
    size = F.col("p_size")
    path = F.concat(F.lit("lib."), F.when(size % 2 == 0, "_x.").otherwise("x."), F.when(size % 3 == 0, "v2beta1.").otherwise(""), F.lit("f"))
    words = S.name_words(F.concat(F.lit("getPart_"), size.cast("string")))
    also = F.when(size % 4 == 0, F.array(F.lit("c.d"), F.lit("a.b")))
    return _t(spark, sf_dir, "part").select(
        "p_partkey", S.module_of(F.lit("lib.core.C.m"), F.lit(True)).alias("module"), S.is_private(path).alias("private"), S.has_beta_segment(path).alias("beta"), S.same_spelling(F.lit("getPart"), F.lit("get_part")).alias("same"),
        F.array_join(words, ",").alias("words"), F.array_join(S.all_paths(F.lit("a.b"), also, F.lit(None).cast("array<string>")), ",").alias("paths"), S.plain_owner(F.lit("AsyncClientWithRawResponse")).alias("owner"),
    )


@_query("""SELECT p_partkey, p_size % 3 <> 2 AS applies FROM part""")
def markers_that_apply(spark, sf_dir):
    """PF9: environment markers on the platforms tried."""
    size = F.col("p_size") % 3
    marker = F.when(size == 0, "python_version >= '3.9' and sys_platform == 'darwin'").when(size == 1, "platform_machine == 'AMD64' or os_name == 'java'").otherwise("platform_machine == 'aarch64'")
    return _t(spark, sf_dir, "part").select("p_partkey", markers.marker_applies(marker, "3.12").alias("applies"))


@_query("""SELECT '::warning file=' || event_type || ',line=' || CAST(event_id AS VARCHAR) || ',title=100%25 sure::it is' || chr(37) || '0A' || CAST(user_id AS VARCHAR) AS line FROM events""")
def annotation_lines(spark, sf_dir):
    """SC26: lines for a CI service."""
    rows = _t(spark, sf_dir, "events").select(F.col("event_type").alias("file"), F.col("event_id").alias("line"), F.lit("100% sure").alias("title"), F.concat(F.lit("it is\n"), F.col("user_id").cast("string")).alias("message"))
    return files.annotations(rows)


@_query("""SELECT CAST(o_custkey AS VARCHAR) AS who, o_orderstatus AS status, o_totalprice AS total FROM orders""")
def flat_runs(spark, sf_dir):
    """SC27: nested records as flat columns."""
    rows = _t(spark, sf_dir, "orders").select(F.struct(F.col("o_custkey").alias("id"), F.struct(F.col("o_orderstatus").alias("s")).alias("in")).alias("run"), "o_totalprice")
    return environments.flatten_runs(rows, {"who": F.col("run.id").cast("string"), "status": "run.in.s", "total": "o_totalprice"})


@_query("""SELECT user_id AS run_id, event_id AS attempt, event_type FROM events WHERE value > 10 AND event_type <> 'error' QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id) = 1""")
def valid_runs(spark, sf_dir):
    """SC22, WN9: the first valid attempt of each run that is no pilot."""
    rows = _t(spark, sf_dir, "events").select(F.col("user_id").alias("run_id"), F.col("event_id").alias("attempt"), "event_type", (F.col("value") > 10).alias("valid"), F.when(F.col("event_type") == "error", True).alias("pilot"))
    return files.valid_runs(rows).select("run_id", "attempt", "event_type")


@_query("""WITH n AS (SELECT p_brand AS package, 'x.' || CAST(p_size % 10 AS VARCHAR) AS api, min(p_partkey) AS k FROM part GROUP BY 1, 2), b AS (SELECT package, chr(96) || api || chr(96) || ' was removed.' AS bullet, k, api FROM n)
SELECT package, '1' AS old_version, '2' AS new_version, CAST(row_number() OVER (PARTITION BY package ORDER BY k, api) - 1 AS INTEGER) AS ordinal, bullet FROM b""")
def notes_there_and_back(spark, sf_dir):
    """SF18, SC25, SC28, UD9: notes written as Markdown and read back."""
    api = F.concat(F.lit("x."), (F.col("p_size") % 10).cast("string"))
    rows = _t(spark, sf_dir, "part").groupBy(F.col("p_brand").alias("package"), api.alias("path")).agg((-F.min("p_partkey")).cast("double").alias("score"))
    none = F.lit(None).cast("string")
    rows = rows.withColumns({"kind": F.lit("removed"), "parameter": none, "moved_to": none, "deprecation": none, "name": F.col("path"), "old_kind": none, "new_kind": none, "old_signature": none, "suggestions": F.array().cast("array<string>")})
    versions = rows.select("package", F.lit("1").alias("old_version"), F.lit("2").alias("new_version")).distinct()
    pages = notes.markdown(notes.api_notes(rows, versions))
    marked = pages.select(F.col("package").alias("file"), F.concat(F.lit("a\n<!-- notes:start -->\n"), F.col("text"), F.lit("\n<!-- notes:end -->\nb")).alias("value"))
    return registry.blocks_in(marked).drop("file")


@_query("""SELECT 'lines ' || CAST(o_custkey AS VARCHAR) || chr(10) || CASE WHEN o_custkey % 2 = 0 THEN '' ELSE chr(10) END || '<!-- notes:start -->' || chr(10) || 'new' || chr(10) || '<!-- notes:end -->' || CASE WHEN o_custkey % 2 = 0 THEN ' tail' ELSE chr(10) END AS text, o_custkey FROM (SELECT DISTINCT o_custkey FROM orders)""")
def spliced_blocks(spark, sf_dir):
    """IN3: a marked block replaced, or put at the end; twice is once."""
    rows = _t(spark, sf_dir, "orders").select("o_custkey").distinct()
    head = F.concat(F.lit("lines "), F.col("o_custkey").cast("string"), F.lit("\n"))
    text = F.when(F.col("o_custkey") % 2 == 0, F.concat(head, F.lit("<!-- notes:start -->\nold\n<!-- notes:end --> tail"))).otherwise(head)
    return rows.select(T.splice(T.splice(text, F.lit("new")), F.lit("new")).alias("text"), "o_custkey")


@_query("""SELECT o_custkey FROM (SELECT o_custkey, max(o_orderdate) AS d FROM orders GROUP BY 1) WHERE d < TIMESTAMP '1999-01-01'""")
def stale_results(spark, sf_dir):
    """IN6: results whose inputs are older than a day."""
    newest = _t(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.max("o_orderdate").alias("d"))
    return incremental.stale(newest, "d", F.lit("1999-01-01").cast("timestamp")).select("o_custkey")


@_query("""WITH f AS (SELECT o_custkey AS k, max(o_orderkey) AS v FROM orders WHERE o_orderstatus = 'O' GROUP BY 1), s AS (SELECT o_custkey AS k, o_orderkey AS v, o_orderdate AS day FROM orders WHERE o_orderstatus <> 'O' QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) = 1)
SELECT k, v, false AS stale FROM f UNION ALL SELECT k, v, day < TIMESTAMP '1998-01-01' FROM s WHERE k NOT IN (SELECT k FROM f)""")
def documents_with_fallback(spark, sf_dir):
    """SC1, SC19: fresh documents, else stored ones with whether they are too old."""
    from datetime import datetime

    orders = _t(spark, sf_dir, "orders")
    fresh = orders.where("o_orderstatus = 'O'").groupBy(F.col("o_custkey").alias("k")).agg(F.max("o_orderkey").alias("v"), F.max("o_orderdate").alias("at"))
    stored = ranking.best_per_key(orders.where("o_orderstatus <> 'O'"), ["o_custkey"], [F.desc("o_orderdate"), F.desc("o_orderkey")]).select(F.col("o_custkey").alias("k"), F.col("o_orderkey").alias("v"), F.col("o_orderdate").alias("at"))
    return registry.with_fallback(fresh, stored, ["k"], max_age_hours=24.0, now=datetime(1998, 1, 2)).select("k", "v", "stale")


@_query("""SELECT DISTINCT p_size, CASE WHEN p_size % 10 <> 0 THEN CAST(p_size * p_size AS VARCHAR) END AS value, CASE WHEN p_size % 10 = 0 THEN 'ValueError: ten' END AS error FROM part""")
def called_once_each(spark, sf_dir):
    """SC29, UD1, UD5, UD7: a user function once for each input, its failures as values."""

    def square(n: int) -> str:
        if n % 10 == 0:
            raise ValueError("ten")
        return str(n * n)

    return calls.call_each(_t(spark, sf_dir, "part"), ["p_size"], square)


@_query("""SELECT event_id, CASE WHEN value < 5 THEN 'invalid' WHEN event_type = 'view' THEN 'off-task' WHEN user_id % 4 = 0 AND user_id % 8 = 0 THEN 'stale' WHEN user_id % 4 = 0 THEN 'wrong' WHEN user_id % 5 = 0 THEN 'deprecated' WHEN value > 90 THEN 'untouched' ELSE 'pass' END AS outcome FROM events""")
def answer_outcomes(spark, sf_dir):
    """UD8: the label of each answer."""
    v, u = F.col("value"), F.col("user_id")
    label = experiments.outcome(v < 5, F.col("event_type") == "view", (u % 4 == 0).cast("int"), (u % 8 == 0).cast("int"), (u % 5 == 0).cast("int"), v <= 90)
    return _t(spark, sf_dir, "events").select("event_id", label.alias("outcome"))


@_query("""WITH d AS (SELECT l_orderkey AS snippet, l_linenumber AS line, l_suppkey % 4 AS c, l_returnflag AS rule FROM lineitem)
SELECT snippet, line, CAST(c AS INTEGER) AS "column", rule FROM d WHERE rule = 'R' AND NOT EXISTS (SELECT 1 FROM d o WHERE o.snippet = d.snippet AND o.line = d.line AND o.c = d.c AND o.rule = 'A')""")
def diagnostics_at_a_place(spark, sf_dir):
    """PF10: diagnostics of a rule without another at the same place."""
    rows = _t(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("snippet"), F.col("l_linenumber").alias("line"), (F.col("l_suppkey") % 4).cast("int").alias("column"), F.col("l_returnflag").alias("rule"))
    return calls.first_at_place(rows, ["R"], ["A"])


@_query("""SELECT kind, count(*) AS n, count(*) FILTER (WHERE kind = 'deprecated') AS soft FROM (SELECT CASE WHEN p_size % 3 = 0 AND p_size % 2 = 0 THEN 'deprecated' ELSE 'removed' END AS kind FROM part WHERE NOT (p_size % 3 = 0 AND p_size % 2 = 1)) GROUP BY 1""")
def served_removals(spark, sf_dir):
    """PF17: removals that the module still hands out are deprecations if it warns, else none."""
    rows = _t(spark, sf_dir, "part").select(F.lit("p").alias("package"), F.concat(F.lit("p.m.f"), F.col("p_partkey").cast("string")).alias("path"), F.lit("removed").alias("kind"), "p_size", "p_partkey")
    served = rows.where("p_size % 3 = 0").select("package", F.lit("p.m").alias("module"), F.concat(F.lit("f"), F.col("p_partkey").cast("string")).alias("name"), (F.col("p_size") % 2 == 0).alias("warns"))
    out = changes.reclassify_served(rows, served)
    return out.groupBy("kind").agg(F.count("*").alias("n"), F.count_if(F.col("kind") == "deprecated").alias("soft"))


@_query("""SELECT c.p_partkey, string_agg(DISTINCT 'p.' || lower(o.p_type) || '.g' || CAST(o.p_size AS VARCHAR), ',') AS replacements FROM part c JOIN (SELECT DISTINCT p_size, min(p_type) OVER (PARTITION BY p_size) AS p_type FROM part) o ON o.p_size = c.p_size % 20 GROUP BY 1""")
def named_replacements(spark, sf_dir):
    """SF38: public objects that a deprecation names."""
    parts = _t(spark, sf_dir, "part")
    text = F.concat(F.lit("Use `g"), (F.col("p_size") % 20).cast("string"), F.lit("` instead."))
    rows = parts.select("p_partkey", F.lit("p").alias("package"), F.concat(F.lit("p.f"), F.col("p_partkey").cast("string")).alias("path"), F.lit("deprecated").alias("kind"), F.lit("").alias("parameter"), text.alias("deprecation"))
    first = parts.groupBy("p_size").agg(F.min("p_type").alias("t"))
    name = F.concat(F.lit("g"), F.col("p_size").cast("string"))
    objects = first.select(F.lit("p").alias("package"), F.concat(F.lit("p."), F.lower("t"), F.lit("."), name).alias("path"), name.alias("name"), F.lit(True).alias("is_public"))
    out = changes.replacements(rows, objects, ["package", "path", "kind", "parameter", "p_partkey"])
    return out.select("p_partkey", F.array_join("replacements", ",").alias("replacements"))


@_query("""SELECT s_nationkey, round(corr(s_suppkey, s_acctbal), 9) AS r, count(*) AS n FROM supplier GROUP BY 1 HAVING count(*) > 2""")
def pearson_by_nation(spark, sf_dir):
    """ST14: correlations by key."""
    return st.pearson(_t(spark, sf_dir, "supplier"), ["s_nationkey"], "s_suppkey", "s_acctbal").where("n > 2").select("s_nationkey", F.round("r", 9).alias("r"), "n")


@_query("""WITH v AS (SELECT s_suppkey, s_nationkey < 12 AS a, s_acctbal > 4500 AS hit FROM supplier), r AS (SELECT *, row_number() OVER (PARTITION BY a ORDER BY s_suppkey) - 1 AS i, count(*) OVER (PARTITION BY a) AS n FROM v),
d AS (SELECT a, i AS place, n, unnest(range(1, 101)) AS s FROM r), p AS (SELECT d.a, s, avg(CAST(hit AS INTEGER)) AS m FROM d JOIN r ON r.a = d.a AND r.i = CAST('0x' || substr(md5('0:' || CAST(s AS VARCHAR) || ':' || CAST(place AS VARCHAR)), 1, 8) AS BIGINT) % d.n GROUP BY 1, 2),
g AS (SELECT s, sum(CASE WHEN a THEN m ELSE -m END) AS gap FROM p GROUP BY 1), o AS (SELECT avg(CAST(hit AS INTEGER)) FILTER (WHERE a) - avg(CAST(hit AS INTEGER)) FILTER (WHERE NOT a) AS gap FROM v)
SELECT round(o.gap, 9) AS gap, round(quantile_cont(g.gap, 0.025), 9) AS low, round(quantile_cont(g.gap, 0.975), 9) AS high FROM g, o GROUP BY o.gap""")
def strata_difference(spark, sf_dir):
    """ST12: the difference of two strata, each resampled on its own."""
    out = st.strata_difference(_t(spark, sf_dir, "supplier"), [], F.col("s_nationkey") < 12, (F.col("s_acctbal") > 4500).cast("int"), "s_suppkey", 100)
    return out.select(*[F.round(c, 9).alias(c) for c in ("gap", "low", "high")])


@_query("""SELECT l_returnflag, part, treated, control, treated - control AS change, round((treated - control) / CAST(sum(treated - control) OVER (PARTITION BY l_returnflag) AS DOUBLE), 9) AS share FROM (
SELECT l_returnflag, 'quantity' AS part, CAST(sum(CAST(l_quantity AS BIGINT)) FILTER (WHERE l_linestatus = 'O') AS BIGINT) AS treated, CAST(sum(CAST(l_quantity AS BIGINT)) FILTER (WHERE l_linestatus = 'F') AS BIGINT) AS control FROM lineitem GROUP BY 1
UNION ALL SELECT l_returnflag, 'lines', CAST(sum(l_linenumber) FILTER (WHERE l_linestatus = 'O') AS BIGINT), CAST(sum(l_linenumber) FILTER (WHERE l_linestatus = 'F') AS BIGINT) FROM lineitem GROUP BY 1)""")
def arm_decomposition(spark, sf_dir):
    """AG25: parts of the difference between two arms."""
    rows = _t(spark, sf_dir, "lineitem").withColumns({"quantity": F.col("l_quantity").cast("long"), "lines": F.col("l_linenumber").cast("long")})
    out = grouping.decomposition(rows, ["l_returnflag"], ["quantity", "lines"], F.col("l_linestatus"), "O", "F")
    return out.withColumn("share", F.round("share", 9))


@_query("""SELECT event_type, count(*) AS n, count(*) FILTER (WHERE value > 60) AS hits, count(*) FILTER (WHERE value > 60) / count(*) AS share FROM events WHERE user_id % 3 = 0 GROUP BY 1""")
def recall_under_filter(spark, sf_dir):
    """AG24: recall among some rows."""
    return grouping.recall(_t(spark, sf_dir, "events"), ["event_type"], F.col("value") > 60, F.col("user_id") % 3 == 0).select("event_type", "n", "hits", "share")


@_query("""SELECT p_name AS name, max(p_size) AS stars FROM part GROUP BY 1 ORDER BY stars DESC, name LIMIT 10""")
def most_starred_names(spark, sf_dir):
    """SL13: the ten names with most stars (the ten are the operator's)."""
    return release_diff.most_starred(_t(spark, sf_dir, "part").select(F.col("p_name").alias("name"), F.col("p_size").alias("stars")), 10)


@_query("""SELECT CAST(row_number() OVER (ORDER BY changed DESC, imported DESC, breaking DESC, deprecated DESC, name) AS INTEGER) AS place, name FROM (SELECT p_brand AS name, bool_or(p_size > 48) AS changed, bool_or(p_type = 'SMALL') AS imported, count(*) FILTER (WHERE p_size < 10) AS breaking, count(*) FILTER (WHERE p_size > 30) AS deprecated FROM part GROUP BY 1)""")
def package_places(spark, sf_dir):
    """SL4: the order in which a scan lists packages."""
    size = F.col("p_size")
    rows = _t(spark, sf_dir, "part").groupBy(F.col("p_brand").alias("name")).agg(F.bool_or(size > 48).alias("changed"), F.bool_or(F.col("p_type") == "SMALL").alias("imported"), F.count_if(size < 10).alias("breaking"), F.count_if(size > 30).alias("deprecated"))
    order = [F.desc("changed"), F.desc("imported"), F.desc("breaking"), F.desc("deprecated"), F.asc("name")]
    return release_diff.package_order(rows).select(F.row_number().over(ranking.Window.orderBy(*order)).alias("place"), "name")


@_query("""SELECT o_orderkey, false AS bad, o_orderstatus AS role, CAST(floor(o_totalprice) AS BIGINT) AS tokens FROM orders WHERE o_orderkey % 5 <> 0 UNION ALL SELECT o_orderkey, true, NULL, NULL FROM orders WHERE o_orderkey % 5 = 0""")
def transcript_lines(spark, sf_dir):
    """SC23: records of transcript lines, some of which are no JSON."""
    text = F.to_json(F.struct(F.col("o_orderstatus").alias("role"), F.floor("o_totalprice").alias("tokens"), F.lit("x").alias("other")))
    key = F.col("o_orderkey")
    lines = _t(spark, sf_dir, "orders").select(key.cast("string").alias("file"), F.lit(0).alias("line"), F.when(key % 5 == 0, F.substring(text, 1, 12)).otherwise(text).alias("value"))
    out = records.transcript_records(lines, "role string, tokens long")
    return out.select(F.col("file").cast("long").alias("o_orderkey"), "bad", "role", "tokens")


@_query("""SELECT p_brand AS package, max(p_size) AS best, count(*) FILTER (WHERE p_size > 20) AS n, CAST(min(p_partkey) FILTER (WHERE p_size > 20) AS VARCHAR) AS low FROM part GROUP BY 1""")
def result_documents(spark, sf_dir):
    """SC24, PF14: nested result documents, read back."""
    parts = _t(spark, sf_dir, "part")
    packages = parts.groupBy(F.col("p_brand").alias("package")).agg(F.max("p_size").alias("best"), F.max("p_partkey").alias("_private"))
    rows = parts.where("p_size > 20").select(F.col("p_brand").alias("package"), F.col("p_partkey").cast("string").alias("path"), F.col("p_size").cast("double").alias("score"))
    docs = records.result_documents(packages, rows)
    back = docs.select("package", F.from_json("document", "best int, changes array<struct<path:string,score:double>>, _private int").alias("d"))
    return back.where("d._private is null").select("package", "d.best", F.size("d.changes").cast("long").alias("n"), F.array_min(F.transform("d.changes", lambda c: c["path"].cast("long"))).cast("string").alias("low"))


@_query("""WITH p AS (SELECT c_custkey AS id, c_custkey % 3 = 0 AS before, c_custkey % 4 <> 0 AS after FROM customer WHERE c_custkey <= 120) SELECT count(*) AS pairs, count(*) FILTER (WHERE before) AS before, count(*) FILTER (WHERE after) AS after, count(*) FILTER (WHERE NOT before AND after) AS fixed, count(*) FILTER (WHERE before AND NOT after) AS broken FROM p""")
def experiment_run(spark, sf_dir):
    """UD10: sample, ask, label, pair and aggregate, with a stand-in for the model."""
    none = F.lit(None).cast("string")
    key = F.col("c_custkey")
    rows = _t(spark, sf_dir, "customer").where(key <= 120).select(
        key.cast("string").alias("change_id"), F.lit("p").alias("package"), none.alias("owner"), F.concat(F.lit("f"), key.cast("string")).alias("name"), none.alias("path"), none.alias("old_signature"), none.alias("old_doc"), F.lit("use g").alias("note"),
    )
    known = spark.createDataFrame([], "key string, answer string")

    def model(system: str, user: str) -> str:
        n = int(user.split("`f")[1].split("`")[0])
        good = n % 4 != 0 if system else n % 3 == 0
        return f"```\n{'new' if good else 'old'}()\n```"

    def judge(change_id: str, code: str) -> str:
        return "pass" if code.startswith("new") else "stale"

    out = experiment.run(rows, known, model, judge, {"plain": None, "notes": "Notes:"}, "notes", most=1000, resamples=50)
    return out.select("pairs", "before", "after", "fixed", "broken")
