"""Filters, joins and orders over API changes, class hierarchies and the code that uses them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.text import code_names, named_replacement

from .graph import closure
from .matching import semi_anti
from .ranking import best_per_key

#: A static match can't tell whether a call passes these the right way.
NEVER_OLD = ("param_required", "param_keyword_only", "param_positional_only")


def probeable(changes: DataFrame) -> DataFrame:
    """PF5: changes that no decorator of the library marks and that are no dependency switch."""
    return changes.where((F.coalesce("deprecated_by", F.lit("")) == "") & (F.col("kind") != "dependency_switched"))


def annotation_of(signature: Column, parameter: Column) -> Column:
    """The annotation of ``parameter`` in the text of a signature; null without one."""
    bare = F.ltrim(parameter, F.lit("*"))
    found = F.regexp_substr(signature, F.concat(F.lit(r"(?<![\w.])"), bare, F.lit(r"\s*:\s*[^,=)]+")))
    return F.trim(F.regexp_replace(found, r"^[^:]*:", ""))


def worth_a_note(changes: DataFrame) -> DataFrame:
    """PF6: without fields of params classes that mirror a parameter a callable of the package
    lost, and without changes to parameters whose type is private to the library."""
    lost = changes.where("kind = 'param_removed'").select("package", F.col("parameter").alias("name"))
    rows = semi_anti(changes, lost, ["package", "name"], "_lost")
    mirror = F.col("_lost") & F.col("parameter").isNull() & F.col("owner").rlike(r"Params\w*$")
    signature = F.when(F.col("kind").isin(*NEVER_OLD), F.col("new_signature")).otherwise(F.col("old_signature"))
    private = annotation_of(signature, F.col("parameter")).rlike(r"(^|[^\w])_[A-Za-z]")
    return rows.where(~F.coalesce(mirror, F.lit(False)) & ~F.coalesce(private, F.lit(False))).drop("_lost")


def by_tier(changes: DataFrame, tiers: Sequence[str] = ("public", "internal")) -> list[DataFrame]:
    """PF7: one frame for each tier; a null tier is the first.  Filters alone: the order stays."""
    tier = F.coalesce("tier", F.lit(tiers[0]))
    return [changes.where(tier == t) for t in tiers]


def use_form(kind: Column, parameter: Column, names: Column) -> Column:
    """SF36: "old" where code uses what went, with the parameter if the change has one; else "uses".

    ``names`` are the names of the change that the code uses, the callable first."""
    switched = F.exists(F.slice(names, 2, 1 << 30), lambda n: n.contains("(") | n.startswith("except "))
    old = F.when(kind == "dependency_switched", switched).when(kind.isin(*NEVER_OLD) | (F.size(names) == 0), False)
    old = old.when(parameter.isNotNull(), F.size(names) == 2).otherwise(True)
    return F.when(old, "old").otherwise("uses")


def used_apis(uses: DataFrame) -> DataFrame:
    """WN10: one row for each API that is used (package, api, match, old, packages_first), in order.

    ``uses`` has package, ordinal (of the package), api, position (of the API), how and form.
    ``match`` is the best of path, name and name_only; packages with an old form come first,
    then APIs matched by more than a name, then old forms."""
    tier = F.when(F.col("how") == "path", 0).when(F.col("how") == "name", 1).otherwise(2)
    one = uses.groupBy("package", "ordinal", "api", "position").agg(F.min(tier).alias("_t"), F.max((F.col("form") == "old").cast("int")).alias("old"))
    package = Window.partitionBy("package")
    one = one.withColumns({"packages_first": F.max("old").over(package), "match": F.element_at(F.array(F.lit("path"), F.lit("name"), F.lit("name_only")), F.col("_t") + 1)})
    return one.orderBy(F.desc("packages_first"), "ordinal", F.col("_t") == 2, F.desc("old"), "position").drop("_t")


def canonical_order(changes: DataFrame, priority: Column) -> DataFrame:
    """SL6: the changes of an API by kind, place of the parameter in its signature, name and path."""
    signature = F.when(F.col("kind") == "param_required", F.col("new_signature")).otherwise(F.col("old_signature"))
    inside = F.regexp_replace(F.regexp_extract(F.coalesce(signature, F.lit("")), r"\((.*)\)", 1), r"\[[^\]]*\]", "")
    names = F.transform(F.split(inside, ","), lambda p: F.regexp_extract(p, r"^\s*\*{0,2}(\w*)", 1))
    at = F.array_position(names, F.ltrim(F.coalesce("parameter", F.lit("")), F.lit("*")))
    return changes.orderBy(priority, at == 0, at, F.coalesce("parameter", F.lit("")), "path")


def inherited_members(classes: DataFrame, bases: DataFrame, members: DataFrame) -> DataFrame:
    """JN9: (class, name, origin): members that a class has from an ancestor and not of its own.

    ``classes`` (class), ``bases`` (class, base, place), ``members`` (class, name).  Of several
    ancestors with the name the nearest counts, then the first listed base."""
    up = closure(bases.select("class", "base"), "class", "base")
    have = members.select(F.col("class").alias("ancestor"), "name")
    first = bases.groupBy(F.col("class").alias("node"), F.col("base").alias("ancestor")).agg(F.min("place").alias("place"))
    found = up.join(classes.select(F.col("class").alias("node")), "node", "left_semi").join(first, ["node", "ancestor"], "left").join(have, "ancestor")
    own = members.select(F.col("class").alias("node"), "name")
    found = found.join(own, ["node", "name"], "left_anti")
    best = best_per_key(found, ["node", "name"], ["depth", F.asc_nulls_last("place"), "ancestor"])
    return best.select(F.col("node").alias("class"), "name", F.col("ancestor").alias("origin"))


def fold_inherited(lost: DataFrame) -> DataFrame:
    """AG14: one row for each (origin, name): the origin itself if it lost the member too, else the
    shortest class, with the number of classes and the next five.  ``lost`` has class, name, origin."""
    own = (F.col("class") == F.col("origin")).cast("int")
    place = F.struct((1 - own).alias("_o"), F.length("class").alias("_l"), F.col("class").alias("path"))
    rows = lost.groupBy("origin", "name").agg(F.array_sort(F.collect_set(place)).alias("_p"))
    paths = F.transform("_p", lambda p: p["path"])
    return rows.select("origin", "name", F.element_at(paths, 1).alias("path"), F.size("_p").alias("occurrences"), F.slice(paths, 2, 5).alias("also"))


def unresolved_ancestor(bases: DataFrame, known: DataFrame) -> DataFrame:
    """REC6: every class with whether some class above it isn't among ``known`` (class)."""
    up = closure(bases, "class", "base").select(F.col("node").alias("class"), "ancestor")
    flagged = semi_anti(up, known.select(F.col("class").alias("ancestor")), ["ancestor"], "_known")
    return flagged.groupBy("class").agg(F.bool_or(~F.col("_known")).alias("unresolved"))


def by_suffix(changes: DataFrame, paths: DataFrame, owner_first: bool = True) -> DataFrame:
    """JN6: changes and the paths of code in the same root that end in the change's class or name.

    Both sides meet on (root, last segment).  A path with a beta segment fits only a change with
    one, and the reverse."""
    last = lambda c: F.element_at(F.split(c, "[.]"), -1)
    root = lambda c: F.substring_index(c, ".", 1)
    beta = lambda c: F.exists(F.split(c, "[.]"), lambda s: s.rlike(r"^(?:v\d+)?beta\d*$"))
    name = F.coalesce("owner", "name") if owner_first else F.col("name")
    left = changes.withColumns({"_root": root("path"), "_last": name, "_beta": beta("path")})
    right = paths.select(F.col("used"), *[c for c in paths.columns if c != "used"]).withColumns({"_root": root("used"), "_last": last("used"), "_beta": beta("used")})
    return left.join(right, ["_root", "_last", "_beta"]).drop("_root", "_last", "_beta")


def passed_on(calls: DataFrame, switched: DataFrame) -> DataFrame:
    """JN7: calls that hand a value to a switched parameter, by keyword or by position.

    ``calls`` (file, callee, keyword, position), ``switched`` (callee, parameter, position)."""
    wanted = switched.select("callee", "parameter", F.col("position").alias("_at"))
    by_keyword = calls.where("keyword is not null").join(wanted, (calls["callee"] == wanted["callee"]) & (F.col("keyword") == F.col("parameter")))
    by_place = calls.where("keyword is null").join(wanted, (calls["callee"] == wanted["callee"]) & (F.col("position") == F.col("_at")))
    rows = by_keyword.select("file", calls["callee"], "parameter").unionByName(by_place.select("file", calls["callee"], "parameter"))
    return rows.groupBy("file", "callee").agg(F.array_sort(F.collect_set("parameter")).alias("parameters"))


def reference_sites(sites: DataFrame) -> DataFrame:
    """AG15: API reference sites by (path, parameter, context) with their types and counts."""
    return sites.groupBy("path", "parameter", "context").agg(F.array_sort(F.collect_set("type")).alias("types"), F.count("*").alias("n"))


def switched_dependencies(old: DataFrame, new: DataFrame, dropped: DataFrame, added: DataFrame, last: str = "name") -> DataFrame:
    """JN13: (gone, fresh, sites, same_name) where sites of a dropped requirement name an added one now.

    ``old`` and ``new`` have path, parameter, context, root (the distribution) and ``last`` (the
    name there).  At least half the sites keep the name, and no new site names the dropped one."""
    key = ["path", "parameter", "context"]
    still = new.select(F.col("root").alias("gone")).distinct()
    was = old.join(dropped.select(F.col("root")), "root", "left_semi").select(*key, F.col("root").alias("gone"), F.col(last).alias("_was"))
    was = was.join(still, "gone", "left_anti")
    now = new.join(added.select(F.col("root")), "root", "left_semi").select(*key, F.col("root").alias("fresh"), F.col(last).alias("_now"))
    match = [F.col(f"w.{k}").eqNullSafe(F.col(f"n.{k}")) for k in key]
    both = was.alias("w").join(now.alias("n"), match)
    out = both.groupBy("gone", "fresh").agg(F.count("*").alias("sites"), F.count_if(F.col("_was") == F.col("_now")).alias("same_name"))
    return out.where("2 * same_name >= sites")


def unknown_keywords(passed: Column, accepted: Column) -> Column:
    """SO4, SO5: keywords passed that a signature doesn't take; a null set takes any."""
    return F.when(accepted.isNull(), F.array().cast("array<string>")).otherwise(F.array_sort(F.array_except(passed, accepted)))


def keep_checked(fresh: DataFrame, stored: DataFrame, keys: Sequence[str] = ("package", "api"), version: str = "version") -> DataFrame:
    """JN19: ``fresh`` notes, replaced by ``stored`` checked ones of the same API at the same version."""
    kept = stored.join(fresh.select(*keys, version).distinct(), [*keys, version], "left_semi")
    return kept.unionByName(fresh.join(kept.select(*keys), list(keys), "left_anti"))


def requirements_within(roots: DataFrame, requires: DataFrame, depth: int = 2, most: int = 40) -> DataFrame:
    """JN21: (root, name, level, place): what a root requires, breadth first, each name once.

    ``roots`` (root), ``requires`` (package, name, ordinal: its place in the list).  ``depth``
    and ``most``, the rows for each root, are the operator's limits; the first levels win, then
    the place of the parent, then the ordinal."""
    seen = roots.select("root", F.col("root").alias("name"), F.lit(0).alias("level"), F.lit(0).cast("long").alias("place"))
    for level in range(1, depth + 1):
        front = seen.where(F.col("level") == level - 1).select("root", F.col("name").alias("package"), F.col("place").alias("_parent"))
        met = front.join(requires, "package").join(seen.select("root", "name"), ["root", "name"], "left_anti")
        first = best_per_key(met, ["root", "name"], ["_parent", "ordinal", "package"])
        along = Window.partitionBy("root").orderBy("_parent", "ordinal", "package")
        before = seen.groupBy("root").agg(F.max("place").alias("_before"))
        fresh = first.withColumn("_n", F.row_number().over(along)).join(before, "root")
        seen = seen.unionByName(fresh.select("root", "name", F.lit(level).alias("level"), (F.col("_before") + F.col("_n")).alias("place")))
    return seen.where((F.col("level") > 0) & (F.col("place") <= most))


def shortest_paths(paths: DataFrame, keys: Sequence[str], path: str, most: int = 64) -> DataFrame:
    """WN5: the paths of each object, fewest segments first, ``most`` at most, with ``rank``."""
    along = Window.partitionBy(*keys).orderBy(F.size(F.split(path, "[.]")), path)
    return paths.withColumn("rank", F.row_number().over(along)).where(F.col("rank") <= most)


def pass_rates(attempts: DataFrame, keys: Sequence[str], outcome: str = "outcome") -> DataFrame:
    """AG26: n, passed and stale for each key, with their shares."""
    out = attempts.groupBy(*keys).agg(F.count("*").alias("n"), F.count_if(F.col(outcome) == "pass").alias("passed"), F.count_if(F.col(outcome) == "stale").alias("stale"))
    return out.withColumns({"pass_rate": F.col("passed") / F.col("n"), "stale_rate": F.col("stale") / F.col("n")})


def edited_not_listed(edits: DataFrame, header: DataFrame, keys: Sequence[str] = ("session",)) -> DataFrame:
    """JN22: for each session the APIs it edits that the header doesn't list."""
    asked = edits.groupBy(*keys).agg(F.collect_set("api").alias("_edited")).join(header.groupBy(*keys).agg(F.collect_set("api").alias("_listed")), list(keys), "left")
    return asked.select(*keys, F.array_sort(F.array_except("_edited", F.coalesce("_listed", F.array().cast("array<string>")))).alias("apis"))


def reclassify_served(changes: DataFrame, served: DataFrame) -> DataFrame:
    """PF17: removals of what the new release's module still hands out: deprecated if it warns, else gone.

    ``served`` is ``python_api.served_names`` of the new release."""
    one = served.groupBy("package", F.concat_ws(".", "module", "name").alias("path")).agg(F.bool_or("warns").alias("_warns"))
    rows = changes.join(one, ["package", "path"], "left")
    still = F.col("kind").isin("removed", "moved") & F.col("_warns").isNotNull()
    kind = F.when(F.coalesce(still, F.lit(False)), "deprecated").otherwise(F.col("kind"))
    return rows.where(~F.coalesce(still & ~F.col("_warns"), F.lit(False))).withColumn("kind", kind).drop("_warns")


def replacements(changes: DataFrame, objects: DataFrame, keys: Sequence[str] = ("package", "path", "kind", "parameter")) -> DataFrame:
    """SF38: ``keys`` and the public paths of the new release that a deprecation text names, one for each name.

    A name may be dotted; it fits a path that ends with it, and the shortest such path counts."""
    texts = changes.where("deprecation is not null").select(*keys, F.explode(F.array_distinct(F.concat(code_names(F.col("deprecation")), F.array_compact(F.array(named_replacement(F.col("deprecation"))))))).alias("said"))
    texts = texts.withColumns({"_last": F.element_at(F.split("said", "[.]"), -1), "_package": F.col("package"), "_own": F.col("path")})
    have = objects.where("is_public").select(F.col("package").alias("_package"), F.col("path").alias("_to"), F.col("name").alias("_last")).distinct()
    fits = (F.col("_to") == F.col("said")) | F.col("_to").endswith(F.concat(F.lit("."), F.col("said")))
    found = texts.join(have, ["_package", "_last"]).where(fits & (F.col("_to") != F.col("_own")))
    first = found.groupBy(*keys, "said").agg(F.min(F.struct(F.length("_to").alias("l"), F.col("_to").alias("to"))).alias("b"))
    return first.groupBy(*keys).agg(F.array_sort(F.collect_set("b.to")).alias("replacements"))


def still_read(changes: DataFrame, reads: DataFrame) -> DataFrame:
    """SF37: (package, path, parameter, reader, line): removed parameters whose name the new release still looks
    up, in the function itself, in what it calls or is decorated with, or in what those call; the first line.

    ``reads`` are ``python_api.parameter_reads`` of the new release."""
    lost = changes.where("kind = 'param_removed'").select("package", "path", F.regexp_replace("parameter", r"^[*]+", "").alias("parameter")).distinct()
    calls = reads.where("callee is not null").select("package", "function", "callee").distinct()
    keys = reads.where("key is not null").select("package", F.col("function").alias("reader"), F.col("key").alias("parameter"), "line")
    own = lost.select("package", "path", F.col("path").alias("reader")).distinct()
    near = own.join(calls.withColumnRenamed("function", "reader"), ["package", "reader"]).select("package", "path", F.col("callee").alias("reader"))
    far = near.join(calls.withColumnRenamed("function", "reader"), ["package", "reader"]).select("package", "path", F.col("callee").alias("reader"))
    reach = own.withColumn("_hops", F.lit(0)).unionByName(near.withColumn("_hops", F.lit(1))).unionByName(far.withColumn("_hops", F.lit(2)))
    found = lost.join(reach.distinct(), ["package", "path"]).join(keys, ["package", "reader", "parameter"])
    first = found.groupBy("package", "path", "parameter").agg(F.min(F.struct("_hops", "line", "reader")).alias("b"))
    return first.select("package", "path", "parameter", F.col("b.reader").alias("reader"), F.col("b.line").alias("line"))


def dropped_requirements(old: DataFrame, new: DataFrame) -> DataFrame:
    """SO1: (package, name, extra): requirements of the old release that the new one lacks, base ones (null extra)
    and those of extras that both releases have.

    ``old`` and ``new`` have package, name and extra.  What moved from an extra to the base isn't dropped."""
    base = lambda df: df.where("extra is null").select("package", "name").distinct()
    gone = base(old).join(base(new), ["package", "name"], "left_anti").withColumn("extra", F.lit(None).cast("string"))
    extras = lambda df: df.where("extra is not null").select("package", "extra", "name").distinct()
    common = extras(old).select("package", "extra").distinct().join(extras(new).select("package", "extra").distinct(), ["package", "extra"])
    optional = extras(old).join(common, ["package", "extra"]).join(extras(new), ["package", "extra", "name"], "left_anti").join(base(new), ["package", "name"], "left_anti")
    return gone.unionByName(optional.select("package", "name", "extra"))


def switches(old_sites: DataFrame, new_sites: DataFrame, old_requires: DataFrame, new_requires: DataFrame) -> DataFrame:
    """JN13: (package, gone, fresh, sites, same_name): requirements that a release dropped for an added one whose
    types stand where the old one's stood; rows for ``release_diff.diff``.

    Sites have package, path, parameter, context, root and name (``reference_roots``); requirements package and name."""
    lost = dropped_requirements(old_requires, new_requires).where("extra is null").select("package", F.col("name").alias("root"))
    added = dropped_requirements(new_requires, old_requires).where("extra is null").select("package", F.col("name").alias("root"))
    tag = lambda df: df.withColumn("root", F.concat_ws("|", "package", "root"))
    found = switched_dependencies(tag(old_sites), tag(new_sites), tag(lost).select("root").distinct(), tag(added).select("root").distinct())
    split = lambda c, i: F.element_at(F.split(c, "[|]"), i)
    return found.where(split("gone", 1) == split("fresh", 1)).select(split("gone", 1).alias("package"), split("gone", 2).alias("gone"), split("fresh", 2).alias("fresh"), "sites", "same_name")


def reference_roots(objects: DataFrame) -> DataFrame:
    """AG15, JN13: sites where a public API names another package's type: (package, path, parameter, context,
    root, name) for annotations of parameters and returns, and bases; ``root`` is the type's top module, ``name``
    its last name."""
    rows = objects.where("is_public and kind in ('class', 'function', 'attribute')")
    types = rows.select("package", "path", F.lit(None).cast("string").alias("parameter"), F.lit("return").alias("context"), F.explode("returns").alias("_t"))
    types = types.unionByName(rows.select("package", "path", F.lit(None).cast("string").alias("parameter"), F.lit("base").alias("context"), F.explode("bases").alias("_t")))
    given = rows.select("package", "path", F.explode("params").alias("_p")).select("package", "path", F.col("_p.name").alias("parameter"), F.lit("parameter").alias("context"), F.explode("_p.types").alias("_t"))
    types = types.unionByName(given)
    types = types.where("_t like '%.%'").withColumn("root", F.split("_t", "[.]")[0]).where(F.col("root") != F.split("path", "[.]")[0])
    return types.select("package", "path", "parameter", "context", "root", F.element_at(F.split("_t", "[.]"), -1).alias("name")).distinct()
