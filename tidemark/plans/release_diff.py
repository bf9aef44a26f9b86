"""From release histories and sources to ranked API changes, and to the code that uses them."""

from __future__ import annotations

import builtins
import importlib
import sys

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions import scalar as S
from tidemark.functions.versions import is_final, satisfies, version_key
from tidemark.operators import matching, ranking
from tidemark.operators.graph import closure
from tidemark.operators.lineage import cut
from tidemark.sources.python_api import expand_stars, public_paths

#: The weight of each kind of change, smaller first.
PRIORITY = {
    "dependency_switched": 0, "removed": 0, "moved": 0, "param_removed": 1, "param_required": 2, "kind_changed": 3, "deprecated": 4,
    "param_keyword_only": 5, "param_positional_only": 5,
}
#: Segments of paths that application code rarely imports, and names that say little.
INTERNAL_SEGMENTS = ("compat", "connectors", "dialects", "interchange", "internal", "internals", "mypy", "plugin", "plugins")
SIDE_SEGMENTS = ("cli", "commands", "test", "testing", "experimental")
NOISE_NAMES = ("__version__", "__all__", "version", "VERSION")
#: Names that are never API, decorators of test fixtures, modules whose import does something.
NEVER_API = ("TYPE_CHECKING",)
FIXTURES = ("pytest.fixture", "_pytest.fixtures.fixture", "pytest_asyncio.fixture")
NO_IMPORT = frozenset(["antigravity", "this", "idlelib", "turtle", "turtledemo", "tkinter", "__main__"])


def current_releases(releases: DataFrame, cutoffs: DataFrame, python: str | None = None) -> DataFrame:
    """``cutoffs`` (package, cutoff) with the version current then: not yanked, uploaded by that
    day, the highest final one, or the highest pre-release that is no dev version.

    A column ``specifier`` of ``cutoffs`` bounds the versions; ``python`` leaves out releases
    whose ``requires_python`` it doesn't meet."""
    final, dev = is_final(F.col("version")), F.lower("version").rlike(r"dev\d*$")
    able = releases.where(~F.col("yanked")).withColumns({"day": F.to_date("uploaded"), "final": final, "key": version_key(F.col("version"))})
    able = able.where(F.col("key").isNotNull() & (final | ~dev))
    if python and "requires_python" in releases.columns:
        able = able.where(satisfies(F.lit(python), F.col("requires_python")))
    bounded = "specifier" in cutoffs.columns
    if bounded:
        cutoffs = cutoffs.withColumn("specifier", F.coalesce("specifier", F.lit("")))
    holds = satisfies(F.col("version"), F.col("specifier")) if bounded else None
    out = matching.as_of(cutoffs, able, ["package"], "day", "cutoff", [F.desc("final"), F.desc("key")], given=["specifier"] if bounded else [], holds=holds)
    return out.drop("day", "final", "key", "uploaded", "yanked", "requires_python")


def _none(kind: str = "string") -> Column:
    return F.lit(None).cast(kind)


def lineage(objects: DataFrame, paths: DataFrame) -> DataFrame:
    """(package, path, ancestor, depth) of classes, bases followed through the package's aliases; ``paths``
    are the objects' ``public_paths``."""
    names = paths.select("package", F.col("public").alias("base"), F.col("canonical").alias("_c"))
    direct = objects.where("kind = 'class'").select("package", "path", F.explode("bases").alias("base"))
    direct = direct.join(names, ["package", "base"], "left").select(F.concat_ws("|", "package", "path").alias("a"), F.concat_ws("|", "package", F.coalesce("_c", "base")).alias("b")).distinct()
    up = closure(direct, "a", "b")
    part = lambda c, i: F.element_at(F.split(c, r"[|]"), i)
    return up.select(part("node", 1).alias("package"), part("node", 2).alias("path"), part("ancestor", 2).alias("ancestor"), "depth")


def with_inherited(objects: DataFrame, up: DataFrame) -> DataFrame:
    """``objects`` with a row for every public member that a public class has from an ancestor in its
    release and not of its own; ``origin`` is the path of the member where it is defined and ``up``
    the classes' ``lineage``."""
    own = objects.withColumn("origin", F.col("path"))
    classes = objects.where("kind = 'class' and is_public").select("package", "path")
    up = up.join(classes, ["package", "path"], "left_semi")
    members = objects.where("is_public and kind in ('function', 'attribute') and name <> '__init__'").withColumnRenamed("path", "origin").withColumnRenamed("parent", "ancestor")
    got = up.withColumnRenamed("path", "_class").join(members, ["package", "ancestor"])
    got = got.join(objects.select("package", F.col("parent").alias("_class"), "name"), ["package", "_class", "name"], "left_anti")
    got = ranking.best_per_key(got, ["package", "_class", "name"], ["depth", "ancestor"])
    got = got.withColumns({"path": F.concat_ws(".", "_class", "name"), "parent": F.col("_class")}).drop("_class", "ancestor", "depth")
    return own.unionByName(got.select(*own.columns))


def _outside_has(base: Column, name: Column) -> Column:
    """Whether a class of Python's own library has an attribute; null for other classes."""

    @F.pandas_udf("boolean")
    def has(bases: pd.Series, names: pd.Series) -> pd.Series:
        known: dict[str, object] = {}

        def look(path: str | None) -> object:
            if path is None:
                return None
            module, _, attribute = path.rpartition(".")
            if not module:
                return getattr(builtins, path, None)
            if module.split(".")[0] not in sys.stdlib_module_names or module.split(".")[0] in NO_IMPORT:
                return None
            try:
                return getattr(importlib.import_module(module), attribute, None)
            except Exception:  # noqa: BLE001 - a module of another platform
                return None

        out = []
        for path, name in zip(bases, names, strict=True):
            if path not in known:
                known[path] = look(path)
            out.append(hasattr(known[path], name) if isinstance(known[path], type) else None)
        return pd.Series(out, dtype="boolean")

    return has(base, name)


def suppressed(gone: DataFrame, old: DataFrame, new: DataFrame, up: DataFrame) -> DataFrame:
    """PF12: (package, path, suppressed_by) of missing objects that are no real removals.

    ``gone`` are rows of ``old``'s objects, ``up`` is the ``lineage`` of ``new``.  Reasons: ``never_api`` (bound below a check of ``__name__``, or
    a name that is none's API), ``sometimes`` (a value bound on some paths only and not listed),
    ``per_module`` (loggers, type variables), ``star`` (came with a star import for the module's own use),
    ``method`` (a function that the class of its first parameter now defines), ``attribute`` (the new class
    still names it on ``self``), ``outside_base`` (a base outside the package has it, or may: the method
    called the base's), ``listed`` (the new module lists it and binds names dynamically)."""
    key = ["package", "path"]
    parent = old.where("kind in ('class', 'module')").select("package", F.col("path").alias("parent"), F.col("kind").alias("_in"))
    rows = gone.join(parent, ["package", "parent"], "left")
    at_top = F.col("_in") == "module"
    reason = F.when((F.col("binding") == "main") | F.col("name").isin(*NEVER_API), "never_api")
    reason = reason.when(at_top & (F.col("kind") == "attribute") & (F.col("binding") == "sometimes") & ~F.coalesce("listed", F.lit(False)), "sometimes")
    reason = reason.when(at_top & (F.col("kind") == "attribute") & (F.col("value") == "per_module"), "per_module")
    plain = rows.select(*key, reason.alias("suppressed_by"))

    star = gone.where("kind = 'alias' and value = 'star' and not coalesce(listed, false)")
    star = star.join(old.where("kind = 'module'").select("package", F.col("path").alias("parent")), ["package", "parent"])
    inside = old.select("package", F.col("parent").alias("_p")).where("_p is not null").distinct()  # a package has modules below it
    packages = old.where("kind = 'module'").select("package", F.col("parent").alias("parent")).where("parent is not null").distinct()
    star = star.join(packages.join(inside, (F.col("parent") == F.col("_p")) & (packages["package"] == inside["package"]), "left_semi"), ["package", "parent"], "left_anti")
    by_star = star.select(*key, F.lit("star").alias("suppressed_by"))

    methods = new.where("kind = 'function'").join(new.where("kind = 'class'").select("package", F.col("path").alias("parent"), F.col("name").alias("_class")), ["package", "parent"])
    first = F.get("params", F.lit(0))["annotation"]
    loose = rows.where(at_top & (F.col("kind") == "function")).select(*key, "name", F.element_at(F.split(F.regexp_replace(first, "['\"]", ""), "[.]"), -1).alias("_class"))
    by_method = loose.join(methods.select("package", "name", "_class"), ["package", "name", "_class"], "left_semi").select(*key, F.lit("method").alias("suppressed_by"))

    members = rows.where(F.col("_in") == "class")
    now = new.where("kind = 'class'").select("package", F.col("path").alias("parent"), F.col("sets").alias("_sets"))
    with_class = members.join(now, ["package", "parent"])
    held = (F.col("kind") == "attribute") & F.array_contains("_sets", F.col("name"))
    by_attribute = with_class.where(held).select(*key, F.lit("attribute").alias("suppressed_by"))
    up = up.select("package", F.col("path").alias("parent"), F.col("ancestor").alias("_base"))
    outside = members.join(up, ["package", "parent"]).join(new.where("kind = 'class'").select("package", F.col("path").alias("_base")), ["package", "_base"], "left_anti")
    outside = outside.where(F.split("_base", "[.]")[0] != F.split("path", "[.]")[0]).withColumn("_has", _outside_has(F.col("_base"), F.col("name")))
    typing = F.col("_base").rlike(r"^(typing|typing_extensions)\.")
    may = F.col("_has") | (F.col("_has").isNull() & ~typing & F.coalesce("calls_super", F.lit(False)))
    by_base = outside.where(F.coalesce(may, F.lit(False))).select(*key, F.lit("outside_base").alias("suppressed_by"))

    lists = new.where("kind = 'module' and dynamic").select("package", F.col("path").alias("parent"))
    by_list = rows.where(at_top & F.coalesce("listed", F.lit(False))).join(lists, ["package", "parent"], "left_semi").select(*key, F.lit("listed").alias("suppressed_by"))
    every = plain.where("suppressed_by is not null")
    for more in (by_star, by_method, by_attribute, by_base, by_list):
        every = every.unionByName(more)
    return every.groupBy(*key).agg(F.min("suppressed_by").alias("suppressed_by"))


#: Columns of a change, as ``diff`` gives them.
CHANGE = (
    "package string, path string, name string, owner string, kind string, parameter string, moved_to string, deprecation string, origin string, "
    "suggestions array<string>, old_signature string, new_signature string, old_kind string, new_kind string, documented boolean"
)


def diff(old: DataFrame, new: DataFrame, switches: DataFrame | None = None) -> DataFrame:
    """``CHANGE`` rows between two releases' objects (``python_api.OBJECTS``), of nine kinds.

    removed, moved: objects, and members that classes had from an ancestor too (``origin`` tells where);
    what ``suppressed`` explains is left out.  param_removed, param_required, param_keyword_only,
    param_positional_only: see ``parameter_changes``.  kind_changed, deprecated: objects that stay.
    dependency_switched: rows of ``switches`` (package, gone, fresh), as ``changes.switched_dependencies``
    finds them."""
    old, new = expand_stars(old), expand_stars(new)
    old_paths, new_paths = cut(public_paths(old)), cut(public_paths(new))
    up = lineage(new, new_paths)
    was, now = cut(with_inherited(old, lineage(old, old_paths))), cut(with_inherited(new, up))
    owners = old.where("kind = 'class'").select("package", F.col("path").alias("parent"), F.col("name").alias("owner"))
    base = ["package", "path", "name", "parent"]

    gone = was.where("is_public and kind not in ('alias', 'star')").join(now.select("package", "path"), ["package", "path"], "left_anti")
    still = old_paths.join(new_paths.select("package", "public"), ["package", "public"]).select("package", F.col("canonical").alias("path"))
    gone = gone.join(still.distinct(), ["package", "path"], "left_anti")
    # members of a class that is another one now, under the same public path
    same = old_paths.join(new_paths.withColumnRenamed("canonical", "to"), ["package", "public"]).select("package", F.col("canonical").alias("parent"), "to").where("parent <> to").distinct()
    kept = gone.join(same, ["package", "parent"]).select("package", "path", F.concat_ws(".", "to", "name").alias("to")).join(now.select("package", F.col("path").alias("to")), ["package", "to"], "left_semi")
    gone = gone.join(kept.select("package", "path").distinct(), ["package", "path"], "left_anti")
    # an alias that went while what it named is still there, or is another package's
    lost_alias = was.where("is_public and kind = 'alias'").join(now.select("package", "path"), ["package", "path"], "left_anti")
    lost_alias = lost_alias.join(gone.select("package", F.col("path").alias("target")), ["package", "target"], "left_anti")
    gone = cut(gone.unionByName(lost_alias))
    gone = cut(gone.join(suppressed(gone, old, new, up), ["package", "path"], "left_anti"))
    top = gone.join(gone.select("package", F.col("path").alias("parent")), ["package", "parent"], "left_anti")

    moved = _moves(top, old, new, new_paths)
    removed = top.join(moved, ["package", "path"], "left")
    kind = F.when(F.col("moved_to").isNull(), "removed").otherwise("moved")
    out = removed.select(*base, kind.alias("kind"), _none().alias("parameter"), "moved_to", _none().alias("deprecation"), "origin", F.col("signature").alias("old_signature"), F.col("doc").isNotNull().alias("documented"))

    fields = ["package", "path", "kind", "signature", "deprecated", "value", "is_property", "binding", "target"]
    read = F.when(F.coalesce("is_property", F.lit(False)), "attribute").otherwise(F.col("kind"))  # a property is read, not called
    both = old.withColumn("kind", read).where("is_public").select(*base, *[F.col(c).alias(f"o_{c}") for c in fields[2:]], "doc").join(new.withColumn("kind", read).select("package", "path", *[F.col(c).alias(f"n_{c}") for c in fields[2:]]), ["package", "path"])
    targets = new.select("package", F.col("path").alias("n_target"), F.col("kind").alias("_target_kind"))
    changed = both.where("o_kind <> n_kind and o_kind not in ('alias', 'star') and n_kind not in ('alias', 'star')").join(targets, ["package", "n_target"], "left")
    changed = changed.where(~_compatible_kinds() & (F.coalesce("o_binding", F.lit("")) != "sometimes") & (F.coalesce("n_binding", F.lit("")) != "sometimes"))
    changed = changed.select(*base, F.lit("kind_changed").alias("kind"), F.col("o_signature").alias("old_signature"), F.col("n_signature").alias("new_signature"), F.col("o_kind").alias("old_kind"), F.col("n_kind").alias("new_kind"), F.col("doc").isNotNull().alias("documented"))
    warned = both.where("o_deprecated is null and n_deprecated is not null")
    warned = warned.select(*base, F.lit("deprecated").alias("kind"), F.col("n_deprecated").alias("deprecation"), F.col("o_signature").alias("old_signature"), F.col("n_signature").alias("new_signature"), F.col("doc").isNotNull().alias("documented"))
    every = out
    for more in (parameter_changes(old, new), changed, warned):
        every = every.unionByName(more, allowMissingColumns=True)
    every = every.join(owners, ["package", "parent"], "left")
    if switches is not None:
        every = every.unionByName(switches.select("package", F.col("package").alias("path"), F.col("gone").alias("name"), F.lit("dependency_switched").alias("kind"), F.col("fresh").alias("moved_to")), allowMissingColumns=True)
    columns = [part.strip().split(" ") for part in CHANGE.split(", ")]
    return every.select(*[(F.col(c) if c in every.columns else _none(kind)).cast(kind).alias(c) for c, kind in columns])


def _moves(top: DataFrame, old: DataFrame, new: DataFrame, new_paths: DataFrame) -> DataFrame:
    """(package, path, moved_to): the only new object of the same name and kind that has half the members
    of a gone class, or the parameters of a gone function."""

    def members(objects: DataFrame) -> DataFrame:
        kept = objects.where("is_public").select("package", F.col("parent").alias("path"), "name")
        return kept.groupBy("package", "path").agg(F.collect_set("name").alias("members"))

    lost = top.where("kind in ('class', 'function')").join(members(old), ["package", "path"], "left")
    fresh = new.where("is_public and kind in ('class', 'function')").join(old.select("package", "path"), ["package", "path"], "left_anti").join(members(new), ["package", "path"], "left")
    fresh = fresh.select("package", "name", "kind", F.col("path").alias("to"), F.col("members").alias("to_members"), F.col("params").alias("to_params"))
    none = F.array().cast("array<string>")
    kept = F.size(F.array_intersect(F.coalesce("members", none), F.coalesce("to_members", none)))
    same = F.when(F.col("kind") == "class", 2 * kept >= F.size(F.coalesce("members", none))).otherwise(F.size(F.array_except(_names("params"), _names("to_params"))) == 0)
    moved = lost.join(fresh, ["package", "name", "kind"]).where(same).select("package", "path", "to")
    shown = moved.join(new_paths.select("package", F.col("canonical").alias("to"), "public"), ["package", "to"])
    depth = F.size(F.split("public", "[.]"))
    best = shown.groupBy("package", "path").agg(F.min(F.struct(depth.alias("d"), F.col("public"))).alias("m"), F.count_distinct("to").alias("n")).where("n = 1")
    return best.select("package", "path", F.col("m.public").alias("moved_to"))


def _names(c: str) -> Column:
    return F.transform(c, lambda p: p["name"])


def _compatible_kinds() -> Column:
    """PF13: a kind change that code written for the old release doesn't notice: a function that became a
    class, attributes and properties, and names bound to values that may be called the same way."""
    o, n = F.col("o_kind"), F.col("n_kind")
    like = lambda side: (F.col(f"{side}_kind") == "attribute") | F.coalesce(f"{side}_is_property", F.lit(False))
    callable_ = lambda side: F.coalesce(~F.col(f"{side}_value").isin("data", "per_module"), F.lit(False))
    held = F.col("_target_kind")
    becomes = (n == "attribute") & o.isin("function", "class")
    by_target = F.when(held.isNotNull() & (held != "attribute"), (held == o) | ((o == "function") & (held == "class"))).otherwise(callable_("n"))
    return ((o == "function") & (n == "class")) | (like("o") & like("n")) | ((o == "attribute") & n.isin("function", "class") & callable_("o")) | (becomes & by_target)


def parameter_changes(old: DataFrame, new: DataFrame) -> DataFrame:
    """PF13: parameters of functions that both releases have, one row for each call form that breaks.

    Not counted: ``self``, ``cls`` and names that begin with "_"; fixtures and functions that a class of
    the package wraps; a removal that ``**kwargs`` or an overload of the new release takes; a
    positional parameter under a new name, whose callers by position notice nothing; ``*args`` and
    ``**kwargs`` whose place named parameters took; demands that all old overloads made already."""
    wrapped = new.where("kind = 'class'").select("package", F.col("path").alias("_d"))
    fn = lambda objects: objects.where("kind = 'function' and not coalesce(is_property, false)")
    special = fn(old).unionByName(fn(new)).select("package", "path", F.explode("decorators").alias("_d"))
    special = special.join(wrapped, ["package", "_d"], "left_semi").select("package", "path").unionByName(special.where(F.col("_d").isin(*FIXTURES)).select("package", "path")).distinct()
    before = fn(old).where("is_public").select("package", "path", "name", "parent", F.col("params").alias("was"), F.col("overloads").alias("was_over"), F.col("signature").alias("old_signature"), F.col("doc").isNotNull().alias("documented"))
    both = before.join(fn(new).select("package", "path", "params", "overloads", F.col("signature").alias("new_signature")), ["package", "path"])
    both = both.join(special, ["package", "path"], "left_anti")
    names = F.array_union(_names("was"), _names("params"))
    pair = both.select("*", F.explode(names).alias("one")).where(~F.col("one").isin("self", "cls") & ~F.col("one").startswith("_"))

    find = lambda c, name: F.get(F.filter(c, lambda p: p["name"] == name), F.lit(0))
    place = lambda c: F.array_position(_names(c), F.col("one")).cast("int")
    positional = lambda p: p["kind"].isin("positional_only", "positional_or_keyword")
    variadic = lambda p: p["kind"].isin("var_positional", "var_keyword")
    needs = lambda p: ~p["has_default"] & ~variadic(p)
    pair = pair.withColumns({"p": find("was", F.col("one")), "q": find("params", F.col("one"))})
    # what stands in the parameter's place on the other side, if its name is new there
    other = lambda c, known: F.filter(F.array(F.get(c, place("was" if c == "params" else "params") - 1)), lambda x: x.isNotNull() & positional(x) & ~F.array_contains(_names(known), x["name"]))
    pair = pair.withColumns({"renamed": F.get(other("params", "was"), F.lit(0)), "formerly": F.get(other("was", "params"), F.lit(0))})
    pair = pair.withColumns({"renamed": F.when(positional(F.col("p")), F.col("renamed")), "formerly": F.when(positional(F.col("q")), F.col("formerly"))})

    fresh = F.filter("params", lambda x: ~F.array_contains(_names("was"), x["name"]))
    takes = lambda own: F.exists(fresh, lambda x: x["kind"].isin("positional_or_keyword", own, "keyword_only" if own == "var_keyword" else "positional_only"))
    absorbed = F.when(F.col("p.kind") == "var_keyword", takes("var_keyword")).otherwise(takes("var_positional"))
    open_ = F.exists("params", lambda x: x["kind"] == "var_keyword")
    none = F.array().cast("array<string>")
    in_overload = F.exists("overloads", lambda o: F.exists(o, lambda x: (x["name"] == F.col("one")) | (x["kind"] == "var_keyword")))
    renamed, required_now = F.col("renamed").isNotNull(), F.coalesce(needs(F.col("renamed")), F.lit(False))
    removed = F.col("p").isNotNull() & F.col("q").isNull() & ~F.coalesce(in_overload, F.lit(False))
    real = F.when(variadic(F.col("p")), ~absorbed).when((F.col("p.kind") == "positional_only") & renamed, False).when(open_ & (F.col("p.kind") != "positional_only"), renamed & required_now).otherwise(True)

    plain = F.coalesce(F.size("overloads"), F.lit(0)) <= 0
    had_overloads = F.coalesce(F.size("was_over"), F.lit(0)) > 0
    old_need = had_overloads & F.forall("was_over", lambda o: F.exists(o, lambda x: (x["name"] == F.col("one")) & needs(x)))
    demands = F.col("q").isNotNull() & needs(F.col("q")) & (F.col("p").isNull() | F.col("p.has_default")) & ~variadic(F.col("q"))
    same_argument = F.col("p").isNull() & F.col("formerly").isNotNull() & F.coalesce(needs(F.col("formerly")), F.lit(False))
    both_there = F.col("p").isNotNull() & F.col("q").isNotNull() & plain & ~had_overloads
    kind = F.when(removed & real, "param_removed").when(demands & plain & ~F.coalesce(old_need, F.lit(False)) & ~same_argument, "param_required")
    shape = F.when(both_there & (F.col("q.kind") == "keyword_only") & F.col("p.kind").isin("positional_only", "positional_or_keyword"), "param_keyword_only")
    shape = shape.when(both_there & (F.col("q.kind") == "positional_only") & F.col("p.kind").isin("positional_or_keyword", "keyword_only"), "param_positional_only")
    rows = pair.withColumn("kind", F.explode(F.array_compact(F.array(kind, shape))))
    star = F.when(F.col("p.kind") == "var_keyword", "**").when(F.col("p.kind") == "var_positional", "*").otherwise("")
    suggestions = F.when((F.col("kind") == "param_removed") & renamed, F.array("renamed.name")).otherwise(none)
    return rows.select("package", "path", "name", "parent", "kind", F.concat(F.when(F.col("kind") == "param_removed", star).otherwise(""), "one").alias("parameter"), suggestions.alias("suggestions"), "old_signature", "new_signature", "documented")


def usage(changes: DataFrame, used: DataFrame) -> DataFrame:
    """``changes`` with ``usage``: 2 where code names exactly what changed, 1 where it calls the callable and
    not the changed parameter, else 0; and ``class_used``: code imports the class of a member.

    ``used`` is what ``uses`` gives."""
    exact = F.col("parameter").isNull() | (F.col("how").isin("keyword", "keyword_name"))
    found = used.groupBy("package", "path", "parameter").agg(F.max(F.when(exact, 2).otherwise(1)).alias("usage"), F.max(F.col("class_used")).alias("class_used"))
    key = [F.col("c.package") == F.col("u.package"), F.col("c.path") == F.col("u.path"), F.col("c.parameter").eqNullSafe(F.col("u.parameter"))]
    rows = changes.alias("c").join(found.alias("u"), key, "left")
    return rows.select("c.*", F.coalesce("u.usage", F.lit(0)).alias("usage"), F.coalesce("u.class_used", F.lit(False)).alias("class_used"))


def ranked_changes(changes: DataFrame, used: DataFrame | None = None) -> DataFrame:
    """One row for each concept (async and raw-response twins, and what several classes had from one
    origin, are one), with its score, best first.  ``used`` (``uses``) adds what the code's use weighs."""
    changes = usage(changes, used) if used is not None else changes.withColumns({"usage": F.lit(0), "class_used": F.lit(False)})
    key = S.concept_key(F.col("package"), F.col("kind"), F.col("owner"), F.col("name"), F.col("parameter"))
    shared = F.col("origin").isNotNull() & (F.col("origin") != F.col("path"))
    origin = F.when(F.col("origin").isNotNull(), F.element_at(F.split("origin", "[.]"), -2))
    key = F.when(shared, S.concept_key(F.col("package"), F.col("kind"), origin, F.col("name"), F.col("parameter"))).otherwise(key)
    twin = F.lower(F.concat_ws(".", "owner", "path")).rlike(r"async|withraw|withstreaming|\.beta\.|legacy").cast("int")
    rows = changes.where(~F.col("name").isin(*NOISE_NAMES) | F.col("owner").isNotNull())
    rows = rows.withColumns({"concept": key, "_away": shared.cast("int"), "_twin": twin, "_l": F.length("path")})
    kept = ["path", "kind", "name", "owner", "parameter", "moved_to", "deprecation", "old_signature", "documented"]
    first = F.min(F.struct("_away", "_twin", "_l", *kept)).alias("f")
    one = rows.groupBy("package", "concept").agg(first, F.count("*").alias("occurrences"), F.max("usage").alias("usage"), F.max("class_used").alias("class_used"))
    one = one.select("package", "concept", "f.*", "occurrences", "usage", "class_used").drop("_away", "_twin", "_l")
    priority = F.coalesce(F.create_map(*[x for k, v in PRIORITY.items() for x in (F.lit(k), F.lit(v))])[F.col("kind")], F.lit(6))
    inside = F.slice(F.split("path", "[.]"), F.lit(2), F.greatest(F.lit(0), F.size(F.split("path", "[.]")) - 2))
    holds = lambda segments: F.exists(inside, lambda s: s.isin(*segments))
    penalty = F.when(holds(INTERNAL_SEGMENTS), 3.0).when(holds(SIDE_SEGMENTS), 2.0).otherwise(0.0)
    noise = F.col("name").isin(*NOISE_NAMES) | (F.col("name").rlike("^[^a-z]*[A-Z][^a-z]*$") & F.col("owner").isNotNull())
    whole = F.col("kind").isin("removed", "moved") & F.coalesce(F.col("old_signature").startswith("module "), F.lit(False)) & (F.size(F.split("path", "[.]")) == 2)
    score = ranking.change_score(
        priority, F.col("usage"), F.col("owner").isNotNull() & F.col("class_used"), F.col("path"), F.col("occurrences"), F.coalesce("documented", F.lit(False)),
        F.col("deprecation").isNotNull(), noise, penalty, whole,
    )
    return one.withColumn("score", score).orderBy(F.desc("score"), "path", F.coalesce("parameter", F.lit("")))


def uses(changes: DataFrame, facts: DataFrame, objects: DataFrame | None = None, typed: DataFrame | None = None) -> DataFrame:
    """Where files use what changed: (package, path, parameter, file, pos, how, class_used).

    ``how``, best first: keyword (the changed parameter is passed to the changed path), path (that is
    imported or read), member (read on a value that the file, or typing, shows to be of the class),
    keyword_name and name_only (the names alone agree, in a file that imports the package).  ``facts`` are ``usage_facts.file_facts``; with ``objects`` of the old release, an
    object counts under each of its public paths; ``typed`` are the facts of ``usage_facts.typed``."""
    facts = facts.select("file", "fact", "a", "b", "pos")
    if typed is not None:
        facts = facts.unionByName(typed.where("fact <> 'loose'").select("file", "fact", "a", "b", "pos"))
    what = changes.select("package", "path", "name", "owner", F.regexp_replace("parameter", r"^[*]+", "").alias("_bare"), "parameter")
    shown = what.select("package", "path").distinct().withColumn("at", F.col("path"))
    parent = F.regexp_replace("path", r"[.][^.]+$", "")
    if objects is not None:
        names = public_paths(objects).select("package", F.col("canonical"), "public")
        direct = names.select("package", F.col("canonical").alias("path"), F.col("public").alias("at"))
        members = what.where("owner is not null").select("package", "path", parent.alias("canonical"), "name").distinct().join(names, ["package", "canonical"])
        members = members.select("package", "path", F.concat_ws(".", "public", "name").alias("at"))
        shown = shown.unionByName(shown.select("package", "path").join(direct, ["package", "path"])).unionByName(members).distinct()
    at = what.join(shown, ["package", "path"]).withColumn("_class", F.when(F.col("owner").isNotNull(), F.regexp_replace("at", r"[.][^.]+$", "")))
    columns = ["package", "path", "parameter", "file", "pos"]
    of = lambda fact: facts.where(F.col("fact") == fact).select("file", "a", "b", "pos")
    by_keyword = at.where("_bare is not null").join(of("keyword_path"), (F.col("a") == F.col("at")) & (F.col("b") == F.col("_bare"))).select(*columns)
    by_path = at.join(of("path"), F.col("a") == F.col("at")).select(*columns)
    by_member = at.where("owner is not null").join(of("member"), (F.col("a") == F.col("_class")) & (F.col("b") == F.col("name"))).select(*columns)
    roots = of("path").where("a not like '%.%'").select("file", F.col("a").alias("_root")).distinct()
    near = at.select("package", "path", "name", "owner", "parameter", "_bare", F.split("at", "[.]")[0].alias("_root")).distinct().join(roots, "_root")
    by_name_keyword = near.where("_bare is not null").join(of("keyword").withColumnRenamed("file", "_f"), (F.col("a") == F.col("name")) & (F.col("b") == F.col("_bare")) & (F.col("file") == F.col("_f"))).select(*columns)
    by_name = near.where("_bare is null and owner is not null").join(of("attribute").withColumnRenamed("file", "_f"), (F.col("a") == F.col("name")) & (F.col("file") == F.col("_f"))).select(*columns)
    tiers = matching.priority_union([by_keyword, by_path, by_member, by_name_keyword, by_name], ["package", "path", "parameter", "file"])
    how = F.element_at(F.array(*[F.lit(x) for x in ("keyword", "path", "member", "keyword_name", "name_only")]), F.col("tier") + 1)
    classes = at.where("_class is not null").join(of("path"), F.col("a") == F.col("_class")).select("package", "path", "file").distinct().withColumn("_c", F.lit(True))
    found = tiers.withColumn("how", how).drop("tier").distinct()
    return found.join(classes, ["package", "path", "file"], "left").withColumn("class_used", F.coalesce("_c", F.lit(False))).drop("_c").select(*columns, "how", "class_used")


def package_order(packages: DataFrame) -> DataFrame:
    """SL4: packages (changed, imported, breaking, deprecated, name) as a scan lists them: changed ones, then imported
    ones, then by breaking changes and deprecations, then by name."""
    return packages.orderBy(F.desc("changed"), F.desc("imported"), F.desc("breaking"), F.desc("deprecated"), "name")


def site_order(sites: DataFrame) -> DataFrame:
    """SL7: reference sites (path, line) with those of async, raw-response and beta twins after the others, short
    paths first."""
    twin = F.lower("path").rlike(r"async|withraw|withstreaming")
    beta = F.exists(F.split("path", "[.]"), S.is_beta)
    return sites.orderBy(twin, beta, F.size(F.split("path", "[.]")), "path", F.asc_nulls_last("line"))


def most_starred(rows: DataFrame, n: int, stars: str = "stars", name: str = "name") -> DataFrame:
    """SL13: the ``n`` rows with most stars, by name where equal; each name once."""
    return ranking.best_per_key(rows, [name], [F.desc(stars)]).orderBy(F.desc(stars), name).limit(n)


def capped(rows: DataFrame, order: list, most: int) -> tuple[DataFrame, Column]:
    """SL9: the first ``most`` rows in order (the source's own limit), and the text of the warning that more exist."""
    more = F.concat(F.lit(f"only the first {most} of "), F.count("*").cast("string"), F.lit(" were read"))
    return rows.orderBy(*order).limit(most), F.when(F.count("*") > most, more)
