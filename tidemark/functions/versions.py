"""Order of Python package versions as a sortable struct, without a UDF."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_FORM = (
    r"^\s*v?(?:(\d+)!)?(\d+(?:\.\d+)*)(?:[-_.]?(alpha|a|beta|b|preview|pre|c|rc)[-_.]?(\d*))?"
    r"(?:-(\d+)|[-_.]?(post|rev|r)[-_.]?(\d*))?(?:[-_.]?(dev)[-_.]?(\d*))?(?:\+([a-z0-9]+(?:[-_.][a-z0-9]+)*))?\s*$"
)


def version_key(version: Column) -> Column:
    """struct<epoch, release, pre, pre_n, post, dev, local>, null for what is no version.

    Trailing zeros of the release go, so 1.0 equals 1.0.0.  Within a release: dev,
    alpha, beta, candidate, final, post; a dev version comes before what it leads to."""
    v = F.lower(version)
    part = lambda i: F.regexp_extract(v, _FORM, i)
    number = lambda i: F.coalesce(F.nullif(part(i), F.lit("")).cast("long"), F.lit(0).cast("long"))
    release = F.transform(F.split(part(2), "[.]"), lambda x: x.cast("long"))
    last = F.coalesce(F.array_max(F.transform(release, lambda x, i: F.when(x > 0, i + 1))), F.lit(1))
    phase = F.when(part(3).isin("a", "alpha"), 1).when(part(3).isin("b", "beta"), 2).when(part(3) != "", 3)
    is_post, is_dev = (part(5) != "") | (part(6) != ""), part(8) != ""
    pre = F.coalesce(phase, F.when(is_dev & ~is_post, 0).otherwise(4))
    post = F.when(is_post, F.greatest(number(5), number(7)) + 1).otherwise(F.lit(0).cast("long"))
    dev = F.when(is_dev, number(9)).otherwise(F.lit(9223372036854775807))
    key = F.struct(number(1).alias("epoch"), F.slice(release, F.lit(1), last).alias("release"), pre.alias("pre"), number(4).alias("pre_n"), post.alias("post"), dev.alias("dev"), part(10).alias("local"))
    return F.when(v.rlike(_FORM), key)


def is_final(version: Column) -> Column:
    """Neither a pre-release nor a dev version."""
    return (F.regexp_extract(F.lower(version), _FORM, 3) == "") & (F.regexp_extract(F.lower(version), _FORM, 8) == "") & F.lower(version).rlike(_FORM)


def satisfies(version: Column, specifier: Column) -> Column:
    """Whether a version fits every clause of a specifier, pre-releases included; null and empty ones hold.

    A clause or version that is none doesn't hold.  ``==`` and ``!=`` take ".*", a local part counts
    only where the clause has one, ``>`` leaves out post-releases and ``<`` pre-releases of its version."""
    full, plain = version_key(version), version_key(F.regexp_replace(version, r"\+.*$", ""))
    final = F.lit(9223372036854775807)
    early = lambda k: (k["pre"] < 4) | (k["dev"] < final)

    def clause(text: Column) -> Column:
        op = F.regexp_extract(text, r"^(===|~=|==|!=|<=|>=|<|>)", 1)
        given = F.trim(F.regexp_replace(text, r"^[=~!<>]+", ""))
        wild, bare = given.endswith(".*"), F.regexp_replace(given, r"\.\*$", "")
        key = version_key(bare)
        mine = F.when(given.contains("+"), full).otherwise(plain)
        written = F.size(F.split(F.regexp_extract(F.lower(bare), _FORM, 2), "[.]"))

        def head(n: Column) -> Column:
            pad = lambda k: F.slice(F.concat(k["release"], F.array_repeat(F.lit(0).cast("long"), n)), F.lit(1), n)
            return (plain["epoch"] == key["epoch"]) & (pad(plain) == pad(key))

        base = (plain["epoch"] == key["epoch"]) & (plain["release"] == key["release"])
        equal = F.when(wild, head(written)).otherwise(mine == key)
        out = F.when(op == "===", F.lower(F.trim(version)) == F.lower(given)).when(op == "==", equal).when(op == "!=", ~equal)
        out = out.when(wild, False).when(op == ">=", plain >= key).when(op == "<=", plain <= key)
        out = out.when(op == "~=", (plain >= key) & (written > 1) & head(F.greatest(written - 1, F.lit(1))))
        out = out.when(op == ">", (plain > key) & ~(base & (key["post"] == 0) & (plain["post"] > 0)))
        out = out.when(op == "<", (plain < key) & ~(base & ~early(key) & early(plain)))
        return F.coalesce(out, F.lit(False))

    clauses = F.filter(F.transform(F.split(F.coalesce(specifier, F.lit("")), ","), lambda c: F.trim(c)), lambda c: c != "")
    return F.forall(clauses, clause)
