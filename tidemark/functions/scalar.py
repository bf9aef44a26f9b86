"""Column functions: dates, names, keys, paths and numbers for display."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def parse_cutoff(text: Column) -> Column:
    """A date; a year or a month stands for its last day; null if it is none of these."""
    year, month = F.substring(text, 1, 4), F.substring(text, 6, 2)
    of_month = F.last_day(F.try_to_date(F.concat(year, F.lit("-"), month, F.lit("-01"))))
    full = F.try_to_date(text)
    return F.when(text.rlike(r"^\d{4}$"), F.try_to_date(F.concat(year, F.lit("-12-31")))).when(text.rlike(r"^\d{4}-\d{2}$"), of_month).when(text.rlike(r"^\d{4}-\d{2}-\d{2}$"), full)


def compare_date(cutoff: Column, margin: int | Column = 30) -> Column:
    """The cutoff less a margin of days that isn't negative."""
    margin = F.lit(margin) if isinstance(margin, int) else margin
    return F.date_sub(cutoff, F.greatest(F.lit(0), margin))


def canonical_name(name: Column) -> Column:
    """A distribution name as indexes compare it: lower case, runs of - _ . as one hyphen."""
    return F.lower(F.regexp_replace(name, "[-_.]+", "-"))


def plain_owner(owner: Column) -> Column:
    """A class name without the marks of its async and raw-response twins."""
    return F.regexp_replace(owner, "^Async|With(?:Raw|Streaming)Response$", "")


def module_of(path: Column, is_member: Column) -> Column:
    """A dotted path without its last segment, the last two for a member."""
    parts = F.split(path, "[.]")
    keep = F.size(parts) - F.when(is_member, 2).otherwise(1)
    return F.array_join(F.slice(parts, F.lit(1), F.greatest(F.lit(0), keep)), ".")


def _member(owner: Column, name: Column) -> Column:
    return F.concat_ws(".", plain_owner(owner), name)


def group_key(kind: Column, module: Column, owner: Column, name: Column, parameter: Column) -> Column:
    return F.concat_ws(":", kind, module, _member(owner, name), F.coalesce(parameter, F.lit("")))


def concept_key(package: Column, kind: Column, owner: Column, name: Column, parameter: Column) -> Column:
    """Like the group key without the module; what moved counts as removed."""
    return F.concat_ws(":", package, F.when(kind == "moved", "removed").otherwise(kind), _member(owner, name), F.coalesce(parameter, F.lit("")))


def api_key(package: Column, module: Column, owner: Column, name: Column) -> Column:
    return F.concat_ws(":", package, module, _member(owner, name))


def prefixes(path: Column, separator: str = ".") -> Column:
    """All prefixes of a path, the shortest first."""
    parts = F.split(path, "[" + separator + "]")
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, F.lit(1), i), separator))


def is_beta(segment: Column) -> Column:
    return segment.rlike(r"^(?:v\d+)?beta\d*$")


def has_beta_segment(path: Column) -> Column:
    return F.exists(F.split(path, "[.]"), is_beta)


def is_private(path: Column) -> Column:
    """Some segment begins with one underscore, other than dunder names."""
    return F.exists(F.split(path, "[.]"), lambda s: s.startswith("_") & ~(s.startswith("__") & s.endswith("__")))


def same_spelling(a: Column, b: Column) -> Column:
    """Equal but for case and underscores."""
    plain = lambda c: F.lower(F.replace(c, F.lit("_"), F.lit("")))
    return plain(a) == plain(b)


def all_paths(path: Column, also: Column, imports: Column) -> Column:
    none = F.array().cast("array<string>")
    return F.array_distinct(F.concat(F.array(path), F.coalesce(also, none), F.coalesce(imports, none)))


def percent(successes: Column, n: Column) -> Column:
    """Whole percent, half to even."""
    return F.when(n > 0, F.bround(100 * successes / n, 0).cast("int")).otherwise(F.lit(0))


def estimate_tokens(text: Column) -> Column:
    return F.greatest(F.lit(1), F.bround(F.char_length(text) / 4.0, 0).cast("int"))


def without_credentials(url: Column) -> Column:
    return F.regexp_replace(url, "^([a-zA-Z][a-zA-Z0-9+.-]*://)[^/@]*@", "$1")


def annotation_escape(text: Column) -> Column:
    """A message for a CI annotation line: %, CR and LF as percent codes."""
    return F.replace(F.replace(F.replace(text, F.lit("%"), F.lit("%25")), F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))


def name_words(segment: Column) -> Column:
    """Lower-case words of a CamelCase or snake_case name."""
    return F.transform(F.regexp_extract_all(segment, F.lit(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|\d+"), F.lit(0)), lambda w: F.lower(w))
