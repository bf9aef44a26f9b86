"""Column functions over documentation, notes and answers: evidence, quotes, code, identifiers."""

from __future__ import annotations

import difflib
import json

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

_NAME = r"[A-Za-z_][A-Za-z0-9_]*(?:\.[A-Za-z_][A-Za-z0-9_]*)*"
#: Wordings after which a deprecation names what to use, the clearest first.
CUES = (r"(?i:replaced by|replaced with)", r"(?i:renamed to|moved to)", r"(?i:use)", r"(?i:in favou?r of)", r"(?i:see)", r"(?i:instead of this)")


def first_paragraph(doc: Column, limit: int = 400) -> Column:
    return F.nullif(F.substring(F.element_at(F.split(F.trim(doc), r"\n\s*\n"), 1), 1, limit), F.lit(""))


def plain(text: Column) -> Column:
    """Text without reST roles, back-quotes, emphasis and link targets, in single spaces."""
    roles = F.regexp_replace(text, r":[a-z:]+:`~?([^`<]*)(?:\s*<[^>]*>)?`", "$1")
    links = F.regexp_replace(roles, r"\[([^\]]*)\]\([^)]*\)", "$1")
    return F.trim(F.regexp_replace(F.regexp_replace(links, r"[`*]+", ""), r"\s+", " "))


def sentences(text: Column) -> Column:
    """Sentences with their end marks; a full stop inside a name or number ends none."""
    return F.filter(F.split(text, r"(?<=[.!?])\s+(?=[A-Z\"'`(])"), lambda s: s != "")


def quote(text: Column, limit: int = 300) -> Column:
    """Whole sentences from the end of ``text`` that fit ``limit`` together."""
    parts = sentences(text)
    start = F.struct(F.lit("").alias("out"), F.lit(True).alias("open"))

    def add(acc: Column, s: Column) -> Column:
        longer = F.when(acc["out"] == "", s).otherwise(F.concat(s, F.lit(" "), acc["out"]))
        fits = acc["open"] & (F.char_length(longer) <= limit)
        return F.struct(F.when(fits, longer).otherwise(acc["out"]).alias("out"), fits.alias("open"))

    return F.aggregate(F.reverse(parts), start, add, lambda acc: acc["out"])


def named_replacement(text: Column) -> Column:
    """The name that follows the clearest cue, null without one."""
    found = [F.nullif(F.regexp_extract(text, cue + r"[\s:]+(?:the\s+)?[`']*(" + _NAME + ")", 1), F.lit("")) for cue in CUES]
    return F.coalesce(*found)


def code_names(text: Column) -> Column:
    """Distinct names in back-quotes, calls without their brackets."""
    return F.array_distinct(F.regexp_extract_all(text, F.lit(r"`+(" + _NAME + r")(?:\(\))?`+"), F.lit(1)))


def is_grounded(bullet: Column, evidence: Column) -> Column:
    """Every back-quoted name of ``bullet`` is in the array ``evidence``."""
    return F.size(F.array_except(code_names(bullet), evidence)) == 0


def leaks(text: Column, forbidden: Column) -> Column:
    """``text`` holds one of the ``forbidden`` names as a whole word."""
    words = F.split(text, r"[^A-Za-z0-9_]+")
    return F.arrays_overlap(F.transform(words, lambda w: F.lower(w)), F.transform(forbidden, lambda w: F.lower(w)))


def longest_code(answer: Column) -> Column:
    """The longest fenced block of an answer, the first of equals; without a fence the answer itself."""
    blocks = F.regexp_extract_all(answer, F.lit(r"(?s)```[a-zA-Z0-9]*[ \t]*\r?\n(.*?)(?:```|\z)"), F.lit(1))
    best = F.array_max(F.transform(blocks, lambda b, i: F.struct(F.char_length(b).alias("n"), (-i).alias("i"), b.alias("b"))))
    return F.coalesce(best["b"], answer)


def without_control_comments(code: Column) -> Column:
    """Code without the comments that silence a type checker."""
    return F.regexp_replace(code, r"(?m)[ \t]*#[ \t]*(?:type:[ \t]*ignore|noqa|pyright:|mypy:|pylint:)[^\n]*$", "")


def encode_tags(tags: Column) -> Column:
    return F.concat(F.lit("("), F.array_join(F.array_distinct(tags), ", "), F.lit(")"))


def decode_tags(text: Column) -> Column:
    inner = F.regexp_extract(text, r"\(([a-z0-9 ,:-]+)\)\s*$", 1)
    return F.when(inner == "", F.array().cast("array<string>")).otherwise(F.split(inner, r",\s*"))


#: Labels of project links that document releases, and of those that name the repository,
#: in the order tried.
CHANGELOG_LABELS = ("changelog", "changes", "releasenotes", "releases", "history", "whatsnew", "news")
REPOSITORY_LABELS = ("source", "sourcecode", "repository", "repo", "code", "github", "homepage")


def link_by_label(urls: Column, labels: tuple[str, ...] = CHANGELOG_LABELS) -> Column:
    """The value of a map whose key, without blanks, hyphens and underscores, comes first in ``labels``."""
    norm = F.map_from_entries(F.transform(F.map_entries(urls), lambda e: F.struct(F.concat(F.regexp_replace(F.lower(e["key"]), r"[\s_-]+", ""), F.lit("#"), e["key"]).alias("k"), e["value"].alias("v"))))

    def pick(label: str) -> Column:
        return F.get(F.map_values(F.map_filter(norm, lambda k, v: F.substring_index(k, "#", 1) == label)), F.lit(0))

    return F.coalesce(*map(pick, labels))


def changelog_link(urls: Column) -> Column:
    """SF28: the link that documents a package's releases, by label, else the releases page of the
    repository that another link names, the labels of repositories first."""
    web = F.map_filter(urls, lambda k, v: v.rlike("^https?://"))
    page = r"^https?://(?:www\.)?github\.com/(?!sponsors/|orgs/)([^/?#]+)/([^/?#]+?)(?:\.git)?(?:[/?#].*)?$"
    hosted = F.map_filter(urls, lambda k, v: F.trim(v).rlike(page))
    ranked = F.array_sort(F.transform(F.map_entries(hosted), lambda e: F.struct(
        F.coalesce(F.nullif(F.array_position(F.array(*[F.lit(x) for x in REPOSITORY_LABELS]), F.regexp_replace(F.lower(e["key"]), r"[\s_-]+", "")), F.lit(0)), F.lit(99)).alias("r"), e["value"].alias("v"))))
    first = F.trim(F.get(ranked, F.lit(0))["v"])
    repository = F.concat(F.lit("https://github.com/"), F.regexp_extract(first, page, 1), F.lit("/"), F.regexp_extract(first, page, 2), F.lit("/releases"))
    return F.coalesce(F.trim(link_by_label(web)), repository)


def first_json_object(text: Column) -> Column:
    """The first JSON object inside free text, as text; null if there is none."""

    @F.pandas_udf("string")
    def find(values: pd.Series) -> pd.Series:
        decoder, out = json.JSONDecoder(), []
        for value in values:
            found, at = None, (value or "").find("{")
            while at >= 0 and found is None:
                try:
                    found = value[at : at + decoder.raw_decode(value[at:])[1]]
                except ValueError:
                    at = value.find("{", at + 1)
            out.append(found)
        return pd.Series(out, dtype=object)

    return find(text)


def close_names(name: Column, candidates: Column, n: int = 3, cutoff: float = 0.7) -> Column:
    """At most ``n`` candidates that resemble a name, by difflib's ratio, the nearest first."""

    @F.pandas_udf("array<string>")
    def close(names: pd.Series, others: pd.Series) -> pd.Series:
        pairs = zip(names, others, strict=True)
        return pd.Series([difflib.get_close_matches(a, list(b), n, cutoff) if a and b is not None else [] for a, b in pairs])

    return close(name, candidates)


def splice(text, block, start: str = "<!-- notes:start -->", end: str = "<!-- notes:end -->"):
    """IN3: ``text`` with its marked block replaced by ``block``, or with the block at its end.

    What stands outside the marks stays as it is, and splicing the same block again changes nothing."""
    text = F.coalesce(text, F.lit(""))
    at = F.instr(text, start)
    rest = F.substring(text, at, F.char_length(text))
    close = F.instr(rest, end)
    marked = F.concat(F.lit(start + "\n"), block, F.lit("\n" + end))
    inside = F.concat(F.substring(text, F.lit(1), at - 1), marked, F.substring(rest, close + len(end), F.char_length(text)))
    gap = F.when(text == "", "").when(text.endswith("\n"), "\n").otherwise("\n\n")
    return F.when((at > 0) & (close > 0), inside).otherwise(F.concat(text, gap, marked, F.lit("\n")))


def imported_modules(code):
    """SF35: distinct modules that a fragment of Python imports, also one that doesn't parse."""
    code = F.coalesce(code, F.lit(""))
    whole = F.flatten(F.transform(F.regexp_extract_all(code, F.lit(r"(?m)^[ \t]*import[ \t]+([^\n#;]+)"), F.lit(1)), lambda m: F.split(m, ",")))
    whole = F.transform(whole, lambda m: F.regexp_extract(m, r"^\s*([\w.]+)", 1))
    parts = F.regexp_extract_all(code, F.lit(r"(?m)^[ \t]*from[ \t]+(\w[\w.]*)[ \t]+import\b"), F.lit(1))
    return F.array_sort(F.array_remove(F.array_distinct(F.concat(whole, parts)), ""))


def first_label(text, rules: list[tuple[str, str]]):
    """PF16: the label of the first (pattern, label) that a text matches; null if none does."""
    out = F.lit(None).cast("string")
    for pattern, label in reversed(rules):
        out = F.when(text.rlike(pattern), label).otherwise(out)
    return out
