"""Environment markers of requirements, for a given Python on any platform."""

from __future__ import annotations

import re
from collections.abc import Callable

import pandas as pd
from pyspark.sql import functions as F

#: sys_platform, platform_system, os_name and machine of the platforms tried.
PLATFORMS = (
    ("linux", "Linux", "posix", "x86_64"),
    ("win32", "Windows", "nt", "AMD64"),
    ("darwin", "Darwin", "posix", "arm64"),
)
_TOKEN = re.compile(r"""\s*(?:(?P<text>'[^']*'|"[^"]*")|(?P<op><=|>=|===|==|!=|~=|<|>)|(?P<word>[A-Za-z_][A-Za-z_0-9.]*)|(?P<mark>[()]))""")


def _version(text: str) -> tuple[int, ...] | None:
    return tuple(map(int, text.split("."))) if re.fullmatch(r"\d+(\.\d+)*", text) else None


def _compare(left: str, op: str, right: str) -> bool:
    if op in ("in", "not in"):
        return (left in right) == (op == "in")
    if op in ("==", "!=") and right.endswith(".*"):
        head = right[:-2].split(".")
        return (left.split(".")[: len(head)] == head) == (op == "==")
    a, b = _version(left), _version(right)
    if a is None or b is None:
        a, b = left, right
    elif op == "~=":
        return a >= b and a[: len(b) - 1] == b[:-1]
    else:
        width = max(len(a), len(b))
        a, b = a + (0,) * (width - len(a)), b + (0,) * (width - len(b))
    return {"<": a < b, "<=": a <= b, ">": a > b, ">=": a >= b, "!=": a != b}.get(op, a == b)


def parse(marker: str) -> Callable[[dict[str, str]], bool]:
    """The marker as a function of an environment; ValueError for what is no marker."""
    tokens, at = [], 0
    while marker[at:].strip():
        m = _TOKEN.match(marker, at)
        if not m:
            raise ValueError(f"no marker: {marker!r}")
        tokens.append((m.lastgroup, m[m.lastgroup]))
        at = m.end()
    tokens.append(("end", ""))
    place = 0

    def take() -> tuple[str, str]:
        nonlocal place
        place += 1
        return tokens[place - 1]

    def joined(word: str, part: Callable, fold: Callable) -> Callable[[dict[str, str]], bool]:
        parts = [part()]
        while tokens[place] == ("word", word):
            take()
            parts.append(part())
        return parts[0] if len(parts) == 1 else lambda env: fold(p(env) for p in parts)

    def value() -> Callable[[dict[str, str]], str]:
        kind, text = take()
        if kind == "text":
            return lambda env: text[1:-1]
        if kind == "word":
            return lambda env: env.get(text.replace("os.name", "os_name").replace("sys.platform", "sys_platform"), "")
        raise ValueError(f"no marker: {marker!r}")

    def single() -> Callable[[dict[str, str]], bool]:
        if tokens[place] == ("mark", "("):
            take()
            inner = either()
            if take() != ("mark", ")"):
                raise ValueError(f"no marker: {marker!r}")
            return inner
        left, (_, op) = value(), take()
        if op == "not":
            op = f"not {take()[1]}"
        if op not in ("<", "<=", ">", ">=", "==", "!=", "~=", "===", "in", "not in"):
            raise ValueError(f"no marker: {marker!r}")
        right = value()
        return lambda env: _compare(left(env), op, right(env))

    def both() -> Callable[[dict[str, str]], bool]:
        return joined("and", single, all)

    def either() -> Callable[[dict[str, str]], bool]:
        return joined("or", both, any)

    found = either()
    if take()[0] != "end":
        raise ValueError(f"no marker: {marker!r}")
    return found


def environments(python: str) -> list[dict[str, str]]:
    """The environments tried for ``python`` ("3.12")."""
    same = {"python_version": ".".join(python.split(".")[:2]), "python_full_version": python if python.count(".") > 1 else f"{python}.0", "extra": ""}
    same |= {"implementation_name": "cpython", "platform_python_implementation": "CPython"}
    return [same | {"os_name": o, "sys_platform": s, "platform_system": p, "platform_machine": m} for s, p, o, m in PLATFORMS]


def marker_applies(marker, python: str):
    """PF9: whether a requirement's marker holds for ``python`` on some platform; true for null
    and empty markers, false for text that is no marker."""
    tried = environments(python)

    @F.pandas_udf("boolean")
    def holds(markers: pd.Series) -> pd.Series:
        known: dict[str, bool] = {}

        def one(text: str | None) -> bool:
            if text is None or not text.strip():
                return True
            if text not in known:
                try:
                    test = parse(text)
                    known[text] = any(test(env) for env in tried)
                except (ValueError, IndexError):
                    known[text] = False
            return known[text]

        return markers.map(one, na_action=None).astype(bool)

    return holds(marker)
