"""Which diagnostics of a snippet are about a target package, by the names that come from it."""

from __future__ import annotations

import ast

import pandas as pd
from pyspark.sql import DataFrame


def _roots(node: ast.AST) -> set[str]:
    """Names that an expression starts from: of calls, attributes, subscripts and awaits their receiver."""
    if isinstance(node, ast.Name):
        return {node.id}
    if isinstance(node, ast.Call):
        return _roots(node.func)
    if isinstance(node, (ast.Attribute, ast.Subscript, ast.Await, ast.Starred)):
        return _roots(node.value)
    if isinstance(node, (ast.Tuple, ast.List)):
        return set().union(*map(_roots, node.elts))
    if isinstance(node, (ast.BoolOp,)):
        return set().union(*map(_roots, node.values))
    if isinstance(node, ast.IfExp):
        return _roots(node.body) | _roots(node.orelse)
    return set()


def _targets(node: ast.AST) -> set[str]:
    return {n.id for n in ast.walk(node) if isinstance(n, ast.Name)} if not isinstance(node, (ast.Attribute, ast.Subscript)) else set()


def names_from(tree: ast.AST, imports: set[str]) -> set[str]:
    """REC5: names of a snippet that come from packages imported as ``imports``: imports of them, and what is
    assigned, opened, looped over or annotated from such names, until no name is added."""

    def ours(path: str) -> bool:
        return any(path == i or path.startswith(i + ".") for i in imports)

    found: set[str] = set()
    flows: list[tuple[set[str], set[str]]] = []  # from any of these names, to these
    for n in ast.walk(tree):
        if isinstance(n, ast.Import):
            found |= {a.asname or a.name.split(".")[0] for a in n.names if ours(a.name)}
        elif isinstance(n, ast.ImportFrom) and n.module and not n.level:
            found |= {a.asname or a.name for a in n.names if ours(n.module) or ours(f"{n.module}.{a.name}")}
        elif isinstance(n, ast.Assign):
            flows += [(_roots(n.value), _targets(t)) for t in n.targets]
        elif isinstance(n, (ast.AnnAssign, ast.AugAssign)):
            flows.append(((_roots(n.value) if n.value else set()) | (_roots(n.annotation) if isinstance(n, ast.AnnAssign) else set()), _targets(n.target)))
        elif isinstance(n, ast.NamedExpr):
            flows.append((_roots(n.value), _targets(n.target)))
        elif isinstance(n, (ast.For, ast.AsyncFor)):
            flows.append((_roots(n.iter), _targets(n.target)))
        elif isinstance(n, ast.comprehension):
            flows.append((_roots(n.iter), _targets(n.target)))
        elif isinstance(n, (ast.With, ast.AsyncWith)):
            flows += [(_roots(i.context_expr), _targets(i.optional_vars)) for i in n.items if i.optional_vars is not None]
        elif isinstance(n, ast.arg) and n.annotation is not None:
            flows.append((_roots(n.annotation), {n.arg}))
        elif isinstance(n, (ast.FunctionDef, ast.AsyncFunctionDef)):
            if n.returns is not None:
                flows.append((_roots(n.returns), {n.name}))
            flows += [(_roots(r.value), {n.name}) for r in ast.walk(n) if isinstance(r, ast.Return) and r.value is not None]
        elif isinstance(n, ast.ClassDef):
            flows.append((set().union(*map(_roots, n.bases)) if n.bases else set(), {n.name}))
    grown = True
    while grown:
        fresh = {t for sources, targets in flows if sources & found for t in targets} - found
        found |= fresh
        grown = bool(fresh)
    return found


def _covers(node: ast.AST, line: int, column: int) -> bool:
    end = (node.end_lineno or node.lineno, node.end_col_offset if node.end_col_offset is not None else 1 << 30)
    return (node.lineno, node.col_offset) <= (line, column) < end


def attribute_diagnostics(snippets: DataFrame, diagnostics: DataFrame) -> DataFrame:
    """SF24: ``diagnostics`` (snippet, line, column, rule) with ``about``: whether the code at that place comes
    from the target, and ``name``, what it starts from.

    ``snippets`` has snippet, code and imports (array: the target's import names).  The innermost call,
    attribute, name, import or keyword at the place (lines from 1, columns from 0) decides.  Null for
    code that doesn't parse; a null code is empty.  Snippets without diagnostics give no rows."""

    def judge(code: str | None, imports: list[str], places: list[tuple[int, int]]) -> list[tuple[bool | None, str | None]]:
        try:
            tree = ast.parse(code or "")
        except (SyntaxError, ValueError, RecursionError):
            return [(None, None)] * len(places)
        known = names_from(tree, set(imports))
        nodes = [n for n in ast.walk(tree) if hasattr(n, "lineno") and isinstance(n, (ast.expr, ast.keyword, ast.Import, ast.ImportFrom))]
        calls = {id(k): n for n in nodes if isinstance(n, ast.Call) for k in n.keywords}
        out = []
        for line, column in places:
            inside = [n for n in nodes if _covers(n, line, column)]
            inside.sort(key=lambda n: (n.lineno, n.col_offset, -(n.end_lineno or 0), -(n.end_col_offset or 0)))
            about, name = False, None
            for n in reversed(inside):
                if isinstance(n, (ast.Import, ast.ImportFrom)):
                    paths = [a.name for a in n.names] if isinstance(n, ast.Import) else [n.module or ""]
                    name = paths[0]
                    about = any(p == i or p.startswith(i + ".") for p in paths for i in imports)
                    break
                roots = _roots(calls[id(n)] if isinstance(n, ast.keyword) and id(n) in calls else n)
                if roots:
                    name = sorted(roots & known or roots)[0]
                    about = bool(roots & known)
                    break
            out.append((about, name))
        return out

    def run(key, code: pd.DataFrame, found: pd.DataFrame) -> pd.DataFrame:
        if not len(found):
            return found.assign(about=None, name=None)
        text, imports = (code["code"].iloc[0], list(code["imports"].iloc[0] if code["imports"].iloc[0] is not None else [])) if len(code) else ("", [])
        judged = judge(text, imports, list(zip(found["line"].astype(int), found["column"].astype(int), strict=True)))
        return found.assign(about=pd.array([a for a, _ in judged], dtype="boolean"), name=[n for _, n in judged])

    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in diagnostics.schema.fields)
    left = snippets.select("snippet", "code", "imports")
    return left.groupBy("snippet").cogroup(diagnostics.groupBy("snippet")).applyInPandas(run, f"{kinds}, about boolean, name string")
