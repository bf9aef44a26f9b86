"""API objects of Python sources, one row each."""

from __future__ import annotations

import ast
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators.lineage import cut

PARAM = "struct<name:string,kind:string,annotation:string,has_default:boolean,types:array<string>>"
#: ``bases``, ``decorators`` and ``returns`` are dotted paths as the module's imports resolve them.
#: ``binding`` is "sometimes" for names bound on some paths of a block only, "main" below a check of
#: ``__name__``.  ``value`` says what an attribute holds: "data", "per_module" (a logger, a type
#: variable), "name" (another name, in ``target``) or "other".  ``sets`` has the attributes that a
#: class's methods name on ``self``; ``dynamic`` tells modules that bind names by ``globals()``.
OBJECTS = (
    "package string, version string, path string, parent string, name string, kind string, target string, is_public boolean, "
    f"signature string, doc string, deprecated string, params array<{PARAM}>, overloads array<array<{PARAM}>>, bases array<string>, decorators array<string>, "
    "returns array<string>, value string, binding string, listed boolean, is_property boolean, calls_super boolean, sets array<string>, dynamic boolean, error string"
)
LIMIT = 400
#: Calls whose results belong to each module, and annotations and forms that are plain data.
PER_MODULE = frozenset(["getLogger", "get_logger", "TypeVar", "ParamSpec", "TypeVarTuple"])
DATA = frozenset("int float complex str bytes bool None list dict set tuple frozenset bytearray Literal List Dict Set Tuple".split())


def _params(args: ast.arguments, types) -> list[dict]:
    def row(arg: ast.arg, kind: str, default) -> dict:
        return {"name": arg.arg, "kind": kind, "annotation": ast.unparse(arg.annotation) if arg.annotation else None, "has_default": default is not None, "types": types(arg.annotation)}

    placed = [*((a, "positional_only") for a in args.posonlyargs), *((a, "positional_or_keyword") for a in args.args)]
    defaults = [None] * (len(placed) - len(args.defaults)) + list(args.defaults)
    out = [row(a, kind, d) for (a, kind), d in zip(placed, defaults, strict=True)]
    if args.vararg:
        out.append(row(args.vararg, "var_positional", None))
    out += [row(a, "keyword_only", d) for a, d in zip(args.kwonlyargs, args.kw_defaults, strict=True)]
    if args.kwarg:
        out.append(row(args.kwarg, "var_keyword", None))
    return out


def _deprecation(node: ast.AST, doc: str | None) -> str | None:
    """The message of a deprecation decorator, else the docstring's sentence that says so."""
    for d in getattr(node, "decorator_list", []):
        call = d if isinstance(d, ast.Call) else None
        name = ast.unparse(call.func if call else d)
        if "deprecat" in name.lower():
            texts = [a.value for a in (call.args if call else []) if isinstance(a, ast.Constant) and isinstance(a.value, str)]
            return (texts[0] if texts else name)[:300]
    for sentence in (doc or "").replace("\n", " ").split(". "):
        if "deprecat" in sentence.lower():
            return sentence.strip()[:300]
    return None


def dotted(node: ast.AST) -> str | None:
    """"a.b.c" for names read with dots, else None."""
    parts = []
    while isinstance(node, ast.Attribute):
        parts.append(node.attr)
        node = node.value
    return ".".join([node.id, *reversed(parts)]) if isinstance(node, ast.Name) else None


class _Module:
    """One module's names, and its objects as rows."""

    def __init__(self, module: str, is_package: bool, tree: ast.Module):
        self.module, self.tree = module, tree
        self.names: dict[str, str] = {}
        for node in ast.walk(tree):
            if isinstance(node, ast.Import):
                for a in node.names:
                    top = a.name.split(".")[0]
                    self.names[a.asname or top] = a.name if a.asname else top
            elif isinstance(node, ast.ImportFrom):
                base = self.source(node, is_package)
                self.names.update({a.asname or a.name: f"{base}.{a.name}" for a in node.names if a.name != "*"})
        for node in tree.body:
            if isinstance(node, (ast.ClassDef, ast.FunctionDef, ast.AsyncFunctionDef)):
                self.names[node.name] = f"{module}.{node.name}"
        self.is_package = is_package
        self.listed = self._listed()

    def source(self, node: ast.ImportFrom, is_package: bool) -> str:
        up = self.module.split(".")
        if node.level:
            up = up[: len(up) - node.level + is_package]
        return ".".join([*(up if node.level else []), *([node.module] if node.module else [])])

    def resolve(self, path: str | None) -> str | None:
        if path is None:
            return None
        head, dot, rest = path.partition(".")
        return self.names.get(head, head) + dot + rest

    def _listed(self) -> set[str] | None:
        """Names in ``__all__``, also those that are added to it; None without one."""
        found: set[str] | None = None

        def strings(node: ast.AST) -> set[str]:
            return {n.value for n in ast.walk(node) if isinstance(n, ast.Constant) and isinstance(n.value, str)}

        for node in ast.walk(self.tree):
            named = [*getattr(node, "targets", []), getattr(node, "target", None)]
            if isinstance(node, (ast.Assign, ast.AnnAssign, ast.AugAssign)) and any(isinstance(t, ast.Name) and t.id == "__all__" for t in named):
                found = (found or set()) | (strings(node.value) if node.value else set())
            elif isinstance(node, ast.Call) and dotted(node.func) in ("__all__.append", "__all__.extend"):
                found = (found or set()) | set().union(*map(strings, node.args))
        return found

    def types(self, node: ast.AST | None) -> list[str] | None:
        """The classes that an annotation names, alone or in a union; None for anything else."""
        if isinstance(node, ast.Constant):
            if node.value is None:
                return []
            try:
                return self.types(ast.parse(node.value, mode="eval").body) if isinstance(node.value, str) else None
            except (SyntaxError, ValueError):
                return None
        if isinstance(node, ast.BinOp) and isinstance(node.op, ast.BitOr):
            sides = self.types(node.left), self.types(node.right)
            return None if None in sides else sides[0] + sides[1]
        if isinstance(node, ast.Subscript):
            form = (dotted(node.value) or "").rpartition(".")[2]
            if form in ("Optional", "Union"):
                parts = [self.types(p) for p in (node.slice.elts if isinstance(node.slice, ast.Tuple) else [node.slice])]
                return None if None in parts else sum(parts, [])
            return None
        path = dotted(node) if node is not None else None
        if path is None or path.rpartition(".")[2] in DATA:
            return None
        return ["Self"] if path.rpartition(".")[2] == "Self" else [self.resolve(path)]

    def value(self, node: ast.AST | None, annotation: ast.AST | None) -> tuple[str | None, str | None]:
        """What an attribute holds, and the path it names."""
        if isinstance(node, ast.Call):
            called = dotted(node.func)
            return ("per_module", None) if called and called.rpartition(".")[2] in PER_MODULE else ("other", None)
        if isinstance(node, (ast.Constant, ast.List, ast.Dict, ast.Set, ast.Tuple, ast.JoinedStr)):
            return "data", None
        if isinstance(node, (ast.Name, ast.Attribute)):
            return "name", self.resolve(dotted(node))
        if node is None and annotation is not None:
            head = annotation.value if isinstance(annotation, ast.Subscript) else annotation
            return ("data" if (dotted(head) or "").rpartition(".")[2] in DATA else "other"), None
        return "other", None

    def rows(self) -> Iterator[dict]:
        public = not any(p.startswith("_") for p in self.module.split("."))
        dynamic = any(isinstance(n, ast.Call) and dotted(n.func) in ("globals", "vars", "setattr") for n in ast.walk(self.tree))
        parent, _, name = self.module.rpartition(".")
        yield {"path": self.module, "parent": parent or None, "name": name, "kind": "module", "is_public": public, "dynamic": dynamic, "signature": f"module {self.module}", "doc": _summary(ast.get_docstring(self.tree))}
        yield from self.visit(self.tree.body, self.module, public, None, None)

    def visit(self, body: list[ast.stmt], path: str, public: bool, binding: str | None, owner: ast.ClassDef | None) -> Iterator[dict]:
        overloads: dict[str, list] = {}
        done = Counter(n.name for n in body if isinstance(n, (ast.FunctionDef, ast.AsyncFunctionDef)))
        for node in body:
            if isinstance(node, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)):
                decorators = [self.resolve(dotted(d.func if isinstance(d, ast.Call) else d)) or "" for d in node.decorator_list]
                done[node.name] -= not isinstance(node, ast.ClassDef)
                if any(d.rpartition(".")[2] == "overload" for d in decorators):
                    overloads.setdefault(node.name, []).append(_params(node.args, self.types))
                    if done[node.name] > 0:  # a stub's last overload stands for the function
                        continue
                if any(d.rpartition(".")[2] in ("setter", "deleter") for d in decorators):
                    continue
                yield from self.definition(node, path, public, binding, owner, decorators, overloads.get(node.name, []))
            elif isinstance(node, (ast.Assign, ast.AnnAssign)):
                targets = node.targets if isinstance(node, ast.Assign) else [node.target]
                kind, target = self.value(node.value, getattr(node, "annotation", None))
                for t in [e for t in targets for e in (t.elts if isinstance(t, (ast.Tuple, ast.List)) else [t])]:
                    if isinstance(t, ast.Name) and t.id != "__all__":
                        yield self.named(path, t.id, public, binding, owner) | {"kind": "attribute", "value": kind, "target": target, "returns": self.types(getattr(node, "annotation", None))}
            elif isinstance(node, ast.ImportFrom) and owner is None:
                base = self.source(node, self.is_package)
                for a in node.names:
                    if a.name == "*":
                        yield self.named(path, f"* {base}", False, binding, owner) | {"kind": "star", "target": base}
                        continue
                    row = self.named(path, a.asname or a.name, public, binding, owner)
                    # an import is meant for others in a package, under its own name again, or if listed
                    meant = self.is_package or a.asname == a.name or bool(row["listed"])
                    yield row | {"kind": "alias", "target": f"{base}.{a.name}", "is_public": row["is_public"] and meant}
            elif isinstance(node, ast.If):
                test = ast.unparse(node.test)
                inside = "main" if "__name__" in test else binding if "TYPE_CHECKING" in test else binding or "sometimes"
                yield from self.visit(node.body, path, public, inside, owner)
                yield from self.visit(node.orelse, path, public, binding or "sometimes", owner)
            elif isinstance(node, ast.Try):
                for part in (node.body, *(h.body for h in node.handlers), node.orelse, node.finalbody):
                    yield from self.visit(part, path, public, binding or "sometimes", owner)

    def named(self, path: str, name: str, public: bool, binding: str | None, owner: ast.ClassDef | None) -> dict:
        listed = owner is None and self.listed is not None and name in self.listed
        open_ = public and binding != "main" and (listed or not name.startswith("_") or name == "__init__")
        return {"path": f"{path}.{name}", "parent": path, "name": name, "is_public": open_, "binding": binding, "listed": listed}

    def definition(self, node, path: str, public: bool, binding: str | None, owner: ast.ClassDef | None, decorators: list[str], overloads: list) -> Iterator[dict]:
        doc = ast.get_docstring(node)
        row = self.named(path, node.name, public, binding, owner) | {"doc": _summary(doc), "deprecated": _deprecation(node, doc), "decorators": decorators, "overloads": overloads, "params": []}
        own = row["path"]
        if not isinstance(node, ast.ClassDef):
            prefix = "property" if any(d.rpartition(".")[2].lower().endswith("property") for d in decorators) else None
            supers = {n.func.attr for n in ast.walk(node) if isinstance(n, ast.Call) and isinstance(n.func, ast.Attribute) and isinstance(n.func.value, ast.Call) and dotted(n.func.value.func) == "super"}
            yield row | {
                "kind": "function", "signature": f"{node.name}({ast.unparse(node.args)})"[:LIMIT], "params": _params(node.args, self.types), "returns": self.types(node.returns),
                "is_property": prefix is not None, "calls_super": node.name in supers,
            }
            return
        on_self = {n.attr for n in ast.walk(node) if isinstance(n, ast.Attribute) and isinstance(n.value, ast.Name) and n.value.id == "self"}
        bases = [self.resolve(dotted(b.value if isinstance(b, ast.Subscript) else b)) for b in node.bases]
        yield row | {"kind": "class", "bases": [b for b in bases if b], "sets": sorted(on_self), "signature": f"class {node.name}"}
        yield from self.visit(node.body, own, row["is_public"], None, node)
        held = {n.name for n in node.body if isinstance(n, (ast.FunctionDef, ast.AsyncFunctionDef))} | {t.id for n in node.body if isinstance(n, (ast.Assign, ast.AnnAssign)) for t in (n.targets if isinstance(n, ast.Assign) else [n.target]) if isinstance(t, ast.Name)}
        for m in node.body:
            if isinstance(m, ast.FunctionDef) and m.name == "__init__":
                for n in ast.walk(m):
                    for t in n.targets if isinstance(n, ast.Assign) else [n.target] if isinstance(n, ast.AnnAssign) else []:
                        if isinstance(t, ast.Attribute) and isinstance(t.value, ast.Name) and t.value.id == "self" and t.attr not in held:
                            held.add(t.attr)
                            kind, _ = self.value(n.value, getattr(n, "annotation", None))
                            yield self.named(own, t.attr, row["is_public"], None, node) | {"kind": "attribute", "value": kind, "returns": self.types(getattr(n, "annotation", None))}


def _summary(doc: str | None) -> str | None:
    return (doc or "").split("\n\n")[0][:LIMIT] or None


def module_of_file(path: str) -> tuple[str, bool]:
    parts = path.removesuffix(".pyi").removesuffix(".py").split("/")
    is_package = parts[-1] == "__init__"
    return ".".join(parts[:-1] if is_package else parts), is_package


def api_objects(sources: DataFrame) -> DataFrame:
    """``OBJECTS`` of ``sources`` (package, version, path, text); a path is a file within the
    release.  A file that doesn't parse gives one row with ``error``; null texts are empty.
    Of a name that a file binds again the last binding counts, but for a function that follows
    its overloads; a stub file (``.pyi``) counts before the module of the same name."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        columns = [c.strip().split(" ")[0] for c in OBJECTS.replace(PARAM, "x").split(", ")]
        for batch in batches:
            found = []
            for package, version, path, text in batch[["package", "version", "path", "text"]].itertuples(index=False):
                module, is_package = module_of_file(path)
                both = {"package": package, "version": version}
                try:
                    rows = {row["path"]: row for row in _Module(module, is_package, ast.parse(text or "")).rows()}
                    found += [both | row for row in rows.values()]
                except (SyntaxError, ValueError, RecursionError) as e:
                    found.append(both | {"path": module, "name": module, "kind": "module", "error": str(e)[:200]})
            yield pd.DataFrame([{c: row.get(c) for c in columns} for row in found], columns=columns)

    stub = F.col("path").endswith(".pyi")
    files = sources.select("package", "version", "path", "text", F.regexp_replace("path", r"\.pyi?$", "").alias("_m"))
    first = files.where(stub).select("package", "version", "_m").distinct().withColumn("_stub", F.lit(True))
    files = files.join(first, ["package", "version", "_m"], "left").where(stub | F.col("_stub").isNull())
    return files.select("package", "version", "path", "text").mapInPandas(run, OBJECTS)


def expand_stars(objects: DataFrame, rounds: int = 5) -> DataFrame:
    """``objects`` with an alias row for every public name that a star import brings, ``value`` "star".

    Star imports of star imports are followed ``rounds`` times, which is the operator's bound.  Names
    that the target only imports for itself, and names bound in the module itself, aren't added."""
    objects = cut(objects)  # parsed once
    stars = objects.where("kind = 'star'").select("package", "version", F.col("parent").alias("_into"), F.col("target").alias("_from"))
    known = objects.where("kind <> 'star'")
    columns = known.columns
    if not stars.limit(1).count():
        return known
    for _ in range(rounds):
        given = known.where("is_public and name not like '\\\\_%' and kind <> 'module'")
        given = given.select("package", "version", F.col("parent").alias("_from"), "name", F.when(F.col("kind") == "alias", F.col("target")).otherwise(F.col("path")).alias("_to"))
        into = F.concat_ws(".", "_into", "name")
        fresh = stars.join(given, ["package", "version", "_from"]).select("package", "version", into.alias("path"), F.col("_into").alias("parent"), "name", F.col("_to").alias("target")).distinct()
        fresh = fresh.join(known.select("package", "version", "path"), ["package", "version", "path"], "left_anti").dropDuplicates(["package", "version", "path"])
        public = ~F.exists(F.split("parent", "[.]"), lambda p: p.startswith("_"))
        fresh = cut(fresh.withColumns({"kind": F.lit("alias"), "value": F.lit("star"), "is_public": public}))
        if not fresh.limit(1).count():
            break
        known = known.unionByName(fresh, allowMissingColumns=True).select(*columns)
    return known


def public_paths(objects: DataFrame) -> DataFrame:
    """(package, canonical, public): an object's own public path and those of its aliases.

    Chains of aliases are followed by pointer doubling until no pointer changes; a cycle leads nowhere
    and its links stay as they are."""
    alias = objects.where("kind = 'alias' and is_public").select("package", F.col("path").alias("public"), F.col("target").alias("canonical"))
    own = objects.where("kind not in ('alias', 'star') and is_public").select("package", F.col("path").alias("canonical"), F.col("path").alias("public"))
    hops = objects.where("kind = 'alias' and path <> target").select("package", F.col("path").alias("canonical"), F.col("target").alias("next"))
    hops = hops.dropDuplicates(["package", "canonical"])
    hops = cut(hops)
    links = hops.join(hops.select("package", F.col("canonical").alias("next")), ["package", "next"], "left_semi").count()
    for _ in range(links.bit_length()):  # chains are no longer than the links that have a next one
        further = hops.select("package", F.col("canonical").alias("next"), F.col("next").alias("_end"))
        hops = cut(hops.join(further, ["package", "next"], "left").select("package", "canonical", F.coalesce("_end", "next").alias("next"), F.col("_end").isNotNull().alias("_moved")))
        moved = hops.where("_moved").limit(1).count()
        hops = hops.drop("_moved")
        if not moved:
            break
    followed = alias.join(hops, ["package", "canonical"], "left").select("package", F.coalesce("next", "canonical").alias("canonical"), "public")
    return own.unionByName(followed).distinct()


def served_names(sources: DataFrame) -> DataFrame:
    """(package, version, module, name, warns): names that a module's ``__getattr__`` hands out.

    Names are the strings that its argument is compared with or looked up in, literal or in a
    table of the module; ``warns`` says whether the function warns.  Files that don't parse give none."""

    def strings(node: ast.AST | None) -> set[str]:
        parts = node.keys if isinstance(node, ast.Dict) else node.elts if isinstance(node, (ast.Tuple, ast.List, ast.Set)) else [node]
        return {p.value for p in parts if isinstance(p, ast.Constant) and isinstance(p.value, str)}

    def served(tree: ast.Module) -> Iterator[tuple[str, bool]]:
        tables = {t.id: n.value for n in tree.body if isinstance(n, ast.Assign) for t in n.targets if isinstance(t, ast.Name)}
        tables |= {n.target.id: n.value for n in tree.body if isinstance(n, ast.AnnAssign) and isinstance(n.target, ast.Name)}
        for f in tree.body:
            if not (isinstance(f, ast.FunctionDef) and f.name == "__getattr__" and f.args.args):
                continue
            asked, found, warns = f.args.args[0].arg, set(), False
            is_asked = lambda n: isinstance(n, ast.Name) and n.id == asked
            known = lambda n: strings(tables.get(n.id) if isinstance(n, ast.Name) else n)
            for n in ast.walk(f):
                if isinstance(n, ast.Compare) and any(map(is_asked, [n.left, *n.comparators])):
                    found |= {x for side in (n.left, *n.comparators) if not is_asked(side) for x in known(side)}
                elif isinstance(n, ast.Subscript) and is_asked(n.slice):
                    found |= known(n.value)
                elif isinstance(n, ast.Call):
                    warns |= "warn" in ast.unparse(n.func).lower()
                    if isinstance(n.func, ast.Attribute) and n.func.attr == "get" and n.args and is_asked(n.args[0]):
                        found |= known(n.func.value)
            yield from ((name, warns) for name in sorted(found))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = []
            for package, version, path, text in batch[["package", "version", "path", "text"]].itertuples(index=False):
                module, _ = module_of_file(path)
                try:
                    found += [(package, version, module, *row) for row in served(ast.parse(text or ""))]
                except (SyntaxError, ValueError, RecursionError):
                    continue
            yield pd.DataFrame(found, columns=["package", "version", "module", "name", "warns"]).astype({"warns": "boolean"})

    return sources.select("package", "version", "path", "text").mapInPandas(run, "package string, version string, module string, name string, warns boolean")


def parameter_reads(sources: DataFrame) -> DataFrame:
    """SF37: (package, version, function, key, callee, line): strings that a function looks up in a mapping
    (``kwargs.pop("x")``, ``kwargs["x"]``, ``"x" in kwargs``), and the functions that it calls (key null).

    ``changes.still_read`` joins a decorator to what it calls over these rows."""

    def rows(module: _Module) -> Iterator[tuple]:
        def inside(body, path: str) -> Iterator[tuple]:
            for node in body:
                if isinstance(node, ast.ClassDef):
                    yield from inside(node.body, f"{path}.{node.name}")
                elif isinstance(node, (ast.FunctionDef, ast.AsyncFunctionDef)):
                    own = f"{path}.{node.name}"
                    for n in ast.walk(node):
                        key = None
                        if isinstance(n, ast.Call):
                            called = dotted(n.func)
                            if isinstance(n.func, ast.Attribute) and n.func.attr in ("get", "pop") and n.args:
                                key = n.args[0]
                            elif called:
                                yield own, None, module.resolve(called), n.lineno
                        elif isinstance(n, ast.Subscript):
                            key = n.slice
                        elif isinstance(n, ast.Compare) and any(isinstance(o, (ast.In, ast.NotIn)) for o in n.ops):
                            key = n.left
                        if isinstance(key, ast.Constant) and isinstance(key.value, str):
                            yield own, key.value, None, n.lineno
                    for d in node.decorator_list:
                        yield own, None, module.resolve(dotted(d.func if isinstance(d, ast.Call) else d)), node.lineno

        yield from inside(module.tree.body, module.module)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = []
            for package, version, path, text in batch[["package", "version", "path", "text"]].itertuples(index=False):
                try:
                    found += [(package, version, *r) for r in rows(_Module(*module_of_file(path), ast.parse(text or "")))]
                except (SyntaxError, ValueError, RecursionError):
                    continue
            yield pd.DataFrame(found, columns=["package", "version", "function", "key", "callee", "line"]).astype({"line": "Int32"})

    return sources.select("package", "version", "path", "text").mapInPandas(run, "package string, version string, function string, key string, callee string, line int")
