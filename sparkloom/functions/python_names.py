"""What Python files say of names, as the facts that operators.paths resolves: scopes, definitions, imports, classes, uses."""

from __future__ import annotations

import ast
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import paths
from ..operators.precise import module_of
from ..sources import shared

_ROW = "file string, kind string, scope string, name string, line int, target array<string>, other string"
_TYPES = [pa.string(), pa.string(), pa.string(), pa.string(), pa.int32(), pa.list_(pa.string()), pa.string()]


def _dotted(node: ast.AST) -> list[str] | None:
    """a.b.c as its names; a call stands for what it calls, as an instance has its class's members."""
    parts: list[str] = []
    node = node.func if isinstance(node, ast.Call) else node
    while isinstance(node, ast.Attribute):
        parts.append(node.attr)
        node = node.value
    return [node.id, *reversed(parts)] if isinstance(node, ast.Name) else None


class _Names(ast.NodeVisitor):
    """Rows of one file. frames are the open scopes: (scope, whether it is a class, the class names since the last other scope)."""

    def __init__(self, path: str) -> None:
        self.rows: list[tuple] = []
        self.frames: list[tuple[str, bool, list[str]]] = [("", False, [])]
        self.package = module_of(path) if path.endswith("__init__.py") else module_of(path).rpartition(".")[0]

    def add(self, kind: str, name: str = "", line: int | None = None, target: list[str] | None = None, other: str | None = None, scope: str | None = None) -> None:
        self.rows.append((kind, self.frames[-1][0] if scope is None else scope, name, line, target, other))

    def visible(self) -> str:
        """The scope whose names an inner scope sees: class bodies are passed over."""
        return next(scope for scope, is_class, _ in reversed(self.frames) if not is_class)

    def opened(self, name: str, line: int, is_class: bool) -> str:
        scope = f"{self.frames[-1][0]}/{name}@{line}"
        self.add("scope", other=self.visible(), scope=scope)
        self.frames.append((scope, is_class, [*self.frames[-1][2], name] if is_class else []))
        return scope

    def visit_Import(self, node: ast.Import) -> None:  # noqa: N802
        for a in node.names:
            whole = a.name.split(".")
            self.add("alias", a.asname or whole[0], target=whole if a.asname else whole[:1], other="module")

    def visit_ImportFrom(self, node: ast.ImportFrom) -> None:  # noqa: N802
        base = [b for b in self.package.split(".") if b] if node.level else []
        base = base[: len(base) - (node.level - 1)] if node.level else []
        module = [*base, *(node.module.split(".") if node.module else [])]
        for a in node.names:
            if a.name == "*":
                self.add("star", target=module)
            else:
                self.add("alias", a.asname or a.name, target=[*module, a.name], other="module")

    def visit_ClassDef(self, node: ast.ClassDef) -> None:  # noqa: N802
        for x in (*node.decorator_list, *node.bases, *(k.value for k in node.keywords)):
            self.visit(x)
        scope = self.opened(node.name, node.lineno, True)
        outer = self.frames[-2][0]
        self.add("define", node.name, node.lineno, other=scope, scope=outer)
        for base in node.bases:
            if (target := _dotted(base)) is not None:
                self.add("base", target=target)
        for x in node.body:
            self.visit(x)
        self.frames.pop()

    def visit_FunctionDef(self, node: ast.FunctionDef | ast.AsyncFunctionDef) -> None:  # noqa: N802
        self.add("define", node.name, node.lineno)
        for x in (*node.decorator_list, *node.args.defaults, *filter(None, node.args.kw_defaults)):
            self.visit(x)
        method, classes = self.frames[-1][1], self.frames[-1][2]
        static = any(isinstance(d, ast.Name) and d.id == "staticmethod" for d in node.decorator_list)
        self.opened(node.name, node.lineno, False)
        given = [a.arg for a in (*node.args.posonlyargs, *node.args.args, *node.args.kwonlyargs, *filter(None, (node.args.vararg, node.args.kwarg)))]
        for i, name in enumerate(given):
            if i == 0 and method and not static:
                self.add("alias", name, target=classes, other="scope")  # the object of a method has its class's members
            else:
                self.add("define", name)
        for x in node.body:
            self.visit(x)
        self.frames.pop()

    visit_AsyncFunctionDef = visit_FunctionDef

    def visit_Assign(self, node: ast.Assign) -> None:  # noqa: N802
        target = _dotted(node.value)
        for t in node.targets:
            if isinstance(t, ast.Name) and target is not None and target[0] != t.id:
                self.add("alias", t.id, target=target, other="scope")
            else:
                self.visit(t)
        self.visit(node.value)

    def visit_Name(self, node: ast.Name) -> None:  # noqa: N802
        if isinstance(node.ctx, ast.Load):
            self.add("use", line=node.lineno, target=[node.id])
        else:
            self.add("define", node.id)  # a name of its own, which hides outer ones and is no definition to be found

    def visit_Attribute(self, node: ast.Attribute) -> None:  # noqa: N802
        whole = _dotted(node)
        if whole is not None and isinstance(node.ctx, ast.Load):
            self.add("use", line=node.lineno, target=whole)
        self.generic_visit(node)


def facts(files: DataFrame) -> paths.Facts:
    """The facts of the Python files of files(path, text); a file that does not parse tells nothing. The first parameter of a
    method stands for its class, a name that is given a dotted name or a call for what that is."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts:
            rows = []
            for path, text in zip(batch.column("path").to_pylist(), batch.column("text").to_pylist(), strict=True):
                try:
                    tree = ast.parse(text or "")
                    found = _Names(path)
                    found.visit(tree)
                except (SyntaxError, ValueError, RecursionError, MemoryError):
                    continue
                rows += [(path, "module", "", "", None, module_of(path).split("."), None), *((path, *r) for r in found.rows)]
            cols = list(zip(*rows, strict=True)) if rows else [[]] * len(_TYPES)
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(cols, _TYPES, strict=True)], [x.split()[0] for x in _ROW.split(", ")])

    rows = shared.written(shared.dealt(files.filter("path like '%.py' or path like '%.pyi'").select("path", "text")).mapInArrow(run, _ROW), "names")
    of = lambda kind: rows.filter(F.col("kind") == kind)
    return paths.Facts(
        of("module").select("file", F.col("target").alias("name")), of("scope").select("file", "scope", F.col("other").alias("parent")),
        of("define").select("file", "scope", "name", "line", F.col("other").alias("inner")), of("alias").select("file", "scope", "name", "target", (F.col("other") == "module").alias("absolute")),
        of("star").select("file", "scope", "target"), of("base").select("file", "scope", "target"), of("use").select("file", "scope", "line", F.col("target").alias("name")),
    )
