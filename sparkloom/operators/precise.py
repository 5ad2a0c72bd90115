"""References across files by what files import: which lines mean a definition, not merely its name.

Python files tell, by their own syntax, what they define at the top, what they import under which names, and where they use
those names. A use is followed through imports, and through files that only pass a name on, one join a step, until no step
finds anything new. Star imports are followed too. Other languages are not read here.
"""

from __future__ import annotations

import ast
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources import shared

FACTS = "path string, kind string, name string, line int, target string, member string"


def module_of(path: str) -> str:
    """The dotted name of a file: a/b/c.py and a/b/c/__init__.py are a.b.c."""
    parts = path.removesuffix(".pyi").removesuffix(".py").split("/")
    return ".".join(parts[:-1] if parts[-1] == "__init__" else parts)


class _Facts(ast.NodeVisitor):
    def __init__(self, path: str) -> None:
        self.rows: list[tuple[str, str, int, str, str]] = []
        self.package = module_of(path) if path.endswith("__init__.py") else module_of(path).rpartition(".")[0]
        self.bound: list[set[str]] = []

    def add(self, kind: str, name: str, line: int, target: str = "", member: str = "") -> None:
        self.rows.append((kind, name, line, target, member))

    def visit_Import(self, node: ast.Import) -> None:
        for a in node.names:
            # `import a.b` binds a; a use of a.b.f goes through it by its whole name.
            self.add("import", a.asname or a.name, node.lineno, a.name)

    def visit_ImportFrom(self, node: ast.ImportFrom) -> None:
        base = self.package.split(".") if node.level else []
        base = base[: len(base) - (node.level - 1)] if node.level else []
        module = ".".join([*[b for b in base if b], *([node.module] if node.module else [])])
        for a in node.names:
            self.add("star" if a.name == "*" else "import", a.asname or a.name, node.lineno, module, a.name)

    def scope(self, node: ast.AST, names: set[str]) -> None:
        self.bound.append(names)
        self.generic_visit(node)
        self.bound.pop()

    def visit_FunctionDef(self, node: ast.FunctionDef | ast.AsyncFunctionDef) -> None:
        if not self.bound:
            self.add("define", node.name, node.lineno)
        args = node.args
        names = {a.arg for a in (*args.posonlyargs, *args.args, *args.kwonlyargs, *filter(None, (args.vararg, args.kwarg)))}
        names |= {n.id for n in ast.walk(node) if isinstance(n, ast.Name) and isinstance(n.ctx, ast.Store)}
        self.scope(node, names)

    visit_AsyncFunctionDef = visit_FunctionDef

    def visit_ClassDef(self, node: ast.ClassDef) -> None:
        if not self.bound:
            self.add("define", node.name, node.lineno)
        self.scope(node, set())

    def visit_Name(self, node: ast.Name) -> None:
        if isinstance(node.ctx, ast.Load) and not any(node.id in names for names in self.bound):
            self.add("use", node.id, node.lineno)

    def visit_Attribute(self, node: ast.Attribute) -> None:
        parts, at = [node.attr], node.value
        while isinstance(at, ast.Attribute):
            parts.append(at.attr)
            at = at.value
        if isinstance(at, ast.Name) and not any(at.id in names for names in self.bound):
            parts.append(at.id)
            parts.reverse()
            for k in range(1, len(parts)):
                self.add("use", ".".join(parts[:k]), node.lineno, member=parts[k])
        self.generic_visit(node)


def facts(files: DataFrame) -> DataFrame:
    """What the Python files of files(path, text) define, import and use; a file that does not parse tells nothing."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts:
            rows = []
            for path, text in zip(batch.column("path").to_pylist(), batch.column("text").to_pylist(), strict=True):
                try:
                    tree = ast.parse(text or "")
                except (SyntaxError, ValueError, RecursionError, MemoryError):
                    continue
                found = _Facts(path)
                found.visit(tree)
                rows += [(path, *r) for r in found.rows]
            if rows:
                cols = list(zip(*rows, strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int32() if i == 3 else pa.string()) for i, c in enumerate(cols)], ["path", "kind", "name", "line", "target", "member"])

    return shared.dealt(files.filter("path like '%.py' or path like '%.pyi'").select("path", "text")).mapInArrow(run, FACTS)


def references(files: DataFrame, most: int = 64) -> DataFrame:
    """(def_file, def_line, ref_file, ref_line) of every use of a definition at the top of a Python file, in the same file or
    through imports; a name defined twice counts where it is defined last."""
    f = shared.written(facts(files), "facts")
    module = F.regexp_replace(F.regexp_replace(F.regexp_replace("path", r"\.pyi?$", ""), r"/?__init__$", ""), "/", ".")
    modules = files.select("path").withColumn("module", module).filter("path like '%.py' or path like '%.pyi'").groupBy("module").agg(F.min("path").alias("file"))
    defs = shared.written(f.filter("kind = 'define'").groupBy(F.col("path").alias("file"), "name").agg(F.max("line").alias("def_line")), "defs")
    imports = f.filter("kind = 'import'").groupBy("path", "name").agg(F.max(F.struct("line", "target", "member")).alias("i")).select("path", "name", "i.target", "i.member")
    # What a name of a file stands for: a name of another file, or a whole one (member '').
    sub = imports.filter("member <> ''").join(modules.select(F.concat_ws(".", "module").alias("whole"), F.col("file").alias("to_file")), F.concat_ws(".", F.when(F.col("target") != "", F.col("target")), "member") == F.col("whole"))
    into = imports.join(modules.select(F.col("module").alias("target"), F.col("file").alias("to_file")), "target").select("path", "name", "to_file", F.col("member").alias("to_name"))
    named = into.unionByName(sub.select("path", "name", "to_file", F.lit("").alias("to_name")))
    stars = f.filter("kind = 'star'").select("path", "target").distinct().join(modules.select(F.col("module").alias("target"), F.col("file").alias("to_file")), "target").select("path", "to_file")
    named, stars = shared.written(named.distinct(), "names"), shared.written(stars, "stars")

    # A use of a name, or of a member of a file that a name stands for, is a question (file, name) put to some file.
    uses = f.filter("kind = 'use'").select("path", F.col("line").alias("ref_line"), "name", "member")
    plain = uses.filter("member = ''").select(F.col("path").alias("ref_file"), "ref_line", F.col("path").alias("file"), "name")
    through = uses.filter("member <> ''").join(named.filter("to_name = ''"), ["path", "name"]).select(F.col("path").alias("ref_file"), "ref_line", F.col("to_file").alias("file"), F.col("member").alias("name"))
    asked = shared.written(plain.unionByName(through).distinct(), "asked")
    seen, found = asked, None
    key = ["ref_file", "ref_line", "file", "name"]
    for _ in range(most):
        hit = asked.join(defs, ["file", "name"])
        found = hit if found is None else found.unionByName(hit)
        left = asked.join(defs, ["file", "name"], "left_anti")
        passed = left.join(named.filter("to_name <> ''").withColumnRenamed("path", "file"), ["file", "name"]).select("ref_file", "ref_line", F.col("to_file").alias("file"), F.col("to_name").alias("name"))
        starred = left.join(stars.withColumnRenamed("path", "file"), "file").select("ref_file", "ref_line", F.col("to_file").alias("file"), "name")
        asked = shared.written(passed.unionByName(starred).distinct().join(seen.select(key), key, "left_anti"), "asked")
        if asked.isEmpty():
            return found.select(F.col("file").alias("def_file"), "def_line", "ref_file", "ref_line").distinct()
        seen = seen.unionByName(asked)
    raise RuntimeError(f"names are passed on more than {most} times")
