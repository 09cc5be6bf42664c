"""Fact schemas, and the extraction of facts from source texts.

An adapter is a function (kind, source, module) -> rows of that kind's schema without its first column, the file. A text that cannot be
parsed gives no rows; unparsed() lists such files.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame

TREE = "struct<labels:array<string>,sizes:array<int>>"
SIGNATURE = "struct<name_tokens:array<string>,parameter_count:int,parameter_names:array<string>,parameter_type_paths:array<string>,return_type_paths:array<string>,generics:array<string>,receiver:string>"
SCHEMAS = {
    "functions": f"file string, name string, qualified_name string, module string, owner string, start_line int, end_line int, is_test boolean, tree {TREE}, signature {SIGNATURE}",
    "units": "file string, name string, start_line int, end_line int, cyclomatic int, cognitive int, max_nesting int, n1 long, n2 long, big_n1 long, big_n2 long",
    "methods": "file string, kind string, trait_name string, type_name string, unit_start int, unit_end int, method_idx int, name string, start_line int, end_line int, fields array<string>, calls array<string>",
    "wrappers": "file string, name string, start_line int, end_line int, callee string, adapters array<string>, statement_count int",
    "calls": "file string, caller_qualified_name string, caller_module string, caller_owner string, callee_name string, callee_path array<string>, receiver string, imports array<struct<alias:string,target:string,exported:string>>, line int",
    "imports": "file string, module string, level int, segments array<string>, names array<string>, kind string, line int",
    "mods": "file string, parent array<string>, name string, inline boolean, line int",
    "parsed": "file string, ok boolean",
}

Adapter = Callable[[str, str, str], list[tuple]]


class Unparsed(Exception):
    """The text is not of its language."""


def adapters() -> dict[str, Adapter]:
    from quarry.sources import brace_source, python_source

    return {"python": python_source.rows, "go": brace_source.go, "rust": brace_source.rust, "typescript": brace_source.typescript}


def extract(files: DataFrame, kind: str) -> DataFrame:
    """Facts of ``files`` (file, lang, module, source), each text parsed by its language's adapter, in Arrow batches."""
    names = [c.split(" ")[0] for c in _columns(SCHEMAS[kind])]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known = adapters()
        for batch in batches:
            rows = []
            for file, lang, module, source in zip(batch["file"], batch["lang"], batch["module"], batch["source"], strict=True):
                if lang in known and source is not None:
                    rows += [(file, *row) for row in _safely(known[lang], kind, source, module)]
            yield pd.DataFrame(rows, columns=names)

    return files.select("file", "lang", "module", "source").mapInPandas(run, SCHEMAS[kind])


def _safely(adapter: Adapter, kind: str, source: str, module: str) -> list[tuple]:
    if kind == "parsed":
        try:
            adapter("units", source, module)
        except Unparsed:
            return [(False,)]
        return [(True,)]
    try:
        return adapter(kind, source, module)
    except Unparsed:
        return []


def unparsed(files: DataFrame) -> DataFrame:
    return extract(files, "parsed").where("not ok").select("file")


def _columns(schema: str) -> list[str]:
    """The columns of a schema string; commas inside angle brackets do not part them."""
    out, depth, last = [], 0, 0
    for i, c in enumerate(schema):
        depth += (c == "<") - (c == ">")
        if c == "," and not depth:
            out.append(schema[last:i].strip())
            last = i + 1
    return [*out, schema[last:].strip()]


class Counts:
    """Cyclomatic and cognitive complexity, nesting and Halstead counts of one function."""

    def __init__(self) -> None:
        self.branches = self.cognitive = self.nesting = self.deepest = 0
        self.operators: dict[str, int] = {}
        self.operands: dict[str, int] = {}

    def op(self, name: str) -> None:
        self.operators[name] = self.operators.get(name, 0) + 1

    def operand(self, name: str) -> None:
        self.operands[name] = self.operands.get(name, 0) + 1

    def branch(self, weight: int = 1, nested: bool = True) -> None:
        """A decision: one path more, and cognitive cost by depth."""
        self.branches += weight
        self.cognitive += 1 + self.nesting if nested else 1

    def __enter__(self) -> Counts:
        self.nesting += 1
        self.deepest = max(self.deepest, self.nesting)
        return self

    def __exit__(self, *_) -> None:
        self.nesting -= 1

    def row(self) -> tuple[int, int, int, int, int, int, int]:
        return 1 + self.branches, self.cognitive, self.deepest, len(self.operators), len(self.operands), sum(self.operators.values()), sum(self.operands.values())


def qualify(module: str, *names: str | None) -> str:
    return "::".join(n for n in (module, *names) if n)
