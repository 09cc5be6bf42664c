"""Source trees as DataFrames.

Paths are listed on the driver, with ignore rules; texts are read in tasks, from a DataFrame of paths. Spark's own file sources skip names that
begin with an underscore, and so every ``__init__.py``.
"""

from __future__ import annotations

import os
from collections.abc import Iterator
from pathlib import Path

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.functions import paths

SCHEMA = "file string, display_path string"


class IgnoreRules:
    """The patterns of ignore files, as far as directories, ``!``, ``/`` and globs go."""

    def __init__(self) -> None:
        import re

        self.re, self.rules = re, []

    def read(self, folder: str) -> None:
        file = os.path.join(folder, ".gitignore")
        if os.path.isfile(file):
            for line in Path(file).read_text(errors="replace").splitlines():
                line = line.rstrip()
                if line and not line.startswith("#"):
                    keep, only_folders = line.startswith("!"), line.endswith("/")
                    plain = line.lstrip("!").rstrip("/")
                    anchored, plain = "/" in plain, plain.lstrip("/")
                    pattern = paths.glob_regex(plain)
                    if anchored and "/" not in plain:  # a leading slash binds a name to this folder
                        pattern = "^" + pattern[4:].partition("|")[0] + "$"
                    body = pattern
                    self.rules.append((folder, self.re.compile(body), keep, only_folders))

    def ignored(self, path: str, is_folder: bool) -> bool:
        out = False
        for folder, pattern, keep, only_folders in self.rules:
            if path.startswith(folder + os.sep) and (is_folder or not only_folders) and pattern.match(os.path.relpath(path, folder).replace(os.sep, "/")):
                out = not keep
        return out


def walk(root: str, every: bool = False) -> list[str]:
    """Supported files below a root, sorted; hidden and ignored ones are left out, unless ``every``. A file is its own tree."""
    if os.path.isfile(root):
        read_source(root)  # a file that was asked for by name has to be readable
        return [root]
    if not os.path.isdir(root):
        raise FileNotFoundError(root)
    rules, out = IgnoreRules(), []
    for folder, names, files in os.walk(root):
        rules.read(folder)
        names[:] = sorted(n for n in names if every or not n.startswith(".") and not rules.ignored(os.path.join(folder, n), True))
        for n in files:
            path = os.path.join(folder, n)
            if n.rpartition(".")[2] in paths.LANGUAGES and "." in n and (every or not n.startswith(".") and not rules.ignored(path, False)):
                out.append(path)
    return sorted(out)


def _read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    def text(path: str) -> str | None:
        try:
            return Path(path).read_text(encoding="utf-8")
        except (OSError, UnicodeDecodeError):
            return None

    for batch in batches:
        yield batch.assign(source=[text(p) for p in batch["file"]])


def read_tree(spark: SparkSession, root: str, only_tests: bool = False, exclude_tests: bool = False, exclude: tuple[str, ...] = ()) -> DataFrame:
    """file (display path), lang, module, is_test_path, source of a tree's files, a text per file, read in tasks.

    The tree has to lie where all executors can read it. If the root itself looks like tests, all its files are tests."""
    if only_tests and exclude_tests:
        raise ValueError("only_tests and exclude_tests exclude each other")
    root = os.path.normpath(root)
    known: dict[str, tuple[str, str] | None] = {}
    homes = [(p, package(os.path.dirname(os.path.abspath(p)), known) if p.endswith(".rs") else None) for p in walk(root)]
    rows = [(p, home and home[0], os.path.relpath(p, inside).replace(os.sep, "/") if home and os.path.abspath(p).startswith((inside := os.path.join(home[1], "src")) + os.sep) else None) for p, home in homes]
    listed = spark.createDataFrame(rows, "file string, crate string, inside string")
    listed = listed.withColumn("display_path", paths.relative(F.col("file"), root) if os.path.isdir(root) else F.col("file"))
    texts = listed.mapInPandas(_read, "file string, crate string, inside string, display_path string, source string").withColumn("file", F.col("display_path")).drop("display_path")
    return described(texts, _is_test(root), only_tests, exclude_tests, exclude)


def _is_test(root: str) -> bool:
    relative = os.path.relpath(root) if not os.path.relpath(root).startswith("..") else root
    return any(part.lower() in paths.TEST_DIRECTORIES for part in relative.replace(os.sep, "/").split("/"))


def described(texts: DataFrame, all_tests: bool = False, only_tests: bool = False, exclude_tests: bool = False, exclude: tuple[str, ...] = ()) -> DataFrame:
    """``texts`` (file, source) with lang, module and is_test_path, filtered by paths before any text is parsed."""
    out = texts.withColumn("lang", paths.language(F.col("file"))).where("lang is not null")
    out = out.withColumn("is_test_path", F.lit(True) if all_tests else paths.looks_like_test(F.col("file"))).withColumn("module", paths.module_path(F.col("file"), F.col("lang")))
    if "crate" in texts.columns:  # Rust files of a package: its name, and the way below its ``src``
        own = F.regexp_replace(paths.module_path(F.coalesce("inside", "file"), F.lit("rust")), F.lit("^crate"), F.col("crate"))
        out = out.withColumn("module", F.when(F.col("crate").isNotNull(), own).otherwise(F.col("module")))
    if exclude:
        out = out.where(~paths.excluded(F.col("file"), list(exclude)))
    if only_tests or exclude_tests:
        out = out.where(F.col("is_test_path") if only_tests else ~F.col("is_test_path"))
    return out.select("file", "lang", "module", "is_test_path", "source")


class UnsupportedExtension(ValueError):
    """A file of no known language."""


def read_source(path: str) -> tuple[str, str]:
    """A file's language and text. An unknown extension is an UnsupportedExtension, what cannot be read as UTF-8 an OSError."""
    if (lang := paths.LANGUAGES.get(path.rpartition(".")[2]) if "." in os.path.basename(path) else None) is None:
        raise UnsupportedExtension(path)
    try:
        return lang, Path(path).read_text(encoding="utf-8")
    except UnicodeDecodeError as error:
        raise OSError(f"{path}: {error}") from error


def crate_root(path: str) -> str | None:
    """A Rust file itself, or a folder's library or program."""
    if os.path.isfile(path):
        return path if path.endswith(".rs") else None
    return next((p for n in ("lib.rs", "main.rs") if os.path.isfile(p := os.path.join(path, "src", n))), None)


def package(folder: str, known: dict[str, tuple[str, str] | None]) -> tuple[str, str] | None:
    """The name, with underscores, and the folder of the nearest manifest with a package's name; ``known`` keeps what was found for each folder."""
    import tomllib

    if folder not in known:
        try:
            name = tomllib.loads((Path(folder) / "Cargo.toml").read_text(encoding="utf-8")).get("package", {}).get("name")
        except (OSError, UnicodeDecodeError, tomllib.TOMLDecodeError):
            name = None
        above = os.path.dirname(folder)
        known[folder] = (name.replace("-", "_"), folder) if name else None if above == folder else package(above, known)
    return known[folder]


def go_module(path: str) -> str | None:
    """The import path of a folder: the module that the nearest ``go.mod`` above it names, and the way down from there."""
    start = Path(path).resolve() if os.path.isdir(path) else Path(path).resolve().parent
    for folder in [start, *start.parents]:
        if (file := folder / "go.mod").is_file():
            for line in file.read_text(errors="replace").splitlines():
                words = line.partition("//")[0].split()
                if len(words) == 2 and words[0] == "module":
                    return "/".join([words[1].strip('"`'), *start.relative_to(folder).parts])
    return None
