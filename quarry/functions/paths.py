"""Paths and qualified names as column expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Directory names and file-name parts that mark tests.
TEST_DIRECTORIES = ("test", "tests", "__test__", "__tests__", "spec", "specs", "__spec__", "__specs__", "e2e", "integration_tests", "integration-test", "unit_tests", "unit-test", "testdata", "testing")
TEST_NAME_PARTS = ("test", "tests", "spec", "specs", "e2e", "cy")
#: File extensions by language.
LANGUAGES = {"rs": "rust", "py": "python", "go": "go"} | dict.fromkeys(("ts", "tsx", "mts", "cts", "js", "jsx", "mjs", "cjs"), "typescript")


def looks_like_test(path: Column) -> Column:
    """A segment is a test directory's name, or the file's stem has a test part between dots, underscores and hyphens."""
    segments = F.filter(F.split(F.lower(F.replace(path, F.lit("\\"), F.lit("/"))), "/"), lambda s: ~s.isin("", "."))
    file = F.try_element_at(segments, F.lit(-1))
    parts = F.split(F.regexp_replace(file, r"\.[^.]*$", ""), r"[._-]")
    return F.coalesce(F.arrays_overlap(segments, F.array(*map(F.lit, TEST_DIRECTORIES))) | (file == "conftest.py") | F.arrays_overlap(parts, F.array(*map(F.lit, TEST_NAME_PARTS))), F.lit(False))


def language(path: Column) -> Column:
    """The language by extension; null for other files."""
    extension = F.regexp_extract(path, r"\.([^./\\]+)$", 1)
    out = F.when(F.lit(False), F.lit(""))
    for name in dict.fromkeys(LANGUAGES.values()):
        out = out.when(extension.isin(*[e for e, n in LANGUAGES.items() if n == name]), name)
    return out


def glob_regex(pattern: str) -> str:
    """A glob as a regular expression for a whole path; a pattern without a slash matches at any depth.

    ``*`` and ``?`` match any characters, slashes too; ``**/`` matches any directories, ``{a,b}`` one of several, ``[...]`` a class."""
    out, i, depth = "", 0, 0
    while i < len(pattern):
        c = pattern[i]
        if pattern.startswith("**/", i) and (i == 0 or pattern[i - 1] == "/"):
            out, i = out + "(?:.*/)?", i + 3
            continue
        if c == "*":
            while pattern.startswith("*", i + 1):
                i += 1
            out += ".*"
        elif c == "?":
            out += "."
        elif c == "[" and "]" in pattern[i + 2 :]:
            end = pattern.index("]", i + 2)
            body = pattern[i + 1 : end].replace("\\", "\\\\")
            out, i = out + "[" + ("^" + body[1:] if body[0] in "!^" else body) + "]", end
        elif c == "{":
            out, depth = out + "(?:", depth + 1
        elif c == "}" and depth:
            out, depth = out + ")", depth - 1
        elif c == "," and depth:
            out += "|"
        else:
            out += re.escape(c)
        i += 1
    return f"^(?:{out}|.*/{out})$" if "/" not in pattern and "\\" not in pattern else f"^{out}$"


def excluded(path: Column, patterns: list[str]) -> Column:
    """The path matches one of the globs."""
    return path.rlike("|".join(f"(?:{glob_regex(p)})" for p in patterns)) if patterns else F.lit(False)


def last_segment(name: Column) -> Column:
    return F.element_at(F.split(name, "::"), -1)


def first_segment(name: Column) -> Column:
    return F.element_at(F.split(name, "::"), 1)


def parent(name: Column) -> Column:
    """The enclosing module, or null."""
    return F.when(F.instr(name, "::") > 0, F.regexp_replace(name, "::[^:]*$", ""))


def in_crate(qualified: Column, crate: Column) -> Column:
    return (qualified == crate) | qualified.startswith(F.concat(crate, F.lit("::")))


def qualify(module: Column, name: Column) -> Column:
    return F.when(module == "", name).otherwise(F.concat(module, F.lit("::"), name))


def relative(path: Column, root: str) -> Column:
    """The path below a root, with forward slashes."""
    plain = F.replace(path, F.lit("\\"), F.lit("/"))
    base = root.replace("\\", "/").rstrip("/") + "/"
    return F.when(plain.startswith(base), F.substring(plain, len(base) + 1, 1_000_000)).otherwise(plain)


def module_path(path: Column, lang: Column) -> Column:
    """The module that a display path stands for, where it follows from the path: Python and TypeScript by segments without
    ``__init__``, Go by directory, Rust by segments without ``mod``, ``lib`` and ``main`` under the crate's name ``crate``."""
    plain = F.regexp_replace(F.replace(path, F.lit("\\"), F.lit("/")), r"^(\./)+", "")
    parts = F.filter(F.split(F.regexp_replace(plain, r"\.[^./]*$", ""), "/"), lambda s: s != "")
    folders = F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(0)))
    rust = F.filter(F.array_remove(parts, "src"), lambda s: ~s.isin("mod", "lib", "main"))
    return (
        F.when(lang == "go", F.array_join(folders, "::"))
        .when(lang == "rust", F.array_join(F.concat(F.array(F.lit("crate")), rust), "::"))
        .otherwise(F.array_join(F.filter(parts, lambda s: s != "__init__"), "::"))
    )


def identifier_tokens(name: Column) -> Column:
    """Lower-case words of snake-case and camel-case names."""
    return F.filter(F.split(F.lower(F.regexp_replace(name, "([a-z0-9])([A-Z])", "$1_$2")), "[^a-z0-9]+"), lambda t: t != "")


def patch_paths(command: Column, kinds: str = "Update|Add") -> Column:
    """Paths that a patch text names in its ``*** Update File:`` and ``*** Add File:`` lines."""
    return F.regexp_extract_all(command, F.lit(rf"(?m)^\s*\*\*\* (?:{kinds}) File: *(.+?)\s*$"), 1)
