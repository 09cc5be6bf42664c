"""Reports as JSON and Markdown, from small ordered results."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame

#: Left out of JSON where they are null or, as said, 0; all other nulls are written.
OPTIONAL = {"instability", "since", "reuse", "trait_name", "signature_similarity", "type_overlap", "identifier_overlap", "inert_method_count"}
#: Parts of one row, which are objects in JSON.
SINGLE = ("summary", "statistics")


def plain(value: object) -> object:
    if hasattr(value, "asDict"):
        return {k: plain(v) for k, v in value.asDict().items() if not (k in OPTIONAL and (v is None or k == "inert_method_count" and v == 0))}
    return [plain(v) for v in value] if isinstance(value, (list, tuple)) else value


def to_json(parts: dict[str, DataFrame | object]) -> str:
    """One object, pretty-printed, with one line end. DataFrames become lists in their order, or an object if they have one row by their nature."""
    part = lambda k, v: v if not isinstance(v, DataFrame) else plain(v.first()) if k in SINGLE else [plain(r) for r in v.toLocalIterator()]
    return json.dumps({k: part(k, v) for k, v in parts.items()}, indent=2, ensure_ascii=False) + "\n"


def number(value: float | None, digits: int = 2) -> str:
    return "n/a" if value is None else f"{value:.{digits}f}"


def to_markdown(title: str, parts: dict[str, DataFrame | object], top: int = 20) -> str:
    """A section per part; the first ``top`` rows of each DataFrame."""
    out = [f"# {title}", ""]
    for name, part in parts.items():
        if not isinstance(part, DataFrame):
            out += [f"- {name}: {part}", ""]
            continue
        columns = [c for c in part.columns if c not in ("tree", "signature")]
        out += [f"## {name}", "", "| " + " | ".join(columns) + " |", "| " + " | ".join("---" for _ in columns) + " |"]
        rows = part.select(*[f"`{c}`" for c in columns]).limit(top).collect()
        out += ["| " + " | ".join(number(v) if isinstance(v, float) or v is None else str(v) for v in r) + " |" for r in rows] or ["| " + " | ".join("-" for _ in columns) + " |"]
        out.append("")
    return "\n".join(out)
