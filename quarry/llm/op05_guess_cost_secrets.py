"""Secret scans with a password guess cost.

Base spans, per kind leftmost and without overlaps: ``assign`` (a credential name, ``:`` or ``=``, and a value of 6 or more characters),
``access`` (AKIA keys of 20 or more characters) and ``hex`` (24 or more lower-case hexadecimal digits).

The method adds ``guess`` spans: the values after any credential name (more names than ``assign`` has, any printable characters) whose
guess cost is high. The cost is the logarithm to base 10 of the guesses that the cheapest segmentation needs: words (with capitals and
look-alike characters), dates, repeats, keyboard walks and brute-force spans, found by dynamic programming in time proportional to the value's
length. Words are ranked: a short list of password words first, then the words in vocabularies of public byte-level tokenizers, whose order
follows how frequent they were in text of many languages. A placeholder such as ``changeme`` costs little and is not added, nor is a
reference (``${NAME}``, ``%NAME%``, ``{{name}}``, a look-up in the environment); base spans stay whatever their cost.

A null text is an empty one and has no spans. Texts of any length are scanned whole, one at a time. Every row gives a row, also repeated
ones, and an empty table gives an empty result. Other columns are not read.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterable, Iterator
from functools import lru_cache
from math import log10

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm.common import Out, rows_of, run, table

KINDS = ("assign", "access", "hex", "guess")
#: The base patterns.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
#: A value in quotes goes to the matching one; others end at white space, quotes, ``<``, ``>``, comma or semicolon.
#: Names before a credential's value; then ``:`` or ``=`` (``bearer`` needs none).
CONTEXT = re.compile(
    r"""(?:pass(?:word|wd|phrase|code)?|pwd|secret|token|credentials?|auth(?:orization)?|(?:api|access|private|signing|encryption)[_-]?key)["']?[\x20\t]*(?::=|=>|[:=])[\x20\t]*(?:"(?:bearer\x20+)?([^"\x00-\x1f\x7f]{6,})"|'(?:bearer\x20+)?([^'\x00-\x1f\x7f]{6,})'|`(?:bearer\x20+)?([^`\x00-\x1f\x7f]{6,})`|["'`]?(?:bearer\x20+)?([^\s"'`<>,;]{6,}))|\bbearer\x20+([^\s"'`<>,;]{6,})""",
    re.IGNORECASE | re.ASCII,
)

#: Common words of passwords and placeholders, by rank.
WORDS = (
    "password pass word admin user login test guest root welcome master hello love money dragon monkey princess sunshine shadow football baseball "
    "superman batman access letmein iloveyou trustno secret token change changeme default example sample dummy placeholder your my the key api "
    "private public value string none null true false redacted hidden insert here please replace demo temp temporary service system server "
    "client local host database data account super summer winter spring autumn monday friday january june july august december orange banana "
    "cookie cheese coffee soccer hockey tiger eagle silver golden purple green blue black white red flower freedom whatever computer internet "
    "michael jordan jessica charlie thomas daniel andrew george"
).split()
#: A keyboard's rows.
KEYBOARD = ("`1234567890-=", "qwertyuiop[]\\", "asdfghjkl;'", "zxcvbnm,./")
SHIFTED = ('~!@#$%^&*()_+', 'QWERTYUIOP{}|', 'ASDFGHJKL:"', "ZXCVBNM<>?")
#: Look-alike characters.
ALIKE = {"4": "a", "@": "a", "8": "b", "3": "e", "6": "g", "1": "i", "!": "i", "0": "o", "5": "s", "$": "s", "7": "t", "+": "t", "2": "z"}

#: Vocabularies with word ranks, and the shortest of their words that counts.
VOCABULARIES, SHORTEST = ("byte_bpe_50k.tiktoken", "byte_bpe_multi_50k.tiktoken"), 4
#: Values that name a secret's place instead of being one.
REFERENCE = re.compile(r"\$\{[^}]*\}|\$\(?[A-Za-z_][A-Za-z0-9_]*\)?|%[A-Za-z_][A-Za-z0-9_]*%|\{\{.*\}\}|\[?[\w.]*\b(?:environ|getenv|env)\b.*", re.ASCII | re.IGNORECASE)

SEGMENT = log10(5)  # which kind comes next
REPEAT_UNIT = 8
_PLACE = {c: (x + y / 2, y) for rows in (KEYBOARD, SHIFTED) for y, row in enumerate(rows) for x, c in enumerate(row)}
_DATE = re.compile(
    r"(?=((?:19|20)\d\d(?P<a>[-/._]?)(?:0[1-9]|1[0-2])(?P=a)(?:0[1-9]|[12]\d|3[01])|(?:0[1-9]|[12]\d|3[01])(?P<b>[-/._]?)(?:0[1-9]|1[0-2])(?P=b)(?:19|20)\d\d|(?:0[1-9]|1[0-2])(?P<c>[-/._]?)(?:0[1-9]|[12]\d|3[01])(?P=c)(?:19|20)\d\d|(?:19|20)\d\d))",
    re.ASCII,
)


def _char_cost(c: str) -> float:
    return 1.0 if "0" <= c <= "9" else log10(26) if "a" <= c <= "z" or "A" <= c <= "Z" else log10(33) if c < "\x7f" else 3.0


@lru_cache(maxsize=2)
def ranks(vocabularies: tuple[str, ...] = ()) -> tuple[dict[str, int], int]:
    """Words with their ranks, and the length of the longest. ``vocabularies``: paths of files with a token (base64) and its rank a line."""
    found = {w: i + 1 for i, w in enumerate(WORDS)}
    least: dict[str, int] = {}
    for path in vocabularies:
        with open(path, "rb") as lines:
            for token, rank in map(bytes.split, lines):
                word = base64.b64decode(token).decode("utf-8", "replace").strip(" ").lower()
                if len(word) >= SHORTEST and word.isalpha():
                    least[word] = min(least.get(word, 1 << 30), int(rank))
    for word, rank in least.items():
        found.setdefault(word, len(WORDS) + rank)
    return found, max(map(len, found))


def _word_cost(piece: str, known: dict[str, int]) -> float | None:
    """The cost of a piece that is a word, written with capitals or look-alikes."""
    low = piece.lower()
    plain = "".join(ALIKE.get(c, c) for c in low)
    rank = known.get(low) or known.get(plain)
    if not rank:
        return None
    capitals = sum(map(str.isupper, piece))
    capital_cost = 0.0 if not capitals else log10(2) if capitals == len(piece) or piece[0].isupper() and capitals == 1 else capitals * log10(2) + 1
    return log10(rank + 1) + capital_cost + log10(2) * (0 if low in known else sum(a != b for a, b in zip(low, plain, strict=True)))


def _step(a: str, b: str) -> tuple[float, int] | None:
    """The direction from one key to a neighbouring one."""
    p, q = _PLACE.get(a), _PLACE.get(b)
    if not p or not q or a == b:
        return None
    d = (q[0] - p[0], q[1] - p[1])
    return d if abs(d[0]) <= 1 and abs(d[1]) <= 1 else None


@lru_cache(maxsize=4096)
def guess_cost(value: str, vocabularies: tuple[str, ...] = ()) -> float:
    """log10 of the guesses for ``value``: the cheapest segmentation's costs and, for each segment, the choice of its kind."""
    n, (known, longest) = len(value), ranks(vocabularies)
    edges: dict[int, list[tuple[int, float]]] = {}  # end: (begin, cost)

    def edge(begin: int, end: int, cost: float) -> None:
        edges.setdefault(end, []).append((begin, cost + SEGMENT))

    for i in range(n):
        for j in range(i + 3, min(n, i + longest) + 1):
            if (cost := _word_cost(value[i:j], known)) is not None:
                edge(i, j, cost)
    for m in _DATE.finditer(value):
        whole = m[1]
        edge(m.start(), m.start() + len(whole), log10(151) if len(whole) == 4 else log10(151 * 366) + (log10(4) if len(whole) > 8 else 0))
    for u in range(1, min(REPEAT_UNIT, n // 2) + 1):
        i = 0
        while i + u < n:
            j = i
            while j + u < n and value[j] == value[j + u]:
                j += 1
            if j - i >= u and j + u - i >= 3:
                for begin in range(i, min(i + u, j)):
                    times = (j + u - begin) // u
                    if times >= 2 and times * u >= 3:
                        unit = value[begin : begin + u]
                        edge(begin, begin + times * u, (sum(map(_char_cost, unit)) if u < 3 else min(sum(map(_char_cost, unit)), w if (w := _word_cost(unit, known)) is not None else 99.0)) + log10(times))
            i = max(i + 1, j)
    best, brute, walk = [0.0] * (n + 1), float("inf"), float("inf")
    steps = [_step(a, b) for a, b in zip(value, value[1:], strict=False)]
    turn = log10(5)
    for j in range(1, n + 1):
        brute = min(best[j - 1] + SEGMENT, brute) + _char_cost(value[j - 1])
        if j >= 3 and steps[j - 2] and steps[j - 3]:
            more = 0.1 if steps[j - 2] == steps[j - 3] else turn
            walk = min(walk + more, best[j - 3] + SEGMENT + log10(94) + turn + more)
        else:
            walk = float("inf")
        best[j] = min([brute, walk, *(best[i] + cost for i, cost in edges.get(j, ()))])
    return best[n]


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind's number, end), in order."""
    spans = []
    if "=" in text or ":" in text:
        spans += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        spans += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    spans += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(spans)


def guessed_spans(text: str, least: float, vocabularies: tuple[str, ...] = ()) -> list[tuple[int, int, int, float]]:
    """(start, kind's number, end, cost) of the credential values that cost at least ``least``."""
    found = []
    if "=" in text or ":" in text or "earer" in text or "EARER" in text:
        for m in CONTEXT.finditer(text):
            group = m.lastindex
            if not REFERENCE.fullmatch(m[group]) and (cost := guess_cost(m[group], vocabularies)) >= least:
                found.append((m.start(group), 3, m.end(group), cost))
    return found


SPANS = "doc_id long, spans array<struct<kind:string,start:long,end:long,log10_guesses:double>>"
_SPAN = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("log10_guesses", pa.float64())])
_ARROW = pa.schema([("doc_id", pa.int64()), ("spans", pa.list_(_SPAN))])


def _scan(batches: Iterable[pa.RecordBatch], least: float, vocabularies: tuple[str, ...]) -> Iterator[pa.RecordBatch]:
    out = Out(_ARROW)
    for doc_id, text in rows_of(batches):
        text = text or ""
        spans = sorted([(*s, None) for s in base_spans(text)] + guessed_spans(text, least, vocabularies), key=lambda s: s[:3])
        if out.add((doc_id, [{"kind": KINDS[k], "start": a, "end": b, "log10_guesses": c} for a, k, b, c in spans])):
            yield out.batch()
    if out.rows:
        yield out.batch()


def scan(docs: DataFrame, least: float = 8.0, vocabularies: tuple[str, ...] = VOCABULARIES) -> DataFrame:
    """doc_id and spans, by start and kind, of each text. ``least``: the cost (log10 of guesses) from which a credential value is a span.
    ``vocabularies``: names of the public tokenizer files that rank words; executors have them where the driver has."""
    import public_tokenizers

    paths = tuple(map(public_tokenizers.path, vocabularies))
    return run(docs.select(F.col("doc_id").cast("long"), "text"), lambda batches: _scan(batches, least, paths), SPANS)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan(table(spark, sf_dir, "documents"))
    text = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")
    base = F.filter("spans", lambda s: s["kind"] != "guess")
    return found.select("doc_id", *[count(k).alias(f"n_{k}") for k in KINDS], F.sha2(text(base), 256).alias("base_sha256"), text(F.col("spans")).alias("spans"))


def digest(spans: list[tuple[int, int, int]]) -> str:
    """base_sha256 of base_spans(), for tests."""
    return hashlib.sha256(",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans).encode()).hexdigest()
