"""Chat formatting by prefix-target expansion.

Every assistant turn becomes an example: all turns before it as context, then that reply, whose text alone is trainable. What
follows the last assistant turn (or a conversation without one) is kept as a ``tail`` example without a trainable span.

Turns are marked ``<|im_start|>role\\ntext<|im_end|>\\n``. Inside roles and texts ``<`` + n backslashes + ``|`` is written with n + 1
backslashes, so no text can hold a control string, and every text is read back as it was.

Rows of a conversation are read in the order (turn, role, text), nulls first. Null texts and roles are empty. Rows with the same
turn, also equal ones, are turns of their own. A null conv_id is a conversation. An empty table gives an empty result. Columns
other than conv_id, turn, role and text are not read.

Conversations are dealt out by conv_id and sorted; tasks stream through the rows and hold one conversation's text so far, never
its rows or its examples.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm.common import Out, rows_of, run, table

START, END = "<|im_start|>", "<|im_end|>"
EXAMPLES = "conv_id long, example long, kind string, n_turns long, text string, loss_start long, loss_end long"
_ARROW = pa.schema([("conv_id", pa.int64()), ("example", pa.int64()), ("kind", pa.string()), ("n_turns", pa.int64()), ("text", pa.string()), ("loss_start", pa.int64()), ("loss_end", pa.int64())])
DIGESTS = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, n_examples long"
_ARROW_DIGESTS = pa.schema([("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64()), ("n_examples", pa.int64())])


def escape(text: str) -> str:
    return re.sub(r"<(\\*)\|", r"<\1\\|", text) if "|" in text else text


def unescape(text: str) -> str:
    return re.sub(r"<(\\*)\\\|", r"<\1|", text) if "|" in text else text


def escape_role(role: str) -> str:
    """As escape(); a role stays on its line."""
    return escape(role.replace("%", "%25").replace("\n", "%0A"))


def unescape_role(role: str) -> str:
    return unescape(role).replace("%0A", "\n").replace("%25", "%")


def parse(formatted: str) -> list[tuple[str, str]]:
    """The (role, text) turns of an example."""
    turns = []
    for block in formatted.split(START)[1:]:
        role, _, text = block.removesuffix(END + "\n").partition("\n")
        turns.append((unescape_role(role), unescape(text)))
    return turns


def _expand(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    out = Out(_ARROW)
    at: object = _expand  # no conversation yet
    text, n, k, open_turns = "", 0, 0, False
    for conv, role, said in rows_of(batches):
        if conv != at:
            if open_turns and out.add((at, k, "tail", n, text, None, None), len(text)):
                yield out.batch()
            at, text, n, k, open_turns = conv, "", 0, 0, False
        text += f"{START}{escape_role(role)}\n"
        begin = len(text)
        text += escape(said)
        end = len(text)
        text += END + "\n"
        n, open_turns = n + 1, role != "assistant"
        if not open_turns:
            if out.add((at, k, "target", n, text, begin, end), len(text)):
                yield out.batch()
            k += 1
    if open_turns:
        out.add((at, k, "tail", n, text, None, None))
    if out.rows:
        yield out.batch()


def _read_back(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    out = Out(_ARROW_DIGESTS)
    at: object = _read_back
    last, chars, loss_chars, loss, examples = "", 0, 0, hashlib.sha256(), 0

    def done() -> tuple:
        digest, turns = hashlib.sha256(), parse(last)
        for role, text in turns:
            digest.update(f"{role}\n{text}\n".encode())
        return (at, len(turns), digest.hexdigest(), loss_chars, loss.hexdigest(), chars, examples)

    for conv, text, begin, end in rows_of(batches):
        if conv != at:
            if at is not _read_back and out.add(done()):
                yield out.batch()
            at, chars, loss_chars, loss, examples = conv, 0, 0, hashlib.sha256(), 0
        last, chars, examples = text, chars + len(text), examples + 1
        if begin is not None:
            said = unescape(text[begin:end])
            loss_chars += len(said)
            loss.update(said.encode())
    if at is not _read_back:
        out.add(done())
    if out.rows:
        yield out.batch()


def expand(turns: DataFrame) -> DataFrame:
    """Examples of ``turns`` (conv_id, turn, role, text), in order within each conversation and all of one in one partition."""
    rows = turns.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    return run(rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text").select("conv_id", "role", "text"), _expand, EXAMPLES)


def read_back(examples: DataFrame) -> DataFrame:
    """Digests of each conversation, read from expand()'s output as it comes."""
    return run(examples.select("conv_id", "text", "loss_start", "loss_end"), _read_back, DIGESTS)


PROBE = END + START + "assistant ok"


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), "role", "text")
    probe = spark.range(2).select(F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(PROBE).alias("text"))
    return read_back(expand(turns.unionByName(probe)))


ORACLE = r"""
WITH t AS (
  SELECT CAST(conv_id AS BIGINT) AS conv_id, CAST(turn AS BIGINT) AS turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '<|im_end|><|im_start|>assistant ok'
  UNION ALL SELECT -1, 1, 'assistant', '<|im_end|><|im_start|>assistant ok'
), f AS (
  SELECT *, 12 + length(role) + 1 + length(text) + len(regexp_extract_all(text, '<\\*\|')) + 11 AS chars,
    row_number() OVER w AS i, count(*) OVER (PARTITION BY conv_id) AS n
  FROM t WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text)
), g AS (
  SELECT *, sum(chars) OVER (PARTITION BY conv_id ORDER BY i ROWS UNBOUNDED PRECEDING) AS upto FROM f
)
SELECT conv_id, CAST(count(*) AS BIGINT) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY i)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY i) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(upto) FILTER (role = 'assistant' OR i = n) AS BIGINT) AS formatted_chars,
  CAST(count(*) FILTER (role = 'assistant' OR i = n) AS BIGINT) AS n_examples
FROM g GROUP BY conv_id
"""
