"""Chat formatting with loss masks aligned by offsets.

A conversation is rendered whole, encoded once with token offsets, and its
assistant spans are met with the token spans by binary search in the sorted
offsets; a token that reaches over a span's border is clipped to it, so the
text under the mask is the assistant's texts to the byte.

Template: ``<|im_start|>role\\ntext<|im_end|>\\n`` for each turn. Inside texts
and roles a ``<`` before any backslashes and a ``|`` gets one more backslash,
so neither can contain ``<|``; reading takes one away. Roles also escape
backslashes and line ends.

Turns are dealt by ranges of their whole order, so that a conversation of any
length is rendered by several tasks; a part's number tells its task and place, and
reading sorts by it, however the stored parts come. (The digest of a whole
conversation is sequential by nature: its texts stream through one task, one part in memory.)

Edges: null text and role are empty; a null turn comes first; equal turns are
ordered by role, then text; a null conversation id is a conversation of its
own; conversations come in parts of whole turns of about ``PART`` characters,
which bounds memory and changes no token (a turn's start is always a border of
pre-tokens).
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bpe import compiled, encode_text, piece_pattern, tokenizer_file, worker_encoder
from .common import map_arrow, store, table

START, END = "<|im_start|>", "<|im_end|>\n"
PART = 4_000_000
LOSS_ROLE = "assistant"

_ESCAPE, _UNESCAPE = re.compile(r"<(\\*)\|"), re.compile(r"<\\(\\*)\|")


def escape(text: str) -> str:
    return _ESCAPE.sub(r"<\\\1|", text)


def unescape(text: str) -> str:
    return _UNESCAPE.sub(r"<\1|", text)


def escape_role(role: str) -> str:
    return escape(role.replace("\\", "\\\\").replace("\n", "\\n"))


def unescape_role(role: str) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], unescape(role))


def render(turns: list[tuple[str, str]]) -> tuple[bytes, list[tuple[int, int]]]:
    """The formatted text in UTF-8 and the byte spans of the assistant's texts."""
    out, spans, at = [], [], 0
    for role, text in turns:
        head = f"{START}{escape_role(role)}\n".encode("utf-8", "surrogatepass")
        body = escape(text).encode("utf-8", "surrogatepass")
        if role == LOSS_ROLE and body:
            spans.append((at + len(head), at + len(head) + len(body)))
        out += [head, body, END.encode()]
        at += len(head) + len(body) + len(END)
    return b"".join(out), spans


def align(spans: list[tuple[int, int]], starts: np.ndarray, ends: np.ndarray) -> tuple[list[tuple[int, int]], list[tuple[int, int]]]:
    """For each span: the run of tokens that meet it, and the bytes those tokens cover inside it."""
    s, e = np.array(spans, np.int64).reshape(-1, 2).T
    first, last = np.searchsorted(ends, s, "right"), np.searchsorted(starts, e, "left")
    covered = [(int(max(a, starts[i])), int(min(b, ends[j - 1]))) for a, b, i, j in zip(s, e, first, last, strict=True) if j > i]
    return list(zip(first.tolist(), last.tolist(), strict=True)), covered


def read_turns(formatted: str) -> list[tuple[str, str]]:
    turns = []
    for block in formatted.split(START)[1:]:
        role, _, text = block.partition("\n")
        turns.append((unescape_role(role), unescape(text.removesuffix(END))))
    return turns


FORMATTED = "conv_id long, part long, formatted string, ids binary, token_spans array<struct<first:long,last:long>>, loss_spans array<struct<start:long,end:long>>"
_SPAN = [pa.list_(pa.struct([("first", pa.int64()), ("last", pa.int64())])), pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))]


def format_conversations(turns: DataFrame, ranks_file: str | None = None, pattern: str | None = None) -> DataFrame:
    """Rows (a part of a conversation each) with the text, token ids, masked token runs and masked byte spans.

    Rows are dealt by ranges of conversation and turn, sorted inside partitions and read as a
    stream: no conversation is gathered in memory or in one task.
    """
    path, pat = ranks_file or tokenizer_file(), pattern or piece_pattern()
    rows = turns.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    rows = rows.repartitionByRange("conv_id", "turn", "role", F.substring("text", 1, 32)).sortWithinPartitions("conv_id", "turn", "role", "text")

    def made(conv, part: int, part_turns, encoder, pieces, find, sizes) -> tuple:
        data, spans = render(part_turns)
        formatted = data.decode("utf-8", "surrogatepass")
        ids = encode_text(formatted, pieces, find)
        ends = np.cumsum(sizes[np.frombuffer(ids, "<u4")])
        starts = np.concatenate(([0], ends[:-1]))
        tokens, covered = align(spans, starts, ends)
        return conv, part, formatted, ids, [{"first": a, "last": b} for a, b in tokens], [{"start": a, "end": b} for a, b in covered]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, pieces = worker_encoder(path)
        find = compiled(pat)
        sizes = np.zeros(max(encoder.bytes_of, default=0) + 1, np.int64)
        for r, b in encoder.bytes_of.items():
            sizes[r] = len(b)
        nothing = object()
        # partitions are ranges in order: parts of a conversation count on from its partition's number
        conv, part, kept, chars, out, weight = nothing, TaskContext.get().partitionId() << 32, [], 0, [], 0

        def batch_of(rows: list[tuple]) -> pa.RecordBatch:
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.binary(), *_SPAN]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=["conv_id", "part", "formatted", "ids", "token_spans", "loss_spans"])

        for batch in batches:
            for c, _, role, text in zip(*[x.to_pylist() for x in batch.columns], strict=True):
                new = conv is nothing or c != conv
                if kept and (new or chars >= PART):
                    out.append(made(conv, part, kept, encoder, pieces, find, sizes))
                    weight += chars
                    part, kept, chars = part + 1, [], 0
                    if weight >= PART:
                        yield batch_of(out)
                        out, weight = [], 0
                conv = c
                kept.append((role, text))
                chars += len(text)
        if kept:
            out.append(made(conv, part, kept, encoder, pieces, find, sizes))
        if out:
            yield batch_of(out)

    return map_arrow(rows, run, FORMATTED)


READ = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"


def read_formatted(formatted: DataFrame) -> DataFrame:
    """Turns and masked text read back from formatted parts, in whatever order these are stored."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        nothing = object()
        conv, state, rows = nothing, None, []

        def close() -> None:
            rows.append((conv, state[0], state[1].hexdigest(), state[2], state[3].hexdigest(), state[4]))

        def batch_of() -> pa.RecordBatch:
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=[x.split()[0] for x in READ.split(", ")])

        for batch in batches:
            for c, text, spans in zip(*[x.to_pylist() for x in batch.columns], strict=True):
                if conv is nothing or c != conv:
                    if conv is not nothing:
                        close()
                    conv, state = c, [0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                for role, said in read_turns(text):
                    state[0] += 1
                    state[1].update(f"{role}\n{said}\n".encode("utf-8", "surrogatepass"))
                data = text.encode("utf-8", "surrogatepass")
                for x in spans:
                    masked = unescape(data[x["start"] : x["end"]].decode("utf-8", "surrogatepass"))
                    state[2] += len(masked)
                    state[3].update(masked.encode("utf-8", "surrogatepass"))
                state[4] += len(text)
            if rows:
                yield batch_of()
                rows.clear()
        if conv is not nothing:
            close()
            yield batch_of()

    rows = formatted.select("conv_id", "part", "formatted", "loss_spans").repartition("conv_id").sortWithinPartitions("conv_id", "part")
    return map_arrow(rows.select("conv_id", "formatted", "loss_spans"), run, READ)


def op6_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = "</s>[INST] ok [/INST]"
    extra = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    return read_formatted(store(format_conversations(turns.unionByName(extra))))


OP6_SQL = r"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
f AS (SELECT *, regexp_replace(text, '<(\\*)\|', '<\\\1|', 'g') AS e,
  regexp_replace(replace(replace(role, '\', '\\'), chr(10), '\n'), '<(\\*)\|', '<\\\1|', 'g') AS r FROM t)
SELECT conv_id, count(*)::BIGINT AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum(length(e) + length(r) + 12 + 1 + 10 + 1)::BIGINT AS formatted_chars
FROM f GROUP BY conv_id
"""
