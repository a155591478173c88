"""Token counts that follow edits: a segment tree over each document's pre-tokens.

A leaf covers about ``LEAF`` consecutive pre-tokens and keeps their text, characters
and tokens; inner nodes keep sums. An edit descends by character sums to the
leaf where its effect can begin (some context before the edit, since a
pre-token is chosen by looking a little past its end), scans again from there
until it meets an old leaf border behind the edit, recounts that stretch alone
and updates the sums above the touched leaves. Where a stretch needs more leaves, the
leaves are spliced and the inner sums added up again, without counting anything else anew.

``plant_trees`` makes a table of trees, one a document; ``edit_trees`` reads such a table and
applies edits to its trees, in the same order of rows and without a shuffle.

Edges: a null text is empty (0 tokens); null edits are none; an edit's null
text deletes; positions outside the text are clamped to it and an end before
the start counts as the start; repeated rows give repeated rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .bpe import PieceMemory, compiled, piece_pattern, resplit, tokenizer_file, worker_encoder
from .common import map_arrow, rows_batch, store, table, texts_of

LEAF = 32


class PieceCounts(PieceMemory):
    """Pre-token to its number of tokens: small numbers, so more of them are remembered."""

    most = 1_000_000

    def of(self, ids: list[int]) -> int:
        return len(ids)


@lru_cache(maxsize=2)
def worker_counts(path: str) -> PieceCounts:
    return PieceCounts(worker_encoder(path)[0])


class EditedCount:
    """The token count of one text under edits."""

    def __init__(self, texts: list[str], own: np.ndarray, counts: PieceCounts, pattern):
        """``texts`` of the leaves; ``own``: their characters and tokens, a row each."""
        self.texts, self.counts, self.pattern = texts, counts, pattern
        self.rescanned = 0
        self._sum(own)

    @classmethod
    def plant(cls, text: str, counts: PieceCounts, pattern) -> EditedCount:
        return cls(*_leaves(pattern.findall(text), counts), counts, pattern)

    @classmethod
    def read(cls, text: str, leaves: bytes, counts: PieceCounts, pattern) -> EditedCount:
        own = np.frombuffer(leaves, "<i4").reshape(-1, 2).astype(np.int64)
        ends = np.cumsum(own[:, 0]).tolist()
        return cls([text[a:b] for a, b in zip([0, *ends[:-1]], ends, strict=True)], own, counts, pattern)

    def leaves(self) -> bytes:
        """What ``read`` needs beside the text."""
        return self.sums[self.size : self.size + len(self.texts)].astype("<i4").tobytes()

    def _sum(self, own: np.ndarray) -> None:
        n = max(1, len(self.texts))
        self.size = 1 << (n - 1).bit_length()
        self.sums = np.zeros((2 * self.size, 2), np.int64)
        self.sums[self.size : self.size + len(own)] = own
        width = self.size
        while width > 1:
            level = self.sums[width : 2 * width]
            self.sums[width // 2 : width] = level[0::2] + level[1::2]
            width //= 2

    @property
    def chars(self) -> int:
        return int(self.sums[1, 0])

    @property
    def total(self) -> int:
        return int(self.sums[1, 1])

    @property
    def text(self) -> str:
        return "".join(self.texts)

    def _leaf(self, position: int) -> tuple[int, int]:
        """The leaf that holds the character at ``position``, and where that leaf begins."""
        node, begin = 1, 0
        while node < self.size:
            left = int(self.sums[2 * node, 0])
            node *= 2
            if position >= begin + left and int(self.sums[node + 1, 0]):
                begin, node = begin + left, node + 1
        return node - self.size, begin

    def _set(self, leaf: int, own: np.ndarray) -> None:
        node = leaf + self.size
        change = own - self.sums[node]
        while node:
            self.sums[node] += change
            node //= 2

    def edit(self, start: int, end: int, new: str) -> None:
        n = self.chars
        start = min(max(start, 0), n)
        end = min(max(end, start), n)
        first, begin = self._leaf(start)
        sizes = self.sums[self.size : self.size + len(self.texts), 0]
        first, behind, pieces = resplit(self.texts, sizes, first, int(begin), start, end, new, self.pattern)
        self.rescanned += sum(map(len, pieces))
        touched = behind - first
        per = max(1, -(-len(pieces) // touched))
        if per <= 4 * LEAF:
            for k in range(touched):
                part = pieces[k * per : (k + 1) * per]
                self.texts[first + k] = "".join(part)
                self._set(first + k, np.array([len(self.texts[first + k]), sum(map(self.counts.__getitem__, part))], np.int64))
            return
        texts, own = _leaves(pieces, self.counts)
        old = self.sums[self.size : self.size + len(self.texts)]
        own = np.concatenate((old[:first], own, old[behind:]))
        self.texts[first:behind] = texts
        self._sum(own)


def _leaves(pieces: list[str], counts: PieceCounts) -> tuple[list[str], np.ndarray]:
    """The texts of leaves of ``LEAF`` pre-tokens, and their characters and tokens."""
    if not pieces:
        return [""], np.zeros((1, 2), np.int64)
    own = np.array([list(map(len, pieces)), list(map(counts.__getitem__, pieces))], np.int64)
    texts = ["".join(pieces[a : a + LEAF]) for a in range(0, len(pieces), LEAF)]
    return texts, np.add.reduceat(own, np.arange(0, len(pieces), LEAF), axis=1).T


def plant_trees(docs: DataFrame, key: str = "doc_id", text: str = "text", ranks_file: str | None = None, pattern: str | None = None) -> DataFrame:
    """A tree of each document: key, text (null: empty), leaves (characters and tokens of each, little-endian 32-bit), n_chars, n_tokens."""
    path, pat = ranks_file or tokenizer_file(), pattern or piece_pattern()
    rows = docs.select(F.col(f"`{key}`").alias("k"), F.col(f"`{text}`").cast("string").alias("t"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, find = worker_counts(path), compiled(pat)
        for batch in batches:
            texts, made = texts_of(batch.column(1)), []
            for t in texts:
                tree = EditedCount.plant(t.as_py(), counts, find)
                made.append((tree.leaves(), tree.chars, tree.total))
            columns = zip(*made, strict=True) if made else ((), (), ())
            yield pa.RecordBatch.from_arrays([batch.column(0), texts, *[pa.array(c, k) for c, k in zip(columns, (pa.binary(), pa.int64(), pa.int64()), strict=True)]], names=["key", "text", "leaves", "n_chars", "n_tokens"])

    kind = docs.schema[key].dataType.simpleString()
    return map_arrow(rows, run, f"key {kind}, text string, leaves binary, n_chars long, n_tokens long")


def edit_trees(trees: DataFrame, edits: Column, ranks_file: str | None = None, pattern: str | None = None, keep_trees: bool = False) -> DataFrame:
    """Counts before and after each tree's edits (array of struct start, end, text, from the trees' columns; each sees the text that the last left).

    Returns key, n_chars, n_tokens, n_edits, n_chars_after, n_tokens_after, n_chars_rescanned, and with ``keep_trees`` the edited text and leaves.
    """
    path, pat = ranks_file or tokenizer_file(), pattern or piece_pattern()
    rows = trees.withColumn("edits", edits).select("key", "text", "leaves", F.expr("transform(edits, e -> struct(cast(e.start as long) as s, cast(e.end as long) as e, cast(e.text as string) as t))").alias("edits"))
    names = ["n_chars", "n_tokens", "n_edits", "n_chars_after", "n_tokens_after", "n_chars_rescanned"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, find = worker_counts(path), compiled(pat)
        for batch in batches:
            out: list[list[int]] = [[] for _ in names]
            texts, leaves = [], []
            for t, kept, e in zip(texts_of(batch.column(1)), batch.column(2), batch.column(3), strict=True):
                tree = EditedCount.read(t.as_py(), kept.as_py(), counts, find)
                row = [tree.chars, tree.total, 0]
                for x in e.as_py() or ():
                    if x is not None:
                        s = x["s"] or 0
                        tree.edit(s, s if x["e"] is None else x["e"], x["t"] or "")
                        row[2] += 1
                for o, v in zip(out, (*row, tree.chars, tree.total, tree.rescanned), strict=True):
                    o.append(v)
                if keep_trees:
                    texts.append(tree.text)
                    leaves.append(tree.leaves())
            made = rows_batch(names, out, [pa.int64()] * len(names))
            more = [pa.array(texts, pa.string()), pa.array(leaves, pa.binary())] if keep_trees else []
            yield pa.RecordBatch.from_arrays([batch.column(0), *made.columns, *more], names=["key", *names, *["text", "leaves"][: len(more)]])

    kind = dict(trees.dtypes)["key"]
    return map_arrow(rows, run, f"key {kind}, " + ", ".join(f"{n} long" for n in names) + ", text string, leaves binary" * keep_trees)


#: The edits of the registered query: a deletion, an insertion and a replacement, at a quarter, a half and three quarters of each text.
EDITS = """array(
  struct(n_chars div 4 as start, n_chars div 4 + 7 as `end`, '' as text),
  struct(n_chars div 2 as start, n_chars div 2 as `end`, ' inserted words 2024\n\n' as text),
  struct(n_chars * 3 div 4 as start, n_chars * 3 div 4 + 5 as `end`, 'é''re  ' as text))"""


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    trees = store(plant_trees(table(spark, sf_dir, "documents")))
    return edit_trees(trees, F.expr(EDITS)).withColumnRenamed("key", "doc_id")
