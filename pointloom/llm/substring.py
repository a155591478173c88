"""Substring deduplication over a log-structured index of window fingerprints.

A window is ``WINDOW`` consecutive words. Windows are bundled in segments:
maximal runs of windows with the same least hash of ``GRAM`` words inside (the
mark). Equal windows have equal marks, so a window can repeat only under a mark
that several documents have, and only under a mark with several different segments
can windows be equal without their whole segments being so.

The index is log-structured. A batch of documents is fingerprinted once; the first
of each different segment goes into a sorted immutable run, a table bucketed by mark with fixed
borders, which later batches read without dealing it out again: each run is merge-joined with
the batch's marks, bucket by bucket, and only its segments of these marks go on with the batch's own.
``FANOUT`` runs of a level are compacted to one of the next. A manifest names the runs, so that an index can be opened again.

Equal segments are decided at once; the first of each of the different segments of a mark
are opened: their windows are read again from the texts of just these documents and
compared. Segments and opened windows count as equal if the BLAKE2 digests (128 bits) of
their very words are: the 64-bit word hashes only choose marks.

Edges: a null text has no words; a null id comes before all others; rows of one
id (repeated or different) do not repeat each other; documents shorter than a
window lose nothing; extra columns are unused.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import wordhash
from .common import map_arrow, materialize, scratch_dir, table, texts_of

WINDOW, GRAM = 50, 8
#: Runs of a level that are compacted to one of the next.
FANOUT = 2
#: Lists of ranges by document go to every executor up to so many ranges (about 40 bytes each); beyond it they are joined by shuffle.
BROADCAST_ROWS = 1_000_000
FIRST_ID = -(2**63)

SEGMENTS = "mark long, seg long, seg2 long, id long, h long, pos int, n int"
RUN = SEGMENTS + ", k long"
WINDOWS = "mark long, w long, w2 long, id long, h long, pos int"


def ids_differ(docs: DataFrame, key: str = "doc_id") -> bool:
    return docs.groupBy(F.coalesce(F.col(f"`{key}`").cast("long"), F.lit(FIRST_ID)).alias("id")).count().where("count > 1").isEmpty()


def keyed(docs: DataFrame, key: str, text: str, distinct: bool = False) -> DataFrame:
    """id, h (tells rows of one id apart; 0 where all ids are known to differ) and text."""
    rows = docs.select(F.coalesce(F.col(f"`{key}`").cast("long"), F.lit(FIRST_ID)).alias("id"), F.col(f"`{text}`").cast("string").alias("text"))
    h = F.lit(0).cast("long") if distinct else F.xxhash64("text")
    return rows.select("id", h.alias("h"), "text")


def merged(spans: str) -> Column:
    """The ranges of an array of struct b, e, joined where they meet, in order."""
    return F.expr(f"""aggregate(array_sort({spans}), named_struct('done', cast(array() as array<struct<b:int,e:int>>), 'b', -1, 'e', -1),
      (a, r) -> if(r.b <= a.e, named_struct('done', a.done, 'b', a.b, 'e', greatest(a.e, r.e)),
        named_struct('done', if(a.e < 0, a.done, concat(a.done, array(named_struct('b', a.b, 'e', a.e)))), 'b', r.b, 'e', r.e)),
      a -> concat(a.done, array(named_struct('b', a.b, 'e', a.e))))""")


def ranges_of(rows: DataFrame, name: str) -> DataFrame:
    """id, h and the joined ranges of its rows (b, e): bounded by a document's length."""
    return materialize(rows.groupBy("id", "h").agg(F.collect_list(F.struct(F.col("b").cast("int").alias("b"), F.col("e").cast("int").alias("e"))).alias("all")).select("id", "h", merged("all").alias(name)))


def marks_of(hashes: np.ndarray) -> np.ndarray:
    """The mark of the window that begins at each word."""
    return wordhash.sliding_min(wordhash.windows(hashes, GRAM), WINDOW - GRAM + 1)


def segments(docs: DataFrame) -> DataFrame:
    """The segments of each keyed document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, hs = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            for s in wordhash.words_of(texts_of(batch.column(2))):
                n = len(s.hashes)
                if n < WINDOW:
                    continue
                row = np.repeat(np.arange(s.rows), np.diff(s.at))
                starts = np.flatnonzero(np.arange(n - WINDOW + 1) + WINDOW <= s.at[row[: n - WINDOW + 1] + 1])
                if not len(starts):
                    continue
                mark = marks_of(s.hashes)[starts]
                new = np.ones(len(starts), bool)
                new[1:] = (mark[1:] != mark[:-1]) | (row[starts[1:]] != row[starts[:-1]])
                first = np.flatnonzero(new)
                count = np.diff(np.append(first, len(starts)))
                begin = starts[first]
                seg, seg2 = wordhash.digests(s, begin, begin + count + WINDOW - 1)
                at = s.first + row[begin]
                columns = [mark[first].view(np.int64), seg, seg2, ids[at], hs[at], (begin - s.at[row[begin]]).astype(np.int32), count.astype(np.int32)]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=[x.split()[0] for x in SEGMENTS.split(", ")])

    return map_arrow(docs, run, SEGMENTS)


def open_windows(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """The windows that begin in the wanted ranges (id, h, b, e), read from the texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, hs, lists = batch.column(0).to_numpy(), batch.column(1).to_numpy(), batch.column(3)
            flat, offsets = lists.flatten(), lists.offsets.to_numpy()
            begin, end = (flat.field(i).to_numpy().astype(np.int64) for i in range(2))
            offsets = offsets - offsets[0]
            for s in wordhash.words_of(texts_of(batch.column(2))):
                at = offsets[s.first : s.first + s.rows + 1]
                a, b = at[0], at[-1]
                if a == b:
                    continue
                row = np.repeat(np.arange(s.rows), np.diff(at))
                k = end[a:b] - begin[a:b]
                place = np.repeat(begin[a:b], k) + np.arange(k.sum()) - np.repeat(np.cumsum(k) - k, k)
                rows = np.repeat(row, k)
                where = s.at[rows] + place
                columns = [marks_of(s.hashes)[where].view(np.int64), *wordhash.digests(s, where, where + WINDOW), ids[s.first + rows], hs[s.first + rows], place.astype(np.int32)]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=[x.split()[0] for x in WINDOWS.split(", ")])

    lists = ranges_of(wanted, "open")
    bound = lists.agg(F.min("id").alias("a"), F.max("id").alias("b")).first()
    docs = docs.where(F.col("id").between(bound.a, bound.b)) if bound.a is not None else docs.limit(0)
    return map_arrow(docs.join(_small(lists), ["id", "h"]).select("id", "h", "text", "open"), run, WINDOWS)


def _small(lists: DataFrame) -> DataFrame:
    """The written lists, to be broadcast if they are few."""
    return F.broadcast(lists) if (lists.agg(F.sum(F.size(lists.columns[-1]))).first()[0] or 0) <= BROADCAST_ROWS else lists


class WindowIndex:
    """Sorted runs of segments in a folder, with a manifest, and the documents they came from."""

    def __init__(self, spark: SparkSession, folder: str | None = None, distinct: bool = False, buckets: int | None = None):
        """``distinct``: all ids of all batches are known to differ. ``buckets``: the fixed borders of all runs; by default one for four of the session's shuffle partitions."""
        self.spark, self.folder, self.distinct = spark, folder or scratch_dir(spark), distinct
        self.buckets = buckets or max(1, int(spark.conf.get("spark.sql.shuffle.partitions")) // 4)
        self.runs: list[tuple[int, str]] = []  # level and folder
        self.history: DataFrame | None = None
        self._made = self._version = 0

    @classmethod
    def open(cls, spark: SparkSession, folder: str, history: DataFrame, key: str = "doc_id", text: str = "text") -> WindowIndex:
        """The index in ``folder`` as its last manifest has it; ``history`` are the documents that it has indexed."""
        last = spark.read.parquet(f"{folder}/manifest/*").orderBy(F.desc("version")).first()
        index = cls(spark, folder, last.distinct_ids, last.buckets)
        index.runs, index._made, index._version = [(r.level, r.path) for r in last.runs], last.made, last.version
        index.history = keyed(history, key, text, index.distinct)
        return index

    def _save(self) -> None:
        self._version += 1
        row = (self._version, self._made, self.buckets, self.distinct, self.runs)
        made = self.spark.createDataFrame([row], "version int, made int, buckets int, distinct_ids boolean, runs array<struct<level:int,path:string>>")
        made.coalesce(1).write.parquet(f"{self.folder}/manifest/{self._version:08d}")

    def _name(self, path: str) -> str:
        return "pointloom_run_" + hashlib.md5(path.encode()).hexdigest()

    def _write_run(self, rows: DataFrame) -> str:
        """``rows`` are dealt by mark already."""
        self._made += 1
        path = f"{self.folder}/run-{self._made}"
        rows.write.option("path", path).option("compression", "zstd").bucketBy(self.buckets, "mark").sortBy("mark", "seg", "seg2").saveAsTable(self._name(path))
        return path

    def _run(self, path: str) -> DataFrame:
        columns = RUN.replace(" long", " bigint")
        self.spark.sql(f"CREATE TABLE IF NOT EXISTS {self._name(path)} ({columns}) USING parquet OPTIONS (path '{path}') CLUSTERED BY (mark) SORTED BY (mark, seg, seg2) INTO {self.buckets} BUCKETS")
        return self.spark.table(self._name(path))

    def _firsts(self, rows: DataFrame, **more: Column) -> DataFrame:
        """The row of the least id of each segment, with further aggregates. Where ids differ all its parts are numbers, which are aggregated by hash."""
        by = rows.groupBy("mark", "seg", "seg2")
        named = [v.alias(n) for n, v in more.items()]
        if not self.distinct:
            return by.agg(F.min(F.struct("id", "h", "pos", "n")).alias("f"), *named).select("mark", "seg", "seg2", "f.id", "f.h", "f.pos", "f.n", *more)
        place = F.shiftleft(F.col("pos").cast("long"), 32) + F.col("n")
        made = by.agg(F.min("id").alias("id"), F.min_by(place, F.col("id")).alias("p"), *named)
        return made.select("mark", "seg", "seg2", "id", F.lit(0).cast("long").alias("h"), F.shiftright("p", 32).cast("int").alias("pos"), F.col("p").bitwiseAND(F.lit((1 << 32) - 1)).cast("int").alias("n"), *more)

    def close(self) -> None:
        """Take the runs out of the session's catalogue; their files and the manifest stay."""
        for k in range(1, self._made + 1):
            self.spark.sql(f"DROP TABLE IF EXISTS {self._name(f'{self.folder}/run-{k}')}")

    def touched(self, path: str, run: str) -> DataFrame:
        """The segments of a run whose marks another run has: both are read as they are dealt."""
        return self._run(path).join(self._run(run).select("mark").distinct().hint("merge"), "mark", "left_semi")

    def add(self, docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
        """Fingerprint a batch, whose ids are above all those before, find its repeats, and index it.

        Returns id, h and removed (array of struct b, e: word ranges) of the documents that lose words.
        """
        batch = keyed(docs, key, text, self.distinct)
        entries = materialize(segments(batch))
        # the first of each segment: combined before the first shuffle, so that copies meet no bucket as rows
        run = self._write_run(self._firsts(entries, k=F.count("*")).repartition(self.buckets, "mark"))
        met = self._run(run).withColumn("new", F.lit(True))
        for _, path in self.runs:
            met = met.unionByName(self.touched(path, run).withColumn("new", F.lit(False)))
        met = materialize(met)  # as much as the batch has, whatever the history
        several = (F.min("seg") != F.max("seg")) | (F.min("seg2") != F.max("seg2"))
        marks = met.groupBy("mark").agg(several.alias("several"), ((F.count("*") > 1) | (F.max("k") > 1)).alias("again"))
        shared = met.join(marks.where("again").select("mark", "several"), "mark")
        decided = self._firsts(shared, k=F.sum("k"), new=F.max("new"), several=F.max("several"))
        decided = materialize(decided.where("several or new and k > 1"))
        known = decided.where("new and k > 1").select("mark", "seg", "seg2", F.col("id").alias("first"))
        whole = entries.join(F.broadcast(known) if known.count() <= BROADCAST_ROWS else known, ["mark", "seg", "seg2"]).where("id > first")
        whole = whole.select("id", "h", F.col("pos").alias("b"), (F.col("pos") + F.col("n") + (WINDOW - 1)).alias("e"))
        texts = batch if self.history is None else self.history.unionByName(batch)
        opened = materialize(open_windows(texts, decided.where("several").select("id", "h", F.col("pos").alias("b"), (F.col("pos") + F.col("n")).alias("e"))))
        low = batch.agg(F.min("id")).first()[0]
        least = opened.groupBy("mark", "w", "w2").agg(F.min("id").alias("first"), F.max("id").alias("last")).where((F.col("first") < F.col("last")) & (F.col("last") >= F.lit(low)))
        least = materialize(least.select("mark", "w", "w2", "first"))
        repeats = opened.where(F.col("id") >= F.lit(low)).join(least, ["mark", "w", "w2"]).where("id > first").select("id", "h", F.col("pos").alias("b"), (F.col("pos") + WINDOW).alias("e"))
        removed = ranges_of(repeats.unionByName(whole), "removed")
        self.runs.append((0, run))
        self.history = texts
        self.compact()
        self._save()
        return removed

    def compact(self) -> None:
        """Merge ``FANOUT`` runs of a level into one of the next, which keeps the smallest document of each segment."""
        level = 0
        while level <= max(at for at, _ in self.runs):
            own = [path for at, path in self.runs if at == level]
            if len(own) >= FANOUT:
                # read as plain files, which claim no order among them: each bucket is gathered once a level
                rows = self.spark.read.schema(RUN).parquet(*own).repartition(self.buckets, "mark")
                made = self._write_run(self._firsts(rows, k=F.sum("k")))
                self.runs = [(at, path) for at, path in self.runs if at != level] + [(level + 1, made)]
            level += 1


def remove_repeats(docs: DataFrame, removed: DataFrame, key: str = "doc_id", text: str = "text", keep_text: bool = True, distinct: bool = False) -> DataFrame:
    """A row per row of ``docs``: key, n_words, n_removed, kept_sha256, and kept (the words that stay, joined by spaces)."""
    rows = keyed(docs, key, text, distinct).join(_small(removed), ["id", "h"], "left").select(F.when(F.col("id") != FIRST_ID, F.col("id")).cast(docs.schema[key].dataType).alias("key"), "text", "removed")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, gone, digest, kept = [], [], [], []
            for t, r in zip(texts_of(batch.column(1)).cast(pa.binary()), batch.column(2), strict=True):
                words = t.as_py().split()
                n.append(len(words))
                ranges = r.as_py()
                if ranges:
                    stay = np.zeros(len(words) + 1, np.int64)
                    for x in ranges:
                        stay[x["b"]] += 1
                        stay[x["e"]] -= 1
                    words = list(compress(words, (np.cumsum(stay)[:-1] == 0).tolist()))
                gone.append(n[-1] - len(words))
                text = b" ".join(words)
                digest.append(hashlib.sha256(text).hexdigest())
                if keep_text:
                    kept.append(text)
            columns = [batch.column(0), pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(digest, pa.string())]
            names = ["key", "n_words", "n_removed", "kept_sha256"]
            if keep_text:
                columns, names = [*columns, pa.array(kept, pa.binary()).cast(pa.string())], [*names, "kept"]
            yield pa.RecordBatch.from_arrays(columns, names=names)

    kind = docs.schema[key].dataType.simpleString()
    out = map_arrow(rows, run, f"key {kind}, n_words long, n_removed long, kept_sha256 string" + ", kept string" * keep_text)
    return out.withColumnRenamed("key", key)


def deduplicate(docs: DataFrame, batches: int = FANOUT + 1, key: str = "doc_id", text: str = "text", keep_text: bool = True) -> DataFrame:
    """Index ``docs`` in so many batches of ascending ids (by default enough to compact and go on) and remove what repeats smaller ids."""
    spark = docs.sparkSession
    cuts = docs.agg(F.percentile_approx(F.col(f"`{key}`").cast("long"), [i / batches for i in range(1, batches)])).first()[0] if batches > 1 else []
    edges = sorted(set(cuts or []))
    distinct = ids_differ(docs, key)
    index, found = WindowIndex(spark, distinct=distinct), None
    column = F.coalesce(F.col(f"`{key}`").cast("long"), F.lit(FIRST_ID))
    for low, high in zip([None, *edges], [*edges, None], strict=True):
        part = docs if low is None else docs.where(column > low)
        part = part if high is None else part.where(column <= high)
        removed = index.add(part, key, text)
        found = removed if found is None else found.unionByName(removed)
    index.close()
    return remove_repeats(docs, found, key, text, keep_text, distinct)


def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return deduplicate(table(spark, sf_dir, "documents"), keep_text=False)
