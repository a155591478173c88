"""Benchmark decontamination by a prefix-filtered join of word windows, with DataFrame functions alone.

Each benchmark item gives windows of ``WINDOW`` consecutive words (a shorter
item is one window). A document contains a window only if it contains its
rarest word, so a window's necessary prefix is that one word: words are
ordered by their count over all documents, every document word is joined with
the prefix words, the window's length and the word's place in it bound where
an occurrence can lie, and the words there are compared one by one.

Texts are split twice: once to count words, once to find occurrences. The second
pass adds an empty word behind each text's last one, which meets an empty window
of its own; the place of that occurrence is the document's number of words.

The prefix table is broadcast only up to ``BROADCAST_WINDOWS`` windows. Beyond
it, word positions are joined by shuffle and candidates meet their documents
again for the comparison.

Edges: null texts have no words; items without words have no windows; rows of
one id with different texts are judged apart, repeated rows alike; a null id is
an id of its own, of documents and of items (it counts in n_items); extra columns are unused.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize, table

WINDOW = 10
BROADCAST_WINDOWS = 100_000
#: Hits (documents with an occurrence) that are broadcast at most, about 30 bytes each.
BROADCAST_HITS = 1_000_000
# Fixed values of the contract: what separates words once A-Z are lower case, and before (the upper-case letters apart, the same).
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
ANY_SEPARATORS = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def as_written(text: str) -> Column:
    """The words of a column of texts, in their own case."""
    return F.array_remove(F.split(F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")), ANY_SEPARATORS), "")


def words_of(text: str) -> Column:
    return F.array_remove(F.split(F.translate(F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")), UPPER, LOWER), SEPARATORS), "")


def folded(word: Column) -> Column:
    """A join key: words that are equal once A-Z are lower case have equal keys."""
    return F.lower(word)


def item_windows(benchmark: DataFrame, window: int = WINDOW, item: str = "item_id", text: str = "text") -> DataFrame:
    """item and w (array of words) of every distinct window."""
    words = benchmark.select(F.col(f"`{item}`").alias("item"), words_of(text).alias("all")).where("size(all) > 0")
    at = F.explode(F.sequence(F.lit(1), F.greatest(F.lit(1), F.size("all") - (window - 1))))
    return words.select("item", "all", at.alias("at")).select("item", F.slice("all", F.col("at"), window).alias("w")).distinct()


def _rarest(windows: DataFrame, docs_words: DataFrame, small: bool) -> DataFrame:
    """Windows with the key of their rarest word and its place; counts are over all documents."""

    def sized(df: DataFrame) -> DataFrame:
        return F.broadcast(df) if small else df

    vocabulary = windows.select(F.explode("w").alias("word")).select(folded(F.col("word")).alias("word")).distinct()
    said = docs_words.select(F.explode("all").alias("word")).select(folded(F.col("word")).alias("word"))
    counts = said.join(sized(vocabulary), "word").groupBy("word").agg(F.count("*").alias("n"))
    placed = windows.select("w").distinct().select("w", F.posexplode("w").alias("off", "word")).select("w", "off", folded(F.col("word")).alias("word")).join(sized(counts), "word", "left")
    best = F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "word", "off")).alias("best")
    prefixes = placed.groupBy("w").agg(best).select("w", F.col("best.word").alias("word"), F.col("best.off").alias("off"))
    return materialize(prefixes)


def _gathered(collect, value: Column) -> Column:
    """The values, nulls among them, which collect_set and collect_list alone leave out."""
    return F.transform(collect(F.struct(value.alias("v"))), lambda x: x["v"])


def _occurrences(docs: DataFrame, windows: DataFrame, key: str, text: str, ends: bool) -> DataFrame:
    """id, h (hash of the text), begin (0-based word) and w of every occurrence; with ``ends`` also, for every row of ``docs``, its number of words as the place of an empty w."""
    small = windows.count() <= BROADCAST_WINDOWS
    words = docs.select(F.col(f"`{key}`").alias("id"), F.xxhash64(f"`{text}`").alias("h"), as_written(text).alias("all"))
    prefixes = _rarest(windows, words, small)
    begin = (F.col("pos") - F.col("off")).alias("begin")
    fits = (F.col("pos") >= F.col("off")) & (F.col("pos") - F.col("off") + F.size("w") <= F.col("n"))
    # words hold no spaces; every expression here is compiled, or each word's row would be written out with its whole text
    same = F.translate(F.array_join(F.slice("all", F.col("begin") + 1, F.size("w")), " "), UPPER, LOWER) == F.array_join("w", " ")
    if small:
        if ends:
            prefixes = prefixes.unionByName(docs.sparkSession.range(1).select(F.array().cast("array<string>").alias("w"), F.lit("").alias("word"), F.lit(0).alias("off")))
        said = F.array_append("all", F.lit("")) if ends else F.col("all")
        at = words.select("id", "h", "all", F.size("all").alias("n"), F.posexplode(said).alias("pos", "word")).withColumn("word", folded(F.col("word")))
        return at.join(F.broadcast(prefixes), "word").where(fits).select("id", "h", "all", "w", begin).where(same).select("id", "h", "begin", "w")
    at = words.select("id", "h", F.size("all").alias("n"), F.posexplode("all").alias("pos", "word")).withColumn("word", folded(F.col("word")))
    candidates = at.join(prefixes, "word").where(fits).select("id", "h", "w", begin)
    own = words.join(_sized(materialize(candidates.select(F.col("id").alias("cid"), F.col("h").alias("ch")).distinct())), F.col("id").eqNullSafe(F.col("cid")) & (F.col("h") == F.col("ch")), "left_semi").dropDuplicates(["id", "h"])
    found = candidates.alias("c").join(own.alias("d"), F.col("c.id").eqNullSafe(F.col("d.id")) & (F.col("c.h") == F.col("d.h"))).select("c.id", "c.h", "d.all", "c.w", "c.begin").where(same)
    found = found.select("id", "h", "begin", "w")
    return found.unionByName(words.select("id", "h", F.size("all").alias("begin"), F.array().cast("array<string>").alias("w"))) if ends else found


def _sized(hits: DataFrame) -> DataFrame:
    """Written rows, to be broadcast where they are few."""
    return F.broadcast(hits) if hits.count() <= BROADCAST_HITS else hits


def find_windows(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Occurrences of benchmark windows: id, h (hash of the text), begin (0-based word), w (its words)."""
    return _occurrences(docs, materialize(item_windows(benchmark, window)), key, text, False)


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, key: str = "doc_id", text: str = "text") -> DataFrame:
    """A row per row of ``docs``: key, n_words, n_hit, n_items, items (sorted strings; a null id first), contaminated."""
    windows = materialize(item_windows(benchmark, window))
    found = materialize(_occurrences(docs, windows, key, text, True))
    hits = found.where("size(w) > 0")
    spots = hits.select("id", "h", F.explode(F.sequence(F.col("begin"), F.col("begin") + F.size("w") - 1)).alias("at")).distinct().groupBy("id", "h").agg(F.count("*").alias("n_hit"))
    by_window = windows.groupBy("w").agg(_gathered(F.collect_set, F.col("item").cast("string")).alias("items"))
    named = hits.select("id", "h", "w").distinct().join(F.broadcast(by_window) if windows.count() <= BROADCAST_WINDOWS else by_window, "w")
    items = named.select("id", "h", F.explode("items").alias("item")).distinct().groupBy("id", "h").agg(F.sort_array(_gathered(F.collect_list, F.col("item"))).alias("items"))
    both = spots.withColumnsRenamed({"id": "sid", "h": "sh"}).join(items, F.col("sid").eqNullSafe(F.col("id")) & (F.col("sh") == F.col("h"))).select("sid", "sh", "n_hit", "items")
    own = found.where("size(w) = 0").select("id", "h", F.col("begin").cast("long").alias("n_words"))
    return own.join(_sized(materialize(both)), F.col("id").eqNullSafe(F.col("sid")) & (F.col("h") == F.col("sh")), "left").select(
        F.col("id").alias(key), "n_words", F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"), F.coalesce("items", F.array().cast("array<string>")).alias("items")
    ).select(key, "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), "items", (F.col("n_hit") > 0).alias("contaminated"))


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs`` in which no benchmark window occurs."""
    hit = materialize(find_windows(docs, benchmark, window, key, text).select("id", F.col("h").alias("hit_h")).distinct())
    columns = docs.columns
    whole = docs.select(F.struct(*[F.col(f"`{c}`") for c in columns]).alias("whole"), F.col(f"`{key}`").alias("k"), F.xxhash64(f"`{text}`").alias("h"))
    kept = whole.join(_sized(hit), F.col("k").eqNullSafe(F.col("id")) & (F.col("h") == F.col("hit_h")), "left_anti")
    return kept.select(*[F.col(f"whole.`{c}`").alias(c) for c in columns])


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated")


OP9_SQL = r"""
WITH d AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM documents),
b AS (SELECT item_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM benchmark),
bw AS (SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(w[i:i + least(len(w), 10) - 1], ' ') AS s
  FROM (SELECT *, unnest(range(1, greatest(1, len(w) - 9) + 1)) AS i FROM b WHERE len(w) > 0)),
dw AS (SELECT doc_id, i, n, array_to_string(w[i:i + n - 1], ' ') AS s
  FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, (SELECT DISTINCT n FROM bw))),
h AS (SELECT doc_id, i, dw.n AS n, item_id FROM dw JOIN bw USING (s)),
p AS (SELECT doc_id, count(DISTINCT j) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS j FROM h) GROUP BY doc_id),
q AS (SELECT doc_id, count(*) AS n_items, string_agg(x, ',' ORDER BY x) AS ids FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS x FROM h) GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN p USING (doc_id) LEFT JOIN q USING (doc_id)
"""
