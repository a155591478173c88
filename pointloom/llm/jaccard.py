"""N-gram Jaccard join by adaptive multi-match prefixes, and its components.

A document's set are its distinct ``SHINGLE``-word shingles. Sets are ordered by
rarity (shingles that are frequent over the corpus last, the others by hash).
Two sets of the asked similarity share at least l shingles among the first
n - ceil(s * n) + l of each; l = 1 is the plain prefix. A pair must share the lesser of its two sets' l.

1. Every text gives its set's hash and size; equal sets are one from here on.
2. With l a sixteenth of the size, prefix shingles meet by shuffle. A set of whose prefix
   too few shingles occur elsewhere has no partner and is gone: its candidates cost nothing.
3. The others lengthen their prefixes to l = half the size. Each shingle links its sets to the first
   of them (never pairs). A set may drop its weakest links as long as they stand
   for fewer than half the shingles it must share: any true pair still keeps a link that both have.
   Clusters are the components of what is left.
   Runs of very frequent shingles are split by a hash of the set (``HOT`` sets a part), and the
   parts' first sets linked in a second round.
4. Texts are dealt by cluster, in chunks of a bounded number of shingles, and joined inside. A chunk
   orders its shingles by its own counts, estimates from them what candidates each set would
   get from prefixes of l = a sixteenth, an eighth, a quarter and half of its size, and takes the cheapest.
   An inverted index over these prefixes counts matches per candidate (the longest lists, fewer than the
   least l, are left out and the asked matches lowered by them), skips candidates that
   are already linked, and verifies the rest on whole sets.
5. Clusters of several chunks share hub documents; if they are then not one
   component, every set outside the largest is joined with the chunks that have a shingle of its plain prefix in theirs.

Links found span every component of the full graph: a pair is skipped only if both are
in one component already.

Edges: null and empty texts have empty sets, which are linked with nothing; fewer words than a shingle
make one shingle; a null id comes before all others; repeated rows are in one component;
extra columns are unused.
"""

from __future__ import annotations

from array import array
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..ship import ship
from . import wordhash
from .common import map_arrow, materialize, table, texts_of
from .components import components

SHINGLE, PERCENT = 5, 75
#: A shingle is frequent from so many sets on, and from its share of all on that lets no more than FREQUENT_MOST be so.
FREQUENT_LEAST, FREQUENT_MOST, LOCAL_LEAST = 64, 1 << 20, 4
#: Shingles that a task holds at once, in counting and in a chunk of a cluster; documents that all chunks of a cluster share.
HELD, CHUNK, HUBS = 2_000_000, 1_000_000, 8
BROADCAST_ROWS = 1_000_000
#: Sets in a part of a frequent shingle's run.
HOT = 8192
#: Rows of numbers that a function gets at once.
WIDE = 100_000
FIRST_ID = -(2**63)


def shingle_sets(texts: pa.Array, size: int = SHINGLE) -> Iterator[tuple[int, np.ndarray]]:
    """Row and sorted distinct shingle hashes of each text."""
    for s in wordhash.words_of(texts, lower=True):
        whole = wordhash.windows(s.hashes, size)
        for i in range(s.rows):
            a, b = s.at[i], s.at[i + 1]
            if b - a >= size:
                yield s.first + i, np.unique(whole[a : b - size + 1])
            elif b > a:
                yield s.first + i, wordhash.span_hashes(s.hashes[a:b], np.array([0]), np.array([b - a]))
            else:
                yield s.first + i, np.zeros(0, np.uint64)


def set_hash(x: np.ndarray) -> int:
    with np.errstate(over="ignore"):
        return int(wordhash.mix(np.array([wordhash.mix(x ^ np.uint64(0x2545F4914F6CDD1D)).sum(dtype=np.uint64) + np.uint64(len(x))]))[0].view(np.int64))


def needed(n, percent: int = PERCENT):
    """The shingles that a set of size n shares with any partner."""
    return -(-percent * n // 100)


#: l as a share of the size, before and after a prefix is lengthened: one in so many.
SHORT, LONG = 16, 2
#: Beyond any set's size: l = 1, the plain prefix.
PLAIN = 1 << 40
#: Inside a chunk, a set's l is one in so many of its size.
LADDER = (16, 8, 4, 2)
#: Candidates that are verified before the others, one by one.
TRIED = 3
#: What a place in a prefix costs beside a match there.
PLACE_COST = 2.0


def least_matches(part: int, percent: int = PERCENT, n: str = "n"):
    """The least l (one in ``part`` of the size) that a set of size n and any partner have."""
    return F.greatest(F.lit(1), F.floor(F.ceil(F.col(n) * percent / 100) / part)).cast("long")


class Order:
    """The global order of shingles: the frequent ones last, by their counts."""

    def __init__(self, frequent: np.ndarray, counts: np.ndarray):
        self.frequent, self.counts = frequent, counts

    def arrange(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The set in order, and the estimated number of other sets with each shingle."""
        if not len(self.frequent) or not len(x):
            return x, np.zeros(len(x), np.int64)
        at = np.minimum(np.searchsorted(self.frequent, x), len(self.frequent) - 1)
        cost = np.where(self.frequent[at] == x, self.counts[at], 0)
        if not cost.any():
            return x, cost
        order = np.lexsort((x, cost))
        return x[order], cost[order]

    def parts(self, tokens: np.ndarray, most: int) -> np.ndarray:
        """Into how many parts the sets of each token are split."""
        if not len(self.frequent):
            return np.ones(len(tokens), np.uint64)
        at = np.minimum(np.searchsorted(self.frequent, tokens), len(self.frequent) - 1)
        return np.where(self.frequent[at] == tokens, -(-self.counts[at] // most), 1).astype(np.uint64)

    def longer(self, x: np.ndarray, part: int, percent: int = PERCENT) -> np.ndarray:
        """The prefix for l = one in ``part`` of the size."""
        n = len(x)
        return self.arrange(x)[0][: n - needed(n, percent) + max(1, n // part)]


SETS = "kind int, x long, y long, n long"


def _sets(docs: DataFrame, size: int) -> DataFrame:
    """kind 0: id, set hash, size of every document; kind 1: a shingle and its count, of those frequent in a stretch of documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n_held, seen = [], 0, set()

        def rows(kind: int, x: np.ndarray, y: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(np.full(len(x), kind, np.int32)), pa.array(x.astype(np.int64)), pa.array(y.astype(np.int64)), pa.array(n.astype(np.int64))], names=["kind", "x", "y", "n"])

        def counted() -> pa.RecordBatch:
            values, counts = np.unique(np.concatenate(held), return_counts=True)
            often = counts >= LOCAL_LEAST
            return rows(1, values[often].view(np.int64), np.zeros(often.sum(), np.int64), counts[often])

        for batch in batches:
            ids, found = batch.column(0).to_numpy(), []
            for i, x in shingle_sets(texts_of(batch.column(1)), size):
                h = set_hash(x)
                found.append((ids[i], h, len(x)))
                if len(x) and h not in seen:
                    seen.add(h)
                    held.append(x)
                    n_held += len(x)
            if found:
                yield rows(0, *np.array(found, np.int64).T)
            if n_held >= HELD:
                yield counted()
                held, n_held, seen = [], 0, set()
        if held:
            yield counted()

    return map_arrow(docs, run, SETS)


def _order(spark: SparkSession, stored: DataFrame) -> Order:
    """Frequent shingles: bounded by FREQUENT_MOST, since no more can have that share of all."""
    total = stored.where("kind = 0").agg(F.sum("n")).first()[0] or 0
    least = max(FREQUENT_LEAST, -(-total // FREQUENT_MOST))
    found = stored.where("kind = 1").groupBy("x").agg(F.sum("n").alias("n")).where(F.col("n") >= least).toArrow()
    x, n = found.column("x").to_numpy().view(np.uint64), found.column("n").to_numpy()
    at = np.argsort(x)
    return Order(x[at], n[at])


def _prefixes(docs: DataFrame, order, part: int, size: int, percent: int) -> DataFrame:
    """token, salt, node, n of every document's prefix. docs: node (null: the set's hash) and text. Tokens of more than HOT sets are split by salts from 0 on, others have -1."""
    most = HOT

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ranked = order.value
        for batch in batches:
            own, tokens, nodes, sizes = batch.column(0).to_pylist(), [], [], []
            for i, x in shingle_sets(texts_of(batch.column(1)), size):
                if len(x):
                    tokens.append(ranked.longer(x, part, percent))
                    nodes.append(own[i] if own[i] is not None else set_hash(x))
                    sizes.append(len(x))
            if tokens:
                lengths = [len(t) for t in tokens]
                token, node = np.concatenate(tokens), np.repeat(np.array(nodes, np.int64), lengths)
                split = ranked.parts(token, most)
                salt = np.where(split > 1, wordhash.mix(node.view(np.uint64)) % split, np.int64(-1)).astype(np.int32)
                yield pa.RecordBatch.from_arrays([pa.array(token.view(np.int64)), pa.array(salt), pa.array(node), pa.array(np.repeat(np.array(sizes, np.int32), lengths))], names=["token", "salt", "node", "n"])

    return map_arrow(docs, run, "token long, salt int, node long, n int")


def _met(tokens: DataFrame) -> DataFrame:
    """node and how many of its tokens other nodes have too. Sorted rows are read as a stream: no token is gathered.

    Every node of a split token has met others.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None  # the last row so far, and whether it was counted
        last_met = True
        for batch in batches:
            rows = np.stack([batch.column(i).to_numpy().astype(np.int64) for i in range(3)])
            if not rows.shape[1]:
                continue
            if last is not None:
                rows = np.column_stack((last, rows))
            differs = rows[:, 1:] != rows[:, :-1]
            fresh = np.ones(rows.shape[1], bool)
            fresh[1:] = differs.any(0)
            rows = rows[:, fresh]
            t, salt, s = rows
            met = np.zeros(len(t), bool)
            same = (t[1:] == t[:-1]) & (salt[1:] == salt[:-1])
            met[1:] |= same
            met[:-1] |= same
            met |= salt >= 0
            out = met.copy()
            if last is not None and last_met:
                out[0] = False
            last_met = bool(met[-1]) or (len(t) == 1 and last is not None and last_met)
            last = rows[:, -1:]
            if out.any():
                nodes, counts = np.unique(s[out], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(nodes), pa.array(counts.astype(np.int64))], names=["node", "c"])

    made = map_arrow(tokens.select("token", "salt", "node").repartition("token", "salt").sortWithinPartitions("token", "salt", "node"), run, "node long, c long", WIDE)
    return made.groupBy("node").agg(F.sum("c").alias("c"))


def _runs(tokens: DataFrame, percent: int) -> DataFrame:
    """token, salt, node, head, n of every row of a token's run: head is the first node of the run.

    A token's sets in order of size form runs without a gap that similarity cannot bridge;
    runs of one set are left out, but for parts of split tokens.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None  # the last row, the head of its run, and whether that has been given out
        for batch in batches:
            t, salt, s, n = (batch.column(i).to_numpy() for i in range(4))
            if not len(t):
                continue
            new = np.ones(len(t), bool)
            new[1:] = (t[1:] != t[:-1]) | (salt[1:] != salt[:-1]) | (100 * n[:-1].astype(np.int64) < percent * n[1:].astype(np.int64))
            if held is not None and (t[0], salt[0]) == held["of"] and 100 * int(held["n"]) >= percent * int(n[0]):
                new[0] = False
            at = np.maximum.accumulate(np.where(new, np.arange(len(t)), -1))
            heads = np.where(at >= 0, s[np.maximum(at, 0)], held["head"] if held is not None else 0)
            first_of_pair = np.zeros(len(t), bool)
            first_of_pair[:-1] = new[:-1] & ~new[1:]
            count = ~new | first_of_pair | (salt >= 0)
            rows = [t[count], salt[count], s[count], heads[count], n[count]]
            if not new[0] and held["alone"]:  # the head, now that its run has a second set
                rows = [np.append(x, v) for x, v in zip(rows, (held["of"][0], held["of"][1], held["head"], held["head"], held["n"]), strict=True)]
            alone = bool(new[-1]) and salt[-1] < 0
            held = {"of": (t[-1], salt[-1]), "n": n[-1], "head": heads[-1], "alone": alone}
            if len(rows[0]):
                yield pa.RecordBatch.from_arrays([pa.array(x.astype(k)) for x, k in zip(rows, (np.int64, np.int32, np.int64, np.int64, np.int32), strict=True)], names=["token", "salt", "node", "head", "n"])

    dealt = tokens.select("token", "salt", "node", "n").repartition("token", "salt").sortWithinPartitions("token", "salt", "n", "node")
    return map_arrow(dealt, run, "token long, salt int, node long, head long, n int", WIDE)


def _leads(tokens: DataFrame, split: bool, percent: int) -> DataFrame:
    """Links (a, b) of sets to the heads of their tokens' runs that are left; with ``split``, also of the heads of a token's parts."""
    rows = _runs(tokens, percent)
    if not split:
        return _kept(rows.groupBy("node", "head").agg(F.max("n").alias("n"), F.count("*").alias("c")), percent)
    part = F.when((F.col("salt") >= 0) & (F.col("node") == F.col("head")), F.col("token")).alias("part")
    leads = materialize(rows.groupBy("node", "head", part).agg(F.max("n").alias("n"), F.count("*").alias("c")))
    heads = leads.where("part is not null").select(F.col("part").alias("token"), F.lit(-1).alias("salt"), "node", "n")
    between = _runs(heads, percent).where("node != head").select(F.col("node").alias("a"), F.col("head").alias("b"))
    return _kept(leads.groupBy("node", "head").agg(F.max("n").alias("n"), F.sum("c").alias("c")), percent).unionByName(between)


def _kept(leads: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) that are left: none of sets that share too little, and not the weakest of a set's."""
    own = Window.partitionBy("node")  # at most a set's size of rows
    weak = F.sum(F.when(F.col("node") != F.col("head"), F.col("c")).otherwise(0)).over(own.orderBy("c", "head").rowsBetween(Window.unboundedPreceding, 0))
    least = least_matches(LONG, percent)
    ranked = leads.withColumn("all", F.sum("c").over(own)).withColumn("weak", weak)
    return ranked.where((F.col("all") >= least) & (F.col("node") != F.col("head")) & (F.col("weak") > F.floor((least - 1) / 2))).select(F.col("node").alias("a"), F.col("head").alias("b"))


def choose_prefix(counts: np.ndarray, percent: int = PERCENT) -> tuple[int, int]:
    """Length and part (l is one in so many of the size) of the cheapest prefix; ``counts``, rising, say how many sets of the chunk have each shingle."""
    n = len(counts)
    plain, met = n - needed(n, percent), np.cumsum(counts - 1)
    best = None
    for part in LADDER:
        ell = max(1, n // part)
        length = min(n, plain + ell)
        cost = met[length - 1] / ell + PLACE_COST * length
        if best is None or cost < best[0]:
            best = cost, length, part
    return best[1], best[2]


class _Local:
    """The join inside a chunk: takes sets in order of size and links each with the components that it has a partner in.

    ``sets`` are sorted; ``components`` are labels: sets of one label are in one component from the start.
    """

    def __init__(self, sets: list[np.ndarray], components: list[int], percent: int):
        n = len(sets)
        self.percent, self.links = percent, []
        _, self.root = np.unique(np.array(components, np.int64), return_inverse=True)
        self.members: dict[int, list[int]] = {}
        for i, r in enumerate(self.root.tolist()):
            self.members.setdefault(r, []).append(i)
        whole = np.concatenate(sets) if n else np.zeros(0, np.uint64)
        _, number, counts = np.unique(whole, return_inverse=True, return_counts=True)
        self.sizes = np.array([len(x) for x in sets], np.int64)
        ends = np.cumsum(self.sizes)
        self.sets = [number[e - k : e] for k, e in zip(self.sizes.tolist(), ends.tolist(), strict=True)]
        #: the sets that have a shingle: owners[at[t] : at[t + 1]]
        self.owners, self.at = np.repeat(np.arange(n, dtype=np.int32), self.sizes)[np.argsort(number, kind="stable")], np.concatenate(([0], np.cumsum(counts)))
        chosen, ells, self.part = [], [], 1
        for x in self.sets:
            x = x[np.lexsort((x, counts[x]))]
            own = counts[x]
            length, part = choose_prefix(own, percent)
            self.part = max(self.part, part)
            ells.append(max(1, len(x) // part))
            chosen.append(x[:length][own[:length] > 1].tolist())
        self.ells = np.array(ells, np.int64)
        #: earlier sets with a shingle in their prefix
        self.posts: dict[int, array] = {}
        for i, tokens in enumerate(chosen):
            self._add(i, tokens)

    def similar(self, i: int, j: int) -> bool:
        a, b = self.sets[i], self.sets[j]
        small, large = (a, b) if len(a) < len(b) else (b, a)
        at = np.searchsorted(large, small)
        shared = int((large[np.minimum(at, len(large) - 1)] == small).sum())
        return 100 * shared >= self.percent * (len(a) + len(b) - shared)

    def _link(self, i: int, j: int) -> None:
        self.links.append((i, j))
        few, many = sorted((int(self.root[i]), int(self.root[j])), key=lambda r: len(self.members[r]))
        moved = self.members.pop(few)
        self.root[moved] = many
        self.members[many] += moved

    def _counted(self, lists: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """The sets in the lists, and how often each is."""
        every = np.concatenate(lists)
        if len(every) < len(self.sets) // 8:
            return np.unique(every, return_counts=True)
        counts = np.bincount(every, minlength=len(self.sets))
        places = np.flatnonzero(counts)
        return places, counts[places]

    def _add(self, i: int, tokens: list[int]) -> None:
        n, ell = int(self.sizes[i]), int(self.ells[i])
        held = sorted((p for t in tokens if (p := self.posts.get(t)) is not None), key=len)
        # the longest lists, fewer than the least l (no partner's is smaller), are left out, and the asked matches lowered by them
        light = held[: max(0, len(held) - (min(max(1, needed(n, self.percent) // self.part), ell) - 1))]
        if light:
            found, counts = self._counted([np.frombuffer(p, np.int32) for p in light])
            enough = (counts >= np.minimum(ell, self.ells[found]) - (len(held) - len(light))) & (100 * self.sizes[found] >= self.percent * n) & (self.root[found] != self.root[i])
            found = found[enough][np.argsort(-counts[enough], kind="stable")]
            self._verify(i, found[:TRIED])  # where these link, most others are in the component already
            found = found[TRIED:]
            found = found[self.root[found] != self.root[i]]
            if len(found) > TRIED * 8:  # all whole intersections at once
                whole, shared = self._counted([self.owners[self.at[t] : self.at[t + 1]] for t in self.sets[i].tolist()])
                shared = shared[np.searchsorted(whole, found)]
                found = found[100 * shared >= self.percent * (n + self.sizes[found] - shared)]
            self._verify(i, found)
        for t in tokens:
            self.posts.setdefault(t, array("i")).append(i)

    def _verify(self, i: int, found: np.ndarray) -> None:
        for j in found.tolist():
            if self.root[i] != self.root[j] and self.similar(i, j):
                self._link(i, j)


def _join_chunks(rows: DataFrame, size: int, percent: int) -> DataFrame:
    """Links (a, b) found inside each group, whose sets are held at once. rows: cluster, chunk, n, sid, component, text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, sids, sets, labels = None, [], [], []

        def links() -> pa.RecordBatch:
            found = _Local(sets, labels, percent).links
            return pa.RecordBatch.from_arrays([pa.array([sids[i] for i, _ in found], pa.int64()), pa.array([sids[j] for _, j in found], pa.int64())], names=["a", "b"])

        for batch in batches:
            cluster, chunk, sid, component = (batch.column(i).to_pylist() for i in (0, 1, 3, 4))
            for i, x in shingle_sets(texts_of(batch.column(5)), size):
                if (cluster[i], chunk[i]) != key:
                    if len(sids) > 1:
                        yield links()
                    key, sids, sets, labels = (cluster[i], chunk[i]), [], [], []
                if sids and sids[-1] == sid[i] or set_hash(x) != sid[i]:  # another row of the id
                    continue
                sids.append(sid[i])
                sets.append(x)
                labels.append(component[i])
        if len(sids) > 1:
            yield links()

    sorted_rows = rows.repartition("cluster", "chunk").sortWithinPartitions("cluster", "chunk", "n", "sid")
    return map_arrow(sorted_rows, run, "a long, b long")


def _small(rows: DataFrame) -> DataFrame:
    return F.broadcast(rows) if rows.count() <= BROADCAST_ROWS else rows


def _rows(docs: DataFrame, key: str, text: str, size: int, percent: int) -> DataFrame:
    """A row per row of ``docs``: id, sid (set hash), n, component (the smallest id that links reach) and root (a set hash that tells components apart)."""
    spark = docs.sparkSession
    ship(spark)
    keyed = docs.select(F.coalesce(F.col(f"`{key}`").cast("long"), F.lit(FIRST_ID)).alias("id"), F.col(f"`{text}`").cast("string").alias("text"))
    stored = materialize(_sets(keyed, size))
    sets = stored.where("kind = 0").select(F.col("x").alias("id"), F.col("y").alias("sid"), "n")
    order = spark.sparkContext.broadcast(_order(spark, stored))

    # a node is the first document of a set; its id, unless ids repeat, then the set's hash
    first = materialize(sets.where("n > 0").groupBy("sid").agg(F.min("id").alias("id"), F.max("n").alias("n"), F.count("*").alias("k")))
    distinct = sets.groupBy("id").count().where("count > 1").isEmpty()
    nodes = first.select("sid", "id", "n", (F.col("id") if distinct else F.col("sid")).alias("node"))
    if distinct:
        later = sets.where("n > 0").join(_small(first.where("k > 1").select("sid", F.col("id").alias("f"))), "sid").where("id > f").select("id")
        once = keyed.join(_small(materialize(later)), "id", "left_anti").select(F.col("id").alias("node"), "text")
    else:
        once = keyed.select(F.lit(None).cast("long").alias("node"), "text")

    met = _met(_prefixes(once, order, SHORT, size, percent))
    live = materialize(met.join(nodes, "node").where(F.col("c") >= least_matches(SHORT, percent)).select("node", "sid", "id", "n"))
    again = keyed.join(_small(live.select("id", F.col("node").alias("known"))), "id").select(F.col("known") if distinct else F.lit(None).cast("long"), "text")
    split = bool((order.value.counts > HOT).any())
    clusters = components(_leads(_prefixes(again.toDF("node", "text"), order, LONG, size, percent), split, percent))

    members = clusters.join(live, "node").withColumnRenamed("root", "cluster")
    weights = members.groupBy("cluster").agg(F.ceil(F.sum("n") / CHUNK).alias("chunks"), F.count("*").alias("k"))
    here = materialize(members.join(weights, "cluster").where("k > 1").withColumn("chunk", F.expr("pmod(xxhash64(node), chunks)")))
    with_text = keyed.join(_small(here), "id")
    hub = (F.col("chunks") > 1) & (F.expr(f"pmod(xxhash64(node, 2), greatest(1, k div {HUBS}))") == 0)
    chunks = F.when(hub, F.expr("sequence(0L, chunks - 1)")).otherwise(F.array("chunk"))
    dealt = with_text.select("cluster", F.explode(chunks).alias("chunk"), "n", "sid", F.col("sid").alias("component"), "text")
    found = materialize(_join_chunks(dealt, size, percent))
    roots = components(found)

    large = here.where("chunks > 1")
    if not large.isEmpty():
        placed = materialize(large.join(roots.select(F.col("node").alias("sid"), "root"), "sid", "left").withColumn("component", F.coalesce("root", "sid")).drop("root"))
        sizes = placed.groupBy("cluster", "component").agg(F.count("*").alias("m"))
        largest = sizes.groupBy("cluster").agg(F.max_by("component", F.struct("m", "component")).alias("largest"), F.count("*").alias("parts"))
        open_ = materialize(placed.join(largest.where("parts > 1"), "cluster"))
        if not open_.isEmpty():
            rest = open_.where("component != largest")
            blocks = rest.groupBy("cluster").agg(F.ceil(F.sum("n") / CHUNK).alias("blocks"))
            chunk_of = (F.col("block") * F.col("chunks") + F.col("at")).alias("chunk")
            said = _prefixes(keyed.join(_small(open_.select("id", "sid")), "id").select(F.col("sid").alias("node"), "text"), order, PLAIN, size, percent).select(F.col("node").alias("sid"), "token").distinct()
            said = materialize(said.join(open_.select("sid", "cluster", F.col("chunk").alias("at"), (F.col("component") != F.col("largest")).alias("outside")), "sid"))
            visits = said.where("outside").select("sid", "cluster", "token").join(said.select("cluster", "at", "token").distinct(), ["cluster", "token"]).select("sid", "at").distinct()
            probes = rest.join(blocks, "cluster").select("*", F.expr("pmod(xxhash64(sid, 1), blocks)").alias("block")).join(visits, "sid")
            bases = open_.join(blocks, "cluster").withColumn("at", F.col("chunk")).select("*", F.explode(F.expr("sequence(0L, blocks - 1)")).alias("block"))
            wanted = ["id", "cluster", chunk_of, "n", "sid", "component"]
            both = probes.select(*wanted).unionByName(bases.select(*wanted)).distinct()
            more = keyed.join(_small(materialize(both)), "id").select("cluster", "chunk", "n", "sid", "component", "text")
            roots = components(found.unionByName(materialize(_join_chunks(more, size, percent))))

    least = first.join(roots.select(F.col("node").alias("sid"), "root"), "sid")
    best = least.groupBy("root").agg(F.min("id").alias("component"))
    linked = least.join(best, "root").select("sid", "component", "root")
    known = materialize(first.where("k > 1").select("sid", F.col("id").alias("own")).join(linked, "sid", "full").select("sid", F.coalesce("component", "own").alias("component"), F.coalesce("root", "sid").alias("root")))
    own = F.when(F.col("n") > 0, F.col("component"))
    return sets.join(_small(known), "sid", "left").select("id", "sid", "n", F.coalesce(own, "id").alias("component"), F.coalesce("root", "sid").alias("root"))


def similar_components(docs: DataFrame, key: str = "doc_id", text: str = "text", size: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """A row per row of ``docs``: key, n_shingles, component_id (the smallest key that links reach)."""

    def shown(c: str):
        return F.when(F.col(c) != FIRST_ID, F.col(c)).cast(docs.schema[key].dataType)

    return _rows(docs, key, text, size, percent).select(shown("id").alias(key), F.col("n").alias("n_shingles"), shown("component").alias("component_id"))


def _set_hashes(texts: DataFrame, size: int) -> DataFrame:
    """id, h and sid of rows of id, h (hash of the text) and text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sids = np.zeros(batch.num_rows, np.int64)
            for i, x in shingle_sets(texts_of(batch.column(2)), size):
                sids[i] = set_hash(x)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(sids)], names=["id", "h", "sid"])

    return map_arrow(texts, run, "id long, h long, sid long")


def keep_first(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row of each component of near copies: of the smallest id, and of its sets there the one of the smallest hash.

    Rows are told apart by id and text: other rows of an id (null included) stay. Of rows without words, one of each id stays.
    """
    found = materialize(_rows(docs, key, text, SHINGLE, PERCENT))
    columns = docs.columns
    whole = docs.select(F.struct(*[F.col(f"`{c}`") for c in columns]).alias("whole"), F.coalesce(F.col(f"`{key}`").cast("long"), F.lit(FIRST_ID)).alias("id"), F.col(f"`{text}`").cast("string").alias("t"))
    if found.groupBy("id").count().where("count > 1").isEmpty():
        kept = whole.join(_small(found.where("id != component").select("id")), "id", "left_anti")
    else:
        best = found.where("n > 0").groupBy("root").agg(F.min(F.struct("id", "sid")).alias("f")).select("f.id", "f.sid")
        sets = best.unionByName(found.where("n = 0").select("id", "sid").distinct())
        whole = whole.withColumn("h", F.xxhash64("t"))
        chosen = _set_hashes(whole.select("id", "h", "t"), SHINGLE).join(sets, ["id", "sid"]).groupBy("id", "sid").agg(F.min("h").alias("h")).select("id", "h")
        kept = whole.join(_small(materialize(chosen)), ["id", "h"], "left_semi").dropDuplicates(["id", "h"])
    return kept.select(*[F.col(f"whole.`{c}`").alias(c) for c in columns])


def op10_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similar_components(table(spark, sf_dir, "documents"))
