"""Secret scans with DataFrame functions alone: fixed patterns and character Markov models.

Patterns give base spans (kinds assign, access, hex). Beside them, long runs of
key-like characters are compared by log-likelihood ratio under two character
Markov models, of random strings and of ordinary identifiers, trained from
labelled samples; runs that are far likelier under the first are spans of kind
markov. Spans are in code points, end exclusive. The labelled samples of ordinary
identifiers are words of documents; those of random strings are generated.

Offsets come from the texts between matches: splitting by a pattern gives the
gaps to the matches, and running sums of both lengths give where each begins.

Edges: a null text is empty and has no spans; no training rows leave an even
model, under which nothing is found; repeated rows give repeated rows; other columns are
kept and unused.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

# The patterns of the base kinds in their order, the group whose length counts, and the least length.
KINDS = ("assign", "access", "hex", "markov")
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]+"
BASE = ((ASSIGN, 2, 12), (ACCESS, 0, 18), (HEX, 0, 16))
#: What a text must contain for a kind to be worth splitting it.
HINTS = (r"(?i)(?:passw|secret|token|api_?key)", r"AKIA[A-Z0-9]{14}", r"[0-9a-f]{16}")
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"

#: Runs shorter than this are not compared; the least ratio of a find, in nats (a million to one); pseudo-counts of a pair.
MIN_RUN = 20
MIN_RATIO = math.log(1e6)
PSEUDO = 0.5
#: Documents whose words train the ordinary model, and generated random strings of each form.
SAMPLE_DOCS = 2000
SAMPLE_RANDOM = 2000


def _q(text: str) -> str:
    """A SQL string literal."""
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


#: Matches that are walked at once: building a list by appending costs the square of its length, so long lists are built in blocks.
WALKED = 256
SPAN_LIST = "array<struct<s:int,k:int,e:int>>"


def walked(text: str, pattern: str, kind: int, wanted: str) -> str:
    """SQL for the spans of the matches ``m`` of ``pattern`` in the column ``text`` that are ``wanted`` (a condition on m), in order.

    Each match is met with the gap before it. Blocks of matches give spans from their own
    beginning; the blocks' lengths, summed up, move them to their place.
    """
    none = f"cast(array() as {SPAN_LIST})"
    pairs = f"arrays_zip(transform(slice(split({text}, {_q(pattern)}, -1), 1, size(f)), x -> char_length(x)), f)"
    block = f"""aggregate(slice(z, b * {WALKED} + 1, {WALKED}), named_struct('at', 0, 'out', {none}),
      (a, x) -> named_struct('at', a.at + x.`0` + char_length(x.f),
        'out', if(element_at(transform(array(x.f), m -> {wanted}), 1), concat(a.out, array(named_struct('s', a.at + x.`0`, 'k', {kind}, 'e', a.at + x.`0` + char_length(x.f)))), a.out)))"""
    blocks = f"transform(sequence(0, (size(z) - 1) div {WALKED}), b -> {block})"
    starts = "aggregate(w, array(0), (a, x) -> concat(a, array(element_at(a, -1) + x.at)))"
    moved = "flatten(transform(arrays_zip(w, slice(o, 1, size(w))), x -> transform(x.w.out, y -> named_struct('s', y.s + x.`1`, 'k', y.k, 'e', y.e + x.`1`))))"
    let = lambda value, name, body: f"element_at(transform(array({value}), {name} -> {body}), 1)"
    inner = let(pairs, "z", let(blocks, "w", let(starts, "o", moved)))
    return let(f"regexp_extract_all({text}, {_q(pattern)}, 0)", "f", f"CASE WHEN size(f) = 0 THEN {none} ELSE {inner} END")


def spans_of(text: str, pattern: str, group: int, least: int, kind: int, hint: str | None = None) -> str:
    """SQL for the spans (array of struct s, k, e) of ``pattern`` whose group is long enough, in order."""
    sized = f"char_length(regexp_extract(m, {_q(pattern)}, {group}))" if group else "char_length(m)"
    walk = walked(text, pattern, kind, f"{sized} >= {least}")
    return f"CASE WHEN {text} RLIKE {_q(hint)} THEN {walk} ELSE cast(array() as {SPAN_LIST}) END" if hint else walk


def labelled_samples(docs: DataFrame, key: str = "doc_id", text: str = "text", sample: int = SAMPLE_DOCS, random: int = SAMPLE_RANDOM) -> DataFrame:
    """value and is_secret: words of at most ``sample`` documents (as they are, lower, upper and title case) that no base
    pattern touches, and generated random strings in hexadecimal, base 64 and upper case with digits."""
    spark = docs.sparkSession
    chosen = docs.select(F.col(f"`{key}`").alias("k")).distinct().orderBy(F.xxhash64("k"), "k").limit(sample)
    said = docs.select(F.col(f"`{key}`").alias("k"), F.col(f"`{text}`").alias("t")).join(F.broadcast(chosen), "k")
    for pattern, _, _ in BASE[:2]:
        said = said.withColumn("t", F.regexp_replace("t", pattern, " "))
    words = said.select(F.explode(F.regexp_extract_all("t", F.lit(r"[A-Za-z][A-Za-z0-9_-]{3,}"), F.lit(0))).alias("w")).where(~F.col("w").rlike("[0-9a-f]{16}"))
    words = words.select(F.explode(F.array("w", F.lower("w"), F.upper("w"), F.initcap("w"))).alias("value"), F.lit(0).alias("is_secret"))
    seed = spark.range(random).select(F.sha2(F.col("id").cast("string"), 512).alias("h"), F.sha2(F.concat(F.lit("x"), F.col("id").cast("string")), 256).alias("g"))
    b64 = F.base64(F.unhex("h"))
    forms = F.array(F.col("g"), b64, F.regexp_replace(F.upper(b64), "[^A-Z0-9]", ""), F.translate(b64, "+/", "-_"))
    return words.unionByName(seed.select(F.explode(forms).alias("value"), F.lit(1).alias("is_secret")))


def train(samples: DataFrame, value: str = "value", label: str = "is_secret") -> list[float]:
    """The log-likelihood ratio of every pair of alphabet characters, the first character's row first.

    Pair counts are summed before they come to the driver: two of each pair at most.
    """
    size = len(ALPHABET)
    known = samples.select((F.col(label) > 0).alias("y"), F.split(F.col(value), "").alias("c")).where("c is not null and y is not null")
    pairs = known.select("y", F.explode(F.expr(f"transform(sequence(1, greatest(1, size(c) - 1)), i -> struct(instr('{ALPHABET}', c[i - 1]) as a, instr('{ALPHABET}', coalesce(c[i], '')) as b))")).alias("p"))
    counts = {0: {}, 1: {}}
    for r in pairs.where("p.a > 0 and p.b > 0").groupBy("y", "p.a", "p.b").count().collect():
        counts[int(r["y"])][r["a"] - 1, r["b"] - 1] = r["count"]
    if not counts[0] or not counts[1]:
        return [0.0] * (size * size)
    from_ = {y: [sum(counts[y].get((a, b), 0) for b in range(size)) for a in range(size)] for y in (0, 1)}

    def log_p(y: int, a: int, b: int) -> float:
        return math.log((counts[y].get((a, b), 0) + PSEUDO) / (from_[y][a] + PSEUDO * size))

    return [log_p(1, a, b) - log_p(0, a, b) for a in range(size) for b in range(size)]


def _markov(text: str, ratios: list[float]) -> str:
    """SQL for the spans of runs that are likelier random."""
    size = len(ALPHABET)
    run = r"[A-Za-z0-9+/_=-]{%d,}" % MIN_RUN
    weights = f"cast(split('{' '.join(f'{x:.4f}' for x in ratios)}', ' ') as array<double>)"
    codes = f"transform(split(x, ''), c -> instr('{ALPHABET}', c))"
    pair = f"{weights}[(p[i - 1] - 1) * {size} + p[i] - 1]"
    ratio = f"aggregate(array({codes}), 0D, (z, p) -> aggregate(sequence(1, size(p) - 1), 0D, (a, i) -> a + if(p[i - 1] > 0 and p[i] > 0, {pair}, 0D)))"
    far = f"aggregate(array(m), 0D, (y, x) -> {ratio}) >= {MIN_RATIO!r}D"
    return f"CASE WHEN {text} RLIKE {_q(run)} THEN {walked(text, run, 3, far)} ELSE cast(array() as {SPAN_LIST}) END"


def find_secrets(docs: DataFrame, ratios: list[float], text: str = "text", base: str = "base_spans", added: str = "added_spans") -> DataFrame:
    """``docs`` with its base spans, and the added ones that lie inside none of them (arrays of struct s, k, e in order), in the place of columns of their names."""
    columns = docs.columns
    t = docs.select(F.struct(*[F.col(f"`{c}`") for c in columns]).alias("whole"), F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")).alias("t"))
    t = t.withColumns({f"b{k}": F.expr(spans_of("t", *rule, k, hint)) for k, (rule, hint) in enumerate(zip(BASE, HINTS, strict=True))} | {"m": F.expr(_markov("t", ratios))})
    t = t.withColumn("b", F.expr("array_sort(concat(b0, b1, b2))"))
    t = t.withColumn("a", F.expr("filter(m, x -> not exists(b, y -> y.s <= x.s and x.e <= y.e))"))
    return t.select(*[F.col(f"whole.`{c}`").alias(c) for c in columns if c not in (base, added)], F.col("b").alias(base), F.col("a").alias(added))


def joined(spans: Column) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.element_at(names, x["k"] + 1), x["s"].cast("string"), x["e"].cast("string"))), ",")


def model_for(docs: DataFrame) -> list[float]:
    return train(labelled_samples(docs))


def redact(docs: DataFrame, ratios: list[float], text: str = "text", mark: str = "[SECRET]") -> DataFrame:
    """``docs`` with every span of its texts replaced by ``mark`` (overlapping spans by one), and n_chars, where there is one, made to fit."""
    columns = docs.columns
    whole = docs.select(F.struct(*[F.col(f"`{c}`") for c in columns]).alias("whole"), F.col(f"`{text}`").cast("string").alias("t"))
    found = find_secrets(whole, ratios, "t", "b", "a").select("whole", "t", F.array_sort(F.concat("b", "a")).alias("spans"))
    clean = f"""CASE WHEN size(spans) = 0 THEN t ELSE aggregate(spans, named_struct('at', 0, 'out', ''),
      (a, x) -> if(x.e <= a.at, a, if(x.s < a.at, named_struct('at', x.e, 'out', a.out),
        named_struct('at', x.e, 'out', concat(a.out, substring(t, a.at + 1, x.s - a.at), {_q(mark)})))),
      a -> concat(a.out, substring(t, a.at + 1))) END"""
    found = found.select("whole", F.size("spans").alias("n"), F.expr(clean).alias("clean"))
    kept = {c: F.col(f"whole.`{c}`") for c in columns}
    kept[text] = F.col("clean")
    if "n_chars" in kept:
        kept["n_chars"] = F.when(F.col("n") > 0, F.char_length("clean").cast(docs.schema["n_chars"].dataType)).otherwise(kept["n_chars"])
    return found.select(*[v.alias(c) for c, v in kept.items()])


def op7_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = find_secrets(docs, model_for(docs))
    counts = [F.expr(f"cast(size(filter(base_spans, x -> x.k = {k})) as long)").alias(f"n_{KINDS[k]}") for k in range(3)]
    return found.select(
        "doc_id", *counts, F.sha2(joined(F.col("base_spans")), 256).alias("base_sha256"),
        joined(F.array_sort(F.concat("base_spans", "added_spans"))).alias("spans"), F.size("added_spans").cast("long").alias("n_markov"),
    )
