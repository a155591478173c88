"""The registered queries and the pipeline on whole small tables, against plain versions of them."""

import hashlib
import os
import zlib
from array import array

import pytest
import tiktoken

import corpus_pipeline
from pointloom.llm import bpe, common, queries, secrets, toxicity

from .test_text_operators import base_spans, brute_components, brute_hits, brute_removed

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no driver tables")


@pytest.fixture(scope="module")
def docs(spark):
    return sorted((r.doc_id, r.text) for r in common.table(spark, DATA, "documents").collect())


@pytest.fixture(scope="module")
def library():
    return tiktoken.Encoding("own", pat_str=bpe.piece_pattern(), mergeable_ranks=bpe.PrefixEncoder.from_file(bpe.tokenizer_file()).ranks, special_tokens={})


def rows(spark, name):
    return {r[0]: r for r in queries.QUERIES[name](spark, DATA).collect()}


def test_op1(spark, docs):
    got = rows(spark, "op1_toxicity")
    chain = toxicity.fit_chain(common.table(spark, DATA, "documents"), common.table(spark, DATA, "labels"))
    p = chain.predict(chain.features([t or "" for _, t in docs]))
    assert [got[i].is_toxic for i, _ in docs] == (p[:, 1] >= chain.thresholds[1]).tolist()


def test_op2(spark, docs):
    got = rows(spark, "op2_mpeg_audio")
    for i, t in docs:
        b = (t or "").encode()
        padded = b + bytes(-len(b) % 64 if b else 64)
        r = got[i]
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(b), len(padded), hashlib.sha256(padded).hexdigest(), zlib.crc32(padded[-64:]))
        assert r.bad_checksums == r.skipped_bytes == 0


def test_op3(spark, docs, library):
    got = rows(spark, "op3_token_counts")
    for i, t in docs:
        t, n = t or "", len(t or "")
        assert got[i].n_tokens == len(library.encode_ordinary(t))
        for start, end, new in ((n // 4, n // 4 + 7, ""), (n // 2, n // 2, " inserted words 2024\n\n"), (n * 3 // 4, n * 3 // 4 + 5, "é're  ")):
            start, end = min(start, len(t)), min(end, len(t))
            t = t[:start] + new + t[end:]
        assert (got[i].n_chars_after, got[i].n_tokens_after) == (len(t), len(library.encode_ordinary(t)))


def test_op5(spark, docs, library):
    got = rows(spark, "op5_byte_bpe")
    for i, t in docs:
        ids = array("I", library.encode_ordinary(t or "")).tobytes()
        assert (got[i].n_tokens, got[i].ids_sha256, got[i].decoded_sha256) == (len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest())


def test_op7(spark, docs):
    got = rows(spark, "op7_secret_scan")
    for i, t in docs:
        want = base_spans(t)
        shown = ",".join(f"{secrets.KINDS[k]}:{a}:{b}" for a, k, b in want)
        assert got[i].base_sha256 == hashlib.sha256(shown.encode()).hexdigest()
        assert (got[i].n_assign, got[i].n_access, got[i].n_hex) == tuple(sum(k == j for _, k, _ in want) for j in range(3))
        assert set(shown.split(",")) <= set(got[i].spans.split(","))


def test_op8(spark, docs):
    got = rows(spark, "op8_substring_dedup")
    assert {i: (r.n_words, r.n_removed, r.kept_sha256) for i, r in got.items()} == brute_removed(docs)


def test_op10(spark, docs):
    got = rows(spark, "op10_jaccard")
    roots, sizes = brute_components([t for _, t in docs])
    assert [(got[i].component_id, got[i].n_shingles) for i, _ in docs] == [(docs[r][0], n) for r, n in zip(roots, sizes, strict=True)]


def test_pipeline_matches_a_plain_version(spark, docs, library):
    got = {r.doc_id: r for r in corpus_pipeline.run(spark, DATA).collect()}
    table = common.table(spark, DATA, "documents")
    chain = toxicity.fit_chain(table, common.table(spark, DATA, "labels"))
    p = chain.predict(chain.features([t or "" for _, t in docs]))
    left = [d for d, toxic in zip(docs, p[:, 1] >= chain.thresholds[1], strict=True) if not toxic]
    roots, _ = brute_components([t for _, t in left])
    left = [d for i, d in enumerate(left) if roots[i] == i]
    items = [(r.item_id, r.text) for r in common.table(spark, DATA, "benchmark").collect()]
    hits = brute_hits(left, items)
    left = [d for d in left if not hits[d[0]][1]]
    kept = spark.createDataFrame(left, "doc_id long, text string")
    added = {r.doc_id: [(x.s, x.e) for x in r.added_spans] for r in secrets.find_secrets(kept, secrets.model_for(kept)).collect()}
    assert set(got) == {i for i, _ in left}
    for i, t in left:
        out, at = "", 0
        for a, b in sorted([(a, b) for a, _, b in base_spans(t)] + added[i]):
            if a >= at:
                out += t[at:a] + "[SECRET]"
            at = max(at, b)
        clean = (t or "") if not at else out + t[at:]
        ids = array("I", library.encode_ordinary(clean)).tobytes()
        assert got[i].ids_sha256 == hashlib.sha256(ids).hexdigest()


def test_stages_keep_columns(spark):
    docs = common.table(spark, DATA, "documents")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, DATA).columns == docs.columns
        assert stage(spark, docs.limit(0), DATA).count() == 0
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "near_copies", "decontamination", "secrets", "byte_bpe"]


CLASHES = ["gone", "whole", "is_toxic", "p_toxic", "base_spans", "added_spans", "id", "h", "sid", "kept", "n_hit", "items", "token", "key", "k", "spans", "clean", "n", "a", "b", "text2"]


@pytest.fixture(scope="module")
def clashing(spark, tmp_path_factory):
    """A folder of small tables: nulls, repeated ids and rows, an empty and a long text, and columns of names that operators use."""
    folder = str(tmp_path_factory.mktemp("tables"))
    long = "several words of a quite long text " * 2000
    texts = [(1, "one two three four five six seven"), (1, "another text of the same id"), (2, "one two three four five six seven"), (None, "one two three four five six seven"), (3, None), (4, ""), (5, long), (6, "alpha beta gamma"), (7, "key token=abcdef0123456789 end")]
    rows = [(i, t, "en", "web", len(t or ""), *[f"{c}{j}" for c in CLASHES]) for j, (i, t) in enumerate(texts)]
    schema = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{c} string" for c in CLASHES)
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(1, 1, 0), (6, 0, 1), (99, None, 1)], "doc_id long, quality int, toxic int").coalesce(1).write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([(None, "Alpha beta GAMMA"), (2, None)], "item_id long, text string").coalesce(1).write.parquet(f"{folder}/benchmark.parquet")
    return folder


def test_queries_take_clashing_columns(spark, clashing):
    for name, query in queries.QUERIES.items():
        if name not in ("op4_warc", "op6_chat_format"):
            got = sorted(str(r.doc_id) for r in query(spark, clashing).collect())
            assert got == sorted(["1", "1", "2", "None", "3", "4", "5", "6", "7"]), name


def test_stages_take_clashing_columns(spark, clashing):
    docs = common.table(spark, clashing, "documents")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        kept = stage(spark, docs, clashing)
        assert kept.columns == docs.columns, name
        left = {(r.doc_id, r.text) for r in kept.collect()}
        assert {(1, "another text of the same id"), (3, None), (4, "")} <= left
        assert ((6, "alpha beta gamma") in left) == (name != "decontamination")
        assert all(r[c].startswith(c) for r in kept.collect() for c in CLASHES)
    assert {r.doc_id for r in corpus_pipeline.run(spark, clashing).collect()} == {None, 1, 3, 4, 5, 7}
