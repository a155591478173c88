import hashlib
import random
from array import array

import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from pointloom.llm import bpe, token_counts

from .conftest import NASTY, check_rows


@pytest.fixture(scope="module")
def tools():
    encoder, pieces = bpe.worker_encoder(bpe.tokenizer_file())
    pattern = bpe.compiled(bpe.piece_pattern())
    other = tiktoken.Encoding("own", pat_str=bpe.piece_pattern(), mergeable_ranks=encoder.ranks, special_tokens={})
    return encoder, pieces, pattern, other


texts = st.text(alphabet=st.sampled_from(list("aeéthinERs 0\n\t'世界ß😀.,!-_re")), max_size=60)


@settings(max_examples=400, deadline=None)
@given(texts)
def test_same_ids_as_the_library(tools, text):
    encoder, pieces, pattern, other = tools
    ids = bpe.encode_text(text, pieces, pattern)
    assert array("I", ids).tolist() == other.encode_ordinary(text)
    assert bpe.decode_ids(ids, encoder) == text.encode()


@settings(max_examples=200, deadline=None)
@given(st.binary(max_size=30), st.binary(max_size=8), st.integers(0, 30), st.integers(0, 30))
def test_appends_and_edits_are_exact(tools, data, more, a, b):
    encoder = tools[0]
    start, end = sorted((min(a, len(data)), min(b, len(data))))
    p = bpe.Prefixes(encoder, data)
    p.append(more)
    assert p.ids() == encoder.encode(data + more)
    p.edit(start, end, more)
    whole = data + more
    assert p.ids() == encoder.encode(whole[:start] + more + whole[end:])


def test_edits_of_long_pieces_stop_where_they_agree(tools):
    encoder = tools[0]
    r = random.Random(5)
    p = bpe.Prefixes(encoder, bytes(r.choice(b"etaoinshr") for _ in range(20_000)))
    whole, before = p.data, p.worked
    for at in (10, 7000, 19_990):
        p.edit(at, at + 3, b"xyz q")
        whole = whole[:at] + b"xyz q" + whole[at + 3 :]
    assert p.data == whole and p.unrolled() == encoder.unroll(encoder.extend(whole, []))
    assert p.worked - before < 20 * encoder.longest


@settings(max_examples=300, deadline=None)
@given(texts, st.lists(st.tuples(st.integers(-2, 70), st.integers(-2, 70), texts), max_size=4))
def test_whole_texts_are_appended_to_and_edited(tools, text, edits):
    encoder, _, pattern, other = tools
    held = bpe.TextPrefixes(encoder, pattern, text)
    for start, end, new in edits:
        held.edit(start, end, new)
        n = len(text)
        start = min(max(start, 0), n)
        end = min(max(end, start), n)
        text = text[:start] + new + text[end:]
        assert (held.pieces, held.ids()) == (pattern.findall(text), other.encode_ordinary(text))
        held.append(new)
        text += new
        assert held.ids() == other.encode_ordinary(text)


def test_documents(spark, nasty, tools):
    out = bpe.encode_documents(nasty)
    check_rows(out, nasty)
    got = {r.doc_id: r for r in out.collect()}
    for i, t in enumerate(NASTY):
        want = array("I", tools[3].encode_ordinary(t or "")).tobytes()
        assert (got[i].n_tokens, got[i].ids_sha256, bytes(got[i].ids)) == (len(want) // 4, hashlib.sha256(want).hexdigest(), want)
        assert got[i].decoded_sha256 == hashlib.sha256((t or "").encode()).hexdigest()
    assert bpe.encode_documents(nasty.limit(0)).count() == 0


@settings(max_examples=300, deadline=None)
@given(texts, st.lists(st.tuples(st.integers(-2, 70), st.integers(-2, 70), texts), max_size=4))
def test_edited_counts_are_full_counts(tools, text, edits):
    encoder, _, pattern, other = tools
    tree = token_counts.EditedCount.plant(text, token_counts.PieceCounts(encoder), pattern)
    for start, end, new in edits:
        tree.edit(start, end, new)
        n = len(text)
        start = min(max(start, 0), n)
        end = min(max(end, start), n)
        text = text[:start] + new + text[end:]
        assert (tree.text, tree.total) == (text, len(other.encode_ordinary(text)))
        assert tree.sums[1, 0] == len(text)
        tree = token_counts.EditedCount.read(tree.text, tree.leaves(), tree.counts, pattern)


def test_long_edits_stay_local(tools):
    encoder, _, pattern, other = tools
    text = "some words here, " * 5000
    tree = token_counts.EditedCount.plant(text, token_counts.PieceCounts(encoder), pattern)
    for at in range(100, 80000, 7919):
        tree.edit(at, at + 5, "new text\n\n" * (at % 3))
    assert tree.total == len(other.encode_ordinary(tree.text))
    assert tree.rescanned < 12 * 1000
    before, tree.rescanned = len(tree.texts), 0
    tree.edit(50_000, 50_010, "many more words " * 3000)  # more leaves, nothing else counted anew
    assert tree.total == len(other.encode_ordinary(tree.text)) and len(tree.texts) > before and tree.rescanned < 50_000


def test_counted_documents(spark, nasty):
    edits = "if(key = 3, null, array(struct(0 as start, 1 as end, 'zz' as text), struct(null as start, null as end, null as text)))"
    trees = token_counts.plant_trees(nasty)
    out = token_counts.edit_trees(trees, F.expr(edits), keep_trees=True)
    check_rows(out.withColumnRenamed("key", "doc_id"), nasty)
    r = {x.key: x for x in out.collect()}
    assert (r[0].n_tokens, r[0].n_chars_after, r[3].n_edits, r[0].n_edits) == (0, 2, 0, 2)
    again = {x.key: x for x in token_counts.edit_trees(out, F.expr("array(struct(0 as start, 2 as end, '' as text))")).collect()}
    assert all(again[i].n_tokens == r[i].n_tokens_after for i in r) and again[4].n_chars_after == 0
    assert token_counts.plant_trees(nasty.limit(0)).count() == 0
