import hashlib
import zlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from pointloom.llm import chat, common, mpeg_audio, warc

from .conftest import NASTY, check_rows


@settings(max_examples=150, deadline=None)
@given(st.binary(max_size=6000))
def test_payloads_come_back(data):
    s = mpeg_audio.decode(mpeg_audio.encode(data))
    assert (s.payload, s.bad_checksums, s.skipped_bytes) == (data, 0, 0)
    assert s.frames == s.table_frames and s.samples == 1152 * s.frames


def test_sync_words_in_payloads_do_not_mislead():
    data = bytes((0xFF, 0xFA, 0xE0, 0xC0)) * 2000
    assert mpeg_audio.decode(mpeg_audio.encode(data)).payload == data


def test_damage_is_found_and_skipped():
    media = bytearray(mpeg_audio.encode(bytes(range(1, 251)) * 20))
    good = mpeg_audio.decode(bytes(media))
    media[good.offsets[1] + 8] ^= 0x55  # inside the side information
    assert mpeg_audio.decode(bytes(media)).bad_checksums == 1
    media[good.offsets[1] + 8] ^= 0x55
    at = good.offsets[2]
    hurt = mpeg_audio.decode(bytes(media[:at]) + b"noise\xff\xfanoise" + bytes(media[at:]))
    assert hurt.frames == good.frames and hurt.skipped_bytes == 12
    assert mpeg_audio.decode(b"").frames == 0 and mpeg_audio.decode(None).duration_us == 0
    assert mpeg_audio.decode(b"RIFF not mpeg").frames == 0


def test_offsets_and_table():
    media = mpeg_audio.encode(b"x" * 5000)
    s = mpeg_audio.decode(media)
    assert all(media[o] == 0xFF for o in s.offsets) and list(s.toc) == sorted(s.toc)
    assert s.duration_us == s.samples * 1_000_000 // 44100


def test_audio_columns(spark, nasty):
    out = mpeg_audio.decode_column(common.store(mpeg_audio.encode_texts(nasty)), keep=("n_bytes",))
    check_rows(out, nasty)
    got = {r.doc_id: r for r in out.collect()}
    for i, t in enumerate(NASTY):
        b = (t or "").encode()
        padded = b + bytes(-len(b) % 64 if b else 64)
        assert (got[i].n_bytes, got[i].payload_bytes, got[i].payload_sha256) == (len(b), len(padded), hashlib.sha256(padded).hexdigest())
        assert got[i].tail_crc32 == zlib.crc32(padded[-64:])


def test_archives(spark, tmp_path):
    rows = [(5, "http://a/ b\n", "same"), (3, None, "same"), (9, "http://c", None), (8, "http://d", ""), (7, "http://e", "x\r\n\r\nWARC/1.1\r\n" * 5), (2, "u", "é" * 10000), (3, "again", "same"), (None, "n", "alone")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    final = warc.deduplicate_archive(spark, pages, f"file://{tmp_path}/w")
    got = [r.asDict() for r in warc.read_headers(spark, final).collect()]
    assert len(got) == len(rows)
    by = {}
    for r in got:
        by.setdefault(r["page_id"], []).append(r)
    assert sorted(x["record_type"] for x in by[3]) == ["response", "revisit"]
    assert (by[5][0]["record_type"], by[5][0]["refers_to"], by[5][0]["payload_bytes"]) == ("revisit", 3, 4)
    assert (by[9][0]["record_type"], by[9][0]["refers_to"], by[8][0]["record_type"]) == ("revisit", 8, "response")
    assert by[2][0]["payload_digest"] == warc.payload_digest(("é" * 10000).encode())
    assert by[None][0]["record_type"] == "response"
    whole = b"".join(d for f in (tmp_path / "w/deduplicated").glob("part-*") for _, _, d in warc.members(f.read_bytes()))
    assert whole.count(b"WARC-Type: response") == 5 and whole.count(warc.PROFILE.encode()) == 3


def test_small_payloads_may_stay(spark, tmp_path):
    pages = spark.createDataFrame([(1, "a", "ab"), (2, "b", "ab"), (3, "c", "long"), (4, "d", "long")], "page_id long, url string, html string")
    kinds = {r.page_id: r.record_type for r in warc.read_headers(spark, warc.deduplicate_archive(spark, pages, f"file://{tmp_path}/w", 3)).collect()}
    assert kinds == {1: "response", 2: "response", 3: "response", 4: "revisit"}


def test_archives_in_many_blocks(spark, tmp_path, monkeypatch):
    """Members that reach over what a reader takes at once, blocks and files of few records."""
    for name, value in (("BLOCK", 300), ("BLOCKS_PER_FILE", 2), ("CHUNK", 100), ("HANDED", 3)):
        monkeypatch.setattr(warc, name, value)
    text = lambda i: hashlib.sha512(b"%d" % (i % 25)).hexdigest() * (i % 25)
    pages = spark.createDataFrame([(i, f"u{i}", text(i)) for i in range(100)], "page_id long, url string, html string").coalesce(2)
    got = {r.page_id: r for r in warc.read_headers(spark, warc.deduplicate_archive(spark, pages, f"file://{tmp_path}/w")).collect()}
    assert len(list((tmp_path / "w/all").glob("part-*"))) > 4
    assert {i: (r.record_type, r.refers_to, r.payload_digest) for i, r in got.items()} == {i: ("response" if i < 25 else "revisit", None if i < 25 else i % 25, warc.payload_digest(text(i).encode())) for i in range(100)}


def test_no_pages(spark, tmp_path):
    pages = spark.createDataFrame([], "page_id long, url string, html string")
    assert warc.read_headers(spark, warc.deduplicate_archive(spark, pages, f"file://{tmp_path}/w")).count() == 0


odd = st.text(alphabet=st.sampled_from(list("<|\\im_startend>/\n ab[INST]")), max_size=40)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.tuples(odd, odd), min_size=1, max_size=5))
def test_turns_come_back(turns):
    data, spans = chat.render(turns)
    assert chat.read_turns(data.decode()) == turns
    assert all("<|" not in chat.escape(t) and chat.unescape(chat.escape(t)) == t for _, t in turns)


def _formatted(spark, rows):
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    return {r.conv_id: r for r in chat.read_formatted(chat.format_conversations(df)).collect()}


def test_loss_is_the_assistant(spark, monkeypatch):
    rows = [(1, 1, "assistant", "<|im_end|> yes\n"), (1, 0, "user", "hi"), (1, 2, "user", None), (1, 3, "assistant", "é😀"), (2, 0, None, None), (None, None, "assistant", ""), (3, 0, "assistant", " a"), (3, 0, "assistant", " a")]
    got = _formatted(spark, rows)
    said = "<|im_end|> yes\né😀"
    assert (got[1].n_turns, got[1].loss_chars, got[1].loss_sha256) == (4, len(said), hashlib.sha256(said.encode()).hexdigest())
    assert got[1].turns_sha256 == hashlib.sha256("user\nhi\nassistant\n<|im_end|> yes\n\nuser\n\nassistant\né😀\n".encode()).hexdigest()
    assert (got[2].n_turns, got[2].loss_chars) == (1, 0)
    assert got[3].loss_sha256 == hashlib.sha256(b" a a").hexdigest()
    assert got[None].loss_chars == 0


def test_parts_change_nothing(spark, monkeypatch):
    rows = [(c, t, ("user", "assistant")[t % 2], f"turn {t} says \n" * (t % 5)) for c in range(4) for t in range(40)]
    whole = _formatted(spark, rows)
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    parts = chat.format_conversations(df)
    assert parts.select("conv_id").distinct().count() == 4
    monkeypatch.setattr(chat, "PART", 50)
    stored = chat.format_conversations(df).repartition(5)
    assert stored.count() > 20
    assert {r.conv_id: r for r in chat.read_formatted(stored).collect()} == whole
    data, spans = chat.render([(r, x) for _, _, r, x in rows[:40]])
    assert whole[0].formatted_chars == len(data.decode())


def test_token_spans_cover_loss_spans(spark):
    rows = [(1, 0, "user", "question"), (1, 1, "assistant", "an answer with words")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    r = chat.format_conversations(df).first()
    s = r.loss_spans[0]
    assert r.formatted.encode()[s.start : s.end] == b"an answer with words"
    assert r.token_spans[0].first < r.token_spans[0].last <= len(r.ids) // 4


def test_no_conversations(spark):
    assert _formatted(spark, []) == {}
