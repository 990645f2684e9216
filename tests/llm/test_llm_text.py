"""Tokens, packing, chat, GIF: against the libraries, brute force and exact round trips."""

import hashlib
import re
import struct
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from marlpit.llm import arrow, byte_bpe, chat, gif, packing, queries, token_counts, tokenizer

ODD = [None, "", "  ", "\n", "a", " a  b\t\nc ", "<|endoftext|> x<|startoftext|>y", "don't WE'LL 'S 's", "É é Straße 日本語 ½ 123", "x\u00a0y \u2003z", "\x1c a\x1eb", "aaaa" * 500, "w " * 20_000, "same", "same"]
SCHEMA = "doc_id bigint, text string, n_tokens string, ids int"


def odd(spark):
    return spark.createDataFrame([(k, t, "clash", k) for k, t in enumerate(ODD)] + [(None, "no id", "clash", 0)], SCHEMA)


@pytest.fixture(scope="module")
def word_bpe():
    return Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))


@pytest.fixture(scope="module")
def byte_level():
    return Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


def test_words_are_runs_outside_ascii_space():
    texts = pa.array(["", " a  b\t\nc ", "x\u00a0y \x1cz", "\v\f"])
    found = arrow.split_words(texts)
    words = [[found.words[int(c)].as_py() for c in found.codes[a:b]] for a, b in zip(found.offsets[:-1], found.offsets[1:], strict=True)]
    assert words == [re.findall(r"[^\x20\x09-\x0D]+", t) for t in texts.to_pylist()]


def test_by_bytes_covers_all_rows_once():
    texts = pa.array(["x" * n for n in (0, 5, 100, 1, 1, 0, 7)])
    parts = [p.to_pylist() for _, p in arrow.by_bytes(pa.record_batch([texts], ["t"]), texts, 8)]
    assert sum(parts, []) == texts.to_pylist()
    assert all(len(p) == 1 or sum(map(len, p)) <= 8 for p in parts)


def test_long_words_fill_no_cache(word_bpe):
    """Texts without spaces: their ids are the library's, and nothing of them is kept."""
    draw = np.random.default_rng(5)
    words = ["".join(chr(c) for c in draw.integers(0x4E00, 0x9000, 100)) for _ in range(10_000)]
    cache = tokenizer.WordCache()
    encode = lambda new: tokenizer.by_library("word_bpe_49k.json", new)
    for at in range(0, len(words), 1000):
        ids, sizes = cache.look_up(words[at : at + 1000], encode)
        if at == 3000:
            assert ids.tolist() == sum((x.ids for x in word_bpe.encode_batch(words[3000:4000], add_special_tokens=False)), [])
    assert cache.used == 0 and not cache.slot and len(cache.ids) == 1 << 16
    # short words are kept up to the bound of ids, mixed with long ones and met again
    small = tokenizer.WordCache(most=100, longest=5, most_ids=60)
    for k in range(50):
        some = [f"w{k}", f"w{k % 7}x", "長い言葉です" * 3] if k % 7 != k else [f"w{k}"]
        ids, sizes = small.look_up(some, encode)
        assert ids.tolist() == sum((x.ids for x in word_bpe.encode_batch(some, add_special_tokens=False)), [])
        assert small.used <= 60 and sizes.sum() == len(ids)


def test_token_counts_are_the_librarys(spark, word_bpe):
    found = {r.doc_id: r for r in token_counts.count_tokens(odd(spark)).collect()}
    for k, t in enumerate(ODD):
        assert found[k].n_tokens == len(word_bpe.encode(t or "", add_special_tokens=False).ids), t
    assert found[None].ids == 0 and len(found) == len(ODD) + 1
    assert token_counts.count_tokens(odd(spark).limit(0)).count() == 0


def test_token_counts_of_documents(spark, tiny, word_bpe):
    docs = {r.doc_id: r.text for r in queries.table(spark, tiny, "documents").collect()}
    rows = queries.op10_token_counts(spark, tiny).collect()
    assert len(rows) == len(docs)
    for r in rows:
        n = len(word_bpe.encode(docs[r.doc_id], add_special_tokens=False).ids)
        assert (r.n_bytes, r.n_tokens, r.over_limit) == (len(docs[r.doc_id].encode()), n, n > 2048)


@pytest.mark.parametrize("texts", [[" hello"], [""], [None], ["\t"], [" ", "hello", "hello world"], ["", "new1 new2"], [None, " hello  other words"]])
def test_empty_words_lead_a_batch(word_bpe, texts):
    """White space first, alone in a batch or before new words, then the same words again in this process."""
    for given in (texts, [*texts, "hello"], ["hello"]):
        found = arrow.split_words(arrow.texts_of(pa.array(given, pa.string())))
        expected = [word_bpe.encode(t or "", add_special_tokens=False).ids for t in given]
        flat, sizes = tokenizer.encode_distinct("word_bpe_49k.json", found.words)
        assert arrow.ragged_sums(sizes[found.codes], found.offsets).tolist() == [len(x) for x in expected]
        ids = arrow.gather(flat, (np.cumsum(sizes) - sizes)[found.codes], sizes[found.codes])
        assert ids.tolist() == sum(expected, []) and "" not in found.words.to_pylist()


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(st.one_of(st.sampled_from("abzAZÄéÿÀ×÷ß09.,'<|>!~{}_İıſK€日½²³ªº·"), st.characters(exclude_categories=["Cs"])), min_size=1, max_size=12), min_size=1, max_size=8))
def test_words_encode_as_in_the_library(word_bpe, texts):
    found = arrow.split_words(pa.array(texts))
    flat, sizes = tokenizer.encode_distinct("word_bpe_49k.json", found.words)
    ids = np.split(arrow.gather(flat, (np.cumsum(sizes) - sizes)[found.codes], sizes[found.codes]), np.concatenate([[0], np.cumsum(sizes[found.codes])])[found.offsets[1:-1]])
    assert [x.tolist() for x in ids] == [word_bpe.encode(t, add_special_tokens=False).ids for t in texts]


def test_word_cache_forgets_and_still_answers():
    cache = tokenizer.WordCache(most=6, longest=3)
    encode = lambda ws: (np.concatenate([[len(w)] * len(w) for w in ws]).astype(np.int32), np.array([len(w) for w in ws]))
    for words in (["a", "bb"], ["bb", "ccc", "dddd"], ["dddd", "a", "e", "ff"], ["a"]):
        ids, sizes = cache.look_up(words, encode)
        assert ids.tolist() == [len(w) for w in words for _ in w] and sizes.tolist() == [len(w) for w in words]


def packed_brute(lengths, window):
    """Best fit by looking at every open window."""
    rooms, where = [], {}
    for k in sorted(range(len(lengths)), key=lambda k: -lengths[k]):
        fits = [w for w in range(len(rooms)) if rooms[w] >= lengths[k]]
        w = min(fits, key=lambda w: rooms[w]) if fits else len(rooms)
        if w == len(rooms):
            rooms.append(window)
        where[k] = window - rooms[w]
        rooms[w] -= lengths[k]
    return len(rooms), sorted(rooms)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 32), max_size=60))
def test_best_fit_decreasing(lengths):
    where, offset = packing.best_fit_decreasing(np.array(lengths, np.int64), 32)
    used = {}
    for w, o, n in sorted(zip(where, offset, lengths, strict=True)):
        assert o == used.get(w, 0) and o + n <= 32
        used[w] = o + n
    n, rooms = packed_brute(lengths, 32)
    assert len(used) == n and sorted(32 - u for u in used.values()) == rooms


def check_packing(rows, texts, word_bpe):
    docs, sequences = {}, {}
    for r in rows:
        docs.setdefault(r.doc_id, []).append(r)
        sequences.setdefault(r.sequence_id, []).append(r)
    assert set(docs) == set(texts)
    for doc_id, own in docs.items():
        ids = np.array([*word_bpe.encode(texts[doc_id] or "", add_special_tokens=False).ids, 2], "<u4")
        at = 0
        for r in sorted(own, key=lambda r: r.start):
            assert r.start == at and r.doc_tokens == len(ids) and 1 <= r.length <= 4096
            assert r.ids_crc32 == zlib.crc32(ids[at : at + r.length].tobytes())
            at += r.length
        assert at == len(ids)
    for own in sequences.values():
        at = 0
        for r in sorted(own, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 4096
    return len(sequences)


def test_packing_of_documents(spark, tiny, word_bpe):
    texts = {r.doc_id: r.text for r in queries.table(spark, tiny, "documents").collect()}
    rows = queries.op7_packing(spark, tiny).collect()
    n = check_packing(rows, texts, word_bpe)
    assert sum(r.length for r in rows) / (n * 4096) > 0.97


def test_packing_of_odd_texts(spark, word_bpe):
    rows = packing.pack_documents(odd(spark).filter("doc_id is not null"), with_ids=True).collect()
    check_packing(rows, dict(enumerate(ODD)), word_bpe)
    assert all(len(r.ids) == 4 * r.length for r in rows)
    assert packing.pack_documents(odd(spark).limit(0)).count() == 0
    assert packing.pack_documents(odd(spark).filter("doc_id is null")).count() == 1


def test_byte_bpe_is_the_librarys(spark, tiny, byte_level):
    docs = queries.table(spark, tiny, "documents").select("doc_id", "text").unionByName(odd(spark).selectExpr("doc_id - 1000 as doc_id", "text"))
    texts = {r.doc_id: r.text or "" for r in docs.collect()}
    rows = byte_bpe.decode(byte_bpe.encode(docs, lexicon_size=500)).collect()
    assert len(rows) == len(texts)
    for r in rows:
        ids = byte_level.encode(texts[r.doc_id], add_special_tokens=False).ids
        assert np.frombuffer(r.ids, "<u4").tolist() == ids
        assert r.decoded == byte_level.decode(ids, skip_special_tokens=False)


def test_byte_bpe_merges_few_new_words_at_once(byte_level, monkeypatch):
    vocab = byte_bpe.Vocabulary("byte_bpe_50k.json")
    sizes, merge = [], vocab.merges.merge
    monkeypatch.setattr(vocab.merges, "merge", lambda ids, starts: (sizes.append(len(ids)), merge(ids, starts))[1])
    text = " ".join(f"w{k * 7919}x<|endoftext|>é" for k in range(40_000))
    lexicon = byte_bpe.Lexicon.compile([b" w"], vocab)
    ids, at = byte_bpe.encode_texts(pa.array([text, ""]), vocab, lexicon)
    assert ids.tolist() == byte_level.encode(text, add_special_tokens=False).ids and at[1] == at[2] == len(ids)
    assert len(sizes) > 3 and max(sizes) <= byte_bpe.MERGED_BYTES + 64
    assert len(vocab.cache.slot) <= byte_bpe.KEPT_WORDS


def test_byte_bpe_decodes_where_it_encodes(spark):
    docs = odd(spark)
    both = byte_bpe.encode(docs, lexicon_size=500, decoded=True)
    assert both._jdf.queryExecution().executedPlan().toString().count("Python") + both._jdf.queryExecution().executedPlan().toString().count("MapInArrow") == 1
    apart = byte_bpe.decode(byte_bpe.encode(docs, lexicon_size=500))
    assert both.columns == apart.columns and both.count() == apart.count()
    assert both.exceptAll(apart).isEmpty() and both.filter("decoded is null").isEmpty()
    assert byte_bpe.encode(docs.limit(0), decoded=True).count() == 0


def test_byte_bpe_of_no_rows(spark):
    assert byte_bpe.encode(odd(spark).limit(0)).count() == 0


@settings(max_examples=150, deadline=None)
@given(st.text(st.characters(codec="utf-8"), max_size=40))
def test_merges_of_any_text(byte_level, text):
    vocab = byte_bpe.vocabulary("byte_bpe_50k.json")
    lexicon = byte_bpe.Lexicon.compile([b" the", b"the", b" of", b""[:0] or b"x"], vocab)
    ids, at = byte_bpe.encode_texts(pa.array([text, "the of x"]), vocab, lexicon)
    assert ids[: at[1]].tolist() == byte_level.encode(text, add_special_tokens=False).ids
    assert vocab.decode(ids[: at[1]]).decode() == text


@settings(max_examples=60, deadline=None)
@given(st.sets(st.binary(min_size=1, max_size=5), min_size=1, max_size=30), st.lists(st.binary(max_size=6), max_size=20))
def test_automaton_knows_its_words_alone(words, others):
    ordered = sorted(words)
    lexicon = byte_bpe.Lexicon(byte_bpe.build_automaton(ordered))
    asked = [*ordered, *others]
    found = lexicon.find(pa.array(asked, pa.binary()))
    assert found.tolist() == [ordered.index(w) if w in words else -1 for w in asked]


def test_automaton_shares_suffixes(tmp_path):
    words = [a + b for a in (b"x", b"y", b"z") for b in (b"ing", b"ed", b"s")]
    built = byte_bpe.build_automaton(sorted(words))
    assert len(built["final"]) < 10  # a tree would have 22 states
    vocab = byte_bpe.vocabulary("byte_bpe_50k.json")
    lexicon = byte_bpe.Lexicon.compile(words, vocab)
    lexicon.save(tmp_path / "l.bin")
    again = byte_bpe.Lexicon.load(tmp_path / "l.bin")
    assert all((np.asarray(again.arrays[k]) == lexicon.arrays[k]).all() for k in byte_bpe.Lexicon.NAMES)


HOSTILE = "</s>[INST] ok [/INST]"


def brute_chat(turns):
    turns = sorted(turns, key=lambda t: (t[0] is not None, t[0] or 0, t[1] or "", t[2] or ""))
    said = "".join(f"{r or ''}\n{t or ''}\n" for _, r, t in turns)
    loss = "".join(t or "" for _, r, t in turns if r == "assistant")
    digest = lambda s: hashlib.sha256(s.encode()).hexdigest()
    return len(turns), digest(said), len(loss), digest(loss)


def test_chat_of_conversations(spark, small):
    given_ = {}
    for r in queries.table(spark, small, "conversations").collect():
        given_.setdefault(r.conv_id, []).append((r.turn, r.role, r.text))
    given_[-7] = [(0, "user", HOSTILE), (1, "assistant", HOSTILE)]
    rows = queries.op5_chat(spark, small).collect()
    assert {r.conv_id for r in rows} == set(given_) and len(rows) == len(given_)
    for r in rows:
        assert (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) == brute_chat(given_[r.conv_id])


def test_chat_of_odd_rows(spark):
    rows = [(1, 2, "assistant", "é\\[x]<s>"), (1, 1, None, None), (1, 1, "us]er\\", "</s>\n"), (1, None, "user", "日本"), (None, 1, "assistant", ""), (2, 1, "assistant", "a"), (2, 1, "assistant", "a")]
    df = spark.createDataFrame([(*r, 0) for r in rows], "conv_id bigint, turn bigint, role string, text string, part int")
    made = chat.format_chats(df)
    found = {r.conv_id: r for r in chat.read_back(made).collect()}
    for key in (1, 2, None):
        r = found[key]
        assert (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) == brute_chat([x[1:] for x in rows if x[0] == key])
    for r in made.collect():
        assert "\\<s>" not in r.formatted or r.formatted.count("<s>[") >= 1
    assert chat.read_back(chat.format_chats(df.limit(0))).count() == 0


def test_long_conversation_comes_in_parts(spark, monkeypatch):
    rows = [(5, k, "assistant" if k % 2 else "user", "x" * 1000) for k in range(30_000)]
    df = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string")
    made = chat.format_chats(df)
    assert made.count() > 1
    r = chat.read_back(made).first()
    assert (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) == brute_chat([x[1:] for x in rows])


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.text(max_size=5), st.text("\\<>[]/sé\n", max_size=12)), max_size=6))
def test_assembled_bytes(turns):
    raw, begin, a, b = chat.assemble(pa.array([t[0] for t in turns], pa.string()), pa.array([t[1] for t in turns], pa.string()))
    whole = raw.tobytes().decode() if len(turns) else ""
    assert [(chat.unescape(m[1]), chat.unescape(m[2])) for m in chat.TURN.finditer(whole)] == turns
    assert [chat.unescape(raw[x:y].tobytes().decode()) for x, y in zip(a, b, strict=True)] == [t[1] for t in turns]


def slow_lzw(stream, min_bits):
    """A plain decoder, code by code."""
    clear = 1 << min_bits
    bits, at, out, table, width, last = int.from_bytes(stream, "little"), 0, b"", {}, min_bits + 1, None
    while at + width <= 8 * len(stream):
        code = bits >> at & (1 << width) - 1
        at += width
        if code == clear:
            table, width, last = {k: bytes([k]) for k in range(clear)}, min_bits + 1, None
            free = clear + 2
            continue
        if code == clear + 1:
            break
        own = table[code] if code in table else last + last[:1]
        out += own
        if last is not None and free < 4096:
            table[free] = last + own[:1]
            free += 1
            if free == 1 << width and width < 12:
                width += 1
        last = own
    return out


@settings(max_examples=40, deadline=None)
@given(st.one_of(st.binary(min_size=1, max_size=3000), st.text("ab", min_size=1, max_size=3000).map(str.encode)))
def test_lzw(samples):
    stream = gif.lzw_encode(samples)
    assert slow_lzw(stream, 8) == samples
    assert gif.lzw_decode(stream, 8, len(samples)).tobytes() == samples


def test_lzw_with_full_tables():
    samples = np.random.default_rng(1).integers(0, 256, 40_000, np.uint8).tobytes() + b"a" * 30_000
    stream = gif.lzw_encode(samples)
    assert slow_lzw(stream, 8) == samples and gif.lzw_decode(stream, 8, len(samples)).tobytes() == samples


def blocks(codes, min_bits=2):
    """A stream of codes, packed as an encoder does that never clears after the first code."""
    width, free, value, at, first = min_bits + 1, (1 << min_bits) + 2, 0, 0, True
    for c in codes:
        value |= c << at
        at += width
        if c == 1 << min_bits:
            width, free, first = min_bits + 1, (1 << min_bits) + 2, True
            continue
        if not first and free < 4096:
            free += 1
            if free == 1 << width and width < 12:
                width += 1
        first = False
    raw = value.to_bytes(-(-at // 8), "little")
    return bytes([min_bits]) + b"".join(bytes([len(raw[i : i + 255])]) + raw[i : i + 255] for i in range(0, len(raw), 255)) + b"\0"


def test_late_clears():
    codes = [4, *([0, 1, 2, 3] * 3000), 5]
    stream = blocks(codes)[1:]
    joined, _ = gif._sub_blocks(stream, 0)
    assert gif.lzw_decode(joined, 2, 12_000).tobytes() == bytes([0, 1, 2, 3] * 3000)


def test_frames_with_disposal_transparency_and_interlace():
    head = b"GIF89a" + (4).to_bytes(2, "little") * 2 + bytes([0x81, 0, 0]) + bytes([0, 0, 0, 255, 0, 0, 0, 255, 0, 0, 0, 255])
    control = lambda disposal, delay, clear: b"\x21\xf9\x04" + bytes([disposal << 2 | (clear is not None)]) + delay.to_bytes(2, "little") + bytes([clear or 0, 0])
    image = lambda x, y, w, h, codes, flags=0: b"\x2c" + b"".join(v.to_bytes(2, "little") for v in (x, y, w, h)) + bytes([flags]) + blocks([4, *codes, 5])
    raw = head + b"\x21\xfe\x02hi\0" + control(1, 7, None) + image(0, 0, 4, 4, [1] * 16)
    raw += control(2, 3, 0) + image(1, 1, 2, 2, [2, 0, 0, 2])
    raw += control(3, 1, None) + image(0, 0, 1, 4, [0, 1, 2, 3], 0x40)
    raw += image(3, 3, 1, 1, [3]) + b"\x3b"
    found = list(gif.read(raw))
    assert [f.delay_ms for f in found] == [70, 30, 10, 0]
    one, two, three, four = (f.rgba for f in found)
    assert (one == [255, 0, 0, 255]).all()
    assert two[1, 1].tolist() == two[2, 2].tolist() == [0, 255, 0, 255] and two[1, 2].tolist() == [255, 0, 0, 255]
    assert three[1, 1].tolist() == [0, 0, 0, 0]  # the second frame's place was cleared
    assert [three[r, 0].tolist()[:3] for r in range(4)] == [[0, 0, 0], [0, 255, 0], [255, 0, 0], [0, 0, 255]]
    assert four[0, 0].tolist() == [255, 0, 0, 255] and four[3, 3].tolist() == [0, 0, 255, 255]
    assert gif.colour_histogram(one)[3 * 16] == 16


def test_frames_of_a_column(spark):
    good = gif.write(b"\0\xff" * 32)
    df = spark.createDataFrame([(1, good, 5), (2, None, 5), (3, b"", 5), (4, b"not one", 5), (5, good[:60], 5), (1, good, 5)], "doc_id bigint, media binary, frame int")
    rows = gif.frames(df).collect()
    by = lambda k: [r for r in rows if r.id == k]
    assert len(by(1)) == 2 and by(1)[0].width == 64 and by(1)[0].colours[0] == 32 and by(1)[0].colours[63] == 32
    assert not by(2) and not by(3) and by(4)[0].error and by(5)[0].error
    assert gif.frames(df.limit(0)).count() == 0


def test_frames_of_many_large_screens_come_in_small_batches(spark, monkeypatch):
    """A screen of 2048 x 2048 with frames of one pixel: a few hundred bytes that say 16 MB of pixels each."""
    monkeypatch.setattr(gif, "VALUE_PIXELS", 5 << 22)
    one = gif.write(bytes(64), 64)
    body = one[13 + 768 : -1]
    screen = b"GIF89a" + struct.pack("<HHBBB", 2048, 2048, 0xF7, 0, 0) + one[13 : 13 + 768]
    df = spark.createDataFrame([(1, screen + body * 3 + b"\x3b"), (2, screen + body * 9 + b"\x3b"), (3, one)], "doc_id bigint, media binary")
    rows = gif.frames(df.coalesce(1)).drop("rgba").collect()
    by = {k: [r for r in rows if r.id == k] for k in (1, 2, 3)}
    assert [len(by[k]) for k in (1, 2, 3)] == [3, 6, 1]
    assert "pixels" in by[2][-1].error and by[2][-1].frame is None and all(r.error is None for r in by[1] + by[3] + by[2][:-1])


def test_frames_of_hostile_headers(spark):
    """A few bytes that claim a huge screen or frame give an error row; no task runs out of memory."""
    screen = b"GIF89a" + struct.pack("<HHBBB", 65535, 65535, 0, 0, 0) + b"\x3b"
    frame = b"GIF89a" + struct.pack("<HHBBB", 4, 4, 0, 0, 0) + b"\x2c" + struct.pack("<HHHHB", 0, 0, 65535, 65535, 0) + b"\x08\x00\x3b"
    df = spark.createDataFrame([(1, screen), (2, frame), (3, gif.write(b"\0" * 64))], "doc_id bigint, media binary")
    rows = {r.id: r for r in gif.frames(df).collect()}
    assert "too large" in rows[1].error and "too large" in rows[2].error and rows[3].frame == 0


def test_long_segments_are_copied_whole():
    texts = pa.array(["x" * (chat.LONG + 5), "", "[INST] é", "y" * 3])
    raw, begin, start, end = chat.assemble(pa.array(["user", "assistant", "user", "a"]), texts)
    assert [chat.unescape(raw[a:b].tobytes().decode()) for a, b in zip(start, end, strict=True)] == texts.to_pylist() and begin[-1] == len(raw)


def test_stored_texts_come_back(spark, tiny):
    docs = queries.table(spark, tiny, "documents").select("doc_id", "text").unionByName(odd(spark).selectExpr("doc_id - 1000 as doc_id", "text"))
    docs.write.mode("overwrite").parquet(f"{(folder := __import__('tempfile').mkdtemp())}/documents.parquet")
    texts = {r.doc_id: (r.text or "").encode() for r in docs.collect()}
    for r in queries.op9_gif(spark, folder).collect():
        raw = texts[r.doc_id]
        payload = raw.ljust(max(64, -(-len(raw) // 64) * 64), b"\0")
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]))
        media = gif.write(payload)
        assert (r.media_bytes, r.media_sha256) == (len(media), hashlib.sha256(media).hexdigest())
        grey = np.bincount(np.frombuffer(payload, np.uint8) >> 6, minlength=4)  # one frame of equal reds, greens and blues
        assert r.feature == "1;100;" + ",".join(str(grey[k // 21] if k % 21 == 0 else 0) for k in range(64))
