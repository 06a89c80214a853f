"""Streaming BPE and token files, held against the tokenizers library."""

import hashlib
import json
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from tipwatch.llm import bpe, tokenfiles
from tipwatch.llm.common import shared_path

PARTS = ["a", "b", " ", "  ", "\n", "'", "re", "'re", "'ll", "'s", "é", "ü", "<|endoftext|>", "<|endo", "1", "23", "!!"]
PARTS += ["日本", "😀", "é", "\x1c", " ", " ", "lower", "tion", "İ", "Σ", "Word.", "ab" * 700, "=" * 2500, " " * 1500]


def mixed(n, seed=1):
    draw = random.Random(seed)
    return ["".join(draw.choice(PARTS) for _ in range(draw.randrange(30))) for _ in range(n)]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


@pytest.mark.parametrize("size", [1 << 16, 37, 3, 1])
def test_slices_do_not_change_ids(library, size):
    tool = bpe.encoder()
    tool.memo.clear()
    odd = ["'really 'll'r'", "we're''re 'nd", " 'd  'dd", "a \n\n  b", "  \t x", " " * 70 + "\n" * 70, "x" + " " * 80, "..." * 60 + "'s", "12 345" * 40]
    for text in [*mixed(60), *odd, "", "a" * 3000, "the" * 2000, " " * 1200 + "a", "日本語" * 900]:
        blocks = list(tool.ids(text[i : i + size] for i in range(0, len(text), size)))
        ids = np.concatenate([np.empty(0, np.int64), *blocks]).tolist()
        assert ids == library.encode(text, add_special_tokens=False).ids
        assert "".join(tool.decode(blocks)) == library.decode(ids, skip_special_tokens=False) == text


def test_merge_stream_keeps_little(library):
    tool, draw = bpe.encoder(), random.Random(3)
    stream, most, ids = bpe.MergeStream(tool.merges), 0, []
    data = "".join(draw.choice("etaoinshrd") for _ in range(20000)).encode()
    for i in range(0, len(data), 50):
        ids += stream.feed(data[i : i + 50])
        most = max(most, len(stream.data))
    ids += stream.finish()
    assert most <= 10 * tool.merges.lookahead
    assert ids == library.encode(data.decode(), add_special_tokens=False).ids


def test_every_pretoken_goes_through_the_stream(monkeypatch, library):
    """Nothing but the transducer gives ids: without it there are none."""
    tool = bpe.Encoder(bpe.vocabulary_path(None, "byte_bpe_50k.json"))
    seen = []
    real = bpe.MergeStream.feed
    monkeypatch.setattr(bpe.MergeStream, "feed", lambda self, more: seen.append(bytes(more)) or real(self, more))
    text = "some words, some more; and 'some' of 3 kinds\n\nthe end of it"
    ids = np.concatenate(list(tool.ids(bpe.sliced(text)))).tolist()
    assert ids == library.encode(text, add_special_tokens=False).ids
    assert set(seen) - {b""} == {p.encode() for p in bpe.PRETOKEN.findall(text)} and not hasattr(tool, "library")


def test_what_a_worker_remembers_stays_small(monkeypatch, library):
    """A worker serves the tasks of all stages, so that what it remembers is bounded, and forgetting changes no id."""
    monkeypatch.setattr(bpe, "YOUNG", 50)
    monkeypatch.setattr(bpe, "KNOWN", 80)
    tool, draw, most, pairs = bpe.Encoder(bpe.vocabulary_path(None, "byte_bpe_50k.json")), random.Random(5), 0, 0
    for _ in range(60):
        words = ["".join(draw.choices("etaoinshrd", k=draw.randrange(1, 9))) for _ in range(40)]
        text = " ".join([*words, "the same few words", "=" * draw.randrange(100, 3000)])
        assert np.concatenate(list(tool.ids(bpe.sliced(text)))).tolist() == library.encode(text, add_special_tokens=False).ids
        most, pairs = max(most, len(tool.memo) + len(tool.older)), max(pairs, len(tool.merges.known))
    assert 50 < most <= 100 and 0 < pairs <= 80
    assert max(map(len, [*tool.memo, *tool.older])) <= bpe.LONGEST


def test_streams_end_side_by_side(monkeypatch, library):
    """The short pretokens that are new in a group of texts are worked out together, not byte by byte each."""
    tool = bpe.Encoder(bpe.vocabulary_path(None, "byte_bpe_50k.json"))
    alone, fed, draw = [], [], random.Random(6)
    look, feed = bpe.MergeStream._look, bpe.MergeStream.feed
    monkeypatch.setattr(bpe.MergeStream, "_look", lambda self: alone.append(bytes(self.data)) or look(self))
    monkeypatch.setattr(bpe.MergeStream, "feed", lambda self, more: fed.append(bytes(more)) or feed(self, more))
    words = ["".join(draw.choices("etaoinshrdéß日", k=draw.randrange(1, 12))) for _ in range(4000)]
    texts = [" ".join([*words[i : i + 40], "=" * (i % 90)]) for i in range(0, 4000, 40)]
    got = [np.concatenate([np.empty(0, np.int64), *blocks]).tolist() for blocks in tool.each(texts)]
    assert got == [library.encode(t, add_special_tokens=False).ids for t in texts]
    assert set(fed) == {p.encode() for t in texts for p in bpe.PRETOKEN.findall(t)}
    assert all(len(data) > bpe.WIDE for data in alone) and len(alone) < 60


@pytest.mark.parametrize("few", [1, 128])
def test_groups_of_texts_do_not_change_ids(monkeypatch, library, few):
    monkeypatch.setattr(bpe, "FEW", few)
    monkeypatch.setattr(bpe, "YOUNG", 100)
    tool = bpe.Encoder(bpe.vocabulary_path(None, "byte_bpe_50k.json"))
    texts = [*mixed(150, 7), "", "", "word " * 30000, "the end<|endoftext|>", *mixed(300, 8), "\0 \0", "x" * 70000, "last"]
    got = [np.concatenate([np.empty(0, np.int64), *blocks]).tolist() for blocks in tool.each(iter(texts))]
    assert got == [library.encode(t, add_special_tokens=False).ids for t in texts]
    assert list(tool.each([])) == []


def test_streams_end_together_as_one_by_one(library):
    """With bytes of every kind, and a table of pairs that forgets."""
    merges, draw = bpe.encoder().merges, random.Random(9)
    datas = ["".join(draw.choices("etaoinshrd=é", k=draw.randrange(1, 400))).encode() for _ in range(40)] + [bytes([b]) * 3 for b in range(256)]
    streams = [bpe.MergeStream(merges) for _ in datas]
    assert not any([stream.feed(data) for stream, data in zip(streams, datas, strict=True)])
    merges.pairs[::2] = -1
    ids, counts = bpe.finish_together(streams)
    parts = np.split(ids, np.cumsum(counts)[:-1])
    assert [p.tolist() for p in parts] == [[merges.ids[t] for t in merges.plain(d)] for d in datas]
    assert [p.tolist() for p in parts] == [stream.finish() for stream in streams]


def streamed(merges, data, step=7, lookahead=None):
    stream, out = bpe.MergeStream(merges, lookahead), []
    for i in range(0, len(data), step):
        out += stream.feed(data[i : i + step])
    return [*out, *stream.finish()]


def test_the_lookahead_follows_from_the_merges(tmp_path):
    """It is the longest token that the merges make of its own bytes, and nothing shorter will do."""
    letters = {b: c for c, b in bpe.byte_letters().items()}
    made = ["ab", "cd", "abcd", "ef", "gh", "efgh", "abcdefgh", "bc", "hab", "zz"]
    pairs = [("a", "b"), ("c", "d"), ("ab", "cd"), ("e", "f"), ("g", "h"), ("ef", "gh"), ("abcd", "efgh"), ("h", "a"), ("ha", "b")]
    vocab = [letters[b] for b in range(256)] + [*made, "ha", "unreachablelongtoken"]
    place = tmp_path / "small.json"
    place.write_text(json.dumps({"model": {"vocab": {t: i for i, t in enumerate(vocab)}, "merges": [list(p) for p in pairs]}, "added_tokens": []}))
    merges = bpe.Merges(str(place))
    assert merges.lookahead == 8
    draw = random.Random(2)
    texts = ["".join(draw.choices(["abcdefgh", "abcd", "efgh", "h", "a", "cd", "z"], k=60)).encode() for _ in range(60)]
    want = [[merges.ids[t] for t in merges.plain(t)] for t in texts]
    assert [streamed(merges, t) for t in texts] == want

    def fails(lookahead):
        for text, ids in zip(texts, want, strict=True):
            try:
                if streamed(merges, text, lookahead=lookahead) != ids:
                    return True
            except ValueError:
                return True
        return False

    assert not fails(8) and all(fails(shorter) for shorter in (1, 2, 4))


def test_the_lookahead_of_the_public_vocabulary(library):
    tool = bpe.encoder()
    assert 1 < tool.merges.lookahead <= max(map(len, tool.merges.ids))
    assert tool.merges.plain(max((t for t in tool.merges.ids if len(t) == tool.merges.lookahead), key=lambda t: tool.merges.plain(t) == [t])) != []
    draw = random.Random(4)
    for _ in range(40):
        text = "".join(draw.choices(["=", "-", "a", "th", "ing", " "], k=draw.randrange(200, 900)))
        assert streamed(tool.merges, text.replace(" ", "").encode()) == [tool.merges.ids[t] for t in tool.merges.plain(text.replace(" ", "").encode())]


def test_decoder_waits_for_cut_characters(library):
    tool = bpe.encoder()
    ids = library.encode("日本語😀é", add_special_tokens=False).ids
    assert "".join(tool.decode(np.array([i]) for i in ids)) == "日本語😀é"
    assert "".join(tool.decode([np.array(ids[:1])])) == library.decode(ids[:1])


def test_round_trip_and_tables(spark, make, library):
    texts = [*mixed(40, 5), None, "", "same", "same"]
    docs = make(texts).withColumnRenamed("lang", "ids")  # a clashing name
    rows = {r.doc_id: r for r in bpe.round_trip(docs).collect()}
    back = {r.doc_id: r.text for r in bpe.decode(bpe.encode(docs)).collect()}
    for i, text in enumerate(texts, 1):
        ids = library.encode(text or "", add_special_tokens=False).ids
        assert rows[i].n_tokens == len(ids)
        assert rows[i].ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert rows[i].decoded_sha256 == hashlib.sha256((text or "").encode()).hexdigest()
        assert back[i] == (text or "")
    assert bpe.round_trip(docs.limit(0)).count() == 0


def test_perfect_hash():
    keys = np.unique(np.random.default_rng(1).integers(-(1 << 62), 1 << 62, 50000))
    index = tokenfiles.perfect_hash(keys)
    assert sorted(tokenfiles.slots(index, keys)) == list(range(len(keys)))
    assert int(index["sizes"].sum()) < 6 * len(keys)  # bits
    assert len(tokenfiles.slots(tokenfiles.perfect_hash(keys[:0]), keys[:3])) == 3


def test_files_hold_what_the_library_gives(spark, make, library):
    words = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    texts = [*mixed(80, 9), None, "", "same", "same", "It's 12 o'clock... (really)."]
    docs = make(texts).unionByName(make(["again", "null key"]).selectExpr("case when doc_id = 1 then 1 end doc_id", "text", "lang", "source", "n_chars"))
    folder = shared_path(spark, "test")
    tokenfiles.write(docs.repartition(5), folder)
    want = sorted([(i, t or "") for i, t in enumerate(texts, 1)] + [(1, "again"), (-1, "null key")])
    rows = sorted(tokenfiles.read(spark, folder).collect(), key=lambda r: r.start)
    start = 0
    assert [-1 if r.doc_id is None else r.doc_id for r in rows] == [k for k, _ in want]
    for row, (_, text) in zip(rows, want, strict=True):
        ids = [*words.encode(text, add_special_tokens=False).ids, 1]
        assert (row.start, row.n_tokens, row.ids) == (start, len(ids), ids)
        assert row.ids_crc32 == zlib.crc32(np.array(ids, "<u4").tobytes())
        start += len(ids)
    asked = spark.createDataFrame([(3,), (83,), (999,), (-5,), (None,)], "doc_id long")
    got = {r.doc_id: r.ids for r in tokenfiles.lookup(spark, folder, asked).collect()}
    assert got == {r.doc_id: r.ids for r in rows if r.doc_id in (3, 83)}


def test_no_documents_no_files(spark, make):
    folder = shared_path(spark, "test")
    assert tokenfiles.write(make(["x"]).limit(0), folder).count() == 0
    assert tokenfiles.read(spark, folder).count() == 0
