"""Byte-level BPE as a bounded-lookahead streaming transducer, and its inverse.

Texts pass through in slices. Pretokens leave a slice as soon as two further characters cannot change them, and every
one is encoded by ``MergeStream``, which emits ids once they are stable; what it gave for a pretoken is remembered. A
pretoken that fills all that is held goes on, part by part, from slice to slice. Texts of a slice at most are cut in
groups of ``GROUP`` characters, and the streams of the pretokens that are new in a group end side by side, position by
position in numpy. Memory is two slices, a group, the remembered pretokens (two generations of ``YOUNG``, none longer than
``LONGEST``), the pairs of tokens looked at (``KNOWN`` at most, and a table of ``2 ** PAIR_BITS``) and a few longest
pieces, however long a text, a run of letters or one of blanks is. A Python worker goes on to the tasks of other stages
and holds all of this beside their data, so it has to stay small.

Null and empty texts have no ids. The special token's literal is its id wherever it occurs, as the tokenizers library
does by default; decoding gives the literal back.
"""

from __future__ import annotations

import codecs
import hashlib
import json
from collections.abc import Iterable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructField, StructType

from .common import text_rows

# Fixed values of the byte-level format: the pretoken pattern and the classes of its runs.
# Letters and digits come first, which no contraction begins with, as most pretokens are runs of them.
PRETOKEN = regex.compile(r" ?\p{L}+| ?\p{N}+|'s|'t|'re|'ve|'m|'ll|'d| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")
BLANKS = regex.compile(r"\s+")
# How a pretoken that may go on begins, and how it goes on.
RUNS = [(regex.compile(" ?" + x), regex.compile(x)) for x in (r"\p{L}+", r"\p{N}+", r"[^\s\p{L}\p{N}]+")] + [(BLANKS, BLANKS)]
SLICE = 1 << 16
# Pretokens that a generation of the memory holds, characters of the longest, and pairs of tokens that are remembered.
YOUNG, LONGEST, KNOWN = 160_000, 64, 100_000
# Characters of short texts that are cut together, and the table of pairs of tokens that their streams look at.
GROUP, PAIR_BITS = 1 << 17, 19
# Streams that end side by side: so many at least, of so many bytes at most; others cost less one by one.
FEW, WIDE = 128, 48
# Rows and ids that an output batch holds at most (a longer text alone makes one).
ROWS_OUT, IDS_OUT = 256, 1 << 20
# A match is stable when this many further characters are known ("'r" may become "'re").
AHEAD = 2


def vocabulary_path(path: str | None, name: str) -> str:
    """The tokenizer file on this machine: ``path``, or the public one of that name."""
    if path:
        return path
    import public_tokenizers

    return public_tokenizers.path(name)


def byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in the vocabulary: itself if printable, else the next free one from 256."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


class Merges:
    """A merge list: ids and bytes of its tokens, plain encoding of short byte strings, and which tokens may meet."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            data = json.load(file)
        letters = byte_letters()
        as_bytes = lambda token: bytes(letters[c] for c in token)
        self.ids = {as_bytes(t): i for t, i in data["model"]["vocab"].items()}
        pairs = [m if isinstance(m, list) else m.split(" ") for m in data["model"]["merges"]]
        self.ranks = {(as_bytes(a), as_bytes(b)): r for r, (a, b) in enumerate(pairs)}
        self.special = {t["content"]: t["id"] for t in data["added_tokens"]}
        size = max([*self.ids.values(), *self.special.values()]) + 1
        self.pieces = [b""] * size
        for piece, i in self.ids.items():
            self.pieces[i] = piece
        for literal, i in self.special.items():
            self.pieces[i] = literal.encode()
        self.decimal = np.array([b",%d" % i for i in range(size)])  # filled up with zero bytes
        # by pairs of ids in one number, which takes a third of the room that pairs of bytes do
        self.begin, self.known = size, dict[int, bool]()
        self.lookahead = self._sufficient_lookahead()
        # by last bytes: all tails of tokens, so that the search backwards ends early, with the id of those that are tokens
        self.tails = {piece[i:]: self.ids.get(piece[i:], -1) for piece in self.ids for i in range(len(piece))}
        # the same as a tree for many at once: a tail is a node, and one byte more to its left leads to the next
        node = {b"": 0} | {tail: n for n, tail in enumerate(self.tails, 1)}
        self.token = np.array([-1, *self.tails.values()], np.int32)
        steps = np.array([(node[tail[1:]] << 8) + tail[0] for tail in self.tails], np.int64)
        order = np.argsort(steps)
        self.steps, self.next_node = steps[order], (order + 1).astype(np.int32)
        self.sizes = np.array([len(p) for p in self.pieces], np.int32)
        self.pairs = np.full(1 << PAIR_BITS, -1, np.int64)

    def plain(self, data: bytes) -> list[bytes]:
        """Encoding by its definition: merge the pair of lowest rank, the leftmost first, until none is left."""
        parts, rank, never = [data[i : i + 1] for i in range(len(data))], self.ranks.get, 1 << 60
        ranks = [rank(pair, never) for pair in zip(parts, parts[1:], strict=False)]
        while ranks and (least := min(ranks)) < never:
            at = ranks.index(least)
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
            del ranks[at]
            if at:
                ranks[at - 1] = rank((parts[at - 1], parts[at]), never)
            if at < len(ranks):
                ranks[at] = rank((parts[at], parts[at + 1]), never)
        return parts

    def _sufficient_lookahead(self) -> int:
        """The longest token that the merges make of its own bytes; vocabulary that no merge reaches does not count.

        The encoding of any longer text steps back from prefix to prefix by one token each time. No step is longer than
        this, so none passes over that many prefixes in a row: what all of the last ones share is decided.
        """
        made = {a + b for a, b in self.ranks} | {t for t in self.ids if len(t) == 1}
        return next((len(t) for t in sorted(made, key=len, reverse=True) if self.plain(t) == [t]), 1)

    def meet(self, left: int, right: int) -> bool:
        """Whether token ``right`` can follow ``left`` (or ``begin``): their bytes together encode to just these two."""
        key = left * (self.begin + 1) + right
        follows = self.known.get(key)
        if follows is None:
            if len(self.known) >= KNOWN:
                self.known.clear()
            pair = [self.pieces[i] for i in (left, right) if i != self.begin]
            follows = self.known[key] = self.plain(b"".join(pair)) == pair
        return follows

    def longer(self, nodes: np.ndarray, left: np.ndarray) -> np.ndarray:
        """The tails that are one byte longer, 0 where no token ends so."""
        step = (nodes.astype(np.int64) << 8) + left
        at = np.minimum(np.searchsorted(self.steps, step), len(self.steps) - 1)
        return np.where(self.steps[at] == step, self.next_node[at], 0)

    def meet_each(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """``meet`` of many pairs; a place of the table holds the pair last put there and its answer in the lowest bit."""
        key = left * (self.begin + 1) + right
        slot = (key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - PAIR_BITS)).astype(np.int64)
        entry = self.pairs[slot]
        follows, new = (entry & 1).astype(bool), np.flatnonzero(entry >> 1 != key)
        if len(new):
            keys, where = np.unique(key[new], return_inverse=True)
            answers = np.array([self.meet(*divmod(k, self.begin + 1)) for k in keys.tolist()])
            follows[new] = answers[where]
            self.pairs[slot[new]] = key[new] << 1 | follows[new]
        return follows


class MergeStream:
    """Encodes the bytes of one pretoken as they come.

    The encoding of every prefix ends with exactly one token: the one that can follow the encoding of what is before
    it. These last tokens form a tree over the prefixes; the part of the tree that all prefixes within the lookahead
    share is stable and leaves as ids.
    """

    def __init__(self, merges: Merges, lookahead: int | None = None):
        self.m, self.lookahead = merges, lookahead or merges.lookahead
        self.data = bytearray()  # from the last stable position on
        self.last: list[int] = [merges.begin]  # last token of each prefix; of the stable one at 0

    def feed(self, more: bytes) -> list[int]:
        """Take in bytes; what has become stable."""
        full, out, begin = 8 * self.lookahead, [], 0
        while begin < len(more):
            taken = more[begin : begin + max(1, full - len(self.data))]
            begin += len(taken)
            self.data += taken
            if len(self.data) >= full:
                self._look()
                out += self._emit(self._shared())
        return out

    def finish(self) -> list[int]:
        self._look()
        return self._emit(len(self.data))

    def _look(self) -> None:
        """Each byte ends one more prefix, whose last token is looked for backwards."""
        m, last, data = self.m, self.last, bytes(self.data)
        id_of, known, most, radix = m.tails.get, m.known.get, m.lookahead, m.begin + 1
        for end in range(len(last), len(data) + 1):
            for at in range(end - 1, (end - most if end > most else 0) - 1, -1):
                token = id_of(data[at:end])
                if token is None:
                    break
                if token >= 0:
                    before = last[at]
                    follows = known(before * radix + token)
                    if follows or (follows is None and m.meet(before, token)):
                        last.append(token)
                        break
            if len(last) <= end:  # what was emitted cannot be gone on from: the lookahead was too short
                raise ValueError("no token can follow what was emitted")

    def _shared(self) -> int:
        """The furthest position that the encodings of all prefixes within the lookahead pass through."""
        end = len(self.data)
        live = set(range(max(0, end - self.lookahead + 1), end + 1))
        while len(live) > 1:  # the last of them steps back to where its token begins, until all have met
            top = max(live)
            live.remove(top)
            live.add(top - len(self.m.pieces[self.last[top]]))
        return live.pop()

    def _emit(self, upto: int) -> list[int]:
        found, at = [], upto
        while at > 0:
            token = self.last[at]
            found.append(token)
            at -= len(self.m.pieces[token])
        if upto:
            del self.data[:upto]
            del self.last[:upto]
        return found[::-1]


def finish_together(streams: list[MergeStream]) -> tuple[np.ndarray, np.ndarray]:
    """What ``finish`` gives of each stream that no id has left, and how many ids of each: their last tokens are looked for
    side by side."""
    m = streams[0].m
    sizes = np.array([len(s.data) for s in streams])
    order = np.argsort(-sizes, kind="stable")  # the longest first, so that those that go on are the first ones
    data = np.frombuffer(b"".join([s.data for s in streams]), np.uint8).astype(np.int64)
    first, sizes = (np.cumsum(sizes) - sizes)[order], sizes[order]
    root = first + order  # of each stream's prefixes in ``last``
    last = np.empty(len(data) + len(streams), np.int64)
    last[root] = m.begin
    for end in range(1, sizes[0] + 1):
        row = np.arange(np.searchsorted(-sizes, -end, "right"))
        node = np.zeros(len(row), np.int32)
        for at in range(end - 1, max(0, end - m.lookahead) - 1, -1):
            node = m.longer(node, data[first[row] + at])
            token = m.token[node]
            found = token >= 0
            found[found] = m.meet_each(last[root[row[found]] + at], token[found])
            last[root[row[found]] + end] = token[found]
            left = ~found & (node > 0)
            if np.count_nonzero(left) + np.count_nonzero(found) < len(row):
                raise ValueError("no token can follow what was emitted")
            row, node = row[left], node[left]
            if not len(row):
                break
        if len(row):
            raise ValueError("no token can follow what was emitted")
    at, row, back = sizes.copy(), np.arange(len(streams)), []
    while len(row):
        token = last[root[row] + at[row]]
        back.append((row, token))
        at[row] -= m.sizes[token]
        row = row[at[row] > 0]
    counts = np.empty(len(streams), np.int64)
    counts[order] = np.bincount(np.concatenate([row for row, _ in back]), minlength=len(streams))
    ends, ids = np.cumsum(counts)[order], np.empty(counts.sum(), np.int64)
    for step, (row, token) in enumerate(back, 1):
        ids[ends[row] - step] = token
    return ids, counts


class Encoder:
    """Texts to ids, slice by slice."""

    def __init__(self, path: str):
        self.merges = Merges(path)
        self.memo: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.kind = np.dtype("<u2" if len(self.merges.pieces) <= 1 << 16 else "<u4")

    def _encoded(self, pieces: list[str]) -> dict[str, bytes]:
        """Pretokens through the transducer, each by a stream of its own."""
        found, held = {}, {}
        for piece in pieces:
            stream = MergeStream(self.merges)
            ids = stream.feed(piece.encode("utf-8", "surrogatepass"))
            if ids or len(stream.data) > WIDE or len(pieces) < FEW:
                found[piece] = np.array(ids + stream.finish(), self.kind).tobytes()
            else:
                held[piece] = stream
        if held:
            ids, counts = finish_together([*held.values()])
            packed, ends = ids.astype(self.kind).tobytes(), (np.cumsum(counts) * self.kind.itemsize).tolist()
            found |= {piece: packed[a:b] for piece, a, b in zip(held, [0, *ends], ends, strict=False)}
        return found

    def _codes(self, pieces: list[str]) -> dict[str, bytes]:
        """The ids of each different pretoken, remembered or worked out now."""
        codes = dict.fromkeys(pieces)
        codes = dict(zip(codes, map(self.memo.get, codes), strict=True))
        new = [piece for piece, known in codes.items() if known is None]
        codes |= {piece: self.older[piece] for piece in new if piece in self.older}
        codes |= self._encoded([piece for piece in new if codes[piece] is None])
        for piece in new:
            if len(piece) <= LONGEST:
                if len(self.memo) >= YOUNG:  # what is not met again before the next time is forgotten then
                    self.memo, self.older = {}, self.memo
                self.memo[piece] = codes[piece]
        return codes

    def _joined(self, pieces: list[str], codes: dict[str, bytes]) -> np.ndarray:
        return np.frombuffer(b"".join(map(codes.__getitem__, pieces)), self.kind)

    def each(self, texts: Iterable[str]) -> Iterator[Iterable[np.ndarray]]:
        """The blocks of ``ids`` of each text in turn, to be read before the next; short texts are cut in groups."""
        group, size = [], 0
        for text in texts:
            if len(text) > SLICE or any(s in text for s in self.merges.special):
                yield from self._grouped(group)
                group, size = [], 0
                yield self.ids(sliced(text))
            else:
                group.append(text)
                size += len(text)
                if size >= GROUP or len(group) == ROWS_OUT:
                    yield from self._grouped(group)
                    group, size = [], 0
        yield from self._grouped(group)

    def _grouped(self, texts: list[str]) -> Iterator[Iterable[np.ndarray]]:
        cut = [PRETOKEN.findall(text) for text in texts]
        codes = self._codes(list(chain.from_iterable(cut)))
        for pieces in cut:
            yield [self._joined(pieces, codes)]

    def ids(self, slices: Iterable[str]) -> Iterator[np.ndarray]:
        """Ids of one text given in slices, in blocks as they become stable."""
        for literal, part in self._segments(slices):
            if literal is not None:
                yield np.array([self.merges.special[literal]], self.kind)
            else:
                yield from self._segment(part)

    def _segments(self, slices: Iterable[str]) -> Iterator[tuple[str | None, Iterator[str]]]:
        """Stretches between special literals as streams of their own, which have to be read in turn."""
        source, state = iter(slices), {"rest": "", "over": False, "hit": None}
        hold = max([len(s) for s in self.merges.special], default=1) - 1
        find = regex.compile("|".join(regex.escape(s) for s in self.merges.special)) if self.merges.special else None

        def stretch() -> Iterator[str]:
            while True:
                hit = find.search(state["rest"]) if find else None
                if hit:
                    before, state["hit"] = state["rest"][: hit.start()], hit.group()
                    state["rest"] = state["rest"][hit.end() :]
                    yield before
                    return
                if state["over"]:
                    last, state["rest"] = state["rest"], ""
                    yield last
                    return
                cut = max(0, len(state["rest"]) - hold)
                head, state["rest"] = state["rest"][:cut], state["rest"][cut:]
                if head:
                    yield head
                more = next(source, None)
                state["over"] = more is None
                state["rest"] += more or ""

        while True:
            state["hit"] = None
            yield None, stretch()
            if state["hit"] is None:
                return
            yield state["hit"], iter(())

    def _segment(self, slices: Iterator[str]) -> Iterator[np.ndarray]:
        rest, run, stream, over = "", None, None, False
        while not over:
            more = next(slices, None)
            over = more is None
            rest += more or ""
            if run is not None:  # a pretoken that fills all that is held goes on
                hit = run.match(rest)
                size = len(hit.group()) if hit else 0
                if run is BLANKS and not (over and size == len(rest)):
                    size = max(0, size - 1)  # the last blank goes with what follows
                yield np.fromiter(stream.feed(rest[:size].encode()), self.kind)
                ended = over or size + (run is BLANKS) < len(rest)
                rest = rest[size:]
                if not ended:
                    continue
                yield np.fromiter(stream.finish(), self.kind)
                run = stream = None
            # the pattern leaves no gap, so the pieces end where they should when their lengths are added up
            pieces, end = PRETOKEN.findall(rest), len(rest)
            if len(pieces) == 1 and not over and end > AHEAD:
                run = next((more for begin, more in RUNS if begin.fullmatch(rest)), None)
                if run is not None:
                    stream, size = MergeStream(self.merges), end - (run is BLANKS)
                    yield np.fromiter(stream.feed(rest[:size].encode()), self.kind)
                    rest = rest[size:]
                    continue
            while pieces and not over and end > len(rest) - AHEAD:
                end -= len(pieces.pop())
            rest = rest[end:]
            if pieces:
                yield self._joined(pieces, self._codes(pieces))

    def decode(self, blocks: Iterable[np.ndarray]) -> Iterator[str]:
        """Ids to text, block by block; bytes of a character cut by a block wait for the next one."""
        machine, piece = codecs.getincrementaldecoder("utf-8")(errors="replace"), self.merges.pieces.__getitem__
        for block in blocks:
            yield machine.decode(b"".join(map(piece, block.tolist())))
        yield machine.decode(b"", final=True)


_LOADED: dict[str, Encoder] = {}


def encoder(path: str | None = None, name: str = "byte_bpe_50k.json") -> Encoder:
    """The encoder of this worker process: loaded once, its memory of pretokens serves all tasks."""
    place = vocabulary_path(path, name)
    if place not in _LOADED:
        _LOADED[place] = Encoder(place)
    return _LOADED[place]


def sliced(text: str) -> Iterator[str]:
    return (text[i : i + SLICE] for i in range(0, len(text), SLICE))


def _emitted(batches: Iterator[pa.RecordBatch], path: str | None, key: str, decoded: bool) -> Iterator[pa.RecordBatch]:
    """Batches of (key, ids) or (key, ids, text) from batches of (key, _text); small ones, whatever the input's size."""
    tool = encoder(path)

    def done(rows: pa.Array, ids: list[np.ndarray], texts: list[str]) -> pa.RecordBatch:
        ends = np.cumsum([0, *map(len, ids)])
        flat = pa.array(np.concatenate([np.empty(0, tool.kind), *ids]).astype(np.int32))
        columns = [rows, pa.ListArray.from_arrays(pa.array(ends, pa.int32()), flat)]
        if decoded:
            columns.append(pa.array(texts, pa.string()))
        return pa.RecordBatch.from_arrays(columns, names=[key, "ids", "text"][: len(columns)])

    for batch in batches:
        first, ids, texts, size = 0, [], [], 0
        for i, blocks in enumerate(tool.each(text_rows(batch, "_text"))):
            own = np.concatenate([np.empty(0, tool.kind), *blocks])
            ids.append(own)
            size += len(own)
            if decoded:
                texts.append("".join(tool.decode([own])))
            if len(ids) == ROWS_OUT or size >= IDS_OUT:
                yield done(batch.column(0).slice(first, len(ids)), ids, texts)
                first, ids, texts, size = i + 1, [], [], 0
        yield done(batch.column(0).slice(first, len(ids)), ids, texts)


def encode(docs: DataFrame, path: str | None = None, text: str = "text", key: str = "doc_id") -> DataFrame:
    """``key`` and ``ids`` (array of int) of every row; other columns are left out."""
    lean = docs.select(key, F.col(text).alias("_text"))
    schema = lean.select(key).schema.add("ids", ArrayType(IntegerType()))
    return lean.mapInArrow(lambda batches: _emitted(batches, path, key, False), schema)


def encode_and_decode(docs: DataFrame, path: str | None = None, text: str = "text", key: str = "doc_id") -> DataFrame:
    """``key``, ``ids`` and ``text`` as decoded from them, in one pass; other columns are left out."""
    lean = docs.select(key, F.col(text).alias("_text"))
    schema = lean.select(key).schema.add("ids", ArrayType(IntegerType())).add("text", "string")
    return lean.mapInArrow(lambda batches: _emitted(batches, path, key, True), schema)


def decode(coded: DataFrame, path: str | None = None, ids: str = "ids", text: str = "text") -> DataFrame:
    """The rows with ``text`` from their ``ids``; null ids give an empty text. A column of that name is replaced."""
    rest = coded.drop(text)

    def run(batches):
        tool = encoder(path)
        for batch in batches:
            column = batch.column(batch.schema.get_field_index(ids))
            texts = ["".join(tool.decode([x.values.to_numpy() if x.is_valid else np.empty(0, np.int64)])) for x in column]
            yield batch.append_column(text, pa.array(texts, pa.string()))

    return rest.mapInArrow(run, StructType([*rest.schema.fields, StructField(text, StringType())]))


def round_trip(docs: DataFrame, path: str | None = None, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Per row the number of ids and digests of the ids and of the text decoded from them, in one pass without holding
    the ids of a text at once."""

    def run(batches):
        tool = encoder(path)
        decimal = tool.merges.decimal
        for batch in batches:
            counts, coded, plain = [], [], []
            for own in tool.each(text_rows(batch, "_text")):
                n, ids_digest, text_digest = 0, hashlib.sha256(), hashlib.sha256()

                def seen(blocks, ids_digest=ids_digest):
                    nonlocal n
                    for block in blocks:
                        if len(block):
                            ids_digest.update(decimal[block].tobytes().translate(None, b"\0")[n == 0 :])
                            n += len(block)
                            yield block

                for part in tool.decode(seen(own)):
                    text_digest.update(part.encode())
                counts.append(n)
                coded.append(ids_digest.hexdigest())
                plain.append(text_digest.hexdigest())
            columns = [batch.column(0), pa.array(counts, pa.int64()), pa.array(coded, pa.string()), pa.array(plain, pa.string())]
            yield pa.RecordBatch.from_arrays(columns, names=[key, "n_tokens", "ids_sha256", "decoded_sha256"])

    lean = docs.select(key, F.col(text).alias("_text"))
    schema = lean.select(key).schema.add("n_tokens", "long").add("ids_sha256", "string").add("decoded_sha256", "string")
    return lean.mapInArrow(run, schema)
