"""Byte-level BPE: encoding and decoding of whole texts, without a regular expression.

A chunk of texts becomes an array of one symbol a byte: the class of the
character that starts there (letter, number, other, white space with what
follows it, apostrophe of a contraction) or "inside a character".  A symbol is
a transition function over eight scanner states; function composition is
associative, so blocks of bytes are composed side by side, the blocks' functions
are scanned in a logarithmic number of steps, and a last pass marks where
pieces begin.  Distinct pieces of a chunk are merged once, through a cache that
lives as long as the Python worker, and their ids are gathered for every
occurrence.  Pieces of up to SHORTEST_LONG - 1 bytes are told apart by two
numbers that hold all their bytes and their length, longer ones by their bytes.

Defined cases: null text is empty; an empty text has no ids and the SHA-256 of
no bytes; no length is special; repeated rows are encoded alike; the functions
name the columns that they read and ignore others.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import sys
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from quarry.llm._cluster import small_batches
from quarry.llm._text import CHUNK_BYTES, MASKS, U64, chunks, lean, mix, ragged, windows

# Scanner symbols.
LETTER, NUMBER, OTHER, LAST_BLANK, LAST_WHITE, WHITE, SHORT, LONG, INSIDE, RESET = range(10)
# Scanner states: nothing open; within letters, numbers, others, white space; after a blank that joins what follows; one or two letters of a contraction to come.
OPEN, IN_LETTERS, IN_NUMBERS, IN_OTHERS, IN_WHITE, JOINS, ONE_MORE, TWO_MORE = range(8)
BLOCK = 128
CHUNK = 1 << 20
SHORTEST_LONG = 16


def _scanner() -> tuple[np.ndarray, np.ndarray]:
    """next[state * 16 + symbol] and begins[state * 16 + symbol]."""
    nxt, begins = np.zeros(128, np.uint8), np.zeros(128, np.uint8)
    for state in range(8):
        for symbol in range(10):
            to, new = state, 0
            if symbol == RESET:
                to = OPEN
            elif symbol == INSIDE:
                pass
            elif state in (ONE_MORE, TWO_MORE):
                to = OPEN if state == ONE_MORE else ONE_MORE
            elif symbol in (LETTER, NUMBER, OTHER):
                to = (IN_LETTERS, IN_NUMBERS, IN_OTHERS)[symbol]
                new = int(state not in (to, JOINS))
            elif symbol in (SHORT, LONG):
                joins = state in (IN_OTHERS, JOINS)
                to, new = (IN_OTHERS, 0) if joins else (ONE_MORE if symbol == SHORT else TWO_MORE, 1)
            elif symbol == WHITE:
                to, new = IN_WHITE, int(state != IN_WHITE)
            else:
                to, new = (JOINS if symbol == LAST_BLANK else OPEN), 1
            nxt[state * 16 + symbol], begins[state * 16 + symbol] = to, new
    return nxt, begins


NEXT, BEGINS = _scanner()
_classes: np.ndarray | None = None


def codepoint_classes() -> np.ndarray:
    """LETTER, NUMBER, OTHER or WHITE of every code point, by the Unicode version that tiktoken was built with."""
    global _classes
    if _classes is None:
        import tiktoken

        every = "".join(map(chr, (*range(0xD800), *range(0xE000, sys.maxunicode + 1))))
        found = np.full(sys.maxunicode + 1, OTHER, np.uint8)
        for kind, pattern in ((LETTER, r"\p{L}"), (NUMBER, r"\p{N}"), (WHITE, r"\s")):
            kept = tiktoken.Encoding("class", pat_str=pattern, mergeable_ranks={bytes([i]): i for i in range(256)}, special_tokens={})
            found[np.frombuffer(bytes(kept.encode_ordinary(every)).decode().encode("utf-32-le"), "<u4")] = kind
        _classes = found
    return _classes


def symbols(data: np.ndarray, resets: np.ndarray) -> np.ndarray:
    """One scanner symbol a byte of UTF-8; ``resets``: where a text has ended."""
    classes = codepoint_classes()
    kind = classes[:128].copy()
    kind.resize(256)
    kind[0x80:0xC0] = INSIDE
    out = kind[data]
    size = np.ones(len(data), np.int8) if (data >= 0xC0).any() else None
    if size is not None:
        lead = np.flatnonzero(data >= 0xC0)
        b = [data[np.minimum(lead + i, len(data) - 1)].astype(np.int32) & 0x3F for i in range(4)]
        first = data[lead].astype(np.int32)
        two, three = first < 0xE0, first < 0xF0
        code = np.where(two, (first & 0x1F) << 6 | b[1], np.where(three, (first & 0x0F) << 12 | b[1] << 6 | b[2], (first & 0x07) << 18 | b[1] << 12 | b[2] << 6 | b[3]))
        out[lead] = classes[np.minimum(code, sys.maxunicode)]
        size[lead] = np.where(two, 2, np.where(three, 3, 4))
    white = out == WHITE
    white[resets] = True
    at = np.flatnonzero(white)
    at = at[at + 1 < len(data)]
    following = at + (1 if size is None else size[at])
    last = at[~white[np.minimum(following, len(data) - 1)]]
    out[last] = np.where(data[last] == 0x20, LAST_BLANK, LAST_WHITE)
    quote = np.flatnonzero(data == 0x27)
    if len(quote):
        one, two = data[np.minimum(quote + 1, len(data) - 1)], data[np.minimum(quote + 2, len(data) - 1)]
        short = np.isin(one, np.frombuffer(b"stmd", np.uint8))
        long = (one == 0x72) & (two == 0x65) | (one == 0x76) & (two == 0x65) | (one == 0x6C) & (two == 0x6C)
        out[quote[short]], out[quote[long]] = SHORT, LONG
    out[resets] = RESET
    return out


def piece_starts(sym: np.ndarray) -> np.ndarray:
    """Where pieces begin: a blocked associative scan of transition functions."""
    n = len(sym)
    rows = -(-n // BLOCK)
    cols = np.full(rows * BLOCK, INSIDE, np.uint8)
    cols[:n] = sym
    cols = np.ascontiguousarray(cols.reshape(rows, BLOCK).T)
    f = np.repeat(np.arange(8, dtype=np.uint8)[:, None], rows, 1)  # the identity
    done = 0
    for c in cols:
        f = NEXT[(f << 4) + c]
        done += 1
        if done % 8 == 0 and (f == f[0]).all():  # white space has made all functions constant: one value each is enough
            one = f[0]
            for c in cols[done:]:
                one = NEXT[(one << 4) + c]
            f = np.repeat(one[None, :], 8, 0)
            break
    step = 1
    while step < rows:  # f[:, i] comes to hold the blocks 0..i composed
        f[:, step:] = np.take_along_axis(f[:, step:], f[:, :-step], 0)
        step *= 2
    state = np.zeros(rows, np.uint8)
    state[1:] = f[OPEN, :-1]
    new = np.empty((BLOCK, rows), np.uint8)
    for i, c in enumerate(cols):
        at = (state << 4) + c
        new[i], state = BEGINS[at], NEXT[at]
    return np.flatnonzero(new.T.reshape(-1)[:n])


class Pairs:
    """Rank of the token that two ids make together, by a bucketed hash of the pair."""

    NONE = np.int32(1 << 30)

    def __init__(self, ranks: dict[bytes, int]):
        found = [
            (ranks[t[:i]] << 32 | ranks[t[i:]], r)
            for t, r in ranks.items()
            for i in range(1, len(t))
            if t[:i] in ranks and t[i:] in ranks
        ]
        keys = np.array([k for k, _ in found], np.uint64)
        self.bits = max(10, len(found).bit_length() + 2)
        slot = self._slot(keys)
        order = np.argsort(slot, kind="stable")
        self.first = np.searchsorted(slot[order], np.arange((1 << self.bits) + 1))
        self.most = int(np.diff(self.first).max(initial=0))
        self.keys = np.concatenate([keys[order], np.full(self.most + 1, (1 << 64) - 1, np.uint64)])
        self.ranks = np.array([r for _, r in found] + [0], np.int32)[np.concatenate([order, [-1] * (self.most + 1)])]

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return (keys * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - self.bits)).astype(np.int64)

    def of(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """NONE where the two make no token; ids below 0 stand for nothing."""
        keys = left.astype(np.uint64) << np.uint64(32) | right.astype(np.uint64)
        at = self.first[self._slot(keys)]
        out = np.full(keys.shape, self.NONE, np.int32)
        for i in range(self.most):
            same = self.keys[at + i] == keys
            out[same] = self.ranks[(at + i)[same]]
        out[(left < 0) | (right < 0)] = self.NONE
        return out


def _numbers(data: np.ndarray, starts: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of short pieces and their lengths, in two numbers each."""
    one, two, i = np.empty(len(starts), U64), np.empty(len(starts), U64), 0
    while i < len(starts):  # a block of bytes at a time
        j = max(i + 1, int(np.searchsorted(starts, starts[i] + CHUNK_BYTES)))
        a = starts[i]
        eight, at, n = windows(data[a : int(starts[j - 1]) + SHORTEST_LONG]), starts[i:j] - a, size[i:j]
        one[i:j] = eight[at] & MASKS[np.minimum(n, 8)]
        two[i:j] = eight[at + 8] & MASKS[np.maximum(n - 8, 0)] | n.astype(U64) << U64(56)
        i = j
    return one, two


class Merger:
    """Ranks of a rank file, merged piece by piece, with a bounded cache of pieces."""

    CACHE, RECENT, WIDEST, LONG_BYTES = 600_000, 50_000, 64, 4 << 20

    def __init__(self, path: str):
        with open(path, "rb") as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
        by_id = {v: k for k, v in self.ranks.items()}
        entries = [by_id.get(i, b"") for i in range(max(by_id) + 1)]
        self.bytes = np.frombuffer(b"".join(entries), np.uint8)
        self.size = np.array([len(x) for x in entries], np.int64)
        self.start = np.concatenate([[0], np.cumsum(self.size)])[:-1]
        self.single = np.array([self.ranks[bytes([i])] for i in range(256)], np.int32)
        self.pairs = Pairs(self.ranks)
        self._empty()

    def _empty(self) -> None:
        """Known short pieces in two levels, each sorted by a hash: the hash, the piece's two numbers, place of the ids in ``flat``, number of ids, whether it was met again."""
        none = [np.zeros(0, t) for t in (U64, U64, U64, np.int64, np.int32, bool)]
        self.levels = [none, none]
        self.long: dict[bytes, list[int]] = {}
        self.long_bytes = 0
        self.flat, self.used = np.zeros(1 << 16, np.uint32), 0

    @staticmethod
    def _merged(a: list[np.ndarray], b: list[np.ndarray]) -> list[np.ndarray]:
        at = np.searchsorted(a[0], b[0])
        return [np.insert(x, at, y) for x, y in zip(a, b, strict=True)]

    def _known(self, key: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Places, lengths, and which are unknown."""
        place, length, open_ = np.zeros(len(key[0]), np.int64), np.zeros(len(key[0]), np.int64), np.arange(len(key[0]))
        for known, one, two, places, lengths, again in self.levels:
            if len(known) and len(open_):
                at = np.minimum(np.searchsorted(known, key[0][open_]), len(known) - 1)
                hit = (one[at] == key[1][open_]) & (two[at] == key[2][open_])
                place[open_[hit]], length[open_[hit]] = places[at[hit]], lengths[at[hit]]
                again[at[hit]] = True
                open_ = open_[~hit]
        return place, length, open_

    def _keep(self, found: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
        """Appends ids to ``flat``; returns their places and numbers."""
        length = np.fromiter(map(len, found), np.int32, len(found))
        total = int(length.sum())
        if self.used + total > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros(max(total, len(self.flat)), np.uint32)])
        self.flat[self.used : self.used + total] = np.fromiter(chain.from_iterable(found), np.uint32, total)
        place = self.used + np.cumsum(length, dtype=np.int64) - length
        self.used += total
        return place, length

    def _learn(self, key: list[np.ndarray], found: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
        """Keeps the ids of new short pieces, whose hashes are sorted; returns their places and lengths."""
        place, length = self._keep(found)
        self.levels[1] = self._merged(self.levels[1], [*key, place, length, np.zeros(len(length), bool)])
        if len(self.levels[1][0]) > self.RECENT:
            self.levels = [self._merged(*self.levels), [x[:0] for x in self.levels[1]]]
        return place, length

    def _forget(self) -> None:
        """Keeps what was met again since the last time; called between chunks."""
        main = self._merged(*self.levels)
        kept = [x[main[5]] for x in main]
        at, offs = ragged(kept[3], kept[4])
        flat = self.flat[at]
        self._empty()
        if len(kept[0]) <= self.CACHE // 2:
            self.flat, self.used = flat if len(flat) else self.flat, len(flat)
            kept[3], kept[5] = offs[:-1], np.zeros(len(kept[0]), bool)
            self.levels[0] = kept

    def _long(self, raw: bytes, starts: np.ndarray, stops: np.ndarray) -> list[list[int]]:
        """Ids of long pieces, which are known by their bytes."""
        every = [raw[a:b] for a, b in zip(starts.tolist(), stops.tolist(), strict=True)]
        if self.long_bytes > self.LONG_BYTES:
            self.long, self.long_bytes = {}, 0
        new = list({p for p in every if p not in self.long})
        self.long.update(zip(new, self.pieces(new), strict=True))
        self.long_bytes += sum(map(len, new))
        return [self.long[p] for p in every]

    def pieces(self, pieces: list[bytes]) -> list[list[int]]:
        """Ids of each piece; pieces of like width are merged side by side."""
        found: list[list[int] | None] = [None] * len(pieces)
        by_width: dict[int, list[int]] = {}
        for i, p in enumerate(pieces):
            if (whole := self.ranks.get(p)) is not None:
                found[i] = [whole]
            elif len(p) <= self.WIDEST:
                by_width.setdefault(-(-len(p) // 4) * 4, []).append(i)
            else:
                found[i] = self._merge(p)
        for width, which in by_width.items():
            for lo in range(0, len(which), 8192):
                part = which[lo : lo + 8192]
                for i, ids in zip(part, self._side_by_side([pieces[i] for i in part], width), strict=True):
                    found[i] = ids
        return found

    def _side_by_side(self, pieces: list[bytes], width: int) -> list[list[int]]:
        raw = np.frombuffer(b"".join(p.ljust(width, b"\0") for p in pieces), np.uint8).reshape(-1, width)
        size = np.fromiter(map(len, pieces), np.int64, len(pieces))
        parts = np.full((len(pieces), width + 1), -1, np.int32)
        parts[:, :width] = self.single[raw]
        parts[:, :width][np.arange(width) >= size[:, None]] = -1
        ranks = self.pairs.of(parts[:, :-1], parts[:, 1:])
        rows, col = np.arange(len(pieces)), np.arange(width)
        while len(rows):
            r = ranks[rows]
            j = r.argmin(1)
            low = r[np.arange(len(rows)), j]
            going = low < Pairs.NONE
            rows, j, low, r = rows[going], j[going], low[going], r[going]
            if not len(rows):
                break
            p, i = parts[rows], np.arange(len(rows))
            shift = (col[None, :] > j[:, None]).astype(np.int64)
            p[:, :width] = np.take_along_axis(p, col + shift, 1)
            p[:, width] = -1
            p[i, j] = low
            r = np.take_along_axis(r, np.minimum(col + shift, width - 1), 1)
            r[:, width - 1] = Pairs.NONE
            r[i, j] = self.pairs.of(low, p[i, j + 1])
            k = np.flatnonzero(j > 0)
            r[k, j[k] - 1] = self.pairs.of(p[k, j[k] - 1], low[k])
            parts[rows], ranks[rows] = p, r
        left = (parts >= 0).sum(1).tolist()
        return [row[:n] for row, n in zip(parts.tolist(), left, strict=True)]

    def _merge(self, p: bytes) -> list[int]:
        """The lowest-ranked adjacent pair merges first, the leftmost on ties; a heap and links keep long pieces cheap."""
        ranks, n = self.ranks, len(p)
        end, before = list(range(1, n + 1)), list(range(-1, n - 1))  # of the part that starts at i
        heap = []

        def offer(i: int) -> None:
            if i >= 0 and end[i] < n and (r := ranks.get(p[i : end[end[i]]])) is not None:
                heap.append((r, i, end[end[i]])) if not ready else heapq.heappush(heap, (r, i, end[end[i]]))

        ready = False
        for i in range(n):
            offer(i)
        heapq.heapify(heap)
        ready, gone = True, bytearray(n)
        while heap:
            _, i, stop = heapq.heappop(heap)
            if gone[i] or end[i] >= n or end[end[i]] != stop:
                continue
            j = end[i]
            gone[j], end[i] = 1, end[j]
            if end[i] < n:
                before[end[i]] = i
            offer(i)
            offer(before[i])
        out, i = [], 0
        while i < n:
            out.append(ranks[p[i : end[i]]])
            i = end[i]
        return out

    def encode(self, data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids (uint32) of a chunk's texts and the offsets of the rows in them."""
        resets = offs[1:] - 1
        starts = piece_starts(symbols(data, resets))
        row = np.searchsorted(starts, offs)
        stops = np.empty_like(starts)
        stops[:-1] = starts[1:]
        last = row[1:][row[1:] > row[:-1]] - 1
        stops[last] = resets[row[1:] > row[:-1]]
        if not len(starts):
            return np.zeros(0, np.uint32), np.zeros(len(offs), np.int64)
        raw = data.tobytes()
        if sum(len(x[0]) for x in self.levels) > self.CACHE or self.used > 8 * self.CACHE:
            self._forget()
        place, length = np.zeros(len(starts), np.int64), np.zeros(len(starts), np.int64)
        size = stops - starts
        few = size < SHORTEST_LONG
        own = np.flatnonzero(few)
        key = [None, *_numbers(data, starts[own], size[own])]
        key[0] = mix(key[1] ^ mix(key[2]))
        order = np.argsort(key[0])
        key = [x[order] for x in key]
        new = np.ones(len(own), bool)
        new[1:] = (key[1][1:] != key[1][:-1]) | (key[2][1:] != key[2][:-1])
        index, group = own[order[new]], np.empty(len(own), np.int64)
        group[order] = np.cumsum(new) - 1
        key = [x[new] for x in key]
        at, n, unknown = self._known(key)
        if len(unknown):
            found = self.pieces([raw[a:b] for a, b in zip(starts[index[unknown]].tolist(), stops[index[unknown]].tolist(), strict=True)])
            at[unknown], n[unknown] = self._learn([x[unknown] for x in key], found)
        place[own], length[own] = at[group], n[group]
        if len(own) < len(starts):
            place[~few], length[~few] = self._keep(self._long(raw, starts[~few], stops[~few]))
        at, total = ragged(place, length)
        return self.flat[at], total[row]

    def decode(self, ids: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bytes of ids and the offsets of the rows in them."""
        at, total = ragged(self.start[ids], self.size[ids])
        return self.bytes[at] if len(at) else np.zeros(0, np.uint8), total[offs]


_mergers: dict[str, Merger] = {}


def merger(path: str) -> Merger:
    """One per worker and rank file."""
    if path not in _mergers:
        _mergers[path] = Merger(path)
    return _mergers[path]


def encode(docs: DataFrame, ranks: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, ids binary): each text's ids as little-endian unsigned 32-bit integers."""
    small_batches(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = merger(ranks)
        for b in batches:
            for lo, hi, data, offs in chunks(b.column(1), CHUNK):
                ids, at = m.encode(data, offs)
                raw = ids.astype("<u4").tobytes()
                rows = [raw[4 * x : 4 * y] for x, y in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([b.column(0).slice(lo, hi - lo), pa.array(rows, pa.binary())], ["id", "ids"])

    return docs.select(id_col, text_col).mapInArrow(lean(run), f"id {kind}, ids binary").withColumnRenamed("id", id_col)


def decode(encoded: DataFrame, ranks: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """(id, text): the inverse of ``encode``; bytes that are no UTF-8 become U+FFFD."""
    kind = encoded.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = merger(ranks)
        for b in batches:
            texts = []
            for raw in b.column(1):
                ids = np.frombuffer(raw.as_py() or b"", "<u4")
                texts.append(m.decode(ids, np.array([0, len(ids)]))[0].tobytes().decode("utf-8", "replace"))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(texts, pa.string())], ["id", "text"])

    return encoded.select(id_col, ids_col).mapInArrow(lean(run), f"id {kind}, text string").withColumnRenamed("id", id_col)


def round_trip(docs: DataFrame, ranks: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, n_tokens, ids_sha256 and decoded_sha256 of the text encoded and its ids decoded again."""
    small_batches(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = merger(ranks)
        for b in batches:
            for lo, hi, data, offs in chunks(b.column(1), CHUNK):
                ids, at = m.encode(data, offs)
                back, ends = m.decode(ids, at)
                raw, text = memoryview(ids.astype("<u4").tobytes()), memoryview(back)
                sha = lambda view, cuts: [hashlib.sha256(view[x:y]).hexdigest() for x, y in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).slice(lo, hi - lo), pa.array(np.diff(at)), pa.array(sha(raw, 4 * at)), pa.array(sha(text, ends))],
                    ["id", "n_tokens", "ids_sha256", "decoded_sha256"],
                )

    out = docs.select(id_col, text_col).mapInArrow(lean(run), f"id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")
    return out.withColumnRenamed("id", id_col)
