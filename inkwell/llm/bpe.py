"""Byte-level BPE encoding and decoding with vectorised pre-tokenisation.

Pre-tokenisation uses no regex. Every code point gets a class from an array, classes and one character of lookahead
give an input symbol, and each symbol is a transition function of an eight-state automaton. Functions compose
associatively, so the state before every character comes from a blocked scan: functions of blocks of characters are
composed column by column, block functions are scanned, and states are filled in. The functions that can arise are
few, so each is a number and a composition is a table lookup. A match of the pattern starts where the automaton says
so. The slices go to cached pair merging; byte offsets of the pieces are kept.
"""

from __future__ import annotations

import base64
import hashlib
import unicodedata
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkwell.session import load

# Code-point classes.
C_LETTER, C_NUMBER, C_OTHER, C_SPACE, C_BLANK, C_APOSTROPHE, C_SEAM = range(7)
# Input symbols: the class and what follows. W_MORE: white space before white space or the end; B_LAST: a blank before
# something else; W_LAST: other white space before something else; A2, A3: an apostrophe with one or two letters that
# may form a contraction with it.
S_L, S_N, S_O, S_WMORE, S_BLAST, S_WLAST, S_A2, S_A3, S_SEAM = range(9)
# States: what is open before a character. PREFIX: a blank that the next run takes along; ONE, TWO: letters of a
# contraction still to come.
FRESH, IN_L, IN_N, IN_O, IN_W, PREFIX, ONE, TWO = range(8)

#: Contractions of the pattern, after the apostrophe. Fixed values.
CONTRACTIONS = ("s", "t", "re", "ve", "m", "ll", "d")
BLOCK = 32


@lru_cache(1)
def class_table() -> np.ndarray:
    """Class of every code point, as the \\p{L}, \\p{N} and \\s of the pattern have it."""
    table = np.full(0x110001, C_OTHER, np.uint8)
    for cp in range(0x110000):
        major = unicodedata.category(chr(cp))[0]
        if major == "L":
            table[cp] = C_LETTER
        elif major == "N":
            table[cp] = C_NUMBER
    # White_Space of Unicode; fixed values.
    spaces = [*range(9, 14), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
    table[spaces] = C_SPACE
    table[0x20] = C_BLANK
    table[ord("'")] = C_APOSTROPHE
    table[0x110000] = C_SEAM
    return table


@lru_cache(1)
def automaton() -> tuple[np.ndarray, np.ndarray]:
    """next[symbol, state] and starts[symbol, state]: whether a match starts at the character."""
    nxt, starts = np.zeros((9, 8), np.uint8), np.ones((9, 8), bool)
    for symbol, own in ((S_L, IN_L), (S_N, IN_N), (S_O, IN_O)):
        nxt[symbol] = own
        starts[symbol, [own, PREFIX]] = False
    nxt[S_WMORE] = IN_W
    starts[S_WMORE, IN_W] = False
    nxt[S_BLAST] = PREFIX
    nxt[S_WLAST] = FRESH
    for symbol, then in ((S_A2, ONE), (S_A3, TWO)):
        nxt[symbol] = then
        nxt[symbol, [IN_O, PREFIX]] = IN_O
        starts[symbol, [IN_O, PREFIX]] = False
    nxt[:, TWO], nxt[:, ONE] = ONE, FRESH
    starts[:, [ONE, TWO]] = False
    nxt[S_SEAM] = FRESH
    starts[S_SEAM] = True
    return nxt, starts


@lru_cache(1)
def monoid() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All functions that transition functions compose to: number of each symbol's function, the composition table
    (first * size + then) and the value table (function * 8 + state). Number 0 is the identity."""
    nxt, _ = automaton()
    found = {tuple(range(8)): 0}
    own = [found.setdefault(tuple(map(int, f)), len(found)) for f in nxt]
    listed, i = list(found), 0
    while i < len(listed):
        for f in {listed[k] for k in own}:
            new = tuple(f[x] for x in listed[i])
            if new not in found:
                found[new] = len(found)
                listed.append(new)
        i += 1
    values = np.array(listed, np.uint16)
    compose = np.array([[found[tuple(int(g[x]) for x in f)] for g in values] for f in values], np.uint16)
    return np.array(own, np.uint16), compose.ravel(), values.ravel()


def symbols_of(cp: np.ndarray) -> np.ndarray:
    """Input symbol of each code point; a seam (0x110000) must stand after each text."""
    cls = class_table()[cp]
    after = np.append(cls[1:], np.uint8(C_SEAM))
    symbol = np.array([S_L, S_N, S_O, S_WMORE, S_WMORE, S_O, S_SEAM], np.uint8)[cls]
    white = (cls == C_SPACE) | (cls == C_BLANK)
    last = white & (after != C_SPACE) & (after != C_BLANK) & (after != C_SEAM)
    symbol[last] = S_WLAST
    symbol[last & (cls == C_BLANK)] = S_BLAST
    at = np.flatnonzero(cls == C_APOSTROPHE)
    if len(at):
        one = cp[np.minimum(at + 1, len(cp) - 1)]
        two = cp[np.minimum(at + 2, len(cp) - 1)]
        symbol[at[np.isin(one, [ord(c) for c in CONTRACTIONS if len(c) == 1])]] = S_A2
        for c in (c for c in CONTRACTIONS if len(c) == 2):
            symbol[at[(one == ord(c[0])) & (two == ord(c[1]))]] = S_A3
    return symbol


def _prefixes(functions: np.ndarray) -> np.ndarray:
    """Number of the composition of all functions before each one: an exclusive scan, block by block."""
    _, compose, values = monoid()
    size = np.uint16(len(values) // 8)
    n = len(functions)
    blocks = -(-n // BLOCK)
    grid = np.zeros(blocks * BLOCK, np.uint16)
    grid[:n] = functions
    grid = np.ascontiguousarray(grid.reshape(blocks, BLOCK).T)
    before = np.empty((BLOCK, blocks), np.uint16)
    total = np.zeros(blocks, np.uint16)
    for i, row in enumerate(grid):
        before[i] = total
        total = compose.take(total * size + row)
    if blocks > 1:
        before = compose.take(_prefixes(total)[None, :] * size + before)
    return before.T.reshape(-1)[:n]


def scan_states(symbol: np.ndarray) -> np.ndarray:
    """State before each character: the scan's function applied to the first state."""
    own, _, values = monoid()
    return values.take(_prefixes(own.take(symbol)) * np.uint16(8) + np.uint16(FRESH))


def cut(texts: list[str]) -> tuple[bytes, np.ndarray, np.ndarray]:
    """The UTF-8 bytes of the joined texts, where each piece starts in them, and how many pieces each text has."""
    joined = "".join(texts)
    lengths = np.fromiter(map(len, texts), np.int64, len(texts))
    seams = np.cumsum(lengths + 1) - 1
    cp = np.full(len(joined) + len(texts), 0x110000, np.uint32)
    keep = np.ones(len(cp), bool)
    keep[seams] = False
    cp[keep] = np.frombuffer(joined.encode("utf-32-le"), np.uint32)
    symbol = symbols_of(cp)
    starts = automaton()[1].ravel().take(symbol * np.uint16(8) + scan_states(symbol))
    starts[seams] = False
    at = np.flatnonzero(starts)
    data = joined.encode()
    count = np.diff(np.searchsorted(at, np.append(0, seams)))
    if len(data) == len(joined):
        return data, at - np.searchsorted(seams, at), count
    width = np.ones(len(cp), np.uint8)
    for most in (0x7F, 0x7FF, 0xFFFF):
        width += cp > most
    width[seams] = 0
    return data, (np.cumsum(width, dtype=np.int64) - width)[at], count


class Codec:
    """Encoder and decoder over a file of ranks, with a cache of merged pieces.

    The cache is direct-mapped: pieces of up to 16 bytes are two machine words and a length, their slot holds the
    place of their ids in a pool, and a newer piece takes an older one's slot; both have a fixed size. The ids of longer
    pieces, and of those that find the pool full, are held for the batch alone. other_merge: another way to merge one
    piece.
    """

    SLOTS, POOL = 20, 1 << 23

    def __init__(self, path: str, other_merge=None):
        with open(path, "rb") as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.vocabulary = np.empty(max(self.ranks.values()) + 1, object)
        for k, v in self.ranks.items():
            self.vocabulary[v] = k
        self.shown = np.array([str(i) for i in range(len(self.vocabulary))], object)
        self.merge_one = other_merge(self.ranks) if other_merge else self.merge
        self._reset()

    def _reset(self) -> None:
        n = 1 << self.SLOTS
        self.low, self.high, self.long = np.zeros(n, np.uint64), np.zeros(n, np.uint64), np.zeros(n, np.uint8)
        self.place, self.count = np.zeros(n, np.int32), np.zeros(n, np.uint8)
        self.pool, self.used = np.zeros(self.POOL, np.int32), 0

    def merge(self, piece: bytes) -> tuple[int, ...]:
        """Ids of one piece: the adjacent pair of lowest rank merges first, the leftmost of equals."""
        ranks = self.ranks
        if (whole := ranks.get(piece)) is not None:
            return (whole,)
        if len(piece) > 64:
            return self._merge_long(piece)
        parts = [piece[i : i + 1] for i in range(len(piece))]
        pairs = [ranks.get(piece[i : i + 2], 1 << 30) for i in range(len(piece) - 1)]
        while pairs and (low := min(pairs)) < 1 << 30:
            i = pairs.index(low)
            parts[i] += parts.pop(i + 1)
            pairs.pop(i)
            if i < len(pairs):
                pairs[i] = ranks.get(parts[i] + parts[i + 1], 1 << 30)
            if i:
                pairs[i - 1] = ranks.get(parts[i - 1] + parts[i], 1 << 30)
        return tuple(map(ranks.__getitem__, parts))

    def _merge_long(self, piece: bytes) -> tuple[int, ...]:
        """The same merges with a heap over a linked list: n log n for very long pieces."""
        import heapq

        n, ranks = len(piece), self.ranks
        end, prev, alive = list(range(1, n + 1)), list(range(-1, n - 1)), [True] * n
        heap = [(r, i, i + 2) for i in range(n - 1) if (r := ranks.get(piece[i : i + 2])) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, stop = heapq.heappop(heap)
            mid = end[i] if alive[i] else n
            if not alive[i] or mid >= n or end[mid] != stop:
                continue
            alive[mid] = False
            end[i] = stop
            if stop < n:
                prev[stop] = i
                if (r := ranks.get(piece[i : end[stop]])) is not None:
                    heapq.heappush(heap, (r, i, end[stop]))
            if (p := prev[i]) >= 0 and (r := ranks.get(piece[p:stop])) is not None:
                heapq.heappush(heap, (r, p, stop))
        return tuple(ranks[piece[i : end[i]]] for i in range(n) if alive[i])

    def encode_flat(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Ids of all texts in order, how many each text has, where each piece ends in the joined bytes, and how many
        pieces each text has."""
        data, start, pieces = cut(texts)
        end = np.append(start[1:], len(data))[: len(start)]
        size = end - start
        if self.used + len(data) > self.POOL:
            self._reset()
        room = np.frombuffer(data + bytes(24), np.uint8)
        words = np.lib.stride_tricks.as_strided(room, (len(data) + 16, 8), (1, 1)).view(np.uint64)[:, 0] if len(data) else np.zeros(1, np.uint64)
        mask = np.array([(1 << (8 * i)) - 1 for i in range(9)], np.uint64)
        low = words.take(start) & mask.take(np.minimum(size, 8))
        high = words.take(np.minimum(start + 8, len(data))) & mask.take(np.clip(size - 8, 0, 8))
        small = size <= 16
        slot = (low ^ (high * np.uint64(0xC2B2AE3D27D4EB4F)) ^ size.astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
        slot = (slot >> np.uint64(64 - self.SLOTS)).astype(np.int64)
        place, count = self.place.take(slot).astype(np.int64), self.count.take(slot).astype(np.int64)
        hit = small & (self.low.take(slot) == low) & (self.high.take(slot) == high) & (self.long.take(slot) == size)
        miss = np.flatnonzero(~hit)
        pool = self.pool
        if len(miss):
            got: dict[bytes, tuple[int, int]] = {}
            beside: list[int] = []
            merge = self.merge_one
            for i, a, b, fits in zip(miss.tolist(), start[miss].tolist(), end[miss].tolist(), small[miss].tolist(), strict=True):
                piece = data[a:b]
                if (at := got.get(piece)) is None:
                    ids = merge(piece)
                    if fits and self.used + len(ids) <= self.POOL:
                        at = (self.used, len(ids))
                        self.pool[self.used : self.used + len(ids)] = ids
                        self.used += len(ids)
                        s = slot[i]
                        self.low[s], self.high[s], self.long[s], self.place[s], self.count[s] = low[i], high[i], b - a, at[0], at[1]
                    else:
                        at = (self.POOL + len(beside), len(ids))
                        beside += ids
                    got[piece] = at
                place[i], count[i] = at
            if beside:
                pool = np.concatenate([pool, np.array(beside, np.int32)])
        total = np.cumsum(count)
        ids = pool.take(np.repeat(place - (total - count), count) + np.arange(total[-1] if len(total) else 0))
        bounds = np.append(0, np.cumsum(pieces))
        each = np.diff(np.append(0, total)[bounds])
        return ids, each, end, pieces

    def encode_batch(self, texts: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """For each text its ids and the byte offsets where its pieces end."""
        ids, each, end, pieces = self.encode_flat(texts)
        a = p = base = 0
        for n, k in zip(each.tolist(), pieces.tolist(), strict=True):
            own = end[p : p + k] - base
            yield ids[a : a + n], own
            a, p, base = a + n, p + k, base + (int(own[-1]) if k else 0)

    def decode(self, ids: np.ndarray) -> bytes:
        return b"".join(self.vocabulary.take(ids).tolist())


@lru_cache(2)
def codec(path: str) -> Codec:
    return Codec(path)


def batched(texts: list[str], most: int = 1 << 19) -> Iterator[list[str]]:
    """Consecutive texts of about most characters together; a longer text comes alone."""
    own, size = [], 0
    for t in texts:
        if own and size + len(t) > most:
            yield own
            own, size = [], 0
        own.append(t)
        size += len(t)
    if own:
        yield own


def bpe_encode(docs: DataFrame, ranks_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col, ids (array<int>), piece_ends (array<long>: the byte offset where each piece of the text ends), decoded
    (the bytes that the ids give back).

    ranks_path: a tiktoken file that every executor has. Null counts as empty and gives no ids; texts of any length
    are encoded whole, with the class arrays of one such text in memory at a time; repeated rows are encoded each;
    other columns are not read; an empty table gives an empty result.
    """
    schema = docs.select(F.col(id_col).alias("id")).schema[0].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(ranks_path)
        for b in batches:
            texts = [t or "" for t in b.column(1).to_pylist()]
            first = 0
            for group in batched(texts):
                got = [(ids, ends, own.decode(ids)) for ids, ends in own.encode_batch(group)]
                cols = {id_col: b.column(0).slice(first, len(group)), "ids": pa.array([g[0] for g in got], pa.list_(pa.int32())), "piece_ends": pa.array([g[1] for g in got], pa.list_(pa.int64())), "decoded": pa.array([g[2] for g in got], pa.binary())}
                first += len(group)
                yield pa.RecordBatch.from_pydict(cols)

    return docs.select(id_col, text_col).mapInArrow(run, f"{id_col} {schema}, ids array<int>, piece_ends array<long>, decoded binary")


def bpe_digest(docs: DataFrame, ranks_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The digests of bpe_encode's result without its arrays leaving the encoder: id_col, n_tokens, ids_sha256,
    decoded_sha256. Cases as in bpe_encode."""
    schema = docs.select(F.col(id_col).alias("id")).schema[0].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(ranks_path)
        for b in batches:
            n, sha, back = [], [], []
            for group in batched([t or "" for t in b.column(1).to_pylist()]):
                for ids, _ in own.encode_batch(group):
                    n.append(len(ids))
                    sha.append(hashlib.sha256(" ".join(own.shown.take(ids).tolist()).encode()).hexdigest())
                    back.append(hashlib.sha256(own.decode(ids)).hexdigest())
            cols = {id_col: b.column(0), "n_tokens": pa.array(n, pa.int64()), "ids_sha256": pa.array(sha, pa.string()), "decoded_sha256": pa.array(back, pa.string())}
            yield pa.RecordBatch.from_pydict(cols)

    return docs.select(id_col, text_col).mapInArrow(run, f"{id_col} {schema}, n_tokens long, ids_sha256 string, decoded_sha256 string")


def op6_byte_bpe(spark, sf_dir):
    """All whole texts of documents."""
    import public_tokenizers

    return bpe_digest(load(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"))
