"""Packing along a space-filling curve.

Each document's hashed token vector is projected to a few dimensions, its cell on a Hilbert curve is its sort key, a
range exchange lays the documents out along the curve, and each partition is packed as one stream of tokens, so
neighbouring sequences hold similar documents.
"""

from __future__ import annotations

import base64
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkwell.session import Scratch, load

#: Hashed dimensions of a document vector, dimensions of the curve and bits of each.
HASHED, DIMS, BITS = 4096, 4, 10
SEED = 20240229


@lru_cache(1)
def projection(ids: int) -> np.ndarray:
    """Rows of a Gaussian projection for each token id, by the id's hash bucket."""
    rows = np.random.Generator(np.random.PCG64(SEED)).standard_normal((HASHED, DIMS))
    bucket = (np.arange(ids, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - 12)
    return rows[bucket.astype(np.int64)]


def project(ids: np.ndarray) -> np.ndarray:
    """The unit-length hashed vector of a document on the projection's dimensions: about standard normal."""
    rows = projection(1 << 16)
    kinds, n = np.unique(ids, return_counts=True)
    return n @ rows[kinds] / np.sqrt(float(n @ n)) if len(kinds) else np.zeros(DIMS)


def hilbert_key(points: np.ndarray) -> np.ndarray:
    """Position on the Hilbert curve of each row of points (unsigned, BITS bits a dimension), by Skilling's
    transpose method over whole columns."""
    x = points.astype(np.int64).T.copy()
    n, q = len(x), 1 << (BITS - 1)
    while q > 1:
        low = q - 1
        for i in range(n):
            on = (x[i] & q) > 0
            swap = np.where(on, 0, (x[0] ^ x[i]) & low)
            x[0] ^= np.where(on, low, swap)
            x[i] ^= swap
        q >>= 1
    for i in range(1, n):
        x[i] ^= x[i - 1]
    turn, q = np.zeros_like(x[0]), 1 << (BITS - 1)
    while q > 1:
        turn = np.where((x[-1] & q) > 0, turn ^ (q - 1), turn)
        q >>= 1
    x ^= turn
    key = np.zeros_like(x[0])
    for b in range(BITS - 1, -1, -1):
        for i in range(n):
            key = (key << 1) | ((x[i] >> b) & 1)
    return key


def cells(vectors: np.ndarray) -> np.ndarray:
    """Grid cell of each projected vector; the logistic curve spreads normal values evenly."""
    return np.clip((1 / (1 + np.exp(-1.702 * vectors)) * (1 << BITS)).astype(np.int64), 0, (1 << BITS) - 1)


@lru_cache(1)
def tokenizer(name: str, pattern_file: str):
    """Encodes one text as the tokenizers library does with add_special_tokens=False.

    The tiktoken library has the same vocabulary and gives the same ids several times faster; a text that holds a
    special token's string, which tokenizers treats apart, goes to tokenizers.
    """
    import public_tokenizers
    import tiktoken
    from tokenizers import Tokenizer

    theirs = Tokenizer.from_file(name)
    marks = [t.content for t in theirs.get_added_tokens_decoder().values()]
    with open(pattern_file, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    fast = tiktoken.Encoding("packing", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})

    def encode(text: str) -> np.ndarray:
        if any(m in text for m in marks):
            return np.array(theirs.encode(text, add_special_tokens=False).ids, np.uint32)
        return np.asarray(fast.encode_ordinary(text), np.uint32)

    return encode


#: Tokens that a partition of the curve holds about, and those from which on another core is worth a partition.
PART_TOKENS, SMALL_TOKENS = 1 << 25, 1 << 19


def lay_out(lengths: np.ndarray, size: int, first: int) -> Iterator[tuple[int, int, int, int, int]]:
    """Cuts a stream of documents of the given lengths into full sequences of size tokens; what is left at the end is
    cut into sequences whose lengths are powers of two. (document, start, length, sequence, offset) of each piece."""
    total = int(lengths.sum())
    sizes = [size] * (total // size) + [1 << b for b in range(size.bit_length(), -1, -1) if total % size >> b & 1]
    ends = np.cumsum(sizes)
    stops = np.cumsum(lengths)
    cuts = np.unique(np.concatenate([ends, stops]))
    a = 0
    for b in cuts.tolist():
        d = int(np.searchsorted(stops, a, "right"))
        s = int(np.searchsorted(ends, a, "right"))
        yield d, a - int(stops[d] - lengths[d]), b - a, first + s, a - int(ends[s] - sizes[s])
        a = b


def curve_pack(docs: DataFrame, json_path: str, ranks_path: str, size: int = 1024, id_col: str = "doc_id", text_col: str = "text", ids_too: bool = False) -> DataFrame:
    """One row per piece: id_col, start, length, ids_crc32, doc_tokens, sequence_id, offset, and hilbert_key; ids
    (array<int>) too where ids_too.

    A document is its token ids and then id 0; every id lies in one piece. Sequences hold size tokens; a partition's
    last tokens form sequences of 2**k tokens, so nothing needs padding. Null text counts as empty and gives the one
    id 0; repeated rows are packed each; documents with equal keys stay in order of id, and a very large group of
    them is split between partitions by id; other columns are not read; an empty table gives an empty result. A task
    holds the ids of one sequence and of the record batch at hand.
    """
    kind = docs.schema[id_col].dataType.simpleString()

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = tokenizer(json_path, ranks_path)
        for b in batches:
            texts, ids, points, sizes = b.column(1).to_pylist(), [], [], []
            for t in texts:
                x = np.append(own(t or ""), 0)
                points.append(project(x[:-1]))
                # Two bytes an id where all of a document's ids fit, else four.
                sizes.append(len(x))
                ids.append(x.astype("<u2" if x.max() < 1 << 16 else "<u4").tobytes())
            keys = hilbert_key(cells(np.array(points).reshape(-1, DIMS)))
            cols = {"id": b.column(0), "key": pa.array(keys, pa.int64()), "n": pa.array(sizes, pa.int64()), "ids": pa.array(ids, pa.binary())}
            yield pa.RecordBatch.from_pydict(cols)

    scratch = Scratch(docs.sparkSession)
    coded = docs.select(id_col, text_col).mapInArrow(encode, f"id {kind}, key long, n long, ids binary")
    coded = scratch.keep(coded, "coded")
    tokens = coded.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    parts = max(-(-tokens // PART_TOKENS), min(docs.sparkSession.sparkContext.defaultParallelism, tokens // SMALL_TOKENS + 1))
    along = coded.repartitionByRange(int(parts), "key", "id").sortWithinPartitions("key", "id")
    kinds = f"{id_col} {kind}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, hilbert_key long"

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        # What is left of the stream so far: (id, key, all ids, tokens already laid out).
        open_docs: list[tuple[int, int, np.ndarray, int]] = []
        sequence = TaskContext.get().partitionId() << 40

        def flush(last: bool) -> Iterator[pa.RecordBatch]:
            nonlocal open_docs, sequence
            lengths = np.array([len(d[2]) - d[3] for d in open_docs], np.int64)
            take = int(lengths.sum()) if last else int(lengths.sum()) // size * size
            if not take:
                return
            over = np.cumsum(lengths) - take
            kept = np.maximum(lengths - np.maximum(over, 0), 0)
            rows = []
            for d, start, n, s, offset in lay_out(kept, size, sequence):
                doc, key, ids, done = open_docs[d]
                own = ids[done + start : done + start + n]
                rows.append((doc, done + start, n, zlib.crc32(own.astype("<u4").tobytes()), len(ids), s, offset, key, own.astype(np.int32)))
                sequence = max(sequence, s)
            sequence += 1
            open_docs = [(d[0], d[1], d[2], d[3] + int(k)) for d, k in zip(open_docs, kept, strict=True) if d[3] + k < len(d[2])]
            cols = list(zip(*rows, strict=True))
            names = [x.split()[0] for x in kinds.split(", ")]
            out = {n: pa.array(c) if n == id_col else pa.array(c, pa.int64()) for n, c in zip(names, cols, strict=False)}
            if ids_too:
                out["ids"] = pa.array(cols[-1], pa.list_(pa.int32()))
            out[id_col] = out[id_col].cast(id_type)
            yield pa.RecordBatch.from_pydict(out)

        id_type = pa.int64()
        for b in batches:
            id_type = b.schema.field(0).type
            for doc, key, n, ids in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist(), b.column(3), strict=True):
                data = ids.as_buffer()
                open_docs.append((doc, key, np.frombuffer(data, "<u2" if data.size == 2 * n else "<u4"), 0))
            yield from flush(False)
        yield from flush(True)

    packed = scratch.keep(along.mapInArrow(pack, kinds + (", ids array<int>" if ids_too else "")), "packed")
    scratch.drop("coded")
    return packed


def op4_curve_packing(spark, sf_dir):
    """All whole texts of documents, in sequences of at most 1024 tokens."""
    import public_tokenizers as p

    return curve_pack(load(spark, sf_dir, "documents"), p.path("byte_bpe_50k.json"), p.path("byte_bpe_50k.tiktoken"))
