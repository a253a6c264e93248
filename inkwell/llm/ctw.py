"""Language-model scoring by context-tree weighting over bytes.

A text is its UTF-8 bytes (A-Z in lower case) and an end mark. Each byte is eight binary decisions in the context of
the bytes before it; at each decision the Krichevsky-Trofimov estimates of all context depths from DEPTH to 0 are
mixed by the tree's weights. The tree is trained from counts, then frozen.

Nothing that grows with the corpus is broadcast: texts are cut into chunks of some megabytes, each chunk asks for the
contexts and words it holds, counts are summed by key, subtrees below the last two bytes are weighted in groups, the
upper two levels (256 nodes) on the driver, and each chunk gets back the values of its own keys: those that most chunks
ask for from a broadcast table of fixed size, all others by a join.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkwell.llm.language import held_out
from inkwell.session import Scratch, load

DEPTH, CHUNK_BYTES = 4, 6 << 20
#: Keys of the broadcast table at most (17 bytes each).
COMMON_MOST = 1 << 20
#: Bytes that UTF-8 never has: what stands before a text, and its end.
BEFORE, END = 0xFE, 0xFF
#: Largest lookup table of the dense ranking of contexts.
DENSE = 1 << 26
END_WORD = b"\n"


def word_key(word: bytes) -> int:
    """A word's key: its 64-bit hash with the sign bit set; contexts have keys from 0."""
    return (xxhash.xxh3_64_intdigest(word) | 1 << 63) - (1 << 64)


def _rank(codes: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct codes, sorted, and each code's place among them; codes are below size."""
    if size > DENSE:
        return np.unique(codes, return_inverse=True)
    used = np.zeros(size, bool)
    used[codes] = True
    kinds = np.flatnonzero(used)
    place = np.zeros(size, np.int32)
    place[kinds] = np.arange(len(kinds), dtype=np.int32)
    return kinds, place.take(codes)


def context_keys(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (context, byte) keys of the texts, the place among them of each coded byte, ends included, and how
    many bytes each text has coded. A key is four context bytes, oldest first, and the byte."""
    pad = bytes([BEFORE]) * DEPTH
    seq = np.frombuffer(b"".join(x for t in texts for x in (pad, t, b"\xff")), np.uint8)
    n = np.fromiter(map(len, texts), np.int64, len(texts)) + 1
    starts = np.cumsum(n + DEPTH) - n
    coded = np.ones(len(seq), bool)
    for k in range(DEPTH):
        coded[starts - DEPTH + k] = False
    two = (seq[:-1].astype(np.uint16) << 8) | seq[1:]
    kinds2, rank2 = _rank(two, 1 << 16)
    r = len(kinds2)
    at = np.flatnonzero(coded).astype(np.int32)
    four = rank2[at - 4].astype(np.int32 if r * r < 1 << 31 else np.int64) * r + rank2[at - 2]
    del two, rank2
    kinds4, rank4 = _rank(four, r * r)
    del four
    last = rank4.astype(np.int32 if len(kinds4) < 1 << 23 else np.int64) * 256 + seq[at]
    del rank4, at
    kinds, rank = _rank(last, len(kinds4) * 256)
    context = kinds4[kinds >> 8]
    keys = (kinds2[context // r].astype(np.int64) << 24) | (kinds2[context % r].astype(np.int64) << 8) | (kinds & 255)
    return keys, rank, n


def lgamma(x: np.ndarray) -> np.ndarray:
    """log Gamma for x > 0: Stirling's series after shifting by eight."""
    shift = np.zeros_like(x)
    y = x + 8
    for k in range(8):
        shift += np.log(x + k)
    z = 1 / (y * y)
    return (y - 0.5) * np.log(y) - y + 0.9189385332046727 + (1 / 12 - z * (1 / 360 - z * (1 / 1260 - z / 1680))) / y - shift


def log_kt(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Log of the KT estimate of a zeros and b ones."""
    a, b = a.astype(float), b.astype(float)
    return lgamma(a + 0.5) + lgamma(b + 0.5) - lgamma(a + b + 1) - np.log(np.pi)


def weighted(kt: np.ndarray, children: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A node's weight for its own estimate against its children's product, and the log of the mixture."""
    return 1 / (1 + np.exp(np.clip(children - kt, -700, 700))), np.logaddexp(kt, children) - np.log(2)


def subtree(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For sorted keys with equal last two context bytes: the mixed probability, from depth 2 down, of each key's
    eight decisions; and of the depth-2 context the decision nodes, zeros, ones and log weighted probability."""
    sym = keys & 255
    bit = np.arange(8)
    node = (256 | sym[:, None]) >> (8 - bit)
    one = (sym[:, None] >> (7 - bit)) & 1
    p = own = children = place = None
    levels = []
    for depth in range(DEPTH, 1, -1):
        context = (keys >> 8) & ((1 << (8 * depth)) - 1)
        kinds, at = np.unique((context[:, None] << 8) | node, return_inverse=True)
        at = at.reshape(node.shape)
        ones = np.bincount(at.ravel(), (counts[:, None] * one).ravel(), len(kinds))
        zeros = np.bincount(at.ravel(), (counts[:, None] * (1 - one)).ravel(), len(kinds))
        kt = log_kt(zeros, ones)
        if depth == DEPTH:
            below, w = kt, np.ones(len(kinds))
        else:
            # Each deeper node counts once under its parent.
            parent = np.zeros(len(levels[-1]), np.int64)
            parent[place.ravel()] = at.ravel()
            children = np.bincount(parent, levels[-1], len(kinds))
            w, below = weighted(kt, children)
        levels.append(below)
        est = np.where(one == 1, ones[at] + 0.5, zeros[at] + 0.5) / (ones + zeros + 1)[at]
        p = est if p is None else w[at] * est + (1 - w[at]) * p
        place, own = at, (kinds & 255, zeros, ones, below)
    return p, *own


def _subtree_rows(pdf):
    import pandas as pd

    pdf = pdf.sort_values("key")
    keys = pdf["key"].to_numpy(np.int64)
    p, node, zeros, ones, below = subtree(keys, pdf["c"].to_numpy(np.int64))
    a = pd.DataFrame({"key": keys, "p": [x.tobytes() for x in p]})
    b1 = int(keys[0] >> 8 & 255)
    b = pd.DataFrame({"b1": b1, "node": node, "zeros": zeros.astype(np.int64), "ones": ones.astype(np.int64), "lw": below})
    return pd.concat([a, b])[["key", "p", "b1", "node", "zeros", "ones", "lw"]].astype({"key": "Int64", "b1": "Int64", "node": "Int64", "zeros": "Int64", "ones": "Int64"})


def _upper(rows) -> tuple[np.ndarray, np.ndarray]:
    """Own estimate and weight of depths 0 and 1: [1 + 256 contexts (the root first), node, (share of ones, weight)]."""
    zeros, ones, children = (np.zeros((257, 256)) for _ in range(3))
    for b1, node, z, o, lw in rows:
        zeros[1 + b1, node], ones[1 + b1, node], children[1 + b1, node] = z, o, lw
    zeros[0], ones[0] = zeros.sum(0), ones.sum(0)
    kt = log_kt(zeros, ones)
    w, below = weighted(kt, children)
    w[0], _ = weighted(kt[0], below[1:].sum(0))
    return (ones + 0.5) / (zeros + ones + 1), w


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (id, text, train) to one compressed row a chunk."""
    from pyspark import TaskContext

    base, k, held, size = TaskContext.get().partitionId() << 32, 0, [], 0

    def close() -> pa.RecordBatch:
        t = pa.Table.from_batches(held)
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, t.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as w:
            w.write_table(t)
        return pa.RecordBatch.from_pydict({"chunk": pa.array([base + k], pa.int64()), "blob": pa.array([sink.getvalue().to_pybytes()], pa.binary())})

    for b in batches:
        # A batch is cut where a chunk is full.
        lengths = np.array([len(t or "") for t in b.column(1).to_pylist()], np.int64)
        first = 0
        for i, n in enumerate(lengths.tolist()):
            size += n
            if size >= CHUNK_BYTES:
                held.append(b.slice(first, i + 1 - first))
                yield close()
                first, k, held, size = i + 1, k + 1, [], 0
        if first < b.num_rows:
            held.append(b.slice(first))
    if held:
        yield close()


def _open(blob: bytes) -> tuple[list, list[bytes], np.ndarray]:
    t = pa.ipc.open_stream(blob).read_all()
    return t.column(0), [(x or "").encode().lower() for x in t.column(1).to_pylist()], t.column(2).to_numpy(zero_copy_only=False).astype(bool)


def _requests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(chunk, key, n): every context and word of the chunk, with how often its training texts have it."""
    for b in batches:
        for chunk, blob in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            _, texts, train = _open(blob)
            keys, rank, n = context_keys(texts)
            counts = np.bincount(rank, np.repeat(train, n), len(keys)).astype(np.int64)
            words = Counter({END_WORD: int(train.sum())})
            for t, own in zip(texts, train.tolist(), strict=True):
                if own:
                    words.update(t.split())
            for w in set().union(*(t.split() for t, own in zip(texts, train.tolist(), strict=True) if not own)):
                words.setdefault(w, 0)
            wk = np.fromiter(map(word_key, words), np.int64, len(words))
            wn = np.fromiter(words.values(), np.int64, len(words))
            key, n = np.concatenate([wk, keys]), np.concatenate([wn, counts])
            by = np.argsort(key)
            yield pa.RecordBatch.from_pydict({"chunk": pa.array(np.full(len(key), chunk)), "key": pa.array(key[by]), "n": pa.array(n[by])})


def _common_from(counts: DataFrame) -> int:
    """The least number of chunks, a power of two, from which at most COMMON_MOST keys are asked for."""
    level = F.floor(F.log2("chunks")).cast("int")
    total, least = 0, 62
    for row in sorted(counts.groupBy(level.alias("level")).count().collect(), reverse=True):
        if total + row[1] > COMMON_MOST:
            break
        total, least = total + row[1], row[0]
    return 1 << least


def _look_up(keys: np.ndarray, *tables) -> tuple[np.ndarray, np.ndarray]:
    """value and known of each key, from the table that has it; one that no table has is an error."""
    value, known, seen = np.zeros(len(keys)), np.zeros(len(keys), bool), np.zeros(len(keys), bool)
    for have, v, k in tables:
        if len(have):
            at = np.minimum(np.searchsorted(have, keys), len(have) - 1)
            hit = have[at] == keys
            value[hit], known[hit] = v[at[hit]], k[at[hit]]
            seen |= hit
    if not seen.all():
        raise ValueError("a chunk's key has no value")
    return value, known


def ctw_score(docs: DataFrame, train, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id_col, n_tokens, n_known, train_tokens, base_score, score, n_bytes, bits_per_byte.

    train: boolean column, the rows to learn from. score is the log10 probability of the whole text's bytes and its
    end, A-Z in lower case; bits_per_byte is the code length per coded byte (n_bytes has the end). Base: see the README. Null texts are empty: only an end. Repeated rows are learnt from and scored each;
    very long texts are scored whole, and a chunk closes behind one; null ids are scored like others; other columns are not read. Without training rows
    every byte has probability 1/256. An empty table gives an empty result.
    """
    spark = docs.sparkSession
    kind = docs.schema[id_col].dataType.simpleString()
    own = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"), F.coalesce(train, F.lit(False)).alias("train"))
    scratch = Scratch(spark)
    blobs = scratch.keep(own.mapInArrow(_chunks, "chunk long, blob binary"), "chunks")
    asked = scratch.keep(blobs.mapInArrow(_requests, "chunk long, key long, n long"), "asked")
    counts = scratch.keep(asked.groupBy("key").agg(F.sum("n").alias("c"), F.count("*").alias("chunks")), "counts")

    words = counts.where("key < 0")
    total, distinct = words.where("c > 0").agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
    pair = F.expr("shiftrightunsigned(key, 8) & 65535").alias("pair")
    tree = counts.where("key >= 0").groupBy(pair).applyInPandas(_subtree_rows, "key long, p binary, b1 long, node long, zeros long, ones long, lw double")
    tree = scratch.keep(tree, "tree")
    rows = tree.where("key is null").groupBy("b1", "node").agg(F.sum("zeros"), F.sum("ones"), F.sum("lw")).collect()
    upper = spark.sparkContext.broadcast(_upper(rows))

    @F.pandas_udf("double")
    def mixed(key, p):
        import pandas as pd

        share, weight = upper.value
        k = key.to_numpy(np.int64)
        q = np.frombuffer(b"".join(p), np.float64).reshape(-1, 8)
        b1, sym = k >> 8 & 255, k & 255
        bit = np.arange(8)
        node = (256 | sym[:, None]) >> (8 - bit)
        one = (sym[:, None] >> (7 - bit)) & 1
        for c in (1 + b1[:, None], np.zeros_like(b1)[:, None]):
            s = share[c, node]
            q = weight[c, node] * np.where(one == 1, s, 1 - s) + (1 - weight[c, node]) * q
        return pd.Series(np.log10(q).sum(1))

    base = F.log10((F.col("c") + 0.5) / F.lit(total + 0.5 * (distinct + 1)))
    values = words.select("key", base.alias("value"), (F.col("c") > 0).alias("known"))
    values = values.unionAll(tree.where("key is not null").select("key", mixed("key", "p"), F.lit(True)))
    values = scratch.keep(values, "values")
    scratch.drop("tree")
    common = counts.where(F.col("chunks") >= _common_from(counts)).select("key")
    table = values.join(common, "key", "left_semi").orderBy("key").toArrow()
    told = spark.sparkContext.broadcast(tuple(table.column(c).to_numpy() for c in ("key", "value", "known")))
    # common has at most COMMON_MOST rows.
    answers = asked.select("chunk", "key").join(F.broadcast(common), "key", "left_anti").join(values, "key")
    out = f"{id_col} {kind}, n_tokens long, n_known long, train_tokens long, base_score double, score double, n_bytes long"

    def score(key, left, right):
        import pandas as pd

        by = np.argsort(right["key"].to_numpy(np.int64))
        rare = tuple(right[c].to_numpy(t)[by] for c, t in (("key", np.int64), ("value", np.float64), ("known", bool)))
        parts = []
        for blob in left["blob"]:
            ids, texts, _ = _open(blob)
            keys, rank, n = context_keys(texts)
            of_key, _ = _look_up(keys, told.value, rare)
            frame = pd.DataFrame({"score": np.add.reduceat(of_key[rank], np.cumsum(n) - n), "n_bytes": n})
            del keys, rank
            place: dict[bytes, int] = {}
            at = []
            size = []
            for t in texts:
                ws = t.split()
                ws.append(END_WORD)
                size.append(len(ws))
                at.append(np.fromiter([place.setdefault(w, len(place)) for w in ws], np.int32, len(ws)))
            base_of, known_of = _look_up(np.fromiter(map(word_key, place), np.int64, len(place)), told.value, rare)
            at, size = np.concatenate(at), np.array(size)
            first = np.cumsum(size) - size
            frame.insert(0, id_col, ids.to_pandas())
            frame["n_tokens"], frame["train_tokens"] = size, total
            frame["n_known"] = np.add.reduceat(known_of[at].astype(np.int64), first)
            frame["base_score"] = np.add.reduceat(base_of[at], first)
            parts.append(frame)
        names = [c.split()[0] for c in out.split(", ")]
        return pd.concat(parts)[names] if parts else pd.DataFrame(columns=names)

    scored = blobs.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInPandas(score, out)
    scored = scored.withColumn("bits_per_byte", -F.col("score") / float(np.log10(2)) / F.col("n_bytes"))
    scored = scratch.keep(scored, "scored")
    scratch.drop(but="scored")
    return scored


def op9_ctw_scoring(spark, sf_dir):
    """All whole texts of documents; learns from those whose crc32(doc_id) mod 5 is not 1."""
    docs = load(spark, sf_dir, "documents")
    held = held_out("doc_id", 5, 1)
    scored = ctw_score(docs, ~held)
    return scored.withColumn("held_out", held)
