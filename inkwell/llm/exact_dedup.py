"""Exact deduplication by two-pass Bloom filtering.

Pass one builds a Bloom filter of the slots that were hit at least twice, as bitmaps that meet in a tree of merges.
Pass two tests each row: rows with a slot hit only once cannot have a copy and pass straight through; only the rest
shuffle, and an exact comparison of their SHA-256 settles them. A false positive costs a shuffled row of some 80
bytes, never a wrong answer: the filter grows with the rows up to a fixed bound. A text that a large share of all rows
have gets its group by broadcast, so its rows do not meet in one task.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkwell.llm.common import ascii_lower, attach
from inkwell.session import Scratch, load

#: Slots a row, slots tested a row, and the bound of the filter: 2**31 slots are 256 MB, enough for 2**27 rows at
#: 16 slots each; beyond it the slots a row fall, false positives grow, and more rows of 80 bytes shuffle.
SLOTS_PER_ROW, PROBES, MAX_LOG_SLOTS, MIN_LOG_SLOTS = 16, 2, 31, 16
#: The filter is built in pieces of so many slots (16 KB of bitmap).
PIECE = 1 << 17


def slots_of(h: np.ndarray, log_slots: int) -> list[np.ndarray]:
    """PROBES slots of each 64-bit hash, from separate bits of it."""
    h = h.view(np.uint64)
    mixed = (h ^ (h >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    return [(x >> np.uint64(64 - log_slots)).astype(np.int64) for x in (h, mixed)][:PROBES]


def _pack(once: np.ndarray, twice: np.ndarray) -> bytes:
    return zlib.compress(np.concatenate([once, twice]).tobytes(), 1)


def _merge(parts: list[bytes]) -> bytes:
    """Union of slots seen, and of slots seen twice: in one part, or in two of them."""
    once = np.zeros(PIECE // 8, np.uint8)
    twice = np.zeros(PIECE // 8, np.uint8)
    for p in parts:
        x = np.frombuffer(zlib.decompress(p), np.uint8)
        twice |= x[PIECE // 8 :] | (once & x[: PIECE // 8])
        once |= x[: PIECE // 8]
    return _pack(once, twice)


def repeated_slots(hashes: DataFrame, log_slots: int, fan_in: int = 32, scratch: Scratch | None = None) -> bytes:
    """The bitmap of slots hit by two rows or more, of 2**log_slots bits. hashes: one column h (bigint).

    A task sends compressed pieces of its bitmaps, groups of fan_in tasks merge theirs, and so on: no task ever
    reads more than fan_in parts of one piece.
    """

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        seen = [b.column(0).to_numpy(zero_copy_only=False) for b in batches]
        if not sum(map(len, seen)):
            return
        # Per probe a row counts once even where both its probes share a slot.
        both = np.stack(slots_of(np.concatenate(seen), log_slots))
        both[1:][both[1:] == both[0]] = -1
        slots, counts = np.unique(both[both >= 0], return_counts=True)
        part = TaskContext.get().partitionId()
        cut = np.searchsorted(slots, np.arange(0, (1 << log_slots) + 1, PIECE))
        for piece in np.flatnonzero(np.diff(cut)):
            own = slice(cut[piece], cut[piece + 1])
            bits = [np.zeros(PIECE, bool), np.zeros(PIECE, bool)]
            at = slots[own] - piece * PIECE
            bits[0][at] = True
            bits[1][at[counts[own] > 1]] = True
            data = _pack(*(np.packbits(b) for b in bits))
            yield pa.RecordBatch.from_pydict({"piece": [int(piece)], "part": [part], "bits": [data]})

    def merge(key, pdf):
        import pandas as pd

        return pd.DataFrame({"piece": [key[0]], "part": [key[1]], "bits": [_merge(list(pdf["bits"]))]})

    schema = "piece long, part long, bits binary"
    parts = (scratch or Scratch(hashes.sparkSession)).keep(hashes.mapInArrow(build, schema), "bloom")
    width = hashes.rdd.getNumPartitions()
    while width > 1:
        parts = parts.withColumn("part", F.expr(f"part div {fan_in}"))
        parts = parts.groupBy("piece", "part").applyInPandas(merge, schema)
        width = -(-width // fan_in)
    out = np.zeros((1 << log_slots) // 8, np.uint8)
    for row in parts.select("piece", "bits").toLocalIterator():
        x = np.frombuffer(zlib.decompress(row["bits"]), np.uint8)[PIECE // 8 :]
        at = row["piece"] * (PIECE // 8)
        out[at : at + PIECE // 8] |= x[: len(out) - at]
    return out.tobytes()


def exact_dedup(docs: DataFrame, text: Column | None = None, id_col: str = "doc_id") -> DataFrame:
    """One row per input row: id_col, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical after lower-casing A-Z only; the largest id of equal texts stays. Null counts as
    empty, so all null and empty texts are one group. Rows that repeat an id with the same text are each counted in
    group_size and each marked kept when that id stays; a null id stays only where every id of its group is null.
    An empty table gives an empty result; other columns of the input, whatever their names, are not read. Texts of
    any length are hashed whole.
    """
    norm = ascii_lower(F.col("text") if text is None else text)
    narrow = docs.select(F.col(id_col).alias("id"), F.sha2(F.encode(norm, "UTF-8"), 256).alias("sha"))
    scratch = Scratch(docs.sparkSession)
    narrow = scratch.keep(narrow, "sha").withColumn("h", F.xxhash64("sha"))
    rows = narrow.count()
    log_slots = min(MAX_LOG_SLOTS, max(MIN_LOG_SLOTS, int(np.ceil(np.log2(max(1, rows) * SLOTS_PER_ROW)))))
    log_slots = max(log_slots, PIECE.bit_length() - 1)
    bitmap = narrow.sparkSession.sparkContext.broadcast(repeated_slots(narrow.select("h"), log_slots, scratch=scratch))

    @F.pandas_udf("boolean")
    def maybe_repeated(h):
        import pandas as pd

        bits = np.frombuffer(bitmap.value, np.uint8)
        hit = np.ones(len(h), bool)
        for s in slots_of(h.to_numpy(), log_slots):
            hit &= (bits[s >> 3] & (128 >> (s & 7)).astype(np.uint8)) > 0
        return pd.Series(hit)

    tested = scratch.keep(narrow.withColumn("again", maybe_repeated("h")).drop("h"), "tested")
    scratch.drop("sha", "bloom")
    groups = tested.where("again").groupBy("sha").agg(F.max("id").alias("keep_id"), F.count("*").alias("group_size"))
    groups = scratch.keep(groups, "groups")
    again = attach(tested.where("again").drop("again"), groups, "sha")
    alone = tested.where("not again").select("*", F.col("id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"))
    out = again.select("id", "keep_id", "group_size", "sha").unionByName(alone.drop("again"))
    kept = F.col("id").eqNullSafe(F.col("keep_id")).alias("kept")
    return out.select(F.col("id").alias(id_col), "keep_id", "group_size", kept, F.col("sha").alias("text_sha256"))


def op2_exact_dedup(spark, sf_dir):
    """All rows and whole texts of documents."""
    return exact_dedup(load(spark, sf_dir, "documents"))


_NORM = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
SQL = f"""
SELECT doc_id, max(doc_id) OVER (PARTITION BY sha) AS keep_id, count(*) OVER (PARTITION BY sha) AS group_size,
       doc_id = max(doc_id) OVER (PARTITION BY sha) AS kept, sha AS text_sha256
FROM (SELECT doc_id, sha256({_NORM}) AS sha FROM documents)
"""
