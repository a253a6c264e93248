"""N-gram Jaccard self-join: a size-aware heavy-light join over sets of word shingles.

Sets are ordered by one global order, rare shingles first. Two sets with Jaccard >= 0.8 share at least k of the first
n - ceil(0.8 n) + k shingles of each, for any k up to ceil(0.8 n). Light sets, smaller than a boundary, therefore
enumerate all two-element subsets of such a prefix (k = 2); heavy ones, and light ones that could be their partners,
scan the inverted lists of theirs and must meet SCANNED times (k = SCANNED). The boundary is where the estimated cost
of both together is least.

The order comes from a count sketch over all shingles of all tasks, with slots in proportion to the text: a sketch that
is too full hides what a list of SHORT sets has above chance, frequent shingles then count as rare, and zones grow into
one another. Lists of at most SHORT sets give their pairs, so pairs are at most SHORT / 2 times the entries. Sets that
share a longer list belong to one zone, and all sets of a zone whose sizes allow a link are compared with one another in
blocks of bounded size that give counts and a spanning forest, never pairs. A pair that links shares a list, so it lies
in one zone or meets in short lists only: no link between different texts is lost, all is verified on whole sets, and
none is invented (shingles and sets are told apart by 64-bit and 128-bit hashes, keys between steps have 64 bits).

What joins of entries, pairs and sets shuffle is taken in passes, so that it is bounded whatever the groups are.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkwell.llm.common import attach, components
from inkwell.session import Scratch, load

#: Words of a shingle; the similarity is NUM / DEN.
WORDS, NUM, DEN = 5, 4, 5
#: Hashes that a task counts at a time; sets of BOUNDARY_MOST shingles and more are always heavy; texts that are taken out of
#: a batch at a time.
CHUNK, BOUNDARY_MOST, TEXTS = 1 << 21, 200, 1024
#: Lists in which a pair with a heavy set must meet; sets below four shingles have no unequal partner.
SCANNED = 4
#: Log2 of the sketch's slots, at least and at most (128 MB of classes), and of the slots of one of its rows; bytes of text
#: a slot, about; rows that are added up at a time.
SLOTS, SLOTS_MOST, ROW, LOAD, ROWS = 22, 28, 16, 256, 256
#: List entries that are joined at a time, about, and joins at most: shuffle files of one join are deleted before the next.
JOINED, PASSES = 1 << 22, 16
#: Pairs of list entries, and shingles of the sets that go beside pairs or into blocks, that are shuffled at a time, about.
PAIRED, COMPARED = 1 << 26, 1 << 26
#: Sets of a list that gives its pairs, at most.
SHORT = 24
#: Shingles and sets of a block of a zone, about.
BLOCK, BLOCK_SETS = 1 << 17, 1 << 10
#: Sizes of one band are within this factor. It exceeds DEN / NUM, so sets that link are in one band or in neighbouring ones.
BAND = 1.26
M1, M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def need(n):
    """Least overlap of a set of n shingles with any partner: ceil(0.8 n)."""
    return (NUM * n + DEN - 1) // DEN


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * M1
    h = (h ^ (h >> np.uint64(29))) * M2
    return h ^ (h >> np.uint64(32))


def _parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The batches in parts of at most TEXTS rows, so that few texts are Python strings at once."""
    for b in batches:
        for first in range(0, b.num_rows, TEXTS):
            yield b.slice(first, TEXTS)


class _Words(dict):
    """Hashes of words; at most 2^17 are remembered."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= 1 << 17:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


_words = _Words()


def shingles(text: str | None) -> np.ndarray:
    """Sorted distinct hashes of the 5-word shingles of a text, A-Z in lower case; of fewer words, the whole sequence."""
    words = (text or "").encode().lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    w = np.array(list(map(_words.__getitem__, words)), np.uint64)
    k = min(WORDS, len(w))
    h = np.full(len(w) - k + 1, k, np.uint64)
    for i in range(k):
        h = (h ^ w[i : len(w) - k + 1 + i]) * M1
        h ^= h >> np.uint64(32)
    return np.unique(mix(h))


def signature(s: np.ndarray) -> tuple[bytes, int]:
    """128-bit hash of a set, and its first 64 bits as a signed key."""
    sig = xxhash.xxh3_128_digest(s.tobytes())
    return sig, int.from_bytes(sig[:8], "little", signed=True)


def sketch_slots(size: int) -> int:
    """Log2 of the slots of a sketch of texts of so many bytes."""
    return min(SLOTS_MOST, max(SLOTS, (max(1, size // LOAD) - 1).bit_length()))


def _describe(log: int):
    """A row per document (id, n, key, sig, scan), and rows of a chunk's sketch of 2^log slots (place, at, times): counts of
    the slots of one row of it that are not empty. Each distinct set of a task counts once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[bytes] = set()
        sets: list[np.ndarray] = []
        rows: list[list] = []
        id_type, held = pa.int64(), 0

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal sets, rows
            slots = [(s >> np.uint64(64 - SLOTS)).astype(np.int32) for s in sets]
            times = np.bincount(np.concatenate(slots), minlength=1 << SLOTS) if sets else np.zeros(1 << SLOTS, np.int64)
            scans = [int((np.partition(times[x], len(x) - need(len(x)))[: len(x) - need(len(x)) + 1] - 1).sum()) for x in slots]
            for r in rows:
                r[4] = scans[r[4]] if r[4] is not None else 0
            ids, sizes, keys, sigs, scan = zip(*rows, strict=True) if rows else ((),) * 5
            own = len(rows)
            place, at, counted = [], [], []
            if sets:
                flat = np.sort(np.concatenate([(s >> np.uint64(64 - log)).astype(np.uint32) for s in sets]))
                first = np.flatnonzero(np.append(True, flat[1:] != flat[:-1]))
                slot, times = flat[first], np.diff(np.append(first, len(flat)))
                ends = np.searchsorted(slot >> np.uint32(ROW), np.arange((1 << (log - ROW)) + 1))
                for k in np.flatnonzero(np.diff(ends)):
                    part = slice(ends[k], ends[k + 1])
                    place.append(k)
                    at.append(slot[part].astype(np.uint16).tobytes())
                    counted.append(np.minimum(times[part], 65535).astype(np.uint16).tobytes())
            lone = len(place)
            yield pa.RecordBatch.from_pydict({
                "id": pa.array([*ids, *[None] * lone], id_type), "n": pa.array([*sizes, *[None] * lone], pa.int64()),
                "key": pa.array([*keys, *[None] * lone], pa.int64()), "sig": pa.array([*sigs, *[None] * lone], pa.binary()),
                "scan": pa.array([*scan, *[None] * lone], pa.int64()), "place": pa.array([*[None] * own, *place], pa.int32()),
                "at": pa.array([*[None] * own, *at], pa.binary()), "times": pa.array([*[None] * own, *counted], pa.binary()),
            })
            sets, rows = [], []

        for b in _parts(batches):
            id_type = b.schema.field(0).type
            for i, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                s = shingles(text)
                sig, key = signature(s)
                new = sig not in seen and len(s) > 0
                rows.append([i, len(s), key, sig, len(sets) if new else None])
                if new:
                    seen.add(sig)
                    sets.append(s)
                    held += len(s)
                if held > CHUNK:
                    yield from flush()
                    held = 0
        yield from flush()

    return run


def _leveled(pdf):
    """The class of each slot of one row of the sketch, two a byte: 0 for a count that chance explains, else log2 of what it
    has above that, 15 at most. Slots are hashes, so the row's median is what chance gives."""
    import pandas as pd

    at, times = (np.frombuffer(b"".join(pdf[c]), np.uint16) for c in ("at", "times"))
    total = np.bincount(at, times, 1 << ROW)
    usual = float(np.median(total))
    above = total - usual - 3 * np.sqrt(usual)
    level = np.minimum(np.floor(np.log2(np.maximum(above, 1))), 15).astype(np.uint8)
    return pd.DataFrame({"place": pdf["place"][:1], "level": [(level[::2] | (level[1::2] << 4)).tobytes()]})


def shingle_levels(sketch: DataFrame, log: int, scratch: Scratch) -> np.ndarray:
    """The classes of the 2^log slots, two a byte: one task a row adds its counts up, ROWS rows at a time, and the driver
    gets half a byte a slot."""
    out = np.zeros((1 << (log - ROW), 1 << (ROW - 1)), np.uint8)
    for k in range(0, len(out), ROWS):
        part = sketch.where(F.col("place").between(k, k + ROWS - 1))
        for row in scratch.keep(part.groupBy("place").applyInPandas(_leveled, "place int, level binary"), "levels").toLocalIterator():
            out[row["place"]] = np.frombuffer(row["level"], np.uint8)
        scratch.drop("levels")
    return out.ravel()


def level_of(levels: np.ndarray, s: np.ndarray) -> np.ndarray:
    """The classes of shingles."""
    at = (s >> np.uint64(64 - (len(levels).bit_length()))).astype(np.int64)
    return (levels[at >> 1] >> ((at & 1) << 2).astype(np.uint8)) & np.uint8(15)


def choose_boundary(sizes: list[tuple[int, int, int]], spread: int) -> int:
    """Smallest size of a heavy set. sizes: (n, sets, list entries their prefixes met in a task); spread: tasks."""
    best, at = None, 4
    rows = {n: (m, m * (n - need(n) + 2) * (n - need(n) + 1) // 2, m * (n - need(n) + SCANNED) + scan * spread) for n, m, scan in sizes}
    for b in range(4, BOUNDARY_MOST + 1):
        cost = sum(x[1] if n < b else x[2] for n, x in rows.items())
        if best is None or cost < best:
            best, at = cost, b
    return at


def _postings(levels, boundary: int):
    """Texts to list entries (h, key, n, pos); pos is -1 where the list is that of a two-element subset."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        level = levels.value
        seen: set[bytes] = set()
        for b in _parts(batches):
            hs, keys, ns, at = [], [], [], []
            for text in b.column(0).to_pylist():
                s = shingles(text)
                n = len(s)
                if n < 4:
                    continue
                sig, key = signature(s)
                if sig in seen:
                    continue
                seen.add(sig)
                s = s[np.argsort(level_of(level, s), kind="stable")]
                spare = n - need(n)
                own = []
                if n * DEN >= boundary * NUM:
                    own.append((s[: spare + SCANNED], np.arange(min(n, spare + SCANNED))))
                if n < boundary:
                    a, c = np.array(list(combinations(range(spare + 2), 2))).T
                    own.append((mix(s[a] * M2 + mix(s[c])), np.full(len(a), -1)))
                for h, p in own:
                    hs.append(h)
                    at.append(p)
                    keys.append(np.full(len(h), key, np.int64))
                    ns.append(np.full(len(h), n, np.int32))
            if hs:
                cols = {"h": np.concatenate(hs).view(np.int64), "key": np.concatenate(keys), "n": np.concatenate(ns), "pos": np.concatenate(at).astype(np.int32)}
                yield pa.RecordBatch.from_pydict({k: pa.array(v) for k, v in cols.items()})

    return run


def _bitmap(hashes: DataFrame, many: int) -> tuple[int, np.ndarray]:
    """A one-probe Bloom filter of the hashes (h): log2 of its slots, at most 2**29 (64 MB), and its bytes. Texts that it
    lets through without need cost time only."""
    log = int(min(29, max(15, np.ceil(np.log2(max(1, many) * 64)))))
    slot = F.shiftrightunsigned("h", 64 - log) + 1
    parts = hashes.groupBy(F.bitmap_bucket_number(slot).alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(slot)).alias("bits"))
    out = np.zeros((1 << log) // 8, np.uint8)
    for row in parts.toLocalIterator():
        at = (row["bucket"] - 1) * 4096
        out[at : at + 4096] = np.frombuffer(row["bits"], np.uint8)
    return log, out


def _sets(wanted):
    """(h, text) to (row, key, s) of the texts whose h the filter knows; row is a number of its own."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        log, bits = wanted.value
        row = TaskContext.get().partitionId() << 40
        for b in batches:
            slot = (b.column(0).to_numpy(zero_copy_only=False).view(np.uint64) >> np.uint64(64 - log)).astype(np.int64)
            hit = np.flatnonzero((bits[slot >> 3] >> (slot & 7).astype(np.uint8)) & 1)
            for part in range(0, len(hit), 256):
                sets = [shingles(t) for t in b.column(1).take(pa.array(hit[part : part + 256])).to_pylist()]
                key = [signature(s)[1] for s in sets]
                rows = np.arange(row, row := row + len(key))
                yield pa.RecordBatch.from_pydict({"row": pa.array(rows, pa.int64()), "key": pa.array(key, pa.int64()), "s": pa.array([s.view(np.int64) for s in sets], pa.list_(pa.int64()))})

    return run


def compare_block(key, pdf):
    """Sets (key, s, copies, salt) of one pair of blocks of a zone, those of one block with one another only where the pair
    is one block: (key, links), how many rows of other sets each links with, and (key, other), links that join all that
    are joined here."""
    import pandas as pd

    sets, copies, salt, names = pdf["s"].tolist(), pdf["copies"].to_numpy(float), pdf["salt"].to_numpy(), pdf["key"].to_numpy()
    sizes = np.array(list(map(len, sets)))
    _, at, many = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    owners = np.repeat(np.arange(len(sets)), sizes)[np.argsort(at, kind="stable")]
    starts, ends = np.cumsum(many) - many, np.cumsum(sizes)
    links, tree = np.zeros(len(sets), np.int64), np.arange(len(sets))
    a, b = [], []
    for i, n in enumerate(sizes):
        own = at[ends[i] - n : ends[i]]
        own = own[many[own] > 1]
        width = many[own]
        place = np.arange(width.sum()) + np.repeat(starts[own] - (np.cumsum(width) - width), width)
        both = np.bincount(owners[place], minlength=len(sets))
        hit = both * 100 >= (n + sizes - both) * 80
        hit[i] = False
        if key[1] != key[2]:
            hit &= salt != salt[i]
        links[i] = int(copies[hit].sum())
        hit = np.flatnonzero(hit)
        trees, first = np.unique(tree[hit], return_index=True)
        apart = trees != tree[i]
        if apart.any():
            a += [names[i]] * int(apart.sum())
            b += names[hit[first[apart]]].tolist()
            tree[np.isin(tree, trees[apart])] = tree[i]
    names, links = names[links > 0], links[links > 0]
    counted = pd.DataFrame({"key": names, "other": pd.array([None] * len(names), "Int64"), "links": links})
    return pd.concat([counted, pd.DataFrame({"key": pd.array(a, "int64"), "other": pd.array(b, "Int64"), "links": 0})])


def measure_lists(postings: DataFrame, scratch: Scratch) -> DataFrame:
    """The entries of lists that more than one set shares, each with the smallest key of its list (low) and its length.

    Lists are taken in passes by their hashes, each over all entries of its lists, so that only the shuffle files of about
    JOINED entries exist at once however large the table is."""
    passes = int(min(PASSES, max(1, -(-postings.count() // JOINED))))
    out = None
    for k in range(passes):
        part = postings.where(F.pmod(F.xxhash64("h"), F.lit(passes)) == k) if passes > 1 else postings
        shared = part.groupBy("h").agg(F.min("key").alias("low"), F.max("key").alias("high")).where("low <> high").select("h", "low")
        live = scratch.keep(part.join(shared, "h").distinct(), "lists")
        # Each entry with the length of its list: one join for long and short lists alike.
        lengths = live.groupBy("h").agg(F.count("*").alias("length"))
        done = scratch.keep(live.join(lengths, "h"), "measured")
        scratch.drop("lists")
        out = done if out is None else out.union(done)
    return out


def pairs_of(placed: DataFrame, scratch: Scratch) -> DataFrame:
    """Pairs (a, b) of sets that meet often enough in the lists whose entries (h, key, n, pos, length, zone) are given, but
    for those of one zone. Pairs are taken in passes by their first set, of about PAIRED pairs of entries each."""
    many = placed.agg(F.coalesce(F.sum(F.col("length") - 1), F.lit(0))).first()[0] // 2
    passes = max(1, -(-many // PAIRED))
    x, y = (placed.select("h", *[F.col(c).alias(f"{c}_{k}") for c in ("key", "n", "pos", "zone")]) for k in "xy")
    fits = (F.col("n_x") * DEN >= F.col("n_y") * NUM) & (F.col("n_y") * DEN >= F.col("n_x") * NUM)
    most = F.least("pos_x", "pos_y") + F.least(F.col("n_x") - F.col("pos_x"), F.col("n_y") - F.col("pos_y"))
    room = (F.col("pos_x") < 0) | (most * (NUM + DEN) >= (F.col("n_x") + F.col("n_y")) * NUM)
    alike = (F.col("pos_x") < 0) == (F.col("pos_y") < 0)
    apart = F.col("zone_x").isNull() | F.col("zone_y").isNull() | (F.col("zone_x") != F.col("zone_y"))
    out = None
    for k in range(passes):
        own = x.where(F.pmod(F.xxhash64("key_x"), F.lit(passes)) == k) if passes > 1 else x
        pairs = own.join(y, (own["h"] == y["h"]) & (own["key_x"] < y["key_y"]) & fits & alike & room & apart)
        pairs = pairs.groupBy(F.col("key_x").alias("a"), F.col("key_y").alias("b")).agg(F.sum(F.when(F.col("pos_x") < 0, SCANNED).otherwise(1)).alias("met"))
        done = scratch.keep(pairs.where(F.col("met") >= SCANNED).select("a", "b"), "pairs")
        out = done if out is None else out.union(done)
    return out


def whole_sets(texts: DataFrame, known, scratch: Scratch) -> DataFrame:
    """(key, s) of the texts (h, text) that the filter knows, each set once. Sets do not move for that: only the rows of
    those that came more than once are looked for."""
    sets = scratch.keep(texts.mapInArrow(_sets(known), "row long, key long, s array<long>"), "sets")
    firsts = sets.groupBy("key").agg(F.min("row").alias("first"), F.count("*").alias("times")).where("times > 1").select("key", "first")
    again = scratch.keep(sets.select("row", "key").join(firsts, "key").where("row <> first").select("row"), "again")
    return sets.join(again, "row", "left_anti").select("key", "s")


def verified(pairs: DataFrame, sets: DataFrame, scratch: Scratch) -> DataFrame:
    """The pairs (a, b) that link, by their whole sets, in passes by the first one, of about COMPARED shingles each."""
    mean = sets.agg(F.coalesce(F.avg(F.size("s")), F.lit(0.0))).first()[0]
    passes = max(1, int(pairs.count() * mean / COMPARED) + 1)
    out = None
    for k in range(passes):
        mine = lambda c: F.pmod(F.xxhash64(c), F.lit(passes)) == k
        near, first = (pairs.where(mine("a")), sets.where(mine("key"))) if passes > 1 else (pairs, sets)
        near = near.join(first.select(F.col("key").alias("a"), F.col("s").alias("sa")), "a")
        near = near.join(sets.select(F.col("key").alias("b"), F.col("s").alias("sb")), "b")
        both = F.size(F.array_intersect("sa", "sb"))
        done = scratch.keep(near.where(both * 100 >= (F.size("sa") + F.size("sb") - both) * 80).select("a", "b"), "near")
        out = done if out is None else out.union(done)
    return out


def compare_zones(members: DataFrame, sets: DataFrame, scratch: Scratch) -> DataFrame:
    """compare_block over all pairs of blocks of each zone whose sizes allow a link. members: zone, key, n, copies.

    A zone of more than one block is cut by size into bands, these by hash into blocks; blocks of one band and of
    neighbouring bands meet. Pairs of blocks are taken in passes by hash, of about COMPARED shingles each."""
    blocks = F.greatest(F.ceil(F.sum("n") / BLOCK), F.ceil(F.count("*") / BLOCK_SETS)).cast("long")
    members = attach(members, members.groupBy("zone").agg(blocks.alias("salts")), "zone")
    band = F.when(F.col("salts") > 1, F.floor(F.log("n") / float(np.log(BAND)))).otherwise(0).cast("long")
    members = scratch.keep(members.withColumn("band", band).withColumn("place", F.concat_ws(":", "zone", "band")).drop("salts"), "members")
    salts = scratch.keep(members.groupBy("place", "zone", "band").agg(blocks.alias("salts"), F.sum("n").alias("n")), "salts")
    for name, step in (("below", -1), ("above", 1)):
        beside = salts.select("zone", (F.col("band") - step).alias("band"), F.col("salts").alias(name))
        salts = salts.join(beside, ["zone", "band"], "left") 
    salts = scratch.keep(salts.na.fill(0, ["below", "above"]), "beside")
    many = salts.agg(F.coalesce(F.sum(F.col("n") * (F.col("salts") + F.col("below") + F.col("above"))), F.lit(0))).first()[0]
    passes = max(1, -(-many // COMPARED))
    at = lambda step, salt: F.shiftleft(F.col("band") + step, 32) + salt
    rows = attach(members, salts.select("place", "salts", "below", "above"), "place").join(sets, "key")
    rows = rows.withColumn("salt", at(0, F.pmod(F.xxhash64("key"), "salts")))
    rows = scratch.keep(rows.select("zone", "key", "s", "copies", "salt", "band", "salts", "below", "above"), "zoned")
    all_of = lambda step, c: F.when(F.col(c) > 0, F.transform(F.sequence(F.lit(0).cast("long"), F.col(c) - 1), lambda o: at(step, o))).otherwise(F.array().cast("array<long>"))
    others = F.concat(all_of(-1, "below"), all_of(0, "salts"), all_of(1, "above"))
    out = None
    for k in range(passes):
        due = lambda o: F.pmod(F.xxhash64("zone", F.least("salt", o), F.greatest("salt", o)), F.lit(passes)) == k
        part = rows.withColumn("other", F.explode(F.filter(others, due) if passes > 1 else others))
        part = part.select("zone", F.least("salt", "other").alias("one"), F.greatest("salt", "other").alias("two"), "key", "s", "copies", "salt")
        done = scratch.keep(part.groupBy("zone", "one", "two").applyInPandas(compare_block, "key long, other long, links long"), "dense")
        out = done if out is None else out.union(done)
    scratch.drop("members", "salts", "beside", "zoned")
    return out


def ngram_classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id_col, n_shingles, component_id, links_verified.

    Documents link when 100 * intersection >= 80 * union of their distinct 5-word shingles; component_id is the
    smallest id reachable by links, itself included. Equal sets link as one class. Null, empty and all-blank texts
    have the empty set and link with nothing; a text of one to four words is one shingle. Repeated rows share their
    class; a null id takes part like any other, and a class of null ids alone has a null component_id. Very long texts
    are read whole, ties of the order go by hash, other columns are not read, and an empty table gives an empty result.
    links_verified counts the other rows that a row links with, equal sets included.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark)
    kind = docs.schema[id_col].dataType.simpleString()
    own = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    log = sketch_slots(own.agg(F.sum(F.octet_length("text"))).first()[0] or 0)
    told = own.mapInArrow(_describe(log), f"id {kind}, n long, key long, sig binary, scan long, place int, at binary, times binary")
    told = scratch.keep(told, "shingles")
    rows = scratch.keep(told.where("n is not null").select("id", "n", "key", "scan"), "rows")
    levels = spark.sparkContext.broadcast(shingle_levels(told.where("place is not null").select("place", "at", "times"), log, scratch))
    spread = max(1, told.rdd.getNumPartitions())
    scratch.drop("shingles")
    sizes = rows.where(f"n between 4 and {BOUNDARY_MOST - 1}").groupBy("n").agg(F.approx_count_distinct("key"), F.sum("scan")).collect()
    boundary = choose_boundary([tuple(map(int, r)) for r in sizes], spread)
    kinds = rows.where("n > 0").groupBy("key").agg(F.max("n").alias("n"), F.count("*").alias("copies"), F.min("id").alias("low"))
    kinds = scratch.keep(kinds, "kinds")

    postings = scratch.keep(own.select("text").mapInArrow(_postings(levels, boundary), "h long, key long, n int, pos int"), "postings")
    measured = measure_lists(postings, scratch)
    scratch.drop("postings")
    same = measured.where(F.col("length") > SHORT).select(F.col("key").alias("a"), F.col("low").alias("b")).distinct()
    zones = components(scratch, same).select(F.col("id").alias("key"), F.col("component").alias("zone"))

    # Pairs of short lists, but for those of one zone.
    placed = measured.where(F.col("length") <= SHORT).join(zones, "key", "left").select("h", "key", "n", "pos", "length", "zone")
    pairs = pairs_of(scratch.keep(placed, "placed"), scratch)
    scratch.drop("measured", "placed")

    # The whole sets of all that are compared, from the text of one document each.
    wanted = pairs.select(F.explode(F.array("a", "b")).alias("key")).union(zones.select("key")).distinct()
    first = scratch.keep(kinds.join(wanted, "key", "left_semi").select(F.xxhash64("low").alias("h")), "wanted")
    known = spark.sparkContext.broadcast(_bitmap(first, first.count()))
    texts = own.select(F.xxhash64("id").alias("h"), "text")
    sets = whole_sets(texts, known, scratch)
    near = verified(pairs, sets, scratch)
    scratch.drop("pairs")
    dense = compare_zones(zones.join(kinds, "key").select("zone", "key", "n", "copies"), sets, scratch)
    scratch.drop("sets", "again")

    edges = near.union(dense.where("other is not null").select("key", "other"))
    found = components(scratch, edges).withColumnRenamed("id", "key")
    ends = near.select(F.col("a").alias("key"), F.col("b").alias("other")).union(near.select("b", "a"))
    ends = ends.join(kinds.select(F.col("key").alias("other"), F.col("copies").alias("links")), "other").select("key", "links")
    ends = ends.union(dense.where("other is null").select("key", "links")).groupBy("key").agg(F.sum("links").alias("links"))
    classes = kinds.join(found, "key", "left").join(ends, "key", "left")
    classes = classes.select("key", F.coalesce("component", "key").alias("component"), "low", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("links_verified"))
    lowest = classes.groupBy("component").agg(F.min("low").alias("component_id"))
    classes = scratch.keep(attach(classes, lowest, "component").select("key", "component_id", "links_verified"), "classes")
    out = attach(rows.where("n > 0"), classes, "key").select("id", "n", "component_id", "links_verified")
    out = out.union(rows.where("n = 0").select("id", "n", "id", F.lit(0).cast("long")))
    out = scratch.keep(out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), "component_id", F.col("links_verified").cast("long")), "result")
    total = rows.count()
    scratch.drop(but="result")
    if out.count() != total:
        raise RuntimeError("two different sets have one 64-bit key")
    return out


def op7_ngram_jaccard(spark, sf_dir):
    """All whole texts of documents."""
    return ngram_classes(load(spark, sf_dir, "documents"))


def stage(spark, docs, sf_dir):
    """Pipeline: of each class the document of the smallest id stays."""
    kept = ngram_classes(docs).where(F.col("doc_id").eqNullSafe(F.col("component_id"))).select("doc_id").distinct()
    return docs.join(kept, docs["doc_id"].eqNullSafe(kept["doc_id"]), "left_semi").select(*docs.columns)
