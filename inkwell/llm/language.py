"""Language identification with hyperdimensional profiles.

Every letter has a random bipolar vector. A trigram's vector binds its letters' vectors, each permuted by its place
(product of rolled vectors); a document's vector bundles (sums) those of its trigrams, and a language's prototype
bundles those of its documents. A document goes to the prototype with the largest cosine.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from inkwell.llm.bpe import C_LETTER, batched, class_table
from inkwell.session import load

#: Dimensions of a vector; letters share so many random vectors by a hash of their code point, 0 being a word's edge.
DIM, LETTERS, SEED = 1024, 4096, 7
#: Sharpness of the score among languages. Cosines of unrelated bundles spread by 1 / sqrt(DIM); below two and a half of
#: these a text is like no language in the pipeline. Of the clean documents of the test tables none has less than 0.14.
TEMPERATURE, LEAST_COSINE = 0.05, 2.5 / DIM**0.5


@lru_cache(1)
def letter_vectors() -> tuple[np.ndarray, ...]:
    """The letters' vectors, rolled by 2, 1 and 0 places."""
    base = np.random.Generator(np.random.PCG64(SEED)).integers(0, 2, (LETTERS, DIM), np.int8) * 2 - 1
    return tuple(np.roll(base, k, axis=1).astype(np.int8) for k in (2, 1, 0))


def gram_vectors(grams: np.ndarray) -> np.ndarray:
    a, b, c = letter_vectors()
    return (a[grams >> 24] * b[(grams >> 12) & 4095] * c[grams & 4095]).astype(np.float32)


@lru_cache(1)
def letter_ids() -> np.ndarray:
    """Vector number of each code point; 0 for all that are no letters."""
    cp = np.arange(0x110001, dtype=np.uint64)
    ids = ((cp * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33)) % np.uint64(LETTERS - 1) + np.uint64(1)
    return np.where(class_table() == C_LETTER, ids, 0).astype(np.int64)


def gram_counts(texts: list[str], owner: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """owner, trigram, count of the letter trigrams of lower-cased texts. A run of other characters is one word edge;
    trigrams across an edge do not count."""
    lowered = [t.lower() for t in texts]
    joined = "\n".join(lowered)
    ids = letter_ids()[np.frombuffer(("\n" + joined + "\n").encode("utf-32-le"), np.uint32)]
    who = np.repeat(owner, [len(t) + 1 for t in lowered])
    who = np.concatenate([who[:1], who])
    keep = np.ones(len(ids), bool)
    keep[1:] = (ids[1:] > 0) | (ids[:-1] > 0)
    ids, who = ids[keep], who[keep]
    inner = ids[1:-1] > 0
    keys = ((who[1:-1] << 36) | (ids[:-2] << 24) | (ids[1:-1] << 12) | ids[2:])[inner]
    keys, n = np.unique(keys, return_counts=True)
    return keys >> 36, keys & ((1 << 36) - 1), n


def bundle(owner: np.ndarray, grams: np.ndarray, n: np.ndarray, owners: int) -> np.ndarray:
    """Sum of trigram vectors by owner; 32 owners and a slice of the trigrams at a time."""
    out = np.zeros((owners, DIM), np.float64)
    for first in range(0, owners, 32):
        lo, hi = np.searchsorted(owner, [first, first + 32])
        kinds, at = np.unique(grams[lo:hi], return_inverse=True)
        for part in range(0, len(kinds), 8192):
            here = (at >= part) & (at < part + 8192)
            counts = np.zeros((min(32, owners - first), min(8192, len(kinds) - part)), np.float32)
            counts[owner[lo:hi][here] - first, at[here] - part] = n[lo:hi][here]
            out[first : first + 32] += counts @ gram_vectors(kinds[part : part + 8192])
    return out


def train_prototypes(labelled: DataFrame) -> tuple[list[str], np.ndarray]:
    """Languages and their unit-length prototypes, from (text, lang) rows. Sums are of whole numbers, so neither the
    order of rows nor their partitions change them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names: dict[str, int] = {}
        total = np.zeros((0, DIM))
        for b in batches:
            lang = np.array([names.setdefault(x, len(names)) for x in b.column(1).to_pylist()], np.int64)
            total = np.vstack([total, np.zeros((len(names) - len(total), DIM))])
            texts, first = [t or "" for t in b.column(0).to_pylist()], 0
            for group in batched(texts):
                total += bundle(*gram_counts(group, lang[first : first + len(group)]), len(names))
                first += len(group)
        yield pa.RecordBatch.from_pydict({"lang": pa.array(list(names), pa.string()), "v": pa.array([np.rint(x).astype(np.int64) for x in total], pa.list_(pa.int64()))})

    parts = labelled.select("text", "lang").mapInArrow(run, "lang string, v array<long>")
    summed = parts.select("lang", F.posexplode("v").alias("pos", "x")).groupBy("lang", "pos").agg(F.sum("x").alias("x"))
    rows = summed.groupBy("lang").agg(F.array_sort(F.collect_list(F.struct("pos", "x"))).alias("v")).orderBy("lang").collect()
    names = [r["lang"] for r in rows]
    out = np.array([[x["x"] for x in r["v"]] for r in rows], np.float64).reshape(-1, DIM)
    norm = np.linalg.norm(out, axis=1, keepdims=True)
    return names, out / np.where(norm > 0, norm, 1)


def identify(docs: DataFrame, names: list[str], prototypes: np.ndarray, text_col: str = "text") -> DataFrame:
    """docs with lang_pred, score and cosine. See language_id for cases."""
    told = docs.sparkSession.sparkContext.broadcast(prototypes.astype(np.float32))
    at = docs.columns.index(text_col)
    schema = StructType(list(docs.schema.fields)).add("lang_pred", "string").add("score", "double").add("cosine", "double")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = told.value
        for b in batches:
            pred, score, cosine = [], [], []
            for group in batched([t or "" for t in b.column(at).to_pylist()]):
                v = bundle(*gram_counts(group, np.arange(len(group))), len(group))
                norm = np.linalg.norm(v, axis=1)
                c = (v @ model.T) / np.where(norm > 0, norm, 1)[:, None]
                for own, n, text in zip(c, norm, group, strict=True):
                    if n == 0 or not len(names):
                        lone = any(map(str.isalpha, text)) and len(names)
                        pred.append(names[0] if lone else "und")
                        score.append(1 / len(names) if lone else 0.0)
                        cosine.append(0.0)
                        continue
                    k = int(np.argmax(own))
                    e = np.exp((own - own[k]) / TEMPERATURE)
                    pred.append(names[k])
                    score.append(float(1 / e.sum()))
                    cosine.append(float(own[k]))
            cols = [*b.columns, pa.array(pred, pa.string()), pa.array(score, pa.float64()), pa.array(cosine, pa.float64())]
            yield pa.RecordBatch.from_arrays(cols, names=[f.name for f in schema])

    return docs.mapInArrow(run, schema)


def held_out(id_col: str, mod: int, rest: int):
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % mod == rest, F.lit(False))


def language_id(docs: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """id_col, held_out, lang_pred, score, cosine of every whole text.

    Learns from the text and lang of documents with a lang whose crc32(id) mod 4 is not 2. Null texts and those
    without letters are `und` with score 0, and so is everything where no document has a lang. Letters that all
    cancel out, which needs an empty bundle, go to the first language, and so do ties of the cosine: languages stand by name. Score is the softmax of cosines. Repeated rows
    are each answered; other columns are not read; very long texts are counted whole; an empty table gives an empty
    result.
    """
    own = docs.select(F.col(id_col), held_out(id_col, 4, 2).alias("held_out"), "text", "lang")
    names, prototypes = train_prototypes(own.where("lang is not null and not held_out"))
    return identify(own.drop("lang"), names, prototypes).drop("text")


def op3_language_id(spark, sf_dir):
    """All whole texts of documents."""
    return language_id(load(spark, sf_dir, "documents"))


def stage(spark, docs, sf_dir):
    """Pipeline: documents in no known language go: those without letters, or less like any prototype than LEAST_COSINE. It
    decides by row, so repeated and null ids are no matter."""
    own = docs.withColumn("inkwell_held", held_out("doc_id", 4, 2))
    names, prototypes = train_prototypes(own.where("lang is not null and not inkwell_held"))
    told = identify(docs, names, prototypes)
    return told.where((F.col("lang_pred") != "und") & (F.col("cosine") >= LEAST_COSINE)).select(*docs.columns)
