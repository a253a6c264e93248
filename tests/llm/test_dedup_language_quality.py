import hashlib
import random
import zlib

import numpy as np
from pyspark.sql import functions as F

from inkwell.llm import exact_dedup as d
from inkwell.llm.language import language_id, op3_language_id
from inkwell.llm.quality import op1_quality_classifier, score_quality


def low(t):
    return (t or "").translate({c: c + 32 for c in range(65, 91)})


def test_exact_dedup_edges(spark):
    rows = [(1, "A b"), (2, "a B"), (3, None), (4, ""), (5, "É"), (6, "é"), (7, "x" * 100_000), (7, "x" * 100_000), (None, "a b")]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as id", "'z' as sha", "true as kept").repartition(4)
    got = sorted((r["doc_id"] or 0, r["keep_id"], r["group_size"], r["kept"], r["text_sha256"]) for r in d.exact_dedup(df).collect())
    want = []
    for i, t in rows:
        same = [j for j, u in rows if low(u) == low(t)]
        best = max(j for j in same if j is not None)
        want.append((i or 0, best, len(same), i == best, hashlib.sha256(low(t).encode()).hexdigest()))
    assert got == sorted(want)
    assert d.exact_dedup(df.limit(0)).count() == 0


def test_bitmap_finds_every_repeat(spark):
    rng = random.Random(2)
    values = [rng.randrange(-(1 << 63), 1 << 63) for _ in range(3000)]
    twice = values[:500]
    df = spark.createDataFrame([(v,) for v in values + twice], "h long").repartition(7)
    bits = np.frombuffer(d.repeated_slots(df, 17, fan_in=2), np.uint8)
    hit = np.ones(len(values), bool)
    for s in d.slots_of(np.array(values), 17):
        hit &= (bits[s >> 3] & (128 >> (s & 7))) > 0
    assert hit[:500].all() and hit[500:].mean() < 0.1


def test_language_held_out_accuracy(spark, sf):
    lang = {r["doc_id"]: (r["lang"], r["text"]) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = op3_language_id(spark, sf).collect()
    assert len(rows) == len(lang)
    held = [r for r in rows if r["held_out"]]
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in rows)
    assert np.mean([r["lang_pred"] == lang[r["doc_id"]][0] for r in held]) > 0.97
    assert all(0 <= r["score"] <= 1 for r in rows)


def test_language_edges(spark):
    rows = [(i, "the cat and the dog are here " * 3, "en") for i in range(8)] + [(10 + i, "der hund und die katze sind hier " * 3, "de") for i in range(8)]
    rows += [(30, None, "en"), (31, "", None), (32, "123 !!", "de"), (33, "the dog" * 4000, None), (33, "the dog", None), (None, "die katze", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").selectExpr("*", "'x' as lang_pred", "0.1 as score")
    got = [(r["doc_id"], r["lang_pred"], r["score"]) for r in language_id(df).collect()]
    told = {i: p for i, p, _ in got}
    assert (told[30], told[31], told[32], told[33], told[None]) == ("und", "und", "und", "en", "de")
    assert len(got) == len(rows) and language_id(df.limit(0)).count() == 0
    unlabelled = df.withColumn("lang", F.lit(None).cast("string"))
    assert {r["lang_pred"] for r in language_id(unlabelled).collect()} == {"und"}


def test_quality_separates_labels(spark, sf):
    rows = {r["doc_id"]: r for r in op1_quality_classifier(spark, sf).collect()}
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    assert np.mean([rows[i]["keep"] == (q == 1) for i, q in labels.items()]) > 0.95
    assert all(0 <= r["path_posterior"] <= 1 for r in rows.values())


def test_quality_shrinks_and_edges(spark):
    good, bad = "a plain sentence about many things. " * 5, "### $$$ !! ### $$$ !! " * 5
    docs = [(i, good, "en", "big") for i in range(60)] + [(100 + i, bad, "en", "junk") for i in range(40)] + [(200, good, "en", "tiny"), (201, None, None, None), (201, None, None, None)]
    df = spark.createDataFrame(docs, "doc_id long, text string, lang string, source string").selectExpr("*", "1 as id", "2 as host", "3 as p")
    labels = spark.createDataFrame([(i, 1) for i in range(30)] + [(100 + i, 0) for i in range(20)] + [(5, None), (7, 1)], "doc_id long, quality int")
    got = {r["doc_id"]: r for r in score_quality(df, labels).collect()}
    assert got[0]["host_posterior"] > got[200]["host_posterior"] > got[100]["host_posterior"]
    assert got[0]["keep"] and not got[100]["keep"] and got[200]["keep"] and 201 in got
    none = score_quality(df, labels.limit(0)).collect()
    assert len(none) == len(docs) and all(r["keep"] and r["doc_score"] == 0.5 for r in none)
    assert score_quality(df.limit(0), labels).count() == 0
