"""Nulls, repeated rows, very long texts, ties and clashing names, one small case an operator."""

import hashlib

import numpy as np
import public_tokenizers
from pyspark.sql import functions as F

from inkwell.llm import ctw, language, packing, quality, vector_graph, warc
from inkwell.llm.ngram_join import ngram_classes
from inkwell.session import scratch_path

LONG = " ".join(f"word{i} of a very long text" for i in range(30_000))


def test_quality_of_long_null_and_tied_rows(spark):
    rows = [(1, LONG, "en", "a"), (None, "plain words stand here.", "en", "a"), (None, None, None, None)] + [(i, "same words in all of these rows.", "en", "b") for i in range(10, 40)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(10, 40)], "doc_id long, quality int")
    assert quality.score_quality(df, labels).count() == len(rows)
    x = spark.createDataFrame([(7, [float(i % 3)], 1.0) for i in range(9)] + [(8, [9.0], 0.0)], "h long, x array<double>, y double")
    assert [r["x"] for r in quality.sample_of(x, 5).collect()] == [[0.0], [0.0], [0.0], [1.0], [1.0]]


def test_sample_reads_few_rows_and_is_whole_below_its_size(spark):
    x = spark.range(20_000).select(F.xxhash64("id").alias("h"), F.array(F.col("id").cast("double")).alias("x"), F.lit(1.0).alias("y"))
    small, all_ = quality.sample_of(x, 100).collect(), sorted(r["h"] for r in x.select("h").collect())
    assert sorted(r["h"] for r in small) == all_[:100]
    assert quality.sample_of(x, 50_000).count() == 20_000


def test_equal_cosines_go_to_the_first_name(spark):
    rows = [(i, "abc def abc def", lang) for i, lang in enumerate(["zz", "aa", "mm"] * 6)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    assert {r["lang_pred"] for r in language.language_id(df).collect()} == {"aa"}


def test_packing_of_repeated_and_null_ids(spark):
    rows = [(5, "some text"), (5, "some text"), (None, "other text"), (None, None), (7, LONG)]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as key", "'x' as ids", "2 as n")
    out = packing.curve_pack(df, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken")).collect()
    by = {}
    for r in out:
        by.setdefault(r["doc_id"], []).append(r)
    assert sum(r["length"] for r in by[5]) == 2 * by[5][0]["doc_tokens"] and sum(r["length"] for r in by[7]) == by[7][0]["doc_tokens"]
    assert {r["doc_tokens"] for r in by[None]} == {1, by[5][0]["doc_tokens"]} or len({r["doc_tokens"] for r in by[None]}) == 2
    used = {}
    for r in out:
        used.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in used.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 1024 and at & (at - 1) == 0


def test_vectors_with_repeated_and_null_ids(spark):
    v, w = [1.0, 0.0, -0.0], [0.0, 1.0, 0.0]
    rows = [(3, v), (3, v), (None, [1.0, 0.0, 0.0]), (9, w), (4, [0.999, 0.01, 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").selectExpr("*", "1 as copies", "2 as shards", "3 as low", "4 as other")
    got = sorted((r["vec_id"] or 0, r["n_links"], r["component_id"]) for r in vector_graph.near_vectors(df).collect())
    assert got == [(0, 3, 3), (3, 3, 3), (3, 3, 3), (4, 3, 3), (9, 0, 9)]


def test_shards_that_centres_cannot_divide_are_dealt_by_hash(spark, monkeypatch):
    for name, value in (("SHARD", 40), ("SHARD_MOST", 60), ("SPLIT_STEP", 100)):
        monkeypatch.setattr(vector_graph, name, value)
    rng = np.random.default_rng(1)
    rows = [(i, (np.ones(8) + rng.normal(size=8) * 1e-7).tolist()) for i in range(400)]
    got = vector_graph.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(2)).collect()
    assert {(r["n_links"], r["component_id"]) for r in got} == {(399, 0)}


def test_shingles_of_null_ids_and_long_texts(spark):
    rows = [(1, LONG), (2, LONG + " and a bit"), (None, LONG), (None, "a b c d e f g"), (None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as h", "2 as zone")
    got = sorted((r["doc_id"] or 0, r["component_id"] or 0, r["links_verified"]) for r in ngram_classes(df).collect())
    assert got == [(0, 0, 0), (0, 0, 0), (0, 1, 2), (1, 1, 2), (2, 1, 2)]


def test_scores_of_null_and_repeated_rows(spark):
    rows = [(1, "one two"), (1, "one two"), (None, "one"), (None, None), (2, LONG[:200_000])]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as chunk", "2 as key")
    got = sorted((r["doc_id"] or 0, r["n_tokens"], round(r["base_score"], 6)) for r in ctw.ctw_score(df, F.col("doc_id").isNotNull()).collect())
    assert [g[:2] for g in got] == [(0, 1), (0, 2), (1, 3), (1, 3), (2, len(LONG[:200_000].split()) + 1)] and got[2] == got[3]


def test_records_of_clashing_columns_odd_urls_and_hot_payloads(spark):
    big = "x" * 2000
    rows = [(i, f"http://h/ä b\r\nInjected: {i}", big) for i in range(700)] + [(1000, None, ""), (None, "u", "y" * 1500)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "1 as payload_bytes", "'z' as record_type", "2 as id", "3 as head").repartition(4)
    out = warc.warc_round_trip(df, scratch_path(spark, "w")).collect()
    assert len(out) == 702 and sum(r["record_type"] == "revisit" for r in out) == 699
    first = next(r for r in out if r["record_type"] == "response" and r["payload_bytes"] == 2000)
    assert first["record_id"].endswith("#699") and first["payload_digest"] == hashlib.sha1(big.encode()).hexdigest() and first["url"] == "http://h/%C3%A4%20b%0D%0AInjected:%20699"
