from pyspark.sql import functions as F

import numpy as np

from inkwell.functions import scalars as S
from inkwell.operators import evidence, layout, lookups
from inkwell.sources import files
from inkwell.streaming import trace


def test_files_have_a_status(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(files, "MOST_BYTES", 100)
    for name, data in (("a.pdf", b"%PDF-1.7 x"), ("b.html", b" <!DOCTYPE html><p>x</p>"), ("c.bin", b"x" * 101)):
        (tmp_path / name).write_bytes(data)
    got = {r["path"][-5:]: (r["status"], r["is_pdf"], r["is_html"]) for r in files.read_documents(spark, str(tmp_path)).collect()}
    assert got["a.pdf"] == ("ok", True, False) and got[".html"[-5:]][0] == "ok" and got["c.bin"][0] == "too large"


def test_windows_close_behind_the_watermark(spark, sf, tmp_path):
    e = spark.read.parquet(f"{sf}/events.parquet").select("ts", "event_type")
    e.orderBy("ts").coalesce(1).write.parquet(str(tmp_path / "in"))
    s = trace.windowed_counts(trace.read_events(spark, str(tmp_path / "in"), e.schema), "ts", "event_type")
    q = s.writeStream.format("memory").queryName("windows").outputMode("complete").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert sorted(map(tuple, spark.table("windows").collect())) == sorted(map(tuple, trace.windowed_counts(e, "ts", "event_type").collect()))


def test_mentions_prefer_the_longest_name(spark):
    lex = evidence.lexicon_rows(spark)
    df = spark.createDataFrame([(1, "We use CIFAR-10, MS COCO and COCO; also Hotpot QA, gsm-8k and wikitext 103."), (2, None), (3, "cifar 1000")], "doc_id long, text string")
    got = {(r["doc_id"], r["name"]): r["n"] for r in evidence.mentions(df, lex, ["doc_id"]).collect()}
    assert got == {(1, "CIFAR-10"): 1, (1, "COCO"): 2, (1, "HotpotQA"): 1, (1, "GSM8K"): 1, (1, "WikiText-103"): 1}


def test_aligned_spans_of_empty_and_absent_answers(spark):
    rows = [("b c", "a b  c"), ("B  C", "a bc"), ("zz", "a"), ("", "abc"), (None, "abc")]
    df = spark.createDataFrame(rows, "a string, c string")
    assert [r[0] for r in df.select(S.align_span(F.col("a"), F.col("c"))).collect()] == [2, 2, -1, 0, -1]


def test_layered_tables_and_deletes(spark):
    base = spark.createDataFrame([("a", "1"), ("b", "2")], "key string, value string")
    changes = spark.createDataFrame([("a", "3", 1), ("a", None, 2), ("c", "4", 1)], "key string, value string, at int")
    now = lookups.kv_put(base, changes)
    assert sorted(map(tuple, now.collect())) == [("b", "2"), ("c", "4")]
    assert sorted(map(tuple, lookups.layered(now, base).collect())) == [("a", "1"), ("b", "2"), ("c", "4")]


def test_table_residue(spark):
    rows = [(1, 0, i, t) for i, t in enumerate(["Plain words stand in this line of the text.", "12 4.5 7", "ab", "3 4", "More plain words in a line here."])]
    df = spark.createDataFrame(rows, "doc long, page long, line long, text string")
    assert sorted(r["line"] for r in layout.table_residue(df).collect()) == [1, 2, 3]


def test_link_pages_against_all_pairs(spark):
    """Links of any length, empty, repeated, cut by others and beyond ASCII; null keys and texts meet nothing."""
    pages = [(d, p, t) for d in (1, 2) for p, t in enumerate(["see https://a.b/ab and aab", "https://a.b/abc", None, "é€é http://ü.x/é", "", "x" * 50])] + [(None, 7, "https://a.b/ab")]
    links = [(d, u) for d in (1, 2, 3, None) for u in ("https://a.b/ab", "https://a.b/abc", "a", "aab", "é", "http://ü.x/é", "", "none", "x" * 49, None)] + [(1, "a")]
    got = evidence.link_pages(spark.createDataFrame(links, "doc long, url string"), spark.createDataFrame(pages, "doc long, page long, text string"))
    assert "contains(" not in got._jdf.queryExecution().toString().lower()  # no page meets a link that it may not hold
    want = {}
    for d, u in set(links):
        met = [p for e, p, t in pages if d is not None and e == d and t is not None and u is not None and u in t]
        want |= {(d, u): min(met)} if met else {}
    rows = got.collect()
    assert {(r["doc"], r["url"]): r["page"] for r in rows} == want and len(rows) == len(want)


def test_window_hashes():
    """Equal windows have one hash wherever they stand, far from the start too, and others have others."""
    raw = bytes(range(256)) * 3
    h = evidence._Windows(raw).at(np.arange(700), 8)
    assert (h[:256] == h[256:512]).all() and len(set(h.tolist())) == 256
