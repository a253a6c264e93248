import math

import duckdb
import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from inkwell.functions import text as T
from inkwell.operators import mining, quantities, review, sequence, structure, summarize, zoning
from inkwell.plans.graph import END, StateGraph


def one(spark, *cols):
    return spark.range(1).select(*cols).first()


def test_sentences():
    text = "We follow Smith et al. (2020) and use Fig. 2 for this. It works well, e.g. on small sets of data. Is it fast enough for us? Yes, it certainly is quite fast.\n\n• A bullet with a long enough text.\nShort."
    got = T.split_sentences(text)
    assert got[0].endswith("for this.") and got[1].startswith("It works") and len(got) == 5 and got[4] == "A bullet with a long enough text."
    assert T.split_sentences(None) == [] and T.split_sentences("tiny.") == []


@pytest.mark.parametrize(
    ("word", "want"),
    [w.split(":") for w in "caresses:caress ponies:poni cats:cat agreed:agre plastered:plaster motoring:motor conflated:conflat troubled:troubl hopping:hop falling:fall filing:file happy:happi sky:sky relational:relat conditional:condit triplicate:triplic formalize:formal hopefulness:hope revival:reviv adoption:adopt roll:roll probate:probat cease:ceas generalizations:gener oscillators:oscil feed:feed sing:sing".split()],
)
def test_stem_gives_the_published_examples(word, want):
    assert T.stem(word) == want


@settings(max_examples=200, deadline=None)
@given(st.text("abcdefghijklmnopqrstuvwxyz", max_size=12))
def test_stem_never_grows_a_word(word):
    assert len(T.stem(word)) <= len(word) and T.stem(word)[:1] == word[:1]


def test_sentence_rules():
    got = T.split_sentences("1. The first item is here and long enough. Dr. Smith of the U.S. Navy went there. J. Doe met him in the U.S. The end was near for all of us.")
    assert got == ["The first item is here and long enough.", "Dr. Smith of the U.S. Navy went there.", "J. Doe met him in the U.S.", "The end was near for all of us."]
    assert T.split_sentences("It ends with a footnote mark.12 Another sentence follows it.") == ["It ends with a footnote mark.12", "Another sentence follows it."]


def test_scalars(spark):
    r = one(spark, T.syllables(F.lit("sample")).alias("a"), T.syllables(F.lit("used")).alias("b"), T.truncate(F.lit("word " * 40), 50).alias("c"), T.compact_count(F.lit(1234)).alias("d"), T.rounded(F.lit(-2.5), 0).alias("e"), T.strip_citations(F.lit("As shown [1, 2] before (Doe et al., 2020), it works.")).alias("f"), T.word_count(F.lit("  ")).alias("g"))
    assert (r["a"], r["b"], r["d"], r["e"], r["f"], r["g"]) == (2, 1, "1.2k", -2, "As shown before, it works.", 0) and len(r["c"]) <= 50


def test_quantities():
    got = quantities.extract_metrics
    assert [(m["value"], m["unit"], m["direction"]) for m in got("Accuracy improves by 4.1% over the baseline.")] == [(4.1, "%", "up")]
    assert [(m["value"], m["metric"]) for m in got("Our model reaches 28.4 BLEU on this task.")] == [(28.4, "BLEU")]
    two = got("Perplexity drops from 5.68 to 5.12 in this setup.")
    assert [(m["value"], m["metric"]) for m in two] == [(5.68, "perplexity"), (5.12, "perplexity")]
    assert got("GPT-4 and a 4-bit setup of 2020 in Table 3 [12] are used by 3 people.") == []
    assert [(m["value"], m["unit"]) for m in got("It needs 2.6x less memory and 85.3 ± 0.4 % recall.")][0] == (2.6, "x")


def test_zoning(spark):
    rows = [(1, "a", "introduction", 0, "However, existing methods suffer from high cost."), (1, "a", "introduction", 1, "We propose a novel method for this."), (1, "a", "introduction", 2, "Our main contributions are as follows:"), (1, "a", "introduction", 3, "Some plain words stand in this list item."), (1, "b", "results", 0, "Our method outperforms all baselines by 4.1 points."), (1, "c", "conclusion", 0, "In future work, we plan to extend this.")]
    df = spark.createDataFrame(rows, "doc_id long, section_id string, section_kind string, index long, text string")
    z = {(r["section_id"], r["index"]): r for r in zoning.zone_sentences(df).collect()}
    assert [z[k]["zone"] for k in (("a", 0), ("a", 1), ("a", 3), ("b", 0), ("c", 0))] == ["problem", "contribution", "contribution", "result", "future"]
    assert all(math.isclose(sum(r["scores"].values()), 1) for r in z.values())


def test_review(spark):
    rows = [(1, "Results", i, t, "result") for i, t in enumerate(["Accuracy on GSM8K is 90 with standard deviation 0.2 over random seeds.", "An ablation shows it.", "We ablate more.", "Another ablation study.", "Our method outperforms the baseline."])] + [(1, "Limitations", 9, "We do not test more.", "limitation"), (2, "Results", 0, "We outperform state-of-the-art.", "result"), (2, "Method", 1, "We train it.", "method"), (2, "Results", 2, "Accuracy is better on MMLU.", "result"), (2, "Results", 3, "Results are good.", "result")]
    s = review.signals(spark.createDataFrame(rows, "doc_id long, section_title string, index long, text string, zone string"))
    found = {(r["doc_id"], r["id"]): r["severity"] for r in review.findings(s).collect()}
    assert found[1, "ablations"] == "strength" and found[2, "no-variance"] == "major" and (1, "no-variance") not in found and found[2, "no-limitations"] == "moderate"
    overall = {r["doc_id"]: r["overall"] for r in review.rigor(s).collect()}
    assert overall[1] > overall[2]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 400), max_size=40), st.integers(0, 3))
def test_windows(lengths, overlap):
    w = sequence.windows_of(lengths, overlap=overlap)
    assert {i for a, b in w for i in range(a, b)} == set(range(len(lengths)))
    assert all(a2 > a1 for (a1, _), (a2, _) in zip(w, w[1:], strict=False))


@settings(max_examples=40, deadline=None)
@given(st.integers(2, 9), st.integers(0, 1000))
def test_ranking_and_clusters(n, seed):
    x = np.random.default_rng(seed).normal(size=(n, 4))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    p = summarize.lex_rank(x @ x.T)
    assert p.sum() == pytest.approx(1) and (p > 0).all()
    picks = summarize.mmr(p, x @ x.T, 3)
    assert len(set(picks)) == min(3, n) and picks[0] == int(np.argmax(p))
    labels, s = mining.choose_clusters(x @ x.T)
    assert -1 <= s <= 1 and labels[0] == 0 and len(labels) == n


def test_planted_clusters():
    at = np.array([0, 0.1, 0.2, 5, 5.1, 5.2, 9, 9.1])
    labels, _ = mining.choose_clusters(1 - np.abs(at[:, None] - at[None, :]) / 10)
    assert labels.tolist() == [0, 0, 0, 1, 1, 1, 2, 2]
    assert summarize.lex_rank(np.eye(3)).tolist() == pytest.approx([1 / 3] * 3)


def test_structure(spark):
    rows = []
    for page in range(4):
        rows.append((1, page, f"Journal {page}", 50.0, 20.0, 80.0, 10.0, False))
        for i in range(14):
            rows.append((1, page, f"left words {i} of a col-", 50.0, 60.0 + 14 * i, 230.0, 10.0, False))
            rows.append((1, page, f"umn right {i}", 320.0, 60.0 + 14 * i, 200.0, 10.0, False))
    rows += [(1, 0, "1 Introduction", 50.0, 45.0, 120.0, 14.0, True)]
    g = spark.createDataFrame(rows, "doc long, page long, text string, x double, y double, width double, size double, bold boolean")
    lines = structure.lines_of(g).cache()
    first = [r["text"] for r in lines.where("page = 1").orderBy("line").collect()]
    assert first[:3] == ["Journal 1", "left words 0 of a col-", "left words 1 of a col-"] and first[-1] == "umn right 13"
    assert structure.furniture(lines).count() == 4
    h = structure.headings(lines).collect()
    assert [(r["number"], r["title"], r["level"]) for r in h] == [("1", "Introduction", 1)]
    assert {r["kind"] for r in structure.sections(lines).collect()} >= {"introduction"}
    refs = spark.createDataFrame([(1, "[1] J. Doe and A. Roe. A title of work. In Proc, 2019. arXiv:1901.00001 [2] B. Poe. “Another long title,” J. 2020. doi:10.1000/xyz.")], "doc long, text string")
    got = structure.parse_references(structure.reference_entries(refs)).orderBy("position").collect()
    assert [(r["year"], r["arxiv"], r["doi"], r["title"]) for r in got] == [(2019, "1901.00001", None, "A title of work"), (2020, None, "10.1000/xyz", "Another long title")]


def test_graph():
    seen, tries = [], iter([ValueError(), None])

    def flaky(s):
        if e := next(tries):
            raise e
        return {"x": s["x"] + 1}

    g = StateGraph().add_node("a", flaky, retries=1).add_node("b", lambda s: {"y": 1}).add_conditional("a", lambda s: "b" if s["x"] == 1 else END, ("b", END)).add_edge("b", END).compile("a")
    assert g.run({"x": 0}, seen.append, sleep=lambda s: None) == {"x": 1, "y": 1}
    assert [e["type"] for e in seen] == ["start", "retry", "end", "start", "end"]
    with pytest.raises(ValueError):
        StateGraph().add_node("a", flaky).compile("a")


def test_stream_equals_batch(spark, sf, tmp_path):
    from inkwell.operators.sequence import fold_trace
    from inkwell.streaming import trace

    e = spark.read.parquet(f"{sf}/events.parquet")
    e.repartition(3).write.parquet(str(tmp_path / "in"))
    args = (["user_id"], "ts", "event_type", "view", "error")
    s = trace.stream_fold(trace.read_events(spark, str(tmp_path / "in"), e.schema), *args)
    q = s.writeStream.format("memory").queryName("fold").outputMode("complete").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert sorted(map(tuple, spark.table("fold").collect())) == sorted(map(tuple, fold_trace(e, *args).collect()))


def test_flesch_rounds_halves_like_decimals(spark):
    """80 words of 158 syllables score 19.45 less a rounding error of doubles, which the constants must not turn upwards."""
    df = spark.createDataFrame([(80, 158), (10, 15), (1, 1)], "words int, syllables int")
    x = F.col("syllables").cast("long") / F.col("words").cast("long")
    got = [r[0] for r in df.select(T.rounded(T.flesch(F.lit(20), x), 1)).collect()]
    want = [duckdb.sql(f"SELECT floor((206.835 - 1.015 * 20 - 84.6 * ({s} / {n})) * 10 + 0.5) / 10").fetchall()[0][0] for n, s in ((80, 158), (10, 15), (1, 1))]
    assert got == want and got[0] == 19.4


def test_keyphrases_of_generic_words(spark):
    """A text of words that are no phrase by themselves has no phrases, and is no error."""
    assert summarize.phrases_of("Data. Results and methods.") == []
    df = spark.createDataFrame([(1, "data"), (2, "Sparse attention caches."), (3, None)], "doc_id long, text string")
    assert {r["doc_id"] for r in summarize.keyphrases(df).collect()} == {2}


def test_keyphrases_look_at_each_word_once(monkeypatch):
    """A word that returns is stemmed once, and phrases are compared with those of the pool that share a stem only."""
    import random

    from inkwell.operators import summarize

    rng, calls, real = random.Random(3), [], summarize.stem
    words = [f"{a}{b}{c}" for a in ("bor", "lim", "tas", "Ker") for b in ("u", "o") for c in ("ndal", "mist", "grek", "pols", "vint")]
    text = ". ".join(" ".join(rng.choices([*words, "the", "of", "data", "NASA"], k=12)) for _ in range(150)) + "."
    want = [("keropols NASA", 1.0), ("kerugrek", 0.98), ("kerogrek keromist", 0.855)]
    summarize._words.clear() if hasattr(summarize, "_words") else None
    monkeypatch.setattr(summarize, "stem", lambda w: (calls.append(w), real(w))[1])
    got = summarize.phrases_of(text)
    assert len(calls) <= 2 * (len(words) + 4), len(calls)
    assert got[:3] == want, got[:3]


def test_mmr_of_ties_and_negative_similarity():
    import numpy as np

    from inkwell.operators.summarize import mmr

    similarity = np.array([[1, -0.5, 0.2], [-0.5, 1, -0.9], [0.2, -0.9, 1]])
    assert mmr(np.array([0.5, 0.5, 0.5]), similarity, 5) == [0, 1, 2] and mmr(np.zeros(0), np.zeros((0, 0)), 3) == []


def test_dealt_rows_of_one_row_group(spark, tmp_path):
    from inkwell.session import dealt

    spark.range(2000).coalesce(1).write.parquet(str(tmp_path / "one"))
    out = dealt(spark.read.parquet(str(tmp_path / "one")))
    sizes = out.rdd.mapPartitions(lambda rows: [sum(1 for _ in rows)]).collect()
    assert sum(sizes) == 2000 and len(sizes) == 16 and max(sizes) < 300
