import pytest
from pyspark.sql import functions as F

from inkwell.operators import review, segment

TEXT = """A Title of the Work
Abstract
We show that plain sentences are found here.
1 Introduction
However, this opening sentence is long enough to stay. 3 apples are no heading.
2 Our Method
## Details of Training
The details are told in one more sentence here.
3.1 Odds and Ends
Some words stand in this part of the method too.
References
[1] A reference that must not be read as a sentence.
"""


def test_sections_and_sentences(spark):
    rows = [(1, TEXT), (2, "One line without a heading stands here.\n" * 120), (3, None), (4, " \n"), (5, "Conclusion")]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'x' as title", "7 as section")
    s = {(r["doc_id"], r["section"]): (r["title"], r["kind"], r["level"]) for r in segment.document_sections(df).collect()}
    assert [s[1, i] for i in range(7)] == [("front", "other", 1), ("Abstract", "abstract", 1), ("Introduction", "introduction", 1), ("Our Method", "method", 1), ("Details of Training", "method", 2), ("Odds and Ends", "method", 2), ("References", "references", 1)]
    assert [s[2, i][0] for i in range(3)] == ["Page 1", "Page 2", "Page 3"] and (2, 3) not in s
    assert s[5, 0] == ("Conclusion", "conclusion", 1)
    got = segment.segment(segment.document_sections(df)).where("doc_id = 1").orderBy("index").collect()
    assert [(r["section_kind"], r["id"], r["index"]) for r in got] == [("abstract", "s1:0", 0), ("introduction", "s2:0", 1), ("method", "s4:0", 2), ("method", "s5:0", 3)]
    assert segment.document_sections(df.limit(0)).count() == 0


#: A document with nothing to say about it; what each finding needs beside it.
PLAIN = {
    "statistics": 1, "seeds": 1, "ablation": 3, "baseline": 3, "sota": 0, "compute": 1, "hyper": 2, "human": 0, "generation": 0, "judge": 0, "contamination": 1, "webscale": 0, "general": 0, "training": 1, "efficiency": 0,
    "errors": 1, "hedge": 0, "booster": 0, "significantly": 0, "code": 0, "repository": 1, "data_link": 0, "claim": 10, "limitations_section": False, "related_section": True, "ablation_section": False,
    "result_sentences": 4, "contribution_sentences": 1, "limitation_sentences": 2, "future_sentences": 1, "method_sentences": 3, "datasets": ["GSM8K", "MATH"], "metrics": ["accuracy"], "unbacked": 0,
    "least_sample": None, "sample_of_people": False, "sentences": 50, "words": 4000, "sections": 5, "full_text": True, "references": 30, "median_age": 4.0, "dated": 20, "recent_share": 0.5, "self_share": 0.1,
}
FIRES = {
    "abstract-only": {"full_text": False}, "variance-reported": {}, "variance-hidden": {"statistics": 0}, "no-variance": {"statistics": 0, "seeds": 0}, "ablations": {}, "thin-ablation": {"ablation": 1}, "no-ablation": {"ablation": 0},
    "broad-evaluation": {"datasets": ["GSM8K", "MATH", "COCO"]}, "no-benchmark": {"datasets": []}, "narrow-evaluation": {"datasets": ["MATH"]}, "baselines": {"sota": 1, "baseline": 4}, "no-baselines": {"baseline": 0}, "few-baselines": {"baseline": 1},
    "sota-without-stats": {"sota": 1, "statistics": 0}, "significance-wording": {"unbacked": 1, "statistics": 0}, "overclaiming": {"booster": 2}, "code-released": {}, "code-promised": {"repository": 0, "code": 1}, "no-code": {"repository": 0},
    "setup-documented": {"hyper": 3}, "no-compute": {"compute": 0}, "no-hyperparameters": {"hyper": 0}, "candid-limitations": {"limitations_section": True}, "no-limitations": {"limitation_sentences": 0}, "limitations-in-passing": {"limitation_sentences": 1},
    "small-sample": {"least_sample": 20}, "human-evaluation": {"human": 1}, "llm-judge-only": {"generation": 2, "judge": 1}, "no-human-eval": {"generation": 2}, "no-related-work": {"related_section": False}, "dated-references": {"median_age": 9.0, "recent_share": 0.1},
    "few-references": {"references": 8}, "self-citation": {"self_share": 0.4}, "no-contamination-check": {"webscale": 1, "contamination": 0}, "error-analysis": {"errors": 2}, "no-error-analysis": {"errors": 0, "result_sentences": 5},
}
KINDS = {"datasets": "array<string>", "metrics": "array<string>", "limitations_section": "boolean", "related_section": "boolean", "ablation_section": "boolean", "sample_of_people": "boolean", "full_text": "boolean", "median_age": "double", "recent_share": "double", "self_share": "double"}


def test_every_finding_fires_alone(spark):
    rows = [tuple([0, *PLAIN.values()])] + [(i, *(PLAIN | told).values()) for i, told in enumerate(FIRES.values(), 1)]
    df = spark.createDataFrame(rows, ", ".join(["doc_id long", *(f"{k} {KINDS.get(k, 'long')}" for k in PLAIN)]))
    got = {}
    for r in review.findings(df).collect():
        got.setdefault(r["doc_id"], set()).add(r["id"])
    usual = got[0]
    assert usual == {"variance-reported", "ablations", "code-released"}
    for i, (name, told) in enumerate(FIRES.items(), 1):
        assert name in got[i], name
        assert not told or name not in usual, name
    assert len(FIRES) == 36


def test_documents_without_sentences_stay(spark):
    docs = spark.createDataFrame([(1,), (2,)], "doc_id long")
    s = spark.createDataFrame([(1, "Results", 0, "We outperform it by 3%.", "result")], "doc_id long, section_title string, index long, text string, zone string")
    out = review.signals(s, documents=docs)
    assert {r["doc_id"]: [f["id"] for f in review.findings(out).where(F.col("doc_id") == r["doc_id"]).collect()][:1] for r in out.collect()}[2] == ["abstract-only"]
    assert review.rigor(out).count() == 2


@pytest.mark.parametrize("n", [1, 49, 50, 51])
def test_pages_hold_all_lines(spark, n):
    text = "\n".join(f"words of line {i} here" for i in range(n))
    parts = spark.createDataFrame([(text,)], "t string").select(segment.parts_of(F.col("t")).alias("p")).first()["p"]
    assert "".join(p["text"] for p in parts) == text and len(parts) == -(-n // 50)


def test_sections_read_written_lines(spark):
    """Lines are made once: what follows reads them from a written table."""
    from inkwell.operators import structure

    lines = spark.createDataFrame([(1, 0, 1, "1 Introduction", True), (1, 0, 2, "Some words.", False)], "doc long, page long, line int, text string, bold boolean").selectExpr("*", "50D x", "100D y", "90D width", "10D size", "0 column")
    out = structure.sections(lines)
    assert all("/body-" in f for f in out.inputFiles()) and out.inputFiles()
