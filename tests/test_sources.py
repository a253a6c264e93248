import json

from pyspark.sql import functions as F

from inkwell.sources import files, identifiers, records


def parsed(spark, texts):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    return [r for r in identifiers.parse_inputs(df, "t").orderBy("i").collect()]


def test_inputs(spark):
    cases = {
        "2402.02750": ("arxiv", "2402.02750"), "arXiv:2402.02750v2 [cs.CL]": ("arxiv", "2402.02750"), "math.GT/0309136": ("arxiv", "math/0309136"),
        "https://arxiv.org/pdf/1706.03762v5.pdf": ("arxiv", "1706.03762"), "arxiv.org/abs/1706.03762": ("arxiv", "1706.03762"), "1413.0001": ("topic", None),
        "https://doi.org/10.48550/arXiv.2402.02750": ("arxiv", "2402.02750"), "doi:10.1145/3292500.3330701.": ("doi", None), "10.1016/S0140(20)30183-5": ("doi", None),
        "https://dl.acm.org/doi/abs/10.1145/1": ("url", None), "https://dl.acm.org/doi/abs/10.1145/12": ("doi", None), "https://x.org/a.pdf": ("pdf-url", None),
        "https://openreview.net/pdf?id=abc": ("pdf-url", None), "www.example.com": ("url", None), "graph   neural networks": ("topic", None), "": ("topic", None), None: ("topic", None),
    }
    cases["https://dl.acm.org/doi/abs/10.1145/1"] = ("doi", None)
    for (text, want), r in zip(cases.items(), parsed(spark, list(cases)), strict=True):
        assert (r["kind"], r["arxiv"]) == want, text
    r = parsed(spark, ["arXiv:2402.02750v2", "(10.1016/S0140(20)30183-5)", "graph   nets"])
    assert r[0]["version"] == "v2" and r[2]["query"] == "graph nets"


def test_batches(spark):
    df = spark.createDataFrame([(1, "2402.02750, 1706.03762; 2402.02750"), (2, "2402.02750 and more")], "i int, t string")
    got = {(r["i"], r["part"]) for r in identifiers.split_batches(df, "i", "t").collect()}
    assert got == {(1, "2402.02750"), (1, "1706.03762"), (2, "2402.02750 and more")}


def test_records(spark):
    dc = {"data": {"attributes": {"doi": "10.48550/arXiv.2402.02750", "titles": [{"title": " A  title "}], "creators": [{"name": "Doe, Jan"}, {"givenName": "A", "familyName": "B"}], "publicationYear": 2024, "dates": [{"date": "2024-02-05T00:00", "dateType": "Submitted"}], "descriptions": [{"description": "text", "descriptionType": "Abstract"}], "citationCount": 3}}}
    oa = {"title": "A title", "publication_date": "2024-01-01", "publication_year": 2024, "cited_by_count": 9, "primary_location": {"landing_page_url": "https://arxiv.org/abs/2402.02750", "source": {"display_name": "Venue"}}, "authorships": [], "abstract_inverted_index": {"world": [1, 3], "hello": [0, 2], "x": [-1]}}
    cr = {"message": {"title": ["A title"], "author": [{"given": "Jan", "family": "Doe"}], "issued": {"date-parts": [[2023, 4]]}, "container-title": ["Journal"], "DOI": "10.1/X", "is-referenced-by-count": 1, "abstract": "<jats:title>Abstract</jats:title><jats:p>We show<jats:sup>1</jats:sup> it.</jats:p>"}}
    s2 = {"externalIds": {"ArXiv": "2402.02750"}, "citationCount": 5, "openAccessPdf": {"url": "https://x/y"}}
    raw = spark.createDataFrame([(1, *(json.dumps(x) for x in (dc, oa, cr, s2)))], "k int, dc string, oa string, cr string, s2 string")
    d, o, c, s = (m(raw, "k", j) for m, j in ((records.map_datacite, "dc"), (records.map_openalex, "oa"), (records.map_crossref, "cr"), (records.map_scholar, "s2")))
    a = d.first()
    assert (a["title"], a["authors"], a["published"], a["arxiv"]) == ("A title", ["Jan Doe", "A B"], "2024-02-05", "2402.02750")
    b = o.first()
    assert (b["abstract"], b["published"], b["arxiv"]) == ("hello world hello world", "2024-02", "2402.02750")
    e = c.first()
    assert (e["abstract"], e["published"], e["year"]) == ("We show it.", "2023-04", 2023)
    got = records.resolve(c, o, s, "k").first()
    assert (got["citations"], got["arxiv"], got["venue"], got["abstract"]) == (9, "2402.02750", "Journal", "We show it.")


def test_files(spark, tmp_path):
    (tmp_path / "a.pdf").write_bytes(b"x" * 10 + b"%PDF-1.7")
    (tmp_path / "b.html").write_bytes(b" <!DOCTYPE html><p>")
    got = {r["path"].rpartition("/")[2]: (r["is_pdf"], r["is_html"]) for r in files.read_documents(spark, str(tmp_path)).collect()}
    assert got == {"a.pdf": (True, False), "b.html": (False, True)}
    row = spark.range(1).select(files.html_text(F.lit("<p>a &amp; <b>b</b></p><script>x</script>")).alias("t"), files.title_of_file(F.lit("http://x/My_paper-v2.pdf?a=1")).alias("n")).first()
    assert (row["t"], row["n"]) == ("a & b", "My paper v2")
