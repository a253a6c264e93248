import corpus_pipeline as c
from inkwell.session import load, materialize


def test_stages_keep_columns_and_take_effect(spark, sf):
    docs = load(spark, sf, "documents")
    columns, sizes = docs.columns, [docs.count()]
    good = {r["doc_id"] for r in load(spark, sf, "labels").where("quality = 1").collect()} & {r["doc_id"] for r in docs.select("doc_id").collect()}
    for name, stage in c.STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf), name)
        assert docs.columns == columns
        sizes.append(docs.count())
        kept = {r["doc_id"] for r in docs.select("doc_id").collect()}
        if name in ("language_id", "quality_classifier"):
            assert len(good - kept) <= 0.03 * len(good), name
    assert sizes == sorted(sizes, reverse=True) and sizes[0] > sizes[-1] > sizes[0] / 3
    pieces = c.packed(spark, docs, sf)
    assert {r["doc_id"] for r in pieces.select("doc_id").collect()} == kept
