import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers as p
from tokenizers import Tokenizer

from inkwell.llm.packing import BITS, DIMS, curve_pack, hilbert_key, op4_curve_packing

HF = Tokenizer.from_file(p.path("byte_bpe_50k.json"))


def verify(rows, texts):
    docs, seqs = defaultdict(list), defaultdict(list)
    for r in rows:
        docs[r["doc_id"]].append(r)
        seqs[r["sequence_id"]].append(r)
    assert set(docs) == set(texts)
    for d, own in docs.items():
        ids = np.array([*HF.encode(texts[d] or "", add_special_tokens=False).ids, 0], "<u4")
        at = 0
        for r in sorted(own, key=lambda r: r["start"]):
            assert r["start"] == at and r["length"] > 0 and r["doc_tokens"] == len(ids)
            assert r["ids_crc32"] == zlib.crc32(ids[at : at + r["length"]].tobytes())
            at += r["length"]
        assert at == len(ids)
    for own in seqs.values():
        at = 0
        for r in sorted(own, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= 1024 and at & (at - 1) == 0


def test_query(spark, sf):
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    verify(op4_curve_packing(spark, sf).collect(), texts)


def test_edges(spark):
    texts = {1: None, 2: "", 3: "x <|endoftext|> y", 4: "word " * 5000, 5: "same", 6: "same"}
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string").selectExpr("*", "'z' as ids", "1 as key", "doc_id as start")
    path = p.path("byte_bpe_50k.json"), p.path("byte_bpe_50k.tiktoken")
    verify(curve_pack(df, *path).collect(), texts)
    assert curve_pack(df.limit(0), *path).count() == 0


def test_curve_visits_each_cell_beside_the_last():
    side = 4
    grid = np.stack(np.meshgrid(*[np.arange(side)] * DIMS), -1).reshape(-1, DIMS)
    keys = hilbert_key(grid)
    assert len(set(keys.tolist())) == side**DIMS and keys.max() == side**DIMS - 1 < 1 << (BITS * DIMS)
    steps = np.abs(np.diff(grid[np.argsort(keys)], axis=0)).sum(axis=1)
    assert (steps == 1).all()
