import math
import zlib
from collections import Counter

import numpy as np
import pytest

from inkwell.llm import ctw
from inkwell.llm.ctw import BEFORE, DEPTH, END, ctw_score, lgamma, op9_ctw_scoring


class Brute:
    """The recursive definition, node by node."""

    def __init__(self, texts):
        self.n = Counter()
        self.contexts = {}
        for t in texts:
            seq = bytes([BEFORE]) * DEPTH + t + bytes([END])
            for i in range(DEPTH, len(seq)):
                for d in range(DEPTH + 1):
                    c = seq[i - d : i]
                    for k in range(8):
                        node = (256 | seq[i]) >> (8 - k)
                        self.n[c, node, seq[i] >> (7 - k) & 1] += 1
                        if d < DEPTH:
                            self.contexts.setdefault((c, node), set()).add(seq[i - d - 1 : i])
        self.memo = {}

    def kt(self, c, node):
        a, b = self.n[c, node, 0], self.n[c, node, 1]
        return math.lgamma(a + 0.5) + math.lgamma(b + 0.5) - math.lgamma(a + b + 1) - math.log(math.pi)

    def lw(self, c, node):
        if (c, node) not in self.memo:
            kt = self.kt(c, node)
            if len(c) == DEPTH:
                self.memo[c, node] = kt
            else:
                self.memo[c, node] = np.logaddexp(kt, self.children(c, node)) - math.log(2)
        return self.memo[c, node]

    def children(self, c, node):
        return sum(self.lw(x, node) for x in self.contexts.get((c, node), ()))

    def score(self, t):
        seq = bytes([BEFORE]) * DEPTH + t + bytes([END])
        total = 0.0
        for i in range(DEPTH, len(seq)):
            for k in range(8):
                node, bit, p = (256 | seq[i]) >> (8 - k), seq[i] >> (7 - k) & 1, None
                for d in range(DEPTH, -1, -1):
                    c = seq[i - d : i]
                    est = (self.n[c, node, bit] + 0.5) / (self.n[c, node, 0] + self.n[c, node, 1] + 1)
                    w = 1 if d == DEPTH else 1 / (1 + math.exp(min(700, self.children(c, node) - self.kt(c, node))))
                    p = est if p is None else w * est + (1 - w) * p
                total += math.log10(p)
        return total


def test_lgamma():
    for x in (0.5, 1.0, 1.5, 3.25, 1e3, 1e9):
        assert lgamma(np.array([x]))[0] == pytest.approx(math.lgamma(x), rel=1e-12, abs=1e-10)


def test_equals_definition_and_sums_to_one(spark, monkeypatch):
    rows = [(i, t) for i, t in enumerate(["The cat sat", "the cat ate the Rat é", None, "", "dog", "the cat sat", "zzz unseen 日本", "a" * 50] + [bytes([c]).decode() for c in range(128)])]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as key", "doc_id as chunk")
    low = lambda t: (t or "").encode().lower()
    training = [low(t) for i, t in rows if i < 6]
    brute = Brute(training)
    got = {r["doc_id"]: r for r in ctw_score(df.repartition(2), df["doc_id"] < 6).collect()}
    words = Counter(w for t in training for w in [*t.split(), b"\n"])
    n, v = sum(words.values()), len(words)
    for i, t in rows:
        assert got[i]["score"] == pytest.approx(brute.score(low(t)), rel=1e-9)
        own = [*low(t).split(), b"\n"]
        assert (got[i]["n_tokens"], got[i]["n_known"], got[i]["train_tokens"]) == (len(own), sum(w in words for w in own), n)
        assert got[i]["base_score"] == pytest.approx(sum(math.log10((words[w] + 0.5) / (n + 0.5 * (v + 1))) for w in own))
    assert ctw_score(df.limit(0), df["doc_id"] < 6).count() == 0


def test_rare_and_common_keys(spark, monkeypatch):
    df = spark.createDataFrame([(i, f"alpha beta {i} gamma " * 30) for i in range(60)], "doc_id long, text string").repartition(4)
    want = {r["doc_id"]: r for r in ctw_score(df, df["doc_id"] % 3 > 0).collect()}
    monkeypatch.setattr(ctw, "COMMON_MOST", 40)
    got = {r["doc_id"]: r for r in ctw_score(df, df["doc_id"] % 3 > 0).collect()}
    assert got == want


def test_first_byte_is_a_distribution():
    keys = np.array([(BEFORE << 32) | (BEFORE << 24) | (BEFORE << 16) | (BEFORE << 8) | s for s in range(256)], np.int64)
    counts = np.random.default_rng(1).integers(0, 5, 256)
    p, *_ = ctw.subtree(keys, counts)
    assert p.prod(1).sum() == pytest.approx(1)


def test_sparse_ranking_equals_dense(monkeypatch):
    texts = ["the cat é".encode(), b"", b"x" * 9]
    dense = ctw.context_keys(texts)
    monkeypatch.setattr(ctw, "DENSE", 1)
    assert all((a == b).all() for a, b in zip(dense, ctw.context_keys(texts), strict=True))


def test_chunks_do_not_matter(spark, sf, monkeypatch):
    got = {r["doc_id"]: r for r in op9_ctw_scoring(spark, sf).collect()}
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    assert set(got) == set(docs)
    assert all(r["held_out"] == (zlib.crc32(str(i).encode()) % 5 == 1) for i, r in got.items())
    held = [r for r in got.values() if r["held_out"]]
    assert sum(r["score"] for r in held) < 0 and sum(r["base_score"] for r in held) < 0
