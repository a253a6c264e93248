import base64
import random

import public_tokenizers
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from inkwell.llm.bpe import Codec, bpe_encode, op6_byte_bpe

PATH = public_tokenizers.path("byte_bpe_50k.tiktoken")
RANKS = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(PATH, "rb"))}
THEIRS = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=RANKS, special_tokens={})
OURS = Codec(PATH)


def check(texts):
    for t, (ids, ends) in zip(texts, OURS.encode_batch(texts), strict=True):
        assert ids.tolist() == THEIRS.encode_ordinary(t), t
        assert OURS.decode(ids) == t.encode()
        assert (ends[-1] if len(ends) else 0) == len(t.encode())


@pytest.mark.parametrize("t", ["", " ", "  ", "a  b", "don't 've it''s 'tis !'s \n's x's's", "\n\n 'll", "a 　 b ", "x" * 300, "é" * 500, "the cat\r\n\t sat  \n", "12 34½Ⅷ", "'re're 'r 'l", "\x1c\x85 z", "👍🏽 ok 日本語"])
def test_cases(t):
    check([t])


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(st.one_of(st.sampled_from("'sdtmlrve \n\t!a1é"), st.characters(exclude_categories=["Cs"])), max_size=80), max_size=5))
def test_equals_library(texts):
    check(texts)


def test_query(spark, sf):
    rows = op6_byte_bpe(spark, sf).collect()
    import hashlib

    text = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    assert len(rows) == len(text)
    for r in rows:
        ids = THEIRS.encode_ordinary(text[r["doc_id"]])
        assert r["n_tokens"] == len(ids)
        assert r["ids_sha256"] == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(text[r["doc_id"]].encode()).hexdigest()


def test_edges(spark):
    df = spark.createDataFrame([(1, None, "x"), (None, "", "y"), (2, "a b", "z"), (2, "a b", "z")], "doc_id long, text string, ids string")
    got = sorted((r["doc_id"] or 0, len(r["ids"]), list(r["piece_ends"])) for r in bpe_encode(df, PATH).collect())
    assert got == [(0, 0, []), (1, 0, []), (2, 2, [1, 3]), (2, 2, [1, 3])]
    assert bpe_encode(df.limit(0), PATH).count() == 0


def test_text_beyond_the_pool(monkeypatch):
    monkeypatch.setattr(Codec, "POOL", 1 << 12)
    own, rng = Codec(PATH), random.Random(1)
    texts = [" ".join("".join(rng.choices("abcdefghijkl", k=rng.randint(2, 24))) for _ in range(3000)) for _ in range(2)]
    for _ in range(2):
        for t, (ids, _) in zip(texts, own.encode_batch(texts), strict=True):
            assert ids.tolist() == THEIRS.encode_ordinary(t)
    assert own.used <= own.POOL
