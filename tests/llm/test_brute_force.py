"""The language, quality and pipeline operators against plain versions of what they compute."""

import math

import numpy as np
import public_tokenizers
from pyspark.sql import functions as F
from test_ngram_join import brute as jaccard_classes

import corpus_pipeline as c
from inkwell.llm import language
from inkwell.llm.quality import KEEP_FROM, LEAST_P, score_quality
from inkwell.session import load, materialize


def plain_bundle(text):
    base = np.random.Generator(np.random.PCG64(language.SEED)).integers(0, 2, (language.LETTERS, language.DIM), np.int8) * 2 - 1
    letter = language.letter_ids()
    ids = [0]
    for ch in text.lower():
        i = int(letter[ord(ch)])
        if i or ids[-1]:
            ids.append(i)
    ids.append(0)
    out = np.zeros(language.DIM)
    for k in range(1, len(ids) - 1):
        if ids[k]:
            out += np.roll(base[ids[k - 1]], 2).astype(float) * np.roll(base[ids[k]], 1) * base[ids[k + 1]]
    return out


def plain_languages(rows, train):
    """rows: (id, text, lang); the language and cosine of each id."""
    own = {}
    for i, text, lang in rows:
        if train(i) and lang is not None:
            own[lang] = own.get(lang, 0) + plain_bundle(text or "")
    names = sorted(own)
    out = {}
    for i, text, _ in rows:
        v = plain_bundle(text or "")
        if not v.any():
            out[i] = ("und", 0.0)
            continue
        cos = [float(v @ own[n] / np.linalg.norm(v) / np.linalg.norm(own[n])) for n in names]
        out[i] = (names[int(np.argmax(cos))], max(cos))
    return out


def held(i, mod, rest):
    import zlib

    return zlib.crc32(str(i).encode()) % mod == rest


def plain_sites(rows, labels):
    """rows: (id, host, path, doc_score); quality of each id by the definition, one document at a time."""
    v = {i: round(labels.get(i, p), 9) for i, _, _, p in rows}
    rate = min(1 - LEAST_P, max(LEAST_P, sum(v.values()) / len(v)))

    def strength(sites):
        k, n = len(sites), sum(s[0] for s in sites)
        nn = sum(s[0] ** 2 for s in sites)
        if k < 2 or n - nn / n <= 0:
            return 1e6
        noise = sum(a * (1 - a) for _, _, a in sites) / k
        q = sum(m * (s / m - a) ** 2 for m, s, a in sites)
        return min(1e6, max(1.0, noise / max(1e-12, (q - (k - 1) * noise) / (n - nn / n)) - 1))

    host, path = {}, {}
    for i, h, p, _ in rows:
        host.setdefault(h, []).append(v[i])
        path.setdefault((h, p), []).append(v[i])
    hk = strength([(len(x), sum(x), rate) for x in host.values()])
    pk = strength([(len(x), sum(x), sum(host[h]) / len(host[h])) for (h, _), x in path.items()])
    logit = lambda x: math.log(min(1 - LEAST_P, max(LEAST_P, x)) / (1 - min(1 - LEAST_P, max(LEAST_P, x))))
    out = {}
    for i, h, p, score in rows:
        a = (sum(host[h]) - v[i] + hk * rate) / (len(host[h]) - 1 + hk)
        b = (sum(path[h, p]) - v[i] + pk * a) / (len(path[h, p]) - 1 + pk)
        out[i] = (a, b, 1 / (1 + math.exp(-(logit(score) + logit(b) - logit(rate)))))
    return out


def test_bundles_and_languages(spark, sf):
    rows = [(r["doc_id"], r["text"], r["lang"]) for r in load(spark, sf, "documents").where("length(text) < 6000").collect()]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3)
    want = plain_languages(rows, lambda i: not held(i, 4, 2))
    got = {r["doc_id"]: r for r in language.language_id(df).collect()}
    assert {i: (got[i]["lang_pred"], w[0]) for i, w in want.items() if got[i]["lang_pred"] != w[0]} == {}
    assert max(abs(got[i]["cosine"] - w[1]) for i, w in want.items()) < 1e-4


def test_unlearnt_languages_are_rejected(spark, sf):
    docs = load(spark, sf, "documents")
    names, prototypes = language.train_prototypes(docs.where("lang is not null"))
    texts = ["Быстрая коричневая лиса прыгает через ленивую собаку и бежит домой", "敏捷的棕色狐狸跳过了懒狗 然后跑回家", "το γρήγορο αλεπού πηδάει πάνω από το τεμπέλικο σκυλί", "1234 !!"]
    told = language.identify(spark.createDataFrame([(t,) for t in texts], "text string"), names, prototypes)
    assert told.where((F.col("lang_pred") != "und") & (F.col("cosine") >= language.LEAST_COSINE)).count() == 0


def test_posteriors(spark, sf):
    docs, labels = load(spark, sf, "documents"), load(spark, sf, "labels")
    told = {r["doc_id"]: float(r["quality"]) for r in labels.collect()}
    got = {r["doc_id"]: r for r in score_quality(docs, labels).collect()}
    rows = [(r["doc_id"], r["source"] or "", r["lang"] or "", got[r["doc_id"]]["doc_score"]) for r in docs.collect()]
    for i, (a, b, q) in plain_sites(rows, told).items():
        assert math.isclose(got[i]["host_posterior"], a, rel_tol=1e-6) and math.isclose(got[i]["path_posterior"], b, rel_tol=1e-6) and math.isclose(got[i]["quality"], q, rel_tol=1e-6)


def low(t):
    return (t or "").translate({k: k + 32 for k in range(65, 91)})


def test_each_stage_of_the_pipeline(spark, sf):
    from tokenizers import Tokenizer

    docs = load(spark, sf, "documents").where("length(text) < 6000 or text is null")
    odd = spark.createDataFrame([(900001, None, None, None, 0), (900002, "", "en", "src1", 0), (None, "A text without an id that is plain enough to stay here, as others do.", "en", "src1", 70)], docs.schema)
    docs = materialize(docs.unionByName(odd), "docs")
    told = {r["doc_id"]: float(r["quality"]) for r in load(spark, sf, "labels").collect()}
    for name, stage in c.STAGES[:-1]:
        rows = docs.collect()
        after = materialize(stage(spark, docs, sf), name)
        kept = sorted(r["doc_id"] or 0 for r in after.collect())
        if name == "language_id":
            got = plain_languages([(r["doc_id"], r["text"], r["lang"]) for r in rows], lambda i: i is None or not held(i, 4, 2))
            want = [i for i, (lang, cos) in got.items() if lang != "und" and cos >= language.LEAST_COSINE]
        elif name == "quality_classifier":
            scores = {r["doc_id"]: r["doc_score"] for r in score_quality(docs, load(spark, sf, "labels")).collect()}
            want = [i for i, x in plain_sites([(r["doc_id"], r["source"] or "", r["lang"] or "", scores[r["doc_id"]]) for r in rows], told).items() if x[2] >= KEEP_FROM]
        elif name == "exact_dedup":
            best = {}
            for r in rows:
                best[low(r["text"])] = max(best.get(low(r["text"]), -1), r["doc_id"] if r["doc_id"] is not None else -1)
            want = [i if i >= 0 else None for i in best.values()]
        else:
            classes = jaccard_classes([(r["doc_id"] if r["doc_id"] is not None else 1 << 40, r["text"]) for r in rows])
            want = [i if i < 1 << 40 else None for i, (_, own) in classes.items() if own == i]
        assert kept == sorted(i or 0 for i in want), name
        assert after.columns == docs.columns and 0 < after.count() <= len(rows)
        docs = after
    encode = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    pieces = {}
    for r in c.packed(spark, docs, sf).collect():
        pieces.setdefault(r["doc_id"], []).append((r["start"], r["length"], r["doc_tokens"]))
    rows = {r["doc_id"]: r["text"] for r in docs.collect()}
    assert set(pieces) == set(rows)
    for i, parts in pieces.items():
        at = 0
        for start, length, total in sorted(parts):
            assert start == at
            at += length
        assert at == total == len(encode.encode(rows[i] or "", add_special_tokens=False).ids) + 1


def test_pipeline_of_an_empty_table(spark, sf):
    docs = load(spark, sf, "documents").limit(0)
    for name, stage in c.STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf), name)
        assert docs.count() == 0
    assert c.packed(spark, docs, sf).count() == 0
