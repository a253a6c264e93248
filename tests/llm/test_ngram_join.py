import random
import re

from inkwell.llm import ngram_join
from inkwell.llm.ngram_join import choose_boundary, ngram_classes, op7_ngram_jaccard


def brute(rows):
    sets = {}
    for i, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate({c: c + 32 for c in range(65, 91)}))
        sets[i] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()
    ids = sorted(sets)
    root = {i: i for i in ids}

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            x, y = sets[a], sets[b]
            if x and y and min(len(x), len(y)) * 5 >= max(len(x), len(y)) * 4 and 100 * len(x & y) >= 80 * len(x | y):
                i, j = sorted((top(a), top(b)))
                root[j] = i
    return {i: (len(sets[i]), top(i)) for i in ids}


def same(df, rows):
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in df.collect()}
    want = brute(rows)
    assert {i: (got[i], want[i]) for i in want if got[i] != want[i]} == {}


def test_query(spark, sf):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    same(op7_ngram_jaccard(spark, sf), rows)


def test_chains_hot_groups_and_sizes(spark):
    rng = random.Random(5)
    vocabulary = [f"w{i}" for i in range(400)]
    rows, passage = [], rng.choices(vocabulary, k=60)
    for size in (5, 8, 9, 12, 14, 20, 33, 60, 150, 400):
        base = rng.choices(vocabulary, k=size)
        for _ in range(12):
            own = list(base)
            for _ in range(rng.randint(0, max(1, size // 60))):
                own[rng.randrange(len(own))] = rng.choice(vocabulary)
            if rng.random() < 0.4:
                own = own[: size - rng.randint(0, 2)]
            rows.append(" ".join(own))
            base = own if rng.random() < 0.5 else base
    rows += [" ".join(passage + rng.choices(vocabulary, k=k)) for k in (5, 8, 12, 14, 15, 16, 18, 200)]
    rows += [None, "", " \t\n", "one", "One", "one two three four", "a b c d e", rows[0], rows[0].upper()]
    rng.shuffle(rows)
    rows = list(enumerate(rows))
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'c' as id", "1 as n", "doc_id as key").repartition(3)
    same(ngram_classes(df), rows)


def test_empty_and_repeated(spark):
    df = spark.createDataFrame([(3, "a b c d e f g"), (3, "a b c d e f g"), (9, "A b c d e f g")], "doc_id long, text string")
    assert sorted((r[0], r[1], r[2]) for r in ngram_classes(df).collect()) == [(3, 3, 3), (3, 3, 3), (9, 3, 3)]
    assert ngram_classes(df.limit(0)).count() == 0


def test_boundary_follows_cost():
    assert choose_boundary([(n, 100, 0) for n in range(4, 100)], 4) < choose_boundary([(n, 100, 100_000) for n in range(4, 100)], 4)


def test_links_inside_a_component_are_counted(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "BLOCK", 500)
    rng = random.Random(7)
    base = [f"w{i}" for i in range(60)]
    texts = [" ".join(base[:k] + [f"x{j}"] + base[k + 1 :]) for j, k in enumerate(rng.choices(range(60), k=30))]
    rows = list(enumerate(texts + texts[:4] + ["p q r s t u v w", "p q r s t u v w", "lone text here", None, ""]))
    sets = {i: {tuple((t or "").split()[k : k + 5]) for k in range(max(1, len((t or "").split()) - 4))} if (t or "").split() else set() for i, t in rows}
    want = {i: sum(i != j and bool(x) and 100 * len(x & y) >= 80 * len(x | y) for j, y in sets.items()) for i, x in sets.items()}
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert {r["doc_id"]: r["links_verified"] for r in ngram_classes(df).collect()} == want


def test_lists_in_passes(spark, monkeypatch):
    """Lists that are joined in several passes are those of one, however few entries a pass takes."""
    from inkwell.llm import ngram_join as N
    from inkwell.session import Scratch

    rows = [(h, key, 10, h % 3) for h in range(-40, 40) for key in range(1 + h % 4)] + [(5, 0, 10, 2)]
    entries = spark.createDataFrame(rows, "h long, key long, n int, pos int")
    scratch = Scratch(spark)
    whole = sorted(map(tuple, N.measure_lists(entries, scratch).select("h", "key", "n", "pos", "low", "length").collect()))
    monkeypatch.setattr(N, "JOINED", 20)
    kept = N.measure_lists(entries, scratch)
    assert sorted(map(tuple, kept.select("h", "key", "n", "pos", "low", "length").collect())) == whole
    assert len(scratch.paths["measured"]) == 1 + -(-len(rows) // 20) and "lists" not in scratch.paths
    scratch.drop()


def test_sketch_grows_with_the_text():
    """A sketch of fixed size hides frequent shingles of large tables: of 10 GB of text, 360 shingles shared a slot."""
    sizes = [ngram_join.sketch_slots(n) for n in (0, 10**9, 10**10, 6 * 10**10, 10**13)]
    assert sizes == [22, 22, 26, 28, 28]


def test_classes_of_a_larger_sketch():
    import numpy as np
    import pandas as pd
    import pyarrow as pa

    log, often = 24, "a b c d e"
    texts = [f"{often} x{i} " + " ".join(f"y{i}_{k}" for k in range(i % 9)) for i in range(40)]
    batch = pa.RecordBatch.from_pydict({"id": pa.array(range(40), pa.int64()), "text": pa.array(texts)})
    rows = pa.Table.from_batches(ngram_join._describe(log)([batch])).to_pandas()
    rows = rows[rows["place"].notna()]
    levels = np.zeros((1 << (log - ngram_join.ROW), 1 << (ngram_join.ROW - 1)), np.uint8)
    for place, part in rows.groupby("place"):
        levels[int(place)] = np.frombuffer(ngram_join._leveled(part)["level"].iloc[0], np.uint8)
    levels = levels.ravel()
    assert ngram_join.level_of(levels, ngram_join.shingles(often)).tolist() == [5]
    own = np.concatenate([ngram_join.shingles(f"y{i}_0 y{i}_1 y{i}_2 y{i}_3 y{i}_4") for i in range(40)])
    assert ngram_join.level_of(levels, own).max() == 0


def test_pairs_sets_and_zones_in_passes(spark, monkeypatch):
    """However few pairs and sets a pass takes, links and classes are those of all pairs; bands of sizes lose none."""
    from inkwell.session import Scratch

    written = []
    keep = Scratch.keep
    monkeypatch.setattr(Scratch, "keep", lambda self, df, tag: (written.append(tag), keep(self, df, tag))[1])
    for name, value in (("BLOCK", 300), ("SHORT", 6), ("PAIRED", 300), ("COMPARED", 1000)):
        monkeypatch.setattr(ngram_join, name, value)
    rng = random.Random(11)
    base = [f"w{i}" for i in range(90)]
    rows = []
    for size in (30, 33, 36, 40, 45, 50, 56, 63, 70, 79, 90):
        for j in range(4):
            own = base[:size]
            if j:
                own[rng.randrange(size)] = f"x{size}_{j}"
            rows.append(" ".join(own))
    for group in range(6):
        own = [f"g{group}_{i}" for i in range(40)]
        rows += [" ".join(own[:k] + ["z"] + own[k + 1 :]) for k in rng.sample(range(40), 5)]
    rows = list(enumerate(rows + rows[:3]))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    sets = {i: {tuple(t.split()[k : k + 5]) for k in range(len(t.split()) - 4)} for i, t in rows}
    want = {i: sum(i != j and 100 * len(x & y) >= 80 * len(x | y) for j, y in sets.items()) for i, x in sets.items()}
    out = ngram_classes(df)
    same(out, rows)
    assert {r["doc_id"]: r["links_verified"] for r in out.collect()} == want
    passes = {tag: written.count(tag) for tag in ("pairs", "near", "dense")}
    assert min(passes.values()) > 1, passes
