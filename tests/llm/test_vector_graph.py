import numpy as np

from inkwell.llm import vector_graph
from inkwell.llm.vector_graph import near_vectors, op5_vector_graph


def brute(rows, least=0.95):
    rows = [(i, None if v is None or any(c is None or not np.isfinite(c) for c in v) or not any(v) else np.array(v, float)) for i, v in rows]
    fine = [(i, v) for i, v in rows if v is not None]
    x = np.array([v / np.sqrt(v @ v) for _, v in fine])
    near = x @ x.T >= least
    np.fill_diagonal(near, False)
    ids = np.array([i for i, _ in fine])
    root = ids.copy()
    while True:
        new = np.minimum(root, [root[r].min() if r.any() else 1 << 60 for r in near])
        if (new == root).all():
            break
        root = new
    out = {int(i): (int(n), int(r)) for i, n, r in zip(ids, near.sum(1), root, strict=True)}
    return out | {i: (0, i) for i, v in rows if v is None}


def test_query(spark, sf):
    rows = [(r["vec_id"], r["embedding"]) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    want = brute(rows)
    got = {r["vec_id"]: r for r in op5_vector_graph(spark, sf).collect()}
    assert set(got) == set(want)
    links = sum(n for n, _ in want.values())
    assert all(got[i]["n_links"] <= n for i, (n, _) in want.items())
    assert sum(r["n_links"] for r in got.values()) >= 0.97 * links
    assert np.mean([got[i]["component_id"] == c for i, (_, c) in want.items()]) > 0.98
    assert all(r["kept"] == (r["vec_id"] == r["component_id"]) for r in got.values())


def test_clusters_copies_and_odd_vectors(spark):
    rng = np.random.default_rng(3)
    rows = []
    for _ in range(40):
        base = rng.normal(size=16)
        rows += [(base + rng.normal(size=16) * rng.choice([0.02, 0.1, 0.25])).tolist() for _ in range(30)]
    rows += [rows[0]] * 200 + [None, [], [0.0] * 16, [float("nan")] * 16, [float("inf")] + [1.0] * 15, [None] + [1.0] * 15]
    rows = list(enumerate(rows))
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").selectExpr("*", "1 as node", "'l' as label").repartition(3)
    want, got = brute(rows), {r["vec_id"]: r for r in near_vectors(df).collect()}
    links = sum(n for n, _ in want.values())
    assert sum(r["n_links"] for r in got.values()) >= 0.97 * links
    assert all(got[i]["n_links"] <= n for i, (n, _) in want.items())
    assert np.mean([got[i]["component_id"] == c for i, (_, c) in want.items()]) > 0.98
    assert got[0]["audit_recall"] >= 0.9
    assert near_vectors(df.limit(0)).count() == 0


def test_large_shards_are_split(spark, monkeypatch):
    monkeypatch.setattr(vector_graph, "SHARD_MOST", 150)
    monkeypatch.setattr(vector_graph, "SPLIT_STEP", 100)
    monkeypatch.setattr(vector_graph, "SHARD", 100)
    rng = np.random.default_rng(4)
    base = rng.normal(size=16)
    rows = list(enumerate([(base + rng.normal(size=16) * 0.3).tolist() for _ in range(700)]))
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)
    want, got = brute(rows), {r["vec_id"]: r for r in near_vectors(df).collect()}
    assert sum(r["n_links"] for r in got.values()) >= 0.9 * sum(n for n, _ in want.values())
    assert all(got[i]["n_links"] <= n for i, (n, _) in want.items())


def test_group_beyond_its_shards_loses_no_links(spark, monkeypatch):
    monkeypatch.setattr(vector_graph, "SHARD", 40)
    monkeypatch.setattr(vector_graph, "CELL", 150)
    monkeypatch.setattr(vector_graph, "BLOCK", 100)
    monkeypatch.setattr(vector_graph, "VISITORS", 200)
    monkeypatch.setattr(vector_graph, "LEAST_RECALL", 0.0)
    rng = np.random.default_rng(5)
    base = rng.normal(size=32)
    rows = [(base + rng.normal(size=32) * 0.14).tolist() for _ in range(900)] + rng.normal(size=(900, 32)).tolist()
    rows = list(enumerate(rows + rows[:50]))
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)
    want, got = brute(rows), {r["vec_id"]: r for r in near_vectors(df).collect()}
    assert all(got[i]["n_links"] <= n for i, (n, _) in want.items())
    assert sum(r["n_links"] for r in got.values()) >= 0.98 * sum(n for n, _ in want.values())
    assert np.mean([got[i]["component_id"] == c for i, (_, c) in want.items()]) > 0.99


def test_low_recall_compares_all_nodes(spark, monkeypatch):
    monkeypatch.setattr(vector_graph, "LEAST_RECALL", 1.1)
    monkeypatch.setattr(vector_graph, "CELL", 100)
    rng = np.random.default_rng(6)
    rows = list(enumerate((np.repeat(rng.normal(size=(60, 16)), 10, 0) + rng.normal(size=(600, 16)) * 0.2).tolist()))
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)
    got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in near_vectors(df).collect()}
    assert got == brute(rows)


def test_search_sorts_beams_only(monkeypatch):
    """A step of the search sorts each row's beam and what is new to it, not all nodes of the shard."""
    import numpy as np

    from inkwell.llm import vector_graph as V

    widths, partition = [], np.partition
    monkeypatch.setattr(V.np, "partition", lambda a, *k, **o: widths.append(a.shape[1]) or partition(a, *k, **o))
    x = V.unit_rows(np.random.default_rng(3).normal(size=(400, 16)))
    V.range_search(x, [r[r >= 0] for r in V.build_lists(x)], 0.8)
    assert widths and max(widths) <= V.BEAM + V.DEGREE
