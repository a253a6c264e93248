"""Embedding near-duplicates through a robust-pruned flat graph.

Equal vectors are one node. Nodes are dealt to overlapping cluster shards; each shard builds robust-pruned adjacency
lists, the lists of a node from all its shards are united, and every node is then searched for in its shards: a
greedy search from the shard's medoid, expanded for as long as it finds nodes within the range. What is found is
verified by cosine in double precision.

The searches tell which nodes have a partner at all. These are dealt once more, to cells, and verified in blocks with the
nodes of every cell that can hold a partner by the geometry of the cells, so that a dense group may span any number of
shards: of two nodes that have a partner each, no link is lost and none counted twice. Recall is audited against
brute force, half of it on nodes with links; where it is below LEAST_RECALL all nodes are compared in this way.
"""

from __future__ import annotations

import numpy as np
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from inkwell.llm.common import attach, components
from inkwell.session import Scratch, load

#: Nodes that a shard has on average, shards that a node goes to at most and how much farther than the nearest centre
#: (in angle) another may be; degree and slack of pruning; beam of the search.
SHARD, OVERLAP, SLACK, DEGREE, ALPHA, BEAM = 600, 4, 1.35, 24, 1.2, 24
#: Rows that centres are fitted on, about (those with the smallest hashes; every row is dealt), and vectors of each half of
#: the audit at most.
FIT_ROWS, AUDIT_ROWS, SEED = 20_000, 64, 11
#: A shard beyond this many nodes is split again by centres of its own, fitted on up to SPLIT_FIT of its rows and dealt
#: SPLIT_STEP rows at a time, until none is left; one that its centres hardly divide is dealt by hash.
SHARD_MOST, SPLIT_FIT, SPLIT_STEP = 1500, 4096, 50_000
#: Nodes that a cell has on average, that a block of a cell has about and that visit a block in one task about; visitors
#: compared at a time; audited recall below which all nodes are compared.
CELL, BLOCK, VISITORS, STEP, LEAST_RECALL = 2048, 4096, 32_768, 512, 0.9


def unit_rows(vectors: np.ndarray) -> np.ndarray:
    return vectors / np.linalg.norm(vectors, axis=1, keepdims=True)


def k_means(x: np.ndarray, k: int, rounds: int = 8) -> np.ndarray:
    """Unit centres by spherical k-means from deterministic random rows."""
    rng = np.random.Generator(np.random.PCG64(SEED))
    centres = x[np.sort(rng.choice(len(x), k, replace=False))]
    for _ in range(rounds):
        at = np.concatenate([np.argmax(x[i : i + 4096] @ centres.T, axis=1) for i in range(0, len(x), 4096)])
        sums = np.zeros_like(centres)
        np.add.at(sums, at, x)
        norm = np.linalg.norm(sums, axis=1, keepdims=True)
        centres = np.where(norm > 1e-9, sums / np.maximum(norm, 1e-9), centres)
    return centres


def assign(x: np.ndarray, centres: np.ndarray, most: int = OVERLAP) -> list[np.ndarray]:
    """The shards of each row: its nearest centre, and the next ones that are not much farther."""
    out = []
    k = min(most, len(centres))
    for i in range(0, len(x), 4096):
        angle = np.arccos(np.clip(x[i : i + 4096] @ centres.T, -1, 1))
        near = np.argpartition(angle, k - 1, axis=1)[:, :k]
        d = np.take_along_axis(angle, near, 1)
        own = d <= d.min(1, keepdims=True) * SLACK + 1e-9
        out += [np.sort(n[o]) for n, o in zip(near, own, strict=True)]
    return out


def build_lists(x: np.ndarray) -> np.ndarray:
    """Robust-pruned adjacency of a shard: each row's nearest rows and some far ones are its candidates."""
    n = len(x)
    k = min(n - 1, 2 * DEGREE)
    if k <= 0:
        return np.full((n, DEGREE), -1)
    rng = np.random.Generator(np.random.PCG64(SEED))
    out = []
    for i in range(0, n, 256):
        sim = x[i : i + 256] @ x.T
        sim[np.arange(len(sim)), np.arange(i, i + len(sim))] = -2
        near = np.argpartition(-sim, k - 1, axis=1)[:, :k]
        out.append(near)
    candidates = np.hstack([np.vstack(out), rng.integers(0, n, (n, DEGREE // 3))])
    return np.vstack([robust_prune(x, np.arange(i, min(n, i + 256)), candidates[i : i + 256]) for i in range(0, n, 256)])


def robust_prune(x: np.ndarray, own: np.ndarray, candidates: np.ndarray) -> np.ndarray:
    """For each row of own at most DEGREE of its candidates, nearest first, none of which is much nearer to one
    already chosen than to the row; -1 fills up. Distances are squared chords."""
    n = len(own)
    far = 2 - 2 * np.einsum("nd,nkd->nk", x[own], x[candidates])
    far[candidates == own[:, None]] = np.inf
    by = np.argsort(far, axis=1, kind="stable")
    candidates, far = np.take_along_axis(candidates, by, 1), np.take_along_axis(far, by, 1)
    alive = np.isfinite(far)
    vectors = x[candidates]
    out, rows = np.full((n, DEGREE), -1), np.arange(n)
    for slot in range(DEGREE):
        left = alive.any(1)
        if not left.any():
            break
        pick = np.argmax(alive, axis=1)
        chosen = candidates[rows, pick]
        out[left, slot] = chosen[left]
        alive[rows, pick] = False
        between = 2 - 2 * np.einsum("nd,nkd->nk", x[chosen], vectors)
        alive &= ~((ALPHA * between <= far) & left[:, None])
    return out


def range_search(x: np.ndarray, lists: list[np.ndarray], least: float) -> list[np.ndarray]:
    """For every row of x the rows within cosine least that a greedy search from the medoid finds over the graph.

    A beam of the nearest rows seen moves until all of it is expanded; then rows within range are expanded until no
    further one turns up. All rows search together, step by step.
    """
    n = len(x)
    width = max(1, max(map(len, lists), default=0))
    graph = np.full((n, width), -1)
    for i, own in enumerate(lists):
        graph[i, : len(own)] = own
    medoid = int(np.argmax(x @ x.sum(0)))
    found: list[np.ndarray] = []
    for first in range(0, n, 512):
        q = x[first : first + 512]
        m = len(q)
        rows = np.arange(m)
        k = min(BEAM, n)
        seen = np.zeros((m, n + 1), bool)
        sim = np.full((m, n + 1), -3.0)
        # Similarities of the nodes that are seen and not expanded, and the k largest of all that are seen.
        todo = np.full((m, n + 1), -4.0)
        beam = np.full((m, k), -3.0)
        seen[:, medoid] = True
        sim[:, medoid] = todo[:, medoid] = beam[:, 0] = q @ x[medoid]
        active = rows
        while len(active):
            best = np.argmax(todo if len(active) == m else todo[active], axis=1)
            top, edge = todo[active, best], beam[active].min(1)
            go = (top > -4) & ((top >= edge) | (top >= least - 1e-9))
            active, best = active[go], best[go]
            if not len(active):
                break
            todo[active, best] = -4.0
            near = graph[best]
            near = np.where(near < 0, n, near)
            new = ~seen[active[:, None], near]
            new[near == n] = False
            a, b = np.nonzero(new)
            at, to = active[a], near[a, b]
            seen[at, to] = True
            fresh = np.full(near.shape, -3.0)
            fresh[a, b] = sim[at, to] = todo[at, to] = np.einsum("nd,nd->n", q[at], x[to])
            beam[active] = -np.partition(-np.hstack([beam[active], fresh]), k - 1, axis=1)[:, :k]
        for i in range(m):
            own = np.flatnonzero(sim[i, :n] >= least - 1e-6)
            found.append(own[own != first + i])
    return found


def near_vectors(vectors: DataFrame, least: float = 0.95, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """One row per input row: id_col, n_links, component_id, kept, audit_recall.

    Two vectors link when their cosine in double precision is least or more; n_links counts the other rows linked
    directly, component_id is the smallest id reachable. Vectors that are null, empty or zero, or hold null or
    non-finite components, link with nothing; so do vectors of different lengths. Equal vectors link with one
    another. Repeated rows count each, null ids are rows like others; other columns are not read; an empty table gives an empty result.
    audit_recall is the share of true links found, see audit.
    """
    spark = vectors.sparkSession
    v = F.transform(F.col(vec_col), lambda x: x.cast("double"))
    fine = F.coalesce(F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0), F.lit(False))
    scratch = Scratch(spark)
    # Negative zeros become zeros, so that equal vectors are equal arrays.
    v = F.transform(v, lambda x: x + F.lit(0.0))
    rows = scratch.keep(vectors.select(F.col(id_col).alias("id"), F.when(fine, v).alias("v")), "vectors")
    named = rows.where("v is not null").withColumn("node", F.xxhash64("v", F.size("v")))
    nodes = named.groupBy("node").agg(F.min("id").alias("low"), F.count("*").alias("copies"), F.min("v").alias("v"), F.max("v").alias("other"))
    nodes = scratch.keep(nodes.withColumn("mixed", F.col("v") != F.col("other")).drop("other"), "nodes")
    if not nodes.where("mixed").isEmpty():
        raise RuntimeError("two different vectors have one 64-bit hash")
    dims = nodes.select(F.size("v").alias("d")).distinct()
    dims = [d for (d,) in dims.orderBy("d").collect()]
    if not dims:
        lone = rows.select(F.col("id").alias(id_col), F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))
        return lone.select("*", F.lit(True).alias("kept"), F.lit(1.0).alias("audit_recall"))
    parts = [nodes.where(F.size("v") == d).select("node", "v", "copies") for d in dims]
    some = scratch.keep(_union([_search(x, least, scratch) for x in parts]), "partnered")
    linked = scratch.keep(_union([compare_cells(x.join(some, "node", "left_semi"), least, scratch) for x in parts]), "linked")
    recall = audit(nodes, linked, least)
    if recall < LEAST_RECALL:
        linked = scratch.keep(_union([compare_cells(x, least, scratch) for x in parts]), "linked")
        recall = audit(nodes, linked, least)
    edges = linked.where("root <> node").select(F.col("node").alias("a"), F.col("root").alias("b"))
    found = components(scratch, edges)
    degree = linked.groupBy("node").agg(F.sum("n").alias("others"))
    told = nodes.select("node", "low", "copies").join(degree, "node", "left").join(found.withColumnRenamed("id", "node"), "node", "left")
    told = scratch.keep(told.withColumn("component", F.coalesce("component", "node")), "told")
    lowest = told.groupBy("component").agg(F.min("low").alias("component_id"))
    told = attach(told, lowest, "component").select("node", "component_id", (F.coalesce("others", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
    told = scratch.keep(told, "classes")
    out = attach(named.select("id", "node"), told, "node").select("id", "n_links", "component_id")
    alone = rows.where("v is null").select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))
    out = out.union(alone)
    out = out.select(F.col("id").alias(id_col), F.col("n_links").cast("long").alias("n_links"), "component_id", F.col("id").eqNullSafe(F.col("component_id")).alias("kept"), F.lit(recall).alias("audit_recall"))
    out = scratch.keep(out, "result")
    scratch.drop(but="result")
    return out


def drawn(rows: DataFrame, most: int, seed: int) -> np.ndarray:
    """The vectors of about most rows, those of the smallest hashes: a fixed share of the hashes leaves the tasks."""
    total = max(1, rows.count())
    h = F.xxhash64("node", F.lit(seed))
    part = rows.where(h < F.lit(int(-(2**63) + min(1.0, most / total) * (2**64 - 1)))) if total > most else rows
    got = sorted((r["h"], r["v"]) for r in part.select(h.alias("h"), "v").collect())
    return unit_rows(np.array([v for _, v in got], float)) if got else unit_rows(np.array([rows.first()["v"]], float))


def _union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def split_large(flat: DataFrame, scratch: Scratch) -> DataFrame:
    """flat (shard, node, v: a row per node and shard) with no shard beyond SHARD_MOST.

    Each round fits centres on a bounded part of every large shard and deals all its rows to them, a bounded group at a
    time, each to up to two of them. What is still large and has not shrunk by a tenth is dealt by hash."""
    was = None
    while True:
        sizes = flat.groupBy("shard").agg(F.count("*").alias("size")).where(F.col("size") > SHARD_MOST)
        big = scratch.keep(sizes, "big")
        now = big.agg(F.max("size")).first()[0]
        if now is None:
            return flat
        if was is not None and now > 0.9 * was:
            part = F.pmod(F.xxhash64("node", F.lit(SEED + 6)), F.ceil(F.col("size") / SHARD).cast("long"))
            flat = flat.join(big, "shard", "left").withColumn("shard", F.when(F.col("size").isNull(), F.col("shard")).otherwise(F.xxhash64("shard", part)))
            return scratch.keep(flat.select("shard", "node", "v"), "dealt")
        was = now
        rows = flat.join(big, "shard")
        # A fixed share of the shard's hashes is drawn before the rows are ranked, so that few rows meet in the window.
        part = rows.where(F.pmod(F.xxhash64("node", F.lit(SEED + 2)), F.col("size")) < 4 * SPLIT_FIT)
        rank = F.row_number().over(Window.partitionBy("shard").orderBy(F.xxhash64("node", F.lit(SEED + 2))))
        part = part.withColumn("nth", rank).where(F.col("nth") <= SPLIT_FIT)

        def fit(key, pdf):
            import pandas as pd

            x = unit_rows(np.array(pdf["v"].tolist(), float))
            k = min(-(-int(pdf["size"].iloc[0]) // SHARD), max(2, len(x) // 8), 1024)
            return pd.DataFrame({"shard": [key[0]], "size": [int(pdf["size"].iloc[0])], "centres": [k_means(x, min(k, len(x))).ravel()]})

        centres = part.groupBy("shard").applyInPandas(fit, "shard long, size long, centres array<double>")
        salts = F.ceil(F.col("size") / SPLIT_STEP).cast("long")
        centres = scratch.keep(centres.withColumn("salt", F.explode(F.sequence(F.lit(0), salts - 1))), "split")
        rows = rows.withColumn("salt", F.pmod(F.xxhash64("node", F.lit(SEED + 3)), salts)).select("shard", "salt", "node", "v")

        def deal(key, left, right):
            import pandas as pd

            if not len(left) or not len(right):
                return pd.DataFrame({"shard": [], "node": [], "v": []})
            x = unit_rows(np.array(left["v"].tolist(), float))
            own = assign(x, np.array(right["centres"].iloc[0]).reshape(-1, x.shape[1]), 2)
            n = list(map(len, own))
            at = np.repeat(np.arange(len(left)), n)
            child = np.array([xxhash.xxh3_64_intdigest(b"%d %d" % (key[0], c)) >> 1 for c in np.concatenate(own).tolist()], np.int64)
            return pd.DataFrame({"shard": child, "node": left["node"].to_numpy()[at], "v": left["v"].to_numpy()[at]})

        got = rows.groupBy("shard", "salt").cogroup(centres.groupBy("shard", "salt")).applyInPandas(deal, "shard long, node long, v array<double>")
        flat = scratch.keep(flat.join(big, "shard", "left_anti").unionByName(got), "dealt")


def _search(nodes: DataFrame, least: float, scratch: Scratch) -> DataFrame:
    """(node) of the nodes for which a search of some shard found a partner."""
    total = nodes.count()
    k = max(1, -(-total // SHARD))
    fit = drawn(nodes, FIT_ROWS, SEED)
    centres = scratch.spark.sparkContext.broadcast(k_means(fit, min(k, max(1, len(fit) // 8))))

    @F.pandas_udf("array<long>")
    def shards(v):
        import pandas as pd

        return pd.Series(assign(unit_rows(np.array(v.tolist(), float)), centres.value)) if len(v) else pd.Series([], dtype=object)

    flat = scratch.keep(nodes.select(F.explode(shards("v")).alias("shard"), "node", "v"), "dealt")
    flat = split_large(flat, scratch)

    def build(key, pdf):
        import pandas as pd

        pdf = pdf.sort_values("node")
        x, ids = unit_rows(np.array(pdf["v"].tolist(), float)), pdf["node"].to_numpy()
        lists = build_lists(x)
        return pd.DataFrame({"node": ids, "near": [ids[r[r >= 0]] for r in lists]})

    lists = flat.groupBy("shard").applyInPandas(build, "node long, near array<long>")
    united = scratch.keep(lists.groupBy("node").agg(F.array_distinct(F.flatten(F.collect_list("near"))).alias("near")), "lists")

    def search(key, pdf):
        import pandas as pd

        pdf = pdf.sort_values("node").reset_index(drop=True)
        x, ids = unit_rows(np.array(pdf["v"].tolist(), float)), pdf["node"].to_numpy()
        place = {i: k for k, i in enumerate(ids.tolist())}
        local = [{place[j] for j in near if j in place} for near in pdf["near"]]
        for i, own in enumerate(list(map(list, local))):
            for j in own:
                local[j].add(i)
        found = range_search(x, [np.array(sorted(s - {i}), np.int64) for i, s in enumerate(local)], least)
        raw = np.array(pdf["v"].tolist(), float)
        norm = np.sqrt((raw * raw).sum(1))
        has = np.zeros(len(ids), bool)
        for i, own in enumerate(found):
            own = own[(raw[own] @ raw[i]) / (norm[own] * norm[i]) >= least]
            has[own] = True
            has[i] |= len(own) > 0
        return pd.DataFrame({"node": ids[has]})

    return flat.join(united, "node").groupBy("shard").applyInPandas(search, "node long").distinct()


def compare_block(r_node, r_raw, r_copies, v_node, v_raw, v_copies, same, least: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(nodes, roots, n) of residents r and visitors v of a block: their links, in double precision.

    same: for each visitor whether the block belongs to its own cell; such a pair counts once, by the order of nodes."""
    r_norm, v_norm = (np.sqrt((x * x).sum(1)) for x in (r_raw, v_raw))
    r_n, v_n = np.zeros(len(r_node)), np.zeros(len(v_node))
    nodes = np.unique(np.concatenate([r_node, v_node]))
    r_at, v_at = np.searchsorted(nodes, r_node), np.searchsorted(nodes, v_node)
    label = np.arange(len(nodes))
    for first in range(0, len(v_node), STEP):
        part = slice(first, first + STEP)
        hit = (v_raw[part] @ r_raw.T) / (v_norm[part, None] * r_norm) >= least
        hit &= ~same[part, None] | (v_node[part, None] > r_node)
        if not hit.any():
            continue
        weight = hit.astype(float)
        v_n[part] += weight @ r_copies
        r_n += v_copies[part] @ weight
        for i in np.flatnonzero(hit.any(1)):
            met = np.unique(np.append(label[r_at[hit[i]]], label[v_at[first + i]]))
            if len(met) > 1:
                label[np.isin(label, met)] = met[0]
    n = np.bincount(r_at, r_n, len(nodes)) + np.bincount(v_at, v_n, len(nodes))
    own = np.flatnonzero(n)
    return nodes[own], nodes[label[own]], n[own].astype(np.int64)


def compare_cells(rows: DataFrame, least: float, scratch: Scratch) -> DataFrame:
    """(node, root, n) of the links among rows (node, v, copies), none of them lost: how many rows a node links with, and
    a node that it is joined with.

    Each node belongs to the cell of its nearest centre and visits the cells that can hold a node within the range: its
    distance from the plane between two cells is at most the range's, and so is its distance from the ball of the
    other cell. Of two cells only one's nodes visit the other."""
    spark = scratch.spark
    rows = scratch.keep(rows, "cells")
    total = rows.count()
    if not total:
        return rows.select("node", F.col("node").alias("root"), F.col("copies").alias("n"))
    fit = drawn(rows, FIT_ROWS, SEED)
    centres = k_means(fit, min(-(-total // CELL), max(1, len(fit) // 8)))
    told = spark.sparkContext.broadcast(centres)

    @F.pandas_udf("struct<cell:long,angle:double>")
    def home(v):
        import pandas as pd

        near = unit_rows(np.array(v.tolist(), float)) @ told.value.T if len(v) else np.zeros((0, 1))
        return pd.DataFrame({"cell": near.argmax(1), "angle": np.arccos(np.clip(near.max(1), -1, 1))})

    rows = scratch.keep(rows.withColumn("h", home("v")).select("*", "h.cell", "h.angle").drop("h"), "homes")
    sizes, radius = np.zeros(len(centres), np.int64), np.full(len(centres), -10.0)
    for cell, size, angle in rows.groupBy("cell").agg(F.count("*"), F.max("angle")).collect():
        sizes[cell], radius[cell] = size, angle
    reach, sine = np.arccos(np.clip(least, -1, 1)), np.sqrt(1 - least * least) if least >= 0 else 1.0
    balls = spark.sparkContext.broadcast(radius)

    @F.pandas_udf("array<long>")
    def visits(v, cell):
        import pandas as pd

        if not len(v):
            return pd.Series([], dtype=object)
        c, own = told.value, cell.to_numpy()
        near = unit_rows(np.array(v.tolist(), float)) @ c.T
        # Squared gaps between centres by cosines of units; a centre's own length is one.
        gap = np.sqrt(np.maximum((c[own] ** 2).sum(1)[:, None] + (c**2).sum(1) - 2 * c[own] @ c.T, 0))
        fits = near.max(1)[:, None] - near <= sine * gap + 1e-7
        fits &= np.arccos(np.clip(near, -1, 1)) <= balls.value + reach + 1e-7
        at = np.arange(len(c))
        turn = ((own[:, None] + at) % 2 == 0) == (own[:, None] < at)
        return pd.Series([np.flatnonzero(x) for x in (fits & turn) | (own[:, None] == at)])

    rows = scratch.keep(rows.withColumn("visits", visits("v", "cell")).drop("angle"), "visits")
    came = {c: n for c, n in rows.select(F.explode("visits").alias("c")).groupBy("c").count().collect()}
    told_cells = [(int(c), max(1, -(-int(n) // BLOCK)), max(1, -(-came.get(c, 0) // VISITORS))) for c, n in enumerate(sizes) if n]
    cells = F.broadcast(spark.createDataFrame(told_cells, "cell long, salts long, parts long"))
    salted = F.pmod(F.xxhash64("node", F.lit(SEED + 4)), "salts").alias("salt")
    residents = rows.join(cells, "cell").select("cell", salted, F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("part"), "node", "v", "copies")
    # New names, so that the two sides of the cogroup are told apart.
    visitors = rows.select(*[F.col(c).alias(c) for c in rows.columns]).withColumnRenamed("cell", "own").withColumn("cell", F.explode("visits")).join(cells, "cell")
    chunk = F.pmod(F.xxhash64("node", F.lit(SEED + 5)), "parts").alias("part")
    visitors = visitors.select("cell", F.explode(F.sequence(F.lit(0).cast("long"), F.col("salts") - 1)).alias("salt"), chunk, "node", "v", "copies", (F.col("own") == F.col("cell")).alias("same"))

    def compare(left, right):
        import pandas as pd

        if not len(left) or not len(right):
            return pd.DataFrame({"node": [], "root": [], "n": []})
        sides = []
        for pdf in (left, right):
            sides += [pdf["node"].to_numpy(), np.array(pdf["v"].tolist(), float), pdf["copies"].to_numpy(float)]
        node, root, n = compare_block(*sides, right["same"].to_numpy(bool), least)
        return pd.DataFrame({"node": node, "root": root, "n": n})

    keys = ["cell", "salt", "part"]
    return residents.groupBy(*keys).cogroup(visitors.groupBy(*keys)).applyInPandas(compare, "node long, root long, n long")


def audit(nodes: DataFrame, linked: DataFrame, least: float) -> float:
    """Share of the true links that were found of up to AUDIT_ROWS nodes with links and as many of all: these nodes against
    all, in blocks. 1 where they have no link."""
    h = F.xxhash64("node", F.lit(SEED + 1))
    some = linked.where("n > 0").select("node").distinct()
    asked = [r for x in (nodes, nodes.join(some, "node", "left_semi")) for r in x.orderBy(h).select("node", "v").limit(AUDIT_ROWS).collect()]
    asked = list({r["node"]: r for r in asked}.values())
    told = nodes.sparkSession.sparkContext.broadcast([(r["node"], np.array(r["v"])) for r in asked])

    @F.pandas_udf("array<long>")
    def hits(node, v, copies):
        import pandas as pd

        out = np.zeros((len(v), len(told.value)), np.int64)
        size = v.map(len).to_numpy()
        for k, (own, q) in enumerate(told.value):
            same = np.flatnonzero((size == len(q)) & (node.to_numpy() != own))
            if len(same):
                x = np.array(v.iloc[same].tolist(), float)
                cos = x @ q / (np.sqrt((x * x).sum(1)) * np.sqrt(q @ q))
                out[same, k] = (cos >= least) * copies.to_numpy()[same]
        return pd.Series(list(out))

    true = nodes.select(F.posexplode(hits("node", "v", "copies")).alias("k", "n")).groupBy("k").agg(F.sum("n").alias("n"))
    truth = sum(r["n"] for r in true.collect())
    ids = [r["node"] for r in asked]
    got = linked.where(F.col("node").isin(ids)).agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    return float(got / truth) if truth else 1.0


def op5_vector_graph(spark, sf_dir):
    """All rows of embeddings."""
    return near_vectors(load(spark, sf_dir, "embeddings"))
