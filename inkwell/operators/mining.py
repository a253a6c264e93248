"""Cross-document mining: spaces, similarities, clusters, vocabularies, coupling, consensus and gaps.

Corpus-wide steps are joins and grouped aggregates over long tables. Greedy and iterative steps run on one collection,
a bounded set of documents (MOST_MEMBERS), inside a grouped map.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Members of one collection that dense, pairwise steps accept; a larger one is an error, not a sample.
MOST_MEMBERS = 2000


def long_vectors(vectors: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """id_col, dim, x."""
    return vectors.select(id_col, F.posexplode(vec_col).alias("dim", "x")).withColumn("x", F.col("x").cast("double"))


def unit(long: DataFrame, id_col: str) -> DataFrame:
    """Rows scaled to unit length; zero vectors stay."""
    norm = F.sqrt(F.sum(F.col("x") * F.col("x")).over(Window.partitionBy(id_col)))
    return long.withColumn("x", F.when(norm > 0, F.col("x") / norm).otherwise(F.col("x")))


def centroids(vectors: DataFrame, group: str, vec_col: str) -> DataFrame:
    """group, dim, x: sums of a group's vectors, of unit length. Sums combine before the shuffle."""
    return unit(long_vectors(vectors, group, vec_col).groupBy(group, "dim").agg(F.sum("x").alias("x")), group)


def mean_centred(long: DataFrame, id_col: str) -> DataFrame:
    """Without the collection's mean, of unit length."""
    mean = long.groupBy("dim").agg(F.avg("x").alias("mean"))
    return unit(long.join(mean, "dim").withColumn("x", F.col("x") - F.col("mean")).drop("mean"), id_col)


def pair_similarity(long: DataFrame, id_col: str) -> DataFrame:
    """a, b, sim of a collection's members, a < b."""
    x, y = (long.select(F.col(id_col).alias(k), "dim", F.col("x").alias(f"x{k}")) for k in "ab")
    return x.join(y, (x["dim"] == y["dim"]) & (x["a"] < y["b"])).groupBy("a", "b").agg(F.sum(F.col("xa") * F.col("xb")).alias("sim"))


def silhouette(vectors: DataFrame, id_col: str, label: str, vec_col: str) -> DataFrame:
    """Mean silhouette under 1 - cosine. Sums of unit vectors give every mean distance to a cluster, so no pair forms:
    n vectors and k clusters take n k dot products."""
    u = unit(long_vectors(vectors.select(F.col(id_col).alias("id"), F.col(label).alias("label"), vec_col).select(F.struct("id", "label").alias("k"), vec_col), "k", vec_col), "k")
    u = u.select(F.col("k.id").alias("id"), F.col("k.label").alias("label"), "dim", "x")
    sums = u.groupBy("label", "dim").agg(F.sum("x").alias("s")).withColumnRenamed("label", "other")
    size = vectors.groupBy(F.col(label).alias("other")).agg(F.count("*").alias("n"))
    d = u.join(sums, "dim").groupBy("id", "label", "other").agg(F.sum(F.col("x") * F.col("s")).alias("t")).join(F.broadcast(size), "other")
    own = F.col("label") == F.col("other")
    # A member's own term, cosine 1, leaves its cluster's sum.
    mean = F.when(own, F.when(F.col("n") > 1, (F.col("n") - 1 - (F.col("t") - 1)) / (F.col("n") - 1))).otherwise((F.col("n") - F.col("t")) / F.col("n"))
    m = d.groupBy("id").agg(F.max(F.when(own, mean)).alias("a"), F.min(F.when(~own, mean)).alias("b"))
    s = F.when(F.col("a").isNull() | F.col("b").isNull(), 0.0).otherwise((F.col("b") - F.col("a")) / F.greatest("a", "b"))
    return m.agg(F.avg(s).alias("silhouette"))


def class_tfidf(counts: DataFrame) -> DataFrame:
    """cls, term, n, weight = tf / total * ln(1 + A / f), A the mean total; counts: (cls, term, n)."""
    total = counts.groupBy("cls").agg(F.sum("n").alias("total"))
    mean = total.agg(F.avg("total").alias("mean"))
    f = counts.groupBy("term").agg(F.sum("n").alias("f"))
    w = F.col("n") / F.col("total") * F.log(1 + F.col("mean") / F.col("f"))
    return counts.join(f, "term").join(total, "cls").crossJoin(F.broadcast(mean)).select("cls", "term", "n", w.alias("weight"))


def grams(docs: DataFrame, cls: Column, tokens: Column) -> DataFrame:
    """cls, term, n of unigrams and bigrams."""
    told = docs.select(cls.alias("cls"), tokens.alias("t"))
    pairs = F.transform(F.sequence(F.lit(1), F.greatest(F.size("t") - 1, F.lit(1))), lambda i: F.concat_ws(" ", F.element_at("t", i), F.element_at("t", i + 1)))
    both = F.when(F.size("t") > 1, F.concat("t", pairs)).otherwise(F.col("t"))
    return told.select("cls", F.explode(both).alias("term")).groupBy("cls", "term").agg(F.count("*").alias("n"))


def shared_terms(counts: DataFrame, limit: int = 6) -> DataFrame:
    """Terms of at least max(2, half) of the classes: term, df, n; by df * 1000 + count."""
    classes = counts.agg(F.greatest(F.lit(2), F.ceil(F.countDistinct("cls") / 2)).alias("least"))
    t = counts.groupBy("term").agg(F.count("*").alias("df"), F.sum("n").alias("n")).crossJoin(F.broadcast(classes))
    return t.where("df >= least").orderBy(F.desc(F.col("df") * 1000 + F.col("n")), "term").limit(limit).select("term", "df", "n")


# Coupling.


def coupling(cites: DataFrame) -> DataFrame:
    """a, b, shared, jaccard of documents by the works they cite; cites: (doc, work), repeated rows count once."""
    c = cites.distinct()
    size = c.groupBy("doc").agg(F.count("*").alias("size"))
    x, y = (c.select(F.col("doc").alias(k), "work") for k in "ab")
    got = x.join(y, "work").where("a < b").groupBy("a", "b").agg(F.count("*").alias("shared"))
    got = got.join(size.select(F.col("doc").alias("a"), F.col("size").alias("na")), "a").join(size.select(F.col("doc").alias("b"), F.col("size").alias("nb")), "b")
    return got.select("a", "b", "shared", (F.col("shared") / (F.col("na") + F.col("nb") - F.col("shared"))).alias("jaccard"))


def direct_citations(references: DataFrame, papers: DataFrame) -> DataFrame:
    """citing, cited where any key of a reference is a key of another paper. Both: (doc, keys array)."""
    r = references.select(F.col("doc").alias("citing"), F.explode("keys").alias("key"))
    p = papers.select(F.col("doc").alias("cited"), F.explode("keys").alias("key"))
    return r.join(p, "key").where("citing <> cited").select("citing", "cited").distinct()


def canonical(keys: DataFrame) -> DataFrame:
    """key, work: keys that occur together in a record name one work, transitively, by its smallest key.

    keys: (record, key). Minimum labels spread between records and keys until nothing changes; each round is two
    grouped minima and joins, and is written to the shared folder."""
    from inkwell.session import materialize

    edges = materialize(keys.distinct(), "canonical")
    label = edges.groupBy("key").agg(F.min("key").alias("work"))
    while True:
        rec = edges.join(label, "key").groupBy("record").agg(F.min("work").alias("work"))
        new = materialize(edges.join(rec, "record").groupBy("key").agg(F.min("work").alias("work")), "canonical")
        changed = new.join(label.withColumnRenamed("work", "was"), "key").where("work <> was")
        if changed.isEmpty():
            return new
        label = new


# Greedy and iterative steps on one collection.


def average_linkage(distance: np.ndarray) -> list[tuple[int, int, float]]:
    """UPGMA merges (a, b, distance), clusters named by their first member; of equal distances the lowest pair."""
    n = len(distance)
    d = np.where(np.eye(n, dtype=bool), np.inf, np.array(distance, float))
    size, alive, out = np.ones(n), np.ones(n, bool), []
    for _ in range(n - 1):
        open_ = np.where(alive[:, None] & alive[None, :], d, np.inf)
        a, b = divmod(int(np.argmin(open_)), n)
        a, b = min(a, b), max(a, b)
        out.append((a, b, float(d[a, b])))
        joint = (size[a] * d[a] + size[b] * d[b]) / (size[a] + size[b])
        d[a], d[:, a] = joint, joint
        d[a, a] = np.inf
        size[a] += size[b]
        alive[b] = False
    return out


def cut_tree(merges: list[tuple[int, int, float]], n: int, k: int | None = None, at: float | None = None) -> np.ndarray:
    """Labels by first appearance, of k clusters or of merges up to a distance."""
    take = [m for m in merges if m[2] <= at] if at is not None else merges[: max(0, n - k)]
    root = list(range(n))
    for a, b, _ in take:
        root = [a if r == b else r for r in root]
    seen: dict[int, int] = {}
    return np.array([seen.setdefault(r, len(seen)) for r in root])


def silhouette_of(distance: np.ndarray, labels: np.ndarray) -> float:
    """Mean silhouette; singletons are 0 and count; 0 for one cluster or as many as members."""
    n, kinds = len(labels), np.unique(labels)
    if len(kinds) < 2 or len(kinds) >= n:
        return 0.0
    total = 0.0
    for i in range(n):
        own = labels == labels[i]
        if own.sum() < 2:
            continue
        a = distance[i][own].sum() / (own.sum() - 1)
        b = min(distance[i][labels == k].mean() for k in kinds if k != labels[i])
        total += (b - a) / max(a, b) if max(a, b) > 0 else 0.0
    return total / n


def choose_clusters(similarity: np.ndarray, most: int = 6, margin: float = 0.01) -> tuple[np.ndarray, float]:
    """Labels and silhouette: k from 2, a larger k only where it wins by the margin; two members or fewer stay apart."""
    n = len(similarity)
    if n <= 2:
        return np.arange(n), 0.0
    distance = np.maximum(0, 1 - similarity)
    np.fill_diagonal(distance, 0)
    merges = average_linkage(distance)
    best, score = cut_tree(merges, n, 2), -2.0
    for k in range(2, min(most, n - 1) + 1):
        labels = cut_tree(merges, n, k)
        s = silhouette_of(distance, labels)
        if s > score + (margin if score > -2 else 0):
            best, score = labels, s
    return best, score


def classical_mds(similarity: np.ndarray) -> np.ndarray:
    """Two coordinates of each member from double-centred squared distances, scaled to -1..1."""
    d2 = np.maximum(0, 1 - similarity) ** 2
    n = len(d2)
    j = np.eye(n) - 1 / n
    values, vectors = np.linalg.eigh(-0.5 * j @ d2 @ j)
    top = np.argsort(-values)[:2]
    x = vectors[:, top] * np.sqrt(np.maximum(0, values[top]))
    x = x * np.where(x[np.argmax(np.abs(x), axis=0), range(x.shape[1])] < 0, -1, 1)
    return x / max(1e-12, np.abs(x).max())


def cluster_collections(vectors: DataFrame, group: str, id_col: str, vec_col: str) -> DataFrame:
    """group, id, cluster, silhouette, x, y of every member of each collection: mean-centred cosine, average linkage,
    the chosen number of clusters and a map. A collection beyond MOST_MEMBERS is an error."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        if len(pdf) > MOST_MEMBERS:
            raise ValueError(f"a collection has {len(pdf)} members; {MOST_MEMBERS} are allowed")
        pdf = pdf.sort_values("id")
        v = np.array(pdf["v"].tolist(), float)
        u = v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-12)
        if len(u) >= 3:
            u = u - u.mean(0)
            u = u / np.maximum(np.linalg.norm(u, axis=1, keepdims=True), 1e-12)
        sim = u @ u.T
        labels, score = choose_clusters(sim)
        xy = classical_mds(sim) if len(u) > 1 else np.zeros((len(u), 2))
        return pd.DataFrame({"grp": pdf["grp"], "id": pdf["id"], "cluster": labels, "silhouette": score, "x": xy[:, 0], "y": xy[:, 1]})

    own = vectors.select(F.col(group).cast("string").alias("grp"), F.col(id_col).cast("long").alias("id"), F.col(vec_col).alias("v"))
    return own.groupBy("grp").applyInPandas(run, "grp string, id long, cluster long, silhouette double, x double, y double")


def consensus_stars(pairs: DataFrame, limit: int = 6) -> DataFrame:
    """centre, member, sim of greedy disjoint stars: the sentence that most other papers support, then by mean
    strength. pairs: (collection, a, paper_a, b, paper_b, sim), both directions, above the threshold.

    The best match of each other paper is a grouped argmax; the greedy choice runs on a collection's few stars."""
    best = pairs.where("paper_a <> paper_b").groupBy("collection", "a", "paper_a", "paper_b").agg(F.max_by("b", F.struct("sim", -F.col("b"))).alias("b"), F.max("sim").alias("sim"))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        used: set[int] = set()
        out = []
        stars = {a: s.sort_values("b") for a, s in pdf.groupby("a")}
        for _ in range(limit):
            ranked = []
            for a, s in stars.items():
                free = s[~s["b"].isin(used)]
                if a not in used and len(free):
                    ranked.append((-free["paper_b"].nunique(), -round(free["sim"].mean(), 9), a))
            if not ranked:
                break
            centre = min(ranked)[2]
            free = stars[centre][~stars[centre]["b"].isin(used)]
            out.append(pd.DataFrame({"collection": pdf["collection"].iloc[0], "centre": centre, "member": free["b"], "sim": free["sim"]}))
            used |= {centre, *free["b"]}
        return pd.concat(out) if out else pd.DataFrame({"collection": [], "centre": [], "member": [], "sim": []})

    return best.groupBy("collection").applyInPandas(run, "collection string, centre long, member long, sim double")


def unaddressed_gaps(gaps: DataFrame, claims: DataFrame, sims: DataFrame, least: float) -> DataFrame:
    """gaps (gap, paper) that no other paper's claim (claim, paper) addresses; sims: (gap, claim, sim)."""
    hit = sims.where(F.col("sim") >= least).join(claims.withColumnRenamed("paper", "by"), "claim").select("gap", "by")
    return gaps.join(hit, (gaps["gap"] == hit["gap"]) & (gaps["paper"] != hit["by"]), "left_anti")
