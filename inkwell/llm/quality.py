"""Quality classifier: hierarchical empirical Bayes over document evidence, paths and hosts.

A logistic model over text statistics gives each document's evidence. Grouped aggregation turns the evidence into
posteriors of hosts and of paths below them: sparse hosts shrink toward the global rate, sparse paths toward their
host, by strengths estimated from the spread of sites about the mean of the level above. Labelled documents count in their
sites by their label. A document's own evidence is left out of its sites'.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StructType

from inkwell.llm.common import attach
from inkwell.session import Scratch, load

#: Labelled rows that the logistic model is fitted on at most: those with the smallest hash of their id.
FIT_ROWS = 20_000
KEEP_FROM, RIDGE, LEAST_P = 0.5, 1.0, 1e-4
FEATURES = (
    "log_bytes", "letters", "upper", "digits", "marks", "bangs", "bars", "high", "lines", "word_length", "distinct_words",
    "repeated_lines", "log_words", "longest_word", "stops",
)


@lru_cache(1)
def byte_classes() -> np.ndarray:
    """256 x 8 indicator of byte classes: letters (and all bytes of other scripts), capitals, digits, sentence marks,
    odd symbols, '!', '|', line breaks."""
    out = np.zeros((256, 8))
    for i in range(256):
        c = chr(i)
        out[i] = [c.isascii() and c.isalpha() or i > 127, "A" <= c <= "Z", "0" <= c <= "9", c in ".,;:?", c in "#$%&*@^~=+<>{}[]\\_/", c == "!", c == "|", c == "\n"]
    return out


def features(text: str) -> list[float]:
    data = text.encode()
    n = max(1, len(data))
    hist = np.bincount(np.frombuffer(data, np.uint8), minlength=256)
    letters, upper, digits, stops, odd, bangs, bars, breaks = (hist @ byte_classes()).tolist()
    words = text.lower().split()
    k = max(1, len(words))
    lines = [x for x in text.split("\n") if x.strip()]
    return [
        np.log1p(len(data)), letters / n, upper / max(1, letters), digits / n, odd / n, bangs / k, bars / k, float(hist[128:].sum()) / n,
        breaks / k, letters / k, len(set(words)) / k, 1 - len(set(lines)) / max(1, len(lines)), np.log1p(len(words)),
        np.log1p(max(map(len, words), default=0)), stops / k,
    ]


def with_features(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """docs without its text, with x: array of FEATURES."""
    rest = [c for c in docs.columns if c != text_col]
    own = docs.select(text_col, *rest)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = [features(t or "") for t in b.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns[1:], pa.array(x, pa.list_(pa.float64()))], names=[*rest, "x"])

    return own.mapInArrow(run, StructType(list(own.select(*rest).schema.fields)).add("x", ArrayType(DoubleType())))


def fit_logistic(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Centre, scale and weights (intercept last) by ridge-penalised Newton steps on standardised, clipped features,
    with squares of them, so that both ends of a feature can count against a text."""
    centre, scale = x.mean(0), x.std(0) + 1e-9
    z = design(x, centre, scale)
    w = np.zeros(z.shape[1])
    penalty = np.full(len(w), RIDGE)
    penalty[-1] = 1e-6
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        step = np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + np.diag(penalty), z.T @ (y - p) - penalty * w)
        w += step * min(1.0, 5 / (np.abs(step).max() + 1e-12))
        if np.abs(step).max() < 1e-8:
            break
    return centre, scale, w


def design(x: np.ndarray, centre: np.ndarray, scale: np.ndarray) -> np.ndarray:
    z = np.clip((x - centre) / scale, -6, 6)
    return np.hstack([z, z * z, np.ones((len(z), 1))])


def logit(p: Column) -> Column:
    p = F.least(F.greatest(p, F.lit(LEAST_P)), F.lit(1 - LEAST_P))
    return F.log(p / (1 - p))


def between_strength(sites: DataFrame) -> float:
    """Prior weight, in documents, of the level above: from the spread of site means beyond what chance gives.

    sites: n, s, about (the mean of the level above). By the method of moments for a beta-binomial whose sites have the
    mean of their own level above, so the spread of hosts does not count again in that of their paths; within 1 and 1e6.
    """
    m = F.col("s") / F.col("n")
    noise = F.avg(F.col("about") * (1 - F.col("about")))
    k, n, nn, q, noise = sites.agg(F.count("*"), F.sum("n"), F.sum(F.col("n") * F.col("n")), F.sum(F.col("n") * (m - F.col("about")) ** 2), noise).first()
    if not k or k < 2 or n - nn / n <= 0:
        return 1e6
    spread = max(1e-12, (q - (k - 1) * noise) / (n - nn / n))
    return float(min(1e6, max(1.0, noise / spread - 1)))


def sample_of(rows: DataFrame, most: int) -> DataFrame:
    """At most `most` rows (h, x, y): those of the smallest hashes h. A threshold on h first keeps all but about twice that
    many rows from leaving their tasks, however many tasks there are."""
    total = rows.count()
    if total > 4 * most:
        span = 2**64 * (2 * most / total)
        rows = rows.where(F.col("h") < F.lit(int(-(2**63) + span)))
    return rows.orderBy("h", "x").limit(most)


def score_quality(docs: DataFrame, labels: DataFrame, host_col: str = "source", path: Column | None = None, id_col: str = "doc_id") -> DataFrame:
    """One row per document: id_col, doc_score, host_posterior, path_posterior, quality, keep.

    labels: (doc_id, quality); repeated labels of an id are averaged, null ones ignored. path: a site below the host.
    The corpus has no URLs, so the default host is its source and the default path the lang below it. Null hosts and
    paths are sites of their own, null texts are empty; repeated rows each count; very long texts are read whole; ties
    at the cut of the fitted rows go by hash, then features; other columns are not read. Without labels of both
    classes no document is told from another: every doc_score is 0.5 and all are kept. An empty table gives an empty
    result.

    A document's evidence in its sites is its label where it has one, else its doc_score; it is left out of the
    posteriors that it is scored with.
    """
    scratch = Scratch(docs.sparkSession)
    where = F.coalesce(F.col("lang") if path is None else path, F.lit(""))
    own = docs.select(F.col(id_col).alias("id"), "text", F.coalesce(F.col(host_col), F.lit("")).alias("host"), where.alias("path"))
    own = scratch.keep(with_features(own), "features")
    y = labels.where("quality is not null").groupBy(F.col("doc_id").alias("id")).agg((F.avg("quality") >= 0.5).cast("double").alias("y"))
    told = own.join(y, "id").select(F.xxhash64("id").alias("h"), "x", "y")
    fit = sample_of(scratch.keep(told, "labelled"), FIT_ROWS).toPandas()
    classes = set(fit["y"])
    if len(classes) == 2:
        centre, scale, w = fit_logistic(np.array(fit["x"].tolist(), float), fit["y"].to_numpy(float))

    @F.pandas_udf("double")
    def evidence(x):
        import pandas as pd

        if len(classes) < 2:
            return pd.Series(np.full(len(x), 0.5))
        z = design(np.array(x.tolist(), float).reshape(-1, len(FEATURES)), centre, scale) @ w
        return pd.Series(1 / (1 + np.exp(-np.clip(z, -30, 30))))

    p = own.select("id", "host", "path", evidence("x").alias("p")).join(y, "id", "left") if len(classes) == 2 else own.select("id", "host", "path", F.lit(0.5).alias("p"), F.lit(None).cast("double").alias("y"))
    p = scratch.keep(p.select("id", "host", "path", "p", F.round(F.coalesce("y", "p"), 9).alias("v")), "evidence")
    paths = scratch.keep(p.groupBy("host", "path").agg(F.count("*").alias("n"), F.sum("v").alias("s")), "paths")
    hosts = scratch.keep(paths.groupBy("host").agg(F.sum("n").alias("host_n"), F.sum("s").alias("host_s")), "hosts")
    total, soft = hosts.agg(F.sum("host_n"), F.sum("host_s")).first()
    rate = min(1 - LEAST_P, max(LEAST_P, (soft or 0.0) / (total or 1)))
    host_k = between_strength(hosts.select(F.col("host_n").alias("n"), F.col("host_s").alias("s"), F.lit(rate).alias("about")))
    path_k = between_strength(paths.join(hosts, "host").select("n", "s", (F.col("host_s") / F.col("host_n")).alias("about")))
    sites = paths.join(hosts, "host").withColumn("site", F.struct("host", "path")).drop("host", "path")
    out = attach(p.withColumn("site", F.struct("host", "path")), sites, "site")
    host_post = (F.col("host_s") - F.col("v") + host_k * rate) / (F.col("host_n") - 1 + host_k)
    path_post = (F.col("s") - F.col("v") + path_k * F.col("host_posterior")) / (F.col("n") - 1 + path_k)
    out = out.withColumn("host_posterior", host_post).withColumn("path_posterior", path_post)
    told = logit(F.col("p")) + logit(F.col("path_posterior")) - logit(F.lit(rate))
    quality = F.lit(0.5) if len(classes) < 2 else 1 / (1 + F.exp(-told))
    out = out.withColumn("quality", quality)
    out = out.select(F.col("id").alias(id_col), F.col("p").alias("doc_score"), "host_posterior", "path_posterior", "quality", (F.col("quality") >= KEEP_FROM).alias("keep"))
    out = scratch.keep(out, "scored")
    scratch.drop(but="scored")
    return out


def op1_quality_classifier(spark, sf_dir):
    """All whole texts of documents, fitted on labels."""
    return score_quality(load(spark, sf_dir, "documents"), load(spark, sf_dir, "labels"))


def stage(spark, docs, sf_dir):
    """Pipeline: documents of low quality go. It decides by id: of rows that share one, or have none, all stay where one
    does."""
    kept = score_quality(docs, load(spark, sf_dir, "labels")).where("keep").select("doc_id").distinct()
    return docs.join(kept, docs["doc_id"].eqNullSafe(kept["doc_id"]), "left_semi").select(*docs.columns)
