"""Evidence, reports and collection helpers: gains, questions, limitations, caps, merged maps, mentions, phrase likeness."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from inkwell.session import spread

#: A lexicon that comes with the engine: names, other spellings and domains of public data sets; a parameter everywhere.
LEXICON = [
    ("ImageNet", "ILSVRC", "vision"), ("CIFAR-10", "CIFAR10", "vision"), ("CIFAR-100", "CIFAR100", "vision"), ("MNIST", "", "vision"), ("COCO", "MS COCO|Microsoft COCO", "vision"), ("ADE20K", "", "vision"), ("Cityscapes", "", "vision"),
    ("KITTI", "", "vision"), ("Pascal VOC", "VOC 2012", "vision"), ("Visual Genome", "", "vision"), ("VQA", "VQAv2", "vision"), ("SQuAD", "SQuAD 2.0|SQuADv2", "language"), ("GLUE", "", "language"), ("SuperGLUE", "", "language"),
    ("MNLI", "MultiNLI", "language"), ("SNLI", "", "language"), ("WikiText-103", "WikiText103", "language"), ("Penn Treebank", "PTB", "language"), ("LAMBADA", "", "language"), ("HellaSwag", "", "language"), ("WinoGrande", "", "language"),
    ("PIQA", "", "language"), ("BoolQ", "", "language"), ("MMLU", "", "language"), ("BIG-bench", "BBH", "language"), ("TriviaQA", "", "language"), ("Natural Questions", "NQ", "language"), ("HotpotQA", "Hotpot QA", "language"),
    ("FEVER", "", "language"), ("TruthfulQA", "", "language"), ("XSum", "", "language"), ("CNN/DailyMail", "CNN-DM", "language"), ("WMT14", "WMT 2014", "translation"), ("WMT16", "WMT 2016", "translation"), ("FLORES-200", "FLORES", "translation"),
    ("GSM8K", "GSM-8K", "math"), ("MATH", "", "math"), ("HumanEval", "Human Eval", "code"), ("MBPP", "", "code"), ("SWE-bench", "SWEbench", "code"), ("LibriSpeech", "Libri Speech", "speech"), ("Common Voice", "", "speech"), ("VoxCeleb", "", "speech"),
    ("MS MARCO", "MSMARCO", "retrieval"), ("BEIR", "", "retrieval"), ("LongBench", "", "language"), ("MovieLens", "MovieLens-1M", "recommendation"), ("OGB", "", "graphs"), ("Cora", "", "graphs"), ("MIMIC-III", "MIMIC", "medicine"), ("PubMedQA", "", "medicine"),
]


def lexicon_rows(spark, lexicon=LEXICON) -> DataFrame:
    """key (letters and digits in lower case), name, domain of every spelling."""
    rows = {}
    for name, others, domain in lexicon:
        for spelling in (name, *filter(None, others.split("|"))):
            rows.setdefault("".join(c for c in spelling.lower() if c.isalnum()), (name, domain))
    return spark.createDataFrame([(k, *v) for k, v in rows.items()], "key string, name string, domain string")


def mentions(sentences: DataFrame, lexicon: DataFrame, keys: list[str], text: str = "text", longest: int = 4) -> DataFrame:
    """keys, name, domain, n: how often a text names an entry, spaces and hyphens free. Runs of up to so many words meet the
    spellings by an equi-join on their letters and digits, not by one pattern an entry; a longer match hides those inside."""
    w = F.regexp_extract_all(text, F.lit(r"[\p{L}\p{N}]+"), F.lit(0))
    x = sentences.select(*keys, w.alias("w"))
    runs = F.flatten(F.transform(F.sequence(F.lit(1), F.greatest(F.size("w"), F.lit(1))), lambda i: F.transform(F.sequence(F.lit(1), F.lit(longest)), lambda k: F.struct(i.alias("at"), k.alias("k"), F.lower(F.array_join(F.slice("w", i, k), "")).alias("key")))))
    x = x.where(F.size("w") > 0).select(*keys, F.size("w").alias("all"), F.explode(runs).alias("r")).where("r.at + r.k - 1 <= all").select(*keys, "r.*")
    hit = x.join(lexicon, "key")
    longer = Window.partitionBy(*keys).orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    here = Window.partitionBy(*keys, "at")
    hit = hit.withColumn("best", F.max("k").over(here)).where("k = best").withColumn("reach", F.max(F.col("at") + F.col("k")).over(longer))
    return hit.where(F.col("reach").isNull() | (F.col("at") >= F.col("reach"))).groupBy(*keys, "name", "domain").agg(F.count("*").alias("n"))


def smallest_gain(metrics: DataFrame, keys: list[str]) -> DataFrame:
    """keys, value, unit of the smallest positive gain in points: rows value, unit, direction."""
    x = metrics.where("value > 0 and (unit in ('pp', 'points') or (unit = '%' and direction = 'up'))")
    return x.groupBy(*keys).agg(F.min(F.struct("value", "unit")).alias("g")).select(*keys, "g.value", "g.unit")


def reviewer_questions(findings: DataFrame, doc: str = "doc_id") -> DataFrame:
    """doc, position, question: one for each finding that is no strength, gravest first, max(5, min(8, n + 2)) at most."""
    x = findings.where("severity <> 'strength'")
    n = F.count("*").over(Window.partitionBy(doc))
    place = F.row_number().over(Window.partitionBy(doc).orderBy("position"))
    x = x.withColumns({"n": n, "place": place}).where(F.col("place") <= F.greatest(F.lit(5), F.least(F.lit(8), F.col("n") + 2)))
    return x.select(doc, F.col("place").alias("position"), F.concat(F.lit("Could the authors respond to this: "), F.lower(F.substring("title", 1, 1)), F.substr("title", F.lit(2)), F.lit("?")).alias("question"))


def detected_limitations(docs: DataFrame, findings: DataFrame, doc: str = "doc_id", most: int = 5) -> DataFrame:
    """doc, rank, text: grave findings first; a document without any has one general caveat, so the list is never empty."""
    x = findings.where("severity in ('major', 'moderate')")
    x = x.withColumn("rank", F.row_number().over(Window.partitionBy(doc).orderBy("position"))).where(F.col("rank") <= most)
    out = docs.select(doc).distinct().join(x.select(doc, "rank", F.col("title").alias("text")), doc, "left")
    return out.select(doc, F.coalesce("rank", F.lit(1)).alias("rank"), F.coalesce("text", F.lit("No rule found a weakness; the rules read wording, not substance")).alias("text"))


def distinct_evidence(evidence: DataFrame, keys: list[str], by: list[str], order: str) -> DataFrame:
    """The first row, in order, of each piece of evidence."""
    nth = F.row_number().over(Window.partitionBy(*keys, *by).orderBy(order))
    return evidence.withColumn("nth", nth).where("nth = 1").drop("nth")


def capped(evidence: DataFrame, keys: list[str], order: str, most: int) -> DataFrame:
    """The first rows of each list: a cap that is the feature."""
    return evidence.withColumn("nth", F.row_number().over(Window.partitionBy(*keys).orderBy(order))).where(F.col("nth") <= most).drop("nth")


def fresh(candidates: DataFrame, used: DataFrame, keys: list[str], item: str, least: int = 2) -> DataFrame:
    """Candidates that are not used yet, where at least so many of a list remain; else the whole list."""
    u = used.select(*keys, item).distinct().withColumn("used", F.lit(True))
    x = candidates.join(u, [*keys, item], "left").withColumn("left_over", F.sum(F.col("used").isNull().cast("int")).over(Window.partitionBy(*keys)))
    return x.where(F.col("used").isNull() | (F.col("left_over") < least)).drop("used", "left_over")


def merged_counts(*tables: DataFrame, keys: list[str], count: str = "n") -> DataFrame:
    """Counts of several tables added by key."""
    out = tables[0].select(*keys, count)
    for t in tables[1:]:
        out = out.unionByName(t.select(*keys, count))
    return out.groupBy(*keys).agg(F.sum(count).alias(count))


#: Bytes by which links are looked up at first, those of shorter ones by all of theirs; log2 of the slots of the filter of
#: links at most (64 MB); bytes of text that are looked through at a time, about.
ANCHOR, FILTER, CHUNK = 8, 29, 1 << 20
_BASE = 0x9E3779B97F4A7C15
_BACK = pow(_BASE, -1, 1 << 64)


class _Windows:
    """64-bit hashes of any windows of some bytes, from sums of their powers modulo 2^64."""

    def __init__(self, raw: bytes):
        n = len(raw)
        up, self.down = (np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(n, k, np.uint64)])) for k in (np.uint64(_BASE), np.uint64(_BACK)))
        self.sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum((np.frombuffer(raw, np.uint8).astype(np.uint64) + np.uint64(1)) * up[:n])])

    def at(self, starts: np.ndarray, sizes) -> np.ndarray:
        h = (self.sums[starts + sizes] - self.sums[starts]) * self.down[starts]
        h = (h ^ (h >> np.uint64(31))) * np.uint64(0xC2B2AE3D27D4EB4F)
        return h ^ (h >> np.uint64(29))


def _link_hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links to (size, h): their bytes, and the hashes of the whole and of its first ANCHOR bytes."""
    for b in batches:
        raw = [u.encode() for u in b.column(0).to_pylist()]
        sizes = np.array(list(map(len, raw)), np.int64)
        w, starts = _Windows(b"".join(raw)), np.cumsum(sizes) - sizes
        h = np.concatenate([w.at(starts, sizes), w.at(starts, np.minimum(sizes, ANCHOR))])
        yield pa.RecordBatch.from_pydict({"size": pa.array(np.tile(sizes, 2)), "h": pa.array(h.view(np.int64))})


def _links_in(wanted):
    """(doc, page, text) to (doc, page, url): each substring of a text that the filter takes for a link, once a text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        log, bits, sizes = wanted.value

        def known(h):
            slot = (h >> np.uint64(64 - log)).astype(np.int64)
            return ((bits[slot >> 3] >> (slot & 7).astype(np.uint8)) & 1).astype(bool)

        def search(texts: list[bytes]) -> Iterator[tuple[int, bytes]]:
            raw, ends = b"".join(texts), np.cumsum([len(t) for t in texts])
            w = _Windows(raw)
            for anchor in sorted({min(k, ANCHOR) for k in sizes}):
                if not anchor:
                    yield from ((i, b"") for i in range(len(texts)))
                    continue
                hit = np.arange(max(0, len(raw) - anchor + 1))
                hit = hit[known(w.at(hit, anchor))]
                owner = np.searchsorted(ends, hit, "right")
                for k in (k for k in sizes if min(k, ANCHOR) == anchor):
                    fits = hit + k <= ends[owner]
                    at, own = hit[fits], owner[fits]
                    good = known(w.at(at, k))
                    yield from {(i, raw[p : p + k]) for i, p in zip(own[good].tolist(), at[good].tolist(), strict=True)}

        for b in batches:
            texts, first, held = [], 0, 0
            rows, urls = [], []
            for i, t in enumerate(b.column(2).to_pylist()):
                texts.append(t.encode())
                held += len(texts[-1])
                if held > CHUNK or i + 1 == b.num_rows:
                    for k, url in search(texts):
                        try:  # what is cut inside a character is no link
                            urls.append(url.decode())
                            rows.append(first + k)
                        except UnicodeDecodeError:
                            pass
                    texts, first, held = [], i + 1, 0
            at = pa.array(rows, pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(0).take(at), b.column(1).take(at), pa.array(urls, pa.string())], ["doc", "page", "url"])

    return run


def link_pages(links: DataFrame, pages: DataFrame) -> DataFrame:
    """doc, url, page: the first page whose text has the link.

    Every text is read once, past a filter of all links (of 64 MB at most) by hashes of its windows that are as long as a
    link; what passes is joined with the links by document and link, so no page meets a link that it may not hold."""
    spark = links.sparkSession
    own = links.where(F.col("doc").isNotNull() & F.col("url").isNotNull()).select("doc", "url").distinct()
    hashed = own.select("url").distinct().mapInArrow(_link_hashes, "size long, h long")
    many = {r["size"]: r["count"] for r in hashed.groupBy("size").count().collect()}
    log = int(min(FILTER, max(15, np.ceil(np.log2(max(1, sum(many.values())) * 32)))))
    bits, slot = np.zeros((1 << log) // 8, np.uint8), F.shiftrightunsigned("h", 64 - log) + 1
    parts = hashed.groupBy(F.bitmap_bucket_number(slot).alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(slot)).alias("bits"))
    for r in parts.toLocalIterator():
        at = (r["bucket"] - 1) * 4096
        bits[at : at + 4096] = np.frombuffer(r["bits"], np.uint8)
    wanted = spark.sparkContext.broadcast((log, bits, sorted(many)))
    doc, page = (pages.schema[c].dataType.simpleString() for c in ("doc", "page"))
    texts = spread(pages.where(F.col("doc").isNotNull() & F.col("text").isNotNull()).select("doc", "page", "text"))
    met = texts.mapInArrow(_links_in(wanted), f"doc {doc}, page {page}, url string")
    return met.groupBy("doc", "url").agg(F.min("page").alias("page")).join(own, ["doc", "url"])


def fallback_text(sentences: Column, abstract: Column, title: Column) -> Column:
    """The sentences joined, else the abstract, else the title."""
    return F.coalesce(F.nullif(F.array_join(sentences, " "), F.lit("")), F.nullif(abstract, F.lit("")), title)


def duration(ms: Column) -> Column:
    """640 ms, 3.2 s or 2 min 5 s."""
    whole = F.floor(ms / 1000 + 0.5).cast("long")
    return F.when(ms < 1000, F.concat(F.floor(ms + 0.5).cast("string"), F.lit(" ms"))).when(ms < 60000, F.concat(F.format_string("%.1f", F.floor(ms / 100 + 0.5) / 10), F.lit(" s"))).otherwise(
        F.concat((whole / 60).cast("long").cast("string"), F.lit(" min "), (whole % 60).cast("string"), F.lit(" s"))
    )


def near_phrases(a: Column, b: Column) -> Column:
    """Whether two phrases (arrays of stems) say the same: the same words in any order, or half of their words shared, or one
    is the initials of the other."""
    shared = F.size(F.array_intersect(a, b)) / F.size(F.array_union(a, b))
    initials = lambda x: F.array_join(F.transform(x, lambda w: F.substring(w, 1, 1)), "")
    acronym = lambda x, y: (F.size(x) == 1) & (F.size(y) > 1) & (F.get(x, F.lit(0)) == initials(y))
    return (F.array_sort(a) == F.array_sort(b)) | (shared >= 0.5) | acronym(a, b) | acronym(b, a)


def progress(jobs: DataFrame, keys: list[str], steps: int = 9) -> DataFrame:
    """keys, done, failed, share of a queue's steps: at most 0.97 until all are done. jobs: keys, status."""
    x = jobs.groupBy(*keys).agg(F.sum((F.col("status") == "done").cast("int")).alias("done"), F.sum((F.col("status") == "failed").cast("int")).alias("failed"))
    return x.withColumn("share", F.when(F.col("done") >= steps, 1.0).otherwise(F.least(F.lit(0.97), F.col("done") / steps)))
