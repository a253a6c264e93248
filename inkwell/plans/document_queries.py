"""Registered queries of the document pipeline: quantities, zones, signals, rigor, findings, answers, structure, mining."""

from __future__ import annotations

from pyspark.sql import functions as F

from inkwell.functions import text as T
from inkwell.operators import answering, briefing, mining, quantities, review, structure, zoning
from inkwell.plans.text_queries import sentence_rows
from inkwell.session import load, materialize

QUERIES, SQL = {}, {}


def query(name, sql=None):
    def add(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


@query("extracted_metrics")
def extracted_metrics(spark, sf):
    x = sentence_rows(spark, sf).select("doc_id", "index", F.posexplode(quantities.metrics("text")).alias("pos", "m"))
    return x.select("doc_id", "index", "pos", "m.*")


@query("key_numbers")
def key_numbers(spark, sf):
    return quantities.key_numbers(sentence_rows(spark, sf))


def zoned(spark, sf):
    z = zoning.zone_sentences(sentence_rows(spark, sf))
    return materialize(z.select("doc_id", "section_id", "section_title", "section_kind", "index", "text", "zone", "confidence", "scores"), "zoned")


@query("zoned_sentences")
def zoned_sentences(spark, sf):
    z = zoned(spark, sf)
    return z.select("doc_id", "index", "zone", F.round("confidence", 6).alias("confidence"))


@query("zone_distribution")
def zone_distribution(spark, sf):
    return zoning.zone_counts(zoning.zone_sentences(sentence_rows(spark, sf)), documents=load(spark, sf, "documents"))


def _signals(spark, sf):
    return materialize(review.signals(zoned(spark, sf), documents=load(spark, sf, "documents")), "signals")


@query("rigor_profiles")
def rigor_profiles(spark, sf):
    return review.rigor(_signals(spark, sf))


@query("review_findings")
def review_findings(spark, sf):
    return review.findings(_signals(spark, sf))


@query("question_intents", "SELECT item_id, CASE WHEN regexp_matches(q, '(?i)limitation|weakness') THEN 'limitations' WHEN regexp_matches(q, '(?i)\\bhow many\\b') THEN 'results' ELSE 'factual' END AS intent FROM (SELECT item_id, CASE item_id % 3 WHEN 0 THEN 'What are the limitations?' WHEN 1 THEN 'How many?' ELSE 'Where was it made?' END AS q FROM benchmark)")
def question_intents(spark, sf):
    q = F.when(F.col("item_id") % 3 == 0, "What are the limitations?").when(F.col("item_id") % 3 == 1, "How many?").otherwise("Where was it made?")
    return load(spark, sf, "benchmark").select("item_id", answering.intent(q).alias("intent"))


@query("answers")
def answers(spark, sf):
    """Every whole benchmark passage is asked of the document with the same number."""
    q = load(spark, sf, "benchmark").select(F.col("item_id").alias("question_id"), F.col("item_id").alias("doc_id"), F.col("text").alias("question"))
    return answering.answer_questions(q, zoned(spark, sf))


def glyph_rows(spark, sf):
    """The lines of documents as positioned runs, one a line, 50 lines a page."""
    d = load(spark, sf, "documents").select(F.col("doc_id").alias("doc"), F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n")).alias("n", "text")).where("text <> ''")
    page, row = F.expr("n div 50").cast("long"), F.col("n") % 50
    return d.select("doc", page.alias("page"), "text", F.lit(50.0).alias("x"), (row * 14.0 + 50).alias("y"), F.least(F.lit(500.0), F.length("text") * 5.0).alias("width"), F.lit(10.0).alias("size"), (F.length("text") < 40).alias("bold"))


@query("document_lines", "WITH l AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) - 1 AS n FROM documents), t AS (SELECT doc_id AS doc, n // 50 AS page, n, trim(regexp_replace(line, '\\s+', ' ', 'g')) AS text FROM l) SELECT doc, page, row_number() OVER (PARTITION BY doc, page ORDER BY n) AS line, text, 0 AS \"column\" FROM t WHERE text <> ''")
def document_lines(spark, sf):
    return structure.lines_of(glyph_rows(spark, sf)).select("doc", "page", "line", "text", "column")


@query("document_sections")
def document_sections(spark, sf):
    return structure.sections(structure.lines_of(glyph_rows(spark, sf))).drop("text")


@query("body_sizes", "SELECT l_orderkey AS doc, max_by(size, (n, -size)) AS body FROM (SELECT l_orderkey, floor(l_quantity * 2 + 0.5) / 2 AS size, sum(len(l_returnflag || l_linestatus))::BIGINT AS n FROM lineitem GROUP BY 1, 2) GROUP BY 1")
def body_sizes(spark, sf):
    g = load(spark, sf, "lineitem").select(F.col("l_orderkey").alias("doc"), F.col("l_quantity").alias("size"), F.concat("l_returnflag", "l_linestatus").alias("text"))
    return structure.body_size(g)


@query("document_quality", "SELECT user_id AS doc, CASE WHEN avg(value) < 80 THEN 'image-only' WHEN avg(value) < 500 THEN 'degraded' ELSE 'good' END AS quality FROM events GROUP BY 1")
def document_quality(spark, sf):
    p = load(spark, sf, "events").select(F.col("user_id").alias("doc"), F.col("event_id").alias("page"), F.col("value").alias("chars"))
    return structure.quality(p).select("doc", "quality")


@query("rigor_credit", "SELECT l_orderkey, l_linenumber, round(CASE WHEN l_quantity > 0 THEN 1 - pow(2, -l_quantity / 20) ELSE 0 END, 9) AS credit, floor(1.96 * sqrt(0.25 / l_quantity) * 1000 + 0.5) / 10 AS margin FROM lineitem")
def rigor_credit(spark, sf):
    return load(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", F.round(review.credit(F.col("l_quantity"), 20), 9).alias("credit"), review.proportion_margin(F.col("l_quantity")).alias("margin"))


@query("embedding_clusters")
def embedding_clusters(spark, sf):
    """Collections of 50 vectors with neighbouring ids, each clustered and mapped. A collection is what a user puts together, so
    vectors of different ones are not compared."""
    v = load(spark, sf, "embeddings").withColumn("collection", F.expr("vec_id div 50"))
    return mining.cluster_collections(v, "collection", "vec_id", "embedding")


@query("consensus_stars")
def consensus_stars(spark, sf):
    """Vectors as claims, labels as papers; all claims of a collection, 100 vectors with neighbouring ids, are compared with one
    another, those of different collections are not."""
    from inkwell.operators.retrieval import cosine

    v = load(spark, sf, "embeddings").select(F.expr("vec_id div 100").cast("string").alias("collection"), "vec_id", "label", "embedding")
    x, y = v.select("collection", F.col("vec_id").alias("a"), F.col("label").alias("paper_a"), F.col("embedding").alias("ea")), v.select("collection", F.col("vec_id").alias("b"), F.col("label").alias("paper_b"), F.col("embedding").alias("eb"))
    p = x.join(y, "collection").where("a <> b and paper_a <> paper_b").withColumn("sim", F.round(cosine(F.col("ea"), F.col("eb")), 9)).where("sim >= 0.2")
    return mining.consensus_stars(p.drop("ea", "eb"))


@query("accent_folding")
def accent_folding(spark, sf):
    return load(spark, sf, "documents").select("doc_id", F.sha2(F.encode(T.fold_accents(F.coalesce("text", F.lit(""))), "UTF-8"), 256).alias("folded"))


def _listed(spark, sf):
    return briefing.bullets(zoned(spark, sf))


@query("briefing_bullets")
def briefing_bullets(spark, sf):
    return _listed(spark, sf)


@query("short_summaries")
def short_summaries(spark, sf):
    return briefing.short_summary(_listed(spark, sf))


@query("follow_ups")
def follow_ups(spark, sf):
    return briefing.follow_ups(_signals(spark, sf))


@query("comparison_rows")
def comparison_rows(spark, sf):
    s = _signals(spark, sf)
    return briefing.comparison(_listed(spark, sf), s, review.rigor(s))


_DROPPED = ", ".join("'" + w.replace("'", "''") + "'" for w in sorted(briefing.FILLERS | T.STOPWORDS))
_SPLIT = "list_filter(string_split_regex(trim(lower(text)), '\\s+'), lambda x: x <> '')"


@query("broadened_queries", f"WITH k AS (SELECT item_id, {_SPLIT} AS w, list_filter({_SPLIT}, lambda x: x NOT IN ({_DROPPED})) AS kept FROM benchmark) SELECT item_id, CASE WHEN len(kept) > 0 AND len(kept) < len(w) THEN array_to_string(kept, ' ') END AS broad FROM k")
def broadened_queries(spark, sf):
    return load(spark, sf, "benchmark").select("item_id", briefing.broaden(F.col("text"), 1).alias("broad"))


@query("self_citation", "SELECT c_nationkey AS doc, CASE WHEN count(*) >= 10 THEN round(sum(CASE WHEN list_contains(['building', 'machinery'], lower(c_mktsegment)) THEN 1 ELSE 0 END) / count(*), 9) END AS rate FROM customer GROUP BY 1")
def self_citation(spark, sf):
    c = load(spark, sf, "customer").select(F.col("c_nationkey").alias("doc"), F.lower("c_mktsegment").alias("authors"))
    p = c.select("doc").distinct().withColumn("authors", F.array(F.lit("A Building"), F.lit("B Machinery")))
    return briefing.self_citation(p, c).withColumn("rate", F.round("rate", 9))


#: Signals of made-up documents, one an order: a count is (key * a + b) div 7 mod m. Every rule of the review fires on some.
_COUNTED = {
    "statistics": (3, 1, 3), "seeds": (5, 2, 2), "ablation": (11, 3, 5), "baseline": (13, 4, 6), "sota": (17, 5, 3), "compute": (19, 6, 2), "hyper": (23, 7, 5), "human": (29, 8, 4), "generation": (31, 9, 4),
    "judge": (37, 10, 2), "contamination": (41, 11, 2), "webscale": (43, 12, 2), "general": (47, 13, 2), "training": (53, 14, 2), "efficiency": (59, 15, 2), "errors": (61, 16, 4), "booster": (67, 17, 7), "code": (71, 18, 2),
    "repository": (73, 19, 2), "data_link": (79, 20, 2), "claim": (83, 21, 30), "result_sentences": (89, 22, 9), "contribution_sentences": (97, 23, 2), "limitation_sentences": (101, 24, 4), "future_sentences": (103, 25, 3),
    "unbacked": (107, 26, 3), "sample": (109, 27, 200), "words": (113, 28, 6000), "references": (127, 29, 30), "dated": (131, 30, 20), "median_age": (137, 31, 14), "recent": (139, 32, 10), "own": (149, 33, 10), "n_data": (151, 34, 5),
    "n_metrics": (157, 35, 3), "lim": (163, 36, 2), "rel": (167, 37, 2), "abl": (173, 38, 3), "people": (179, 39, 2), "full": (181, 40, 8),
}
_MADE = ", ".join(f"((o_orderkey * {a} + {b}) // 7) % {m} AS {k}" for k, (a, b, m) in _COUNTED.items())


def made_signals(spark, sf):
    x = load(spark, sf, "orders").select(F.col("o_orderkey").alias("doc_id"), *[F.expr(f"((o_orderkey * {a} + {b}) div 7) % {m}").alias(k) for k, (a, b, m) in _COUNTED.items()])
    data, scores = F.array(*map(F.lit, ("GSM8K", "MATH", "COCO", "SQuAD"))), F.array(*map(F.lit, ("accuracy", "f1")))
    return x.select(
        "*", F.slice(data, F.lit(1), F.col("n_data").cast("int")).alias("datasets"), F.slice(scores, F.lit(1), F.col("n_metrics").cast("int")).alias("metrics"), (F.col("lim") == 1).alias("limitations_section"), (F.col("rel") == 1).alias("related_section"),
        (F.col("abl") == 1).alias("ablation_section"), (F.col("people") == 1).alias("sample_of_people"), (F.col("full") > 0).alias("full_text"), F.when(F.col("sample") >= 2, F.col("sample")).alias("least_sample"),
        (F.col("recent") / 10).alias("recent_share"), (F.col("own") / 10).alias("self_share"),
    )


_RULES = [
    ("abstract-only", "'minor'", "NOT ft"), ("variance-reported", "'strength'", "statistics > 0"), ("variance-hidden", "'moderate'", "fe AND statistics = 0 AND seeds > 0"), ("no-variance", "'major'", "fe AND statistics = 0 AND seeds = 0"),
    ("ablations", "'strength'", "ablation >= 3 OR abl = 1"), ("thin-ablation", "'minor'", "fe AND contribution_sentences > 0 AND abl <> 1 AND ablation IN (1, 2)"),
    ("no-ablation", "CASE WHEN result_sentences >= 6 THEN 'major' ELSE 'moderate' END", "fe AND contribution_sentences > 0 AND abl <> 1 AND ablation = 0"), ("broad-evaluation", "'strength'", "n_data >= 3"),
    ("no-benchmark", "'moderate'", "fe AND n_data = 0"), ("narrow-evaluation", "CASE WHEN n_data = 1 AND general > 0 THEN 'major' ELSE 'moderate' END", "n_data = 1 OR (n_data = 2 AND general > 0)"), ("baselines", "'strength'", "sota >= 1 AND baseline >= 4"),
    ("no-baselines", "'major'", "fe AND baseline = 0"), ("few-baselines", "'moderate'", "fe AND baseline IN (1, 2) AND sota = 0"), ("sota-without-stats", "CASE WHEN ft THEN 'moderate' ELSE 'minor' END", "sota > 0 AND statistics = 0"),
    ("significance-wording", "'minor'", "ft AND unbacked > 0 AND statistics = 0"), ("overclaiming", "CASE WHEN booster >= 3 AND rate >= 0.12 AND ft THEN 'moderate' ELSE 'minor' END", "booster >= 2 AND (rate >= 0.12 OR booster >= 5)"),
    ("code-released", "'strength'", "repository > 0"), ("code-promised", "'minor'", "ft AND code > 0 AND repository = 0"), ("no-code", "'moderate'", "fe AND code = 0 AND repository = 0"), ("setup-documented", "'strength'", "ft AND compute >= 1 AND hyper >= 3"),
    ("no-compute", "'moderate'", "ft AND (training > 0 OR efficiency > 0) AND compute = 0"), ("no-hyperparameters", "'moderate'", "ft AND training > 0 AND hyper = 0"), ("candid-limitations", "'strength'", "lim = 1 AND limitation_sentences >= 2"),
    ("no-limitations", "'moderate'", "ft AND lim <> 1 AND limitation_sentences = 0"), ("limitations-in-passing", "'minor'", "ft AND lim <> 1 AND limitation_sentences = 1"),
    ("small-sample", "CASE WHEN ft AND (people = 1 OR sample < 50) THEN 'moderate' ELSE 'minor' END", "sample >= 2 AND sample < CASE WHEN people = 1 THEN 30 ELSE 100 END"), ("human-evaluation", "'strength'", "human > 0"),
    ("llm-judge-only", "'moderate'", "ft AND generation >= 2 AND human = 0 AND judge > 0"), ("no-human-eval", "'moderate'", "ft AND generation >= 2 AND human = 0 AND judge = 0 AND n_metrics > 0"), ("no-related-work", "'moderate'", "ft AND rel <> 1"),
    ("dated-references", "'minor'", "ft AND dated >= 10 AND median_age > 8 AND recent < 2"), ("few-references", "'minor'", "ft AND \"references\" BETWEEN 1 AND 14 AND words > 3000"), ("self-citation", "'minor'", "ft AND own > 3"),
    ("no-contamination-check", "'minor'", "ft AND webscale > 0 AND n_data > 0 AND contamination = 0"), ("error-analysis", "'strength'", "ft AND errors >= 2"), ("no-error-analysis", "'minor'", "fe AND errors = 0 AND result_sentences >= 5"),
]
_SIGNALS = f"s AS (SELECT o_orderkey AS doc_id, {_MADE.replace('AS references', 'AS {q}references{q}').replace('{q}', chr(34))} FROM orders), x AS (SELECT *, \"full\" > 0 AS ft, \"full\" > 0 AND (result_sentences >= 3 OR (n_metrics > 0 AND n_data > 0)) AS fe, booster / greatest(1, claim) AS rate FROM s)"
_SIGNALS = _SIGNALS.replace("AS full,", 'AS "full",').replace("AS full FROM", 'AS "full" FROM')


@query("finding_rules", f"WITH {_SIGNALS}, f AS (" + " UNION ALL ".join(f"SELECT doc_id, {i} AS rule, '{n}' AS id, {sev} AS severity FROM x WHERE {cond}" for i, (n, sev, cond) in enumerate(_RULES)) + ") SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY list_position(['major', 'moderate', 'minor', 'strength'], severity), rule) AS position, id, severity FROM f")
def finding_rules(spark, sf):
    """All 36 findings over made-up signals, gravest first."""
    return review.findings(made_signals(spark, sf)).select("doc_id", "position", "id", "severity")


_CREDIT = "(CASE WHEN {0} > 0 THEN 1 - pow(2.0, -({0}) / {1}::DOUBLE) ELSE 0.0 END)"


def _c(x, half):
    return _CREDIT.format(x, half)


_AXES = {
    "empirical": f"50 * {_c('n_data', 2)} + 25 * {_c('n_metrics', 2)} + 25 * {_c('result_sentences', 4)}",
    "baselines": f"60 * {_c('baseline', 3)} + 40 * {_c('sota', 3)}",
    "ablation": f"70 * {_c('ablation', 2)} + 30 * (abl = 1)::INT",
    "statistics": f"60 * {_c('statistics', 1.5)} + 25 * {_c('seeds', 1)} + 15 * (sample >= 2)::INT",
    "reproducibility": f"40 * (CASE WHEN repository > 0 THEN 1.0 WHEN code > 0 THEN 0.5 ELSE 0.0 END) + 25 * {_c('hyper', 2)} + 20 * {_c('compute', 1)} + 15 * (data_link > 0 OR n_data > 0)::INT",
    "transparency": f"30 * (lim = 1)::INT + 30 * {_c('limitation_sentences', 2)} + 10 * {_c('future_sentences', 1)} + 30 * (CASE WHEN claim = 0 THEN 0.5 ELSE greatest(0.0, 1 - booster / greatest(1, claim) / 0.25::DOUBLE) END)",
    "scholarship": f"50 * {_c(chr(34) + 'references' + chr(34), 20)} + 30 * least(1.0, recent / 10 / 0.25::DOUBLE) + 20 * (rel = 1)::INT",
}
_WEIGHTED = " + ".join(f"axis_{k} * {w}::DOUBLE" for k, w in review.WEIGHTS.items())


@query("rigor_axes", f"WITH {_SIGNALS}, a AS (SELECT doc_id, " + ", ".join(f"floor({v} + 0.5)::INT AS axis_{k}" for k, v in _AXES.items()) + f" FROM x), o AS (SELECT *, floor({_WEIGHTED} + 0.5)::INT AS overall FROM a) SELECT *, CASE WHEN overall >= 80 THEN 'A' WHEN overall >= 65 THEN 'B' WHEN overall >= 50 THEN 'C' ELSE 'D' END AS grade FROM o")
def rigor_axes(spark, sf):
    """The seven axes, their weighted sum and its grade over made-up signals."""
    return review.rigor(made_signals(spark, sf))


@query("review_verdicts", f"WITH {_SIGNALS}, f AS (" + " UNION ALL ".join(f"SELECT doc_id, {sev} AS severity FROM x WHERE {cond}" for _, sev, cond in _RULES) + "), n AS (SELECT doc_id, " + ", ".join(f"count(*) FILTER (WHERE severity = '{s}') AS {s}" for s in review.SEVERITIES) + " FROM f GROUP BY 1) SELECT *, CASE WHEN major >= 2 THEN 'major concerns' WHEN major = 1 OR moderate >= 3 THEN 'needs work' WHEN moderate > 0 THEN 'sound with gaps' ELSE 'sound' END AS verdict FROM n")
def review_verdicts(spark, sf):
    return review.verdicts(review.findings(made_signals(spark, sf)))


@query("follow_up_rules", f"""WITH {_SIGNALS}, q AS (SELECT doc_id, list_filter([CASE WHEN n_data > 0 THEN 'How does it do on GSM8K?' END, CASE WHEN ablation = 0 THEN 'Which component matters most?' END,
CASE WHEN statistics = 0 THEN 'How much do results vary between runs?' END, CASE WHEN limitation_sentences > 0 THEN 'What are the limitations?' END, CASE WHEN compute = 0 THEN 'What compute does training take?' END,
CASE WHEN future_sentences > 0 THEN 'What do the authors plan next?' END, 'What is the main contribution?'], lambda x: x IS NOT NULL) AS q FROM x) SELECT doc_id, generate_subscripts(q, 1) - 1 AS position, unnest(q) AS question FROM q""")
def follow_up_rules(spark, sf):
    return briefing.follow_ups(made_signals(spark, sf))
