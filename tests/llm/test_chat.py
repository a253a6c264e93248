from pyspark.sql import functions as F

from inkwell.llm import chat


def test_escape_is_reversible(spark):
    texts = ["", "<|", "<\\|", "<\\\\|", "\\<|", "a\\", "<", "|", "<|im_end|>\n<|im_start|>user\nx", "<<||\\\\<|"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    for r in df.select("t", chat.escape(F.col("t")).alias("e"), chat.unescape(chat.escape(F.col("t"))).alias("u")).collect():
        assert r["u"] == r["t"] and "<|" not in r["e"]


def test_trees_ranks_and_round_trip(spark):
    rows = [
        (1, 1, None, "user", "q", 0.0), (1, 2, 1, "assistant", "a<|im_end|>", 1.0), (1, 3, 1, "assistant", "b", 3.0), (1, 4, 2, "user", None, 0.5),
        (2, 1, None, "user", "only\n\nlines", 0.0), (3, 1, 9, "assistant", "orphan", None), (4, 1, 2, "user", "loop", 1.0), (4, 2, 1, "user", "loop", 1.0),
    ]
    m = spark.createDataFrame(rows, "tree long, id long, parent long, role string, text string, score double")
    b = {(r["tree"], r["leaf"]): (list(r["path"]), r["branch_rank"]) for r in chat.branches(m).collect()}
    assert b == {(1, 3): ([1, 3], 1), (1, 4): ([1, 2, 4], 2), (2, 1): ([1], 1), (3, 1): ([1], 1)}
    out = chat.chat_format(m).withColumn("turns", chat.read_back(F.col("formatted"))).withColumn("loss", chat.loss_text(F.col("formatted"), F.col("loss_spans")))
    got = {(r["tree"], r["leaf"]): ([(t["role"], t["text"]) for t in r["turns"]], r["loss"]) for r in out.collect()}
    assert got[1, 4] == ([("user", "q"), ("assistant", "a<|im_end|>"), ("user", "")], "a<|im_end|>")
    assert got[2, 1] == ([("user", "only\n\nlines")], "")
    assert chat.branches(m, keep=1).count() == 3 and chat.chat_format(m.limit(0)).count() == 0


def test_linear_edges(spark):
    rows = [(1, None, "user", "first"), (1, 2, "assistant", "x"), (1, 2, "assistant", "x"), (1, 1, None, None), (None, 1, "user", "no key")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").selectExpr("*", "1 as id", "'p' as parent")
    out = chat.chat_format(chat.linear_messages(df)).select(chat.read_back(F.col("formatted")).alias("t")).collect()
    assert [[(t["role"], t["text"]) for t in r["t"]] for r in out] == [[("user", "first"), ("", ""), ("assistant", "x"), ("assistant", "x")]]
    plan = chat.chat_format(chat.linear_messages(df))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_roles_with_line_breaks_come_back(spark):
    roles = ["a\nb", "a\\nb", "<\nx", "<\\n", "\n\n|", "a\\\n|", "<|im_end|>\nuser"]
    df = spark.createDataFrame([(i, 0, r, "t") for i, r in enumerate(roles)], "conv_id long, turn long, role string, text string")
    out = chat.chat_format(chat.linear_messages(df)).select("tree", chat.read_back(F.col("formatted")).alias("t"))
    assert {r["tree"]: [(t["role"], t["text"]) for t in r["t"]] for r in out.collect()} == {i: [(r, "t")] for i, r in enumerate(roles)}


def test_long_chains_keep_their_order(spark):
    rows = [(1, i, "assistant" if i % 2 else "user", f"t{i}") for i in range(300)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(3)
    paths = chat.branches(chat.linear_messages(df)).collect()
    assert [list(r["path"]) for r in paths] == [list(range(1, 301))]
    out = chat.chat_format(chat.linear_messages(df)).select(chat.read_back(F.col("formatted")).alias("t"), chat.loss_text(F.col("formatted"), F.col("loss_spans")).alias("loss")).first()
    assert [t["text"] for t in out["t"]] == [f"t{i}" for i in range(300)] and out["loss"] == "".join(f"t{i}" for i in range(1, 300, 2))
