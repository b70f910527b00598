"""Pages cut from whole texts, and what queries that need no texts leave out."""

import random
import time
import unicodedata

from pyspark.sql import functions as F

from pagegauge.catalog import fixtures as fx
from pagegauge.functions import grids as G, metrics as M, text as X
from pagegauge.functions.exprs import settle
from pagegauge.operators import scoring

DATA = "/root/testdata/sf0.001"


def plan(df, optimized=True):
    execution = df._jdf.queryExecution()
    return (execution.optimizedPlan() if optimized else execution.executedPlan()).toString()


def test_pages_hold_the_whole_text(spark):
    texts = [None, "", "a", "ab\ncd", "x" * 5, "é\U0001f600\r\n abc" * 3]
    docs = spark.createDataFrame([(k, "en", t) for k, t in enumerate(texts)], "doc_id long, lang string, text string")
    assert "substring(" not in plan(fx.paged(docs, 2))
    pages = {}
    for r in fx.paged(docs, 2).orderBy("doc_id", "page_num").collect():
        pages.setdefault(r["doc_id"], []).append((r["page_num"], r["gt_text"]))
    for k, t in enumerate(texts):
        cut = [t] if not t else [t[i:i + 2] for i in range(0, len(t), 2)]
        assert pages[k] == list(enumerate(cut, 1))


def test_keys_of_predicted_pages_need_no_predicted_texts(spark):
    keys = fx.pred_pages(spark, DATA).select("model", "doc_id", "page_num").distinct()
    assert "lower(" not in plan(keys) and "lower(" in plan(fx.pred_pages(spark, DATA))


def test_many_kept_urls_cost_one_pass(spark):
    """Every placeholder once searched the whole text for its originals again."""
    n = 20000
    text = " ".join(f"https://a.b/{k} (*) word, word" for k in range(n))
    df = spark.createDataFrame([(text,)], "t string")
    start = time.perf_counter()
    out = df.select(X.normalize_text(F.col("t"))).first()[0]
    assert time.perf_counter() - start < 15
    assert out.split() == [w for k in range(n) for w in (f"https://a.b/{k}", "(*)", "word,", "word")]


def test_numbers_keep_marks_and_white_space_becomes_single(spark):
    rows = [("1, 2 , 3,4,5 a,b", "1,2, 3,4,5 a, b"), ("2. 5 3.x", "2.5 3.x"), (" a\t\n b\x0bc\r\nd ", "a b c d"),
            ("KeptAsIsNo0 https://a.b", "https://a.b https://a.b"), ("x . . . y", "x y"), ("5 % ( a )", "5% (a)")]
    df = spark.createDataFrame(rows, "t string, want string")
    assert [r[0] for r in df.select(X.normalize_text(F.col("t"))).collect()] == [w for _, w in rows]


def test_equal_lists_send_no_runs_of_nulls_to_python(spark):
    """After every row Spark asks for the size of a batch, and a list column then passes over the NULLs since its last list."""
    limit = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(limit)
    spark.conf.set(limit, "100000")
    try:
        lists = spark.range(0, 100000, 1, 1).select(F.array(F.lit("a"), F.col("id").cast("string")).alias("r"))
        # Equal in every row, but not told from the plan.
        pairs = lists.select("r", F.when(F.rand(1) < 2, F.col("r")).alias("p"))
        start = time.perf_counter()
        out = pairs.select(
            M.item_overlap(F.col("r"), F.col("p")).alias("n"), M.token_distance(F.col("r"), F.col("p")).alias("d"),
            G.teds(F.array("r"), F.array("p")).alias("t")).agg(F.sum("n"), F.sum("d"), F.sum("t")).first()
        assert tuple(out) == (200000, 0, 100000.0)
        assert time.perf_counter() - start < 15
    finally:
        spark.conf.set(limit, before)


def test_lists_that_are_null_or_empty_keep_their_scores(spark):
    rows = [(["a"], ["a"]), (["a", "b"], ["b"]), ([], ["a"]), (["a"], []), (["a"], None), ([], [])]
    df = spark.createDataFrame(rows, "r array<string>, p array<string>")
    got = df.select(M.item_overlap(F.col("r"), F.col("p")), M.token_distance(F.col("r"), F.col("p"))).collect()
    assert [tuple(r) for r in got] == [(1, 0), (1, 1), (0, 1), (0, 1), (1, 0), (0, 0)]


def test_plain_prose_skips_the_steps_with_the_same_result(spark, monkeypatch):
    """Prose told by one pattern has the text that all steps give."""
    from pagegauge.functions import patterns as P

    r = random.Random(4)
    pieces = ["word", "Été", "x", "3", "12", ",", ".", " ", " ", " ", "\n", "\t", "!", "?", "'", '"', "=", "¿", "/"]
    texts = ["".join(r.choices(pieces, k=r.randint(0, 14))) for _ in range(1500)] + [
        "a. b, c", " .a", "5, 6", "5. 6", "5,\n\n6", "a,b.c", "a ,b", "a..", "a. . .", "5,000.25", "5,a", "a,5", "a, 5", ", a", ".", "", " \n", "a,\u00a0b", "a\u0301"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    quick = [row[0] for row in df.select(X.normalize_text(F.col("t"))).collect()]
    plain = [row[0] for row in df.select(F.col("t").rlike(P.PLAIN_TEXT)).collect()]
    monkeypatch.setattr(P, "PLAIN_TEXT", r"(?!)")
    assert quick == [row[0] for row in df.select(X.normalize_text(F.col("t"))).collect()]
    assert 200 < sum(plain) < len(texts) - 200


def test_punctuation_needs_only_the_words_that_differ(spark, monkeypatch):
    """Counts over the changes are those over all aligned words."""
    r = random.Random(5)
    words = ["the", "The", "a,", "b.", "A.", "Ab,c.", "x!", "?", "été", "Été", "ǅ", "_x", "Z;:"]
    rows = [(" ".join(r.choices(words, k=r.randint(0, 9))), " ".join(r.choices(words, k=r.randint(0, 9)))) for _ in range(300)]
    rows += [(a, a.lower().replace(",", "")) for a, _ in rows] + [(a, a) for a, _ in rows[:50]]
    df = spark.createDataFrame(rows, "ref string, hyp string")
    scored = settle(scoring.score_punctuation(df), aligned=M.aligned_words(F.col("ref"), F.col("hyp")))
    marks = ",.?!;:"
    for row in scored.collect():
        pairs = [(w.gt or "", w.pred or "") for w in row.aligned]
        expected = {}
        for mark in marks:
            tp, either = sum(mark in g and mark in p for g, p in pairs), sum(mark in g or mark in p for g, p in pairs)
            if either:
                expected[mark] = round(tp / either, 6)
        assert row.per_punct == expected
        flags = [tuple(unicodedata.category(side[:1] or " ") == "Lu" for side in pair) for pair in pairs]
        assert tuple(row.cap_detail) == tuple(flags.count(f) for f in ((True, True), (False, True), (True, False)))
    # Words that match are not sent back from Python.
    long = spark.createDataFrame([("w " * 500 + "End.", "w " * 500 + "end")], "ref string, hyp string")
    assert long.select(F.size(M.word_changes(F.col("ref"), F.col("hyp")))).first()[0] == 1


def test_structure_is_read_once(spark):
    """Paths with and without text come from one reading of the lines."""
    page = "# A\n- b\n\n```x\n# no\n```\n> q\n1. c\n| d |\nplain\n#"
    df = spark.createDataFrame([(page,), ("",), (None,)], "md string")
    assert [tuple(r) for r in df.select(M.structure_paths(F.col("md")), M.structure_paths(F.col("md"), True)).collect()] == [
        (["heading1", "list/item", "fence", "quote", "ordered/item", "table/row", "paragraph", "paragraph"],
         ["heading1", "list/item", "fence", "quote", "ordered/item", "table/row", "paragraph", "paragraph", "heading1::TEXT::A",
          "list/item::TEXT::b", "quote::TEXT::q", "ordered/item::TEXT::c", "table/row::TEXT::| d |", "paragraph::TEXT::plain",
          "paragraph::TEXT::#"]), ([], []), (None, None)]
    scored = scoring.score_markdown(df.select(F.col("md").alias("gt_text"), F.col("md").alias("pred_text")))
    assert plan(scored, optimized=False).count("list/item") == 2
