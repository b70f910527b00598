"""Jobs over files and streams, and operators against plain Python."""

import json
from collections import Counter

import pytest
from pyspark.sql import functions as F

from pagegauge.functions import geometry
from pagegauge.operators import coverage, evidence, ordering, pairs, rollup
from pagegauge.operators.multiset import multiset_prf
from pagegauge.plans import benchmark, rescore, upload
from pagegauge.sources import assets, documents, markdown, responses, results, review
from pagegauge.streaming import incremental, review as review_stream

TABLE = "<table><tr><th>A</th><th>B</th></tr><tr><td>1</td><td>2</td></tr></table>"
CELLS = [{"row": r, "col": c, "rowspan": 1, "colspan": 1, "text": t, "is_header": r == 0}
         for r, c, t in ((0, 0, "A"), (0, 1, "B"), (1, 0, "1"), (1, 1, "2"))]


def write(root, path, content):
    target = root / path
    target.parent.mkdir(parents=True, exist_ok=True)
    target.write_text(content if isinstance(content, str) else json.dumps(content), encoding="utf-8")


def corpus(root, change=lambda text: text):
    write(root, "scan/en/scan_en_001.json", {"doc_id": "x", "pages": [
        {"page_num": 1, "full_text": change("Hello world, again.")}, {"page_num": 2, "full_text": "second page"}]})
    write(root, "table/en/table_en_001.json", {"pages": [
        {"page_num": 1, "tables": [{"table_id": 1, "html": TABLE, "cells": CELLS}]}, {"page_num": 2, "tables": []}]})
    write(root, "text_layer/vi/textlayer_vi_001.json", {"pages": [
        {"full_text": change("Xin chào"), "blocks": [{"block_id": 1, "bbox": [0.1, 0.1, 0.9, 0.3], "text": "Xin"}]}]})
    write(root, "scan/en/broken.json", "{not json")


def test_self_benchmark_is_perfect(spark, tmp_path):
    corpus(tmp_path / "gt")
    corpus(tmp_path / "pred")
    out = benchmark.run_benchmark(spark, str(tmp_path / "gt"), str(tmp_path / "pred"), "m", str(tmp_path / "out"))
    assert [r.cer for r in out["scan"].collect()] == [0.0, 0.0]
    assert sorted(r.avg_teds for r in out["table"].collect()) == [0.0, 1.0]
    layer = out["text_layer"].first()
    assert (layer.cer, layer.mean_iou) == (0.0, 1.0)
    summary = {r.uc: r for r in out["uc_summary"].collect()}
    assert summary["UC02"].avg_wer == 0.0 and summary["UC05"].avg_cer is None and summary["UC07"].n_pages == 1
    overall = out["overall"].first()
    assert overall.avg_cer == 0.0 and overall.avg_teds == 0.5
    csv = spark.read.option("header", True).csv(str(tmp_path / "out/m_page_results"))
    assert csv.count() == 5 and "cer_detail.substitutions" in csv.columns


def test_worse_prediction_scores_worse(spark, tmp_path):
    corpus(tmp_path / "gt")
    corpus(tmp_path / "pred", lambda text: text.replace("l", "1"))
    pair = benchmark.page_pairs(
        documents.read_ground_truth(spark, str(tmp_path / "gt")),
        documents.read_predictions(spark, str(tmp_path / "pred"), "m"))
    first = benchmark.score_scan_pages(pair).orderBy("page_num").first()
    assert first.cer == pytest.approx(3 / 19, abs=1e-6) and first.cer_detail.substitutions == 3
    bad = documents.quarantine(documents._keyed(documents.read_json(
        spark, str(tmp_path / "gt"), documents.schemas.DOCUMENT)))
    assert bad.count() == 1


def test_table_scores_of_a_page(spark, tmp_path):
    corpus(tmp_path / "gt")
    gt = documents.read_ground_truth(spark, str(tmp_path / "gt"))
    row = benchmark.table_scores(benchmark.page_pairs(gt, gt.withColumn("model", F.lit("m")))).first()
    assert (row.teds, row.cell_accuracy, row.structure_f1) == (1.0, 1.0, 1.0)


def test_upload_and_rescore(spark, tmp_path):
    corpus(tmp_path / "gt")
    gt = documents.read_ground_truth(spark, str(tmp_path / "gt"))
    write(tmp_path, "up/scan_en_001_4.md", "# Hello world, again.\n![x](y.png)")
    write(tmp_path, "up/scan_en_001_04.md", "ignored, same page")
    write(tmp_path, "up/table_en_001_0.md", f"{TABLE}\n")
    files = markdown.read_markdown_files(spark, str(tmp_path / "up"))
    scored = upload.score_upload(gt, files, "m")
    rows = {(r.doc_id, r.page_num): r for r in scored.collect()}
    assert rows["scan_en_001", 1].matched
    assert not rows["scan_en_001", 2].matched and rows["scan_en_001", 2].cer == 1.0
    assert rows["table_en_001", 1].cer == 0.0 and rows["table_en_001", 1].table_teds_doc == 1.0
    summary = {r.doc_id: r for r in upload.summarize(scored).collect()}
    assert summary["table_en_001"].n_matched_pages == 1 and summary["table_en_001"].n_pages == 2
    assert upload.with_evidence(scored).count() == 4

    write(tmp_path, "st/m/scan/en/scan_en_001/scan_en_001_p1.md", "Hello world, again.")
    stored = rescore.stored_predictions(markdown.stored_pages(
        markdown.read_markdown_files(spark, str(tmp_path / "st"))))
    pipeline = stored.where(F.lit(False))
    docs = spark.createDataFrame(
        [("m", "scan", "en", "scan_en_001"), ("m", "table", "en", "table_en_001")],
        "model string, uc_type string, lang string, doc_id string")
    again, statuses = rescore.rescore(docs, gt, stored, pipeline)
    assert {r.page_num: r.cer for r in again.collect()} == {1: 0.0, 2: 1.0}
    assert {r.status: r.n for r in rescore.tally(statuses).collect()} == {"ok": 1, "skip": 1}


def test_scores_are_replaced_per_document(spark, tmp_path):
    path = str(tmp_path / "scores")
    schema = "model string, uc_type string, lang string, doc_id string, cer double"
    results.save_scores(spark.createDataFrame([("m", "scan", "en", "a", 0.1), ("m", "scan", "en", "b", 0.2)], schema), path)
    results.save_scores(spark.createDataFrame([("n", "scan", "vi", "a", 0.4), ("m", "scan", "en", "a", 0.3)], schema), path)
    got = {(r.model, r.doc_id): r.cer for r in results.read_scores(spark, path).collect()}
    assert got == {("m", "a"): 0.3, ("m", "b"): 0.2, ("n", "a"): 0.4}
    assert [r.model for r in results.model_registry(spark, path).collect()] == ["m", "n"]


def test_stored_evaluations(spark, tmp_path):
    write(tmp_path, "m/table/en/d1_eval.json", {"source": "upload", "text": {"summary": {"avg_cer": 0.1}, "pages": [
        {"page_num": 1, "table_teds_doc": 0.5}, {"page_num": 2, "table_teds_doc": 1.0}]}})
    write(tmp_path, "m/table/en/d2_eval.json", {"table": {"summary": {"avg_teds": 0.9}}})
    write(tmp_path, "m/table/en/d3_eval.json", "oops")
    docs = rollup.resolve_table_scores(results.evaluation_scores(results.read_evaluations(spark, str(tmp_path))))
    assert {r.doc_id: r.teds for r in docs.collect()} == {"d1": 0.75, "d2": 0.9}


def test_incremental_equals_batch(spark, tmp_path):
    gt = spark.createDataFrame(
        [("scan", "en", f"d{k}", 1, "some text here", []) for k in range(4)],
        "uc_type string, lang string, doc_id string, page_num int, gt_text string, "
        "gt_tables array<struct<table_id:int,html:string>>")
    def drop(name, docs, text):
        rows = [("m", "scan", "en", d, 1, text, []) for d in docs]
        df = spark.createDataFrame(rows, incremental.PAGES.rsplit(",", 1)[0]).withColumn("received_at", F.current_timestamp())
        df.coalesce(1).write.mode("append").parquet(str(tmp_path / "inbox"))
    def run(**kw):
        incremental.start_scoring(spark, str(tmp_path / "inbox"), gt, str(tmp_path / "scores"), str(tmp_path / "cp"), **kw).awaitTermination()
        return {r.doc_id: r.cer for r in results.read_scores(spark, str(tmp_path / "scores")).collect()}
    drop("a", ["d0", "d1"], "some text here")
    assert run() == {"d0": 0.0, "d1": 0.0}
    drop("b", ["d1", "d2"], "some text hera")
    assert run() == {"d0": 0.0, "d1": 0.0, "d2": pytest.approx(1 / 14)}


def test_review_stream_equals_batch(spark, tmp_path):
    rows = spark.range(200).select(
        F.col("id").alias("event_id"), (F.lit(1700000000) + F.col("id") * 60).cast("timestamp").alias("ts"),
        (F.col("id") % 7).alias("user_id"), F.lit("save").alias("event_type"))
    rows.unionByName(rows.where("event_id % 10 = 0")).coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    review_stream.start_activity(stream, str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    got = {r.window_start: r.n for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    want = {r.window_start: r.n for r in review_stream.hourly_activity(rows).collect()}
    assert got and all(want[k] == n for k, n in got.items()) and len(want) - len(got) <= 1


def test_review_versions(spark, tmp_path):
    docs = spark.createDataFrame([("scan", "en", "a", [1]), ("scan", "en", "b", [1])],
                                 "uc_type string, lang string, doc_id string, pages array<int>")
    at = lambda s: F.lit(s).cast("timestamp")
    path = str(tmp_path / "versions")
    review.append_versions(review.stamp(docs, "r1", "in_progress", at("2024-01-01")), path)
    review.append_versions(review.stamp(docs, "r2", "done", at("2024-01-02")), path)
    review.append_versions(review.tombstone(review.stamp(docs.where("doc_id = 'b'"), "r2", "done"), at("2024-01-03")), path)
    assert [(r.doc_id, r.reviewer) for r in review.read_current(spark, path).collect()] == [("a", "r2")]


def test_block_tree_response(spark, tmp_path):
    write(tmp_path, "doc.json", {"children": [{"block_type": "Page", "bbox": [0, 0, 200, 100], "children": [
        {"block_type": "Text", "bbox": [20, 10, 100, 50], "html": "<p>Hello <b>World</b></p>"},
        {"block_type": "Picture", "html": "x"}, {"block_type": "Table", "html": TABLE, "page": 0},
        {"block_type": "Text", "html": "<img src='logo.png'> AT&amp;T &lt;Corp&gt;"},
        {"block_type": "Text", "markdown": "![a](logo.png)"},
        {"block_type": "Text", "lines": [{"spans": [{"text": "one"}, {"text": "two"}]}]}]}]})
    trees = responses.read_block_trees(spark, str(tmp_path))
    blocks = responses.tree_blocks(trees).orderBy("pos").collect()
    assert [b.text for b in blocks] == ["Hello World", "A B 1 2", "AT&T <Corp>", "one two"]
    assert blocks[0].bbox == [0.1, 0.1, 0.5, 0.5] and [b.block_id for b in blocks] == [1, 3, 4, 6]
    both = responses.tree_blocks(trees)
    page = responses.scan_prediction(responses.text_blocks(both)).first()
    assert page.full_text == "Hello World\nAT&T <Corp>\none two"
    table = responses.table_prediction(both).first().tables[0]
    assert table.table_id == 1 and len(table.cells) == 4 and table.cells[0].is_header
    assert responses.readable_document(trees).first().markdown.startswith("Hello World\n\n<table>")


def test_page_response(spark, tmp_path):
    write(tmp_path, "doc.json", {"pages": [
        {"index": 1, "markdown": "## Body\n[t.html](t.html)", "header": " H ", "tables": [{"id": "t", "content": TABLE}]},
        {"index": 0, "markdown": f"text {TABLE}", "tables": [{"content": "no"}]}]})
    pages = responses.response_pages(responses.read_page_responses(spark, str(tmp_path))).orderBy("page_num").collect()
    assert [(p.page_num, p.full_text, len(p.tables)) for p in pages] == [(1, "text", 1), (2, "H\nBody", 1)]
    assert len(pages[0].tables[0].cells) == 4


def test_rotation(spark):
    got = [r.b for r in spark.createDataFrame([(o,) for o in (1, 3, 6, 8)], "o int").select(
        F.transform(geometry.rotate_box(F.array(*map(F.lit, (0.1, 0.2, 0.3, 0.5))), F.col("o")),
                    lambda v: F.round(v, 6)).alias("b")).collect()]
    assert got == [[0.1, 0.2, 0.3, 0.5], [0.7, 0.5, 0.9, 0.8], [0.5, 0.1, 0.8, 0.3], [0.2, 0.7, 0.5, 0.9]]


def test_numbering_a_hot_group(spark):
    rows = spark.range(5000).select(F.when(F.col("id") % 3 == 0, "hot").otherwise((F.col("id") % 50).cast("string")).alias("g"),
                                    F.col("id").alias("v"))
    numbered = ordering.number_within(rows, ["g"], [F.col("v")]).collect()
    seen: dict = {}
    for r in sorted(numbered, key=lambda r: (r.g, r.v)):
        seen[r.g] = seen.get(r.g, 0) + 1
        assert r.seq == seen[r.g]
    assert len(numbered) == 5000


def test_multiset_prf(spark):
    ref = spark.createDataFrame([(1, c) for c in "aabbc"] + [(2, "x")], "k int, i string")
    hyp = spark.createDataFrame([(1, c) for c in "abbbd"] + [(3, "x")], "k int, i string")
    got = {r.k: (r.overlap, r.precision, r.recall) for r in multiset_prf(ref, hyp, ["k"], ["i"]).collect()}
    assert got[1] == (sum((Counter("aabbc") & Counter("abbbd")).values()), 0.6, 0.6)
    assert got[2] == (0, 0.0, 0.0) == got[3]


def test_evidence_signals(spark):
    flags = spark.createDataFrame([(1.5, 40, 2, 1, 0, False, True, 0.3, 0.9), (1.0, 0, 0, 0, 0, False, False, 0.3, 0.9)],
                                  "r double, i int, d int, g int, p int, t boolean, f boolean, c double, s double")
    got = [r.v for r in flags.select(evidence.signals(*[F.col(c) for c in "ridgptfcs"]).alias("v")).collect()]
    assert got == [["over_generation", "flattened_tables", "figure_text"], ["reading_order"]]


def test_asset_listing(spark, tmp_path):
    for name in ("scan/en/a.pdf", "scan/en/a.png", "scan/en/b.JPG", "scan/en/c.txt"):
        write(tmp_path, name, "x")
    got = [(r.doc_id, r.ext) for r in assets.read_assets(spark, str(tmp_path)).orderBy("doc_id").collect()]
    assert got == [("a", ".pdf"), ("b", ".jpg")]


def test_split_predictions_and_merge(spark, tmp_path):
    page = {"pages": [{"page_num": 1, "full_text": "t", "tables": []}]}
    write(tmp_path, "scan/en/alpha_output/d_text_prediction.json", page)
    write(tmp_path, "scan/en/alpha_output/d_prediction.json", page)
    write(tmp_path, "scan/en/alpha_output/e_prediction.json", page)
    write(tmp_path, "scan/en/alpha_output/d_table_prediction.json",
          {"pages": [{"page_num": 1, "tables": [{"table_id": 1, "html": TABLE}]}]})
    split = documents.read_split_predictions(spark, str(tmp_path))
    text = documents.prefer_text(split)
    assert {r.doc_id: r.split for r in text.collect()} == {"d": "text", "e": "unified"}
    keys = ["model", "uc_type", "lang", "doc_id", "page_num"]
    merged = pairs.merge_tables(
        documents.pages_of(text), documents.pages_of(split.where("split = 'table'")), keys)
    assert {r.doc_id: len(r.tables) for r in merged.collect()} == {"d": 1, "e": 0}


def test_missing_docs(spark):
    done = spark.createDataFrame([("m", "a"), ("n", "a"), ("n", "b")], "model string, doc_id string")
    docs = spark.createDataFrame([("a",), ("b",)], "doc_id string")
    assert [(r.model, r.doc_id) for r in coverage.missing_docs(done, docs, done).collect()] == [("m", "b")]


def test_long_runs_do_not_recurse(spark):
    from pagegauge.functions import text as X
    n = 100_000
    rows = [("dots . . " + ". " * n + "end",), ("before\n" + "| a | b |\n" * n + "after",),
            ("![x](y.png)\n\nCaption" + "\nmore" * n + "\n\nbody",)]
    df = spark.createDataFrame(rows, "t string").select(
        X.normalize_text(F.col("t")).alias("plain"), X.filter_content(F.col("t")).alias("kept"))
    dots, table, caption = df.collect()
    assert dots.plain.split() == ["dots", "end"]
    assert table.kept.split("\n").count("a b") == n and table.kept.endswith("after")
    assert caption.kept.strip() == "body"


def test_raw_pages_replace_older_ones(spark, tmp_path):
    path = str(tmp_path / "raw")
    def pages(text):
        return spark.createDataFrame([("m", "scan", "en", "d", 1, text), ("m", "scan", "en", "d", 2, "same")],
                                     "model string, uc_type string, lang string, doc_id string, page_num int, raw string")
    results.save_raw_pages(pages("old"), path)
    results.save_raw_pages(pages("new").where("page_num = 1"), path)
    assert sorted((r.page_num, r.raw) for r in results.read_scores(spark, path).collect()) == [(1, "new"), (2, "same")]
    assert results.read_scores(spark, str(tmp_path / "none")) is None
    (tmp_path / "broken" / "manifest").mkdir(parents=True)
    (tmp_path / "broken" / "manifest" / "000000000000.json").write_text("not a manifest")
    with pytest.raises(Exception):
        results.read_scores(spark, str(tmp_path / "broken")).count()


def test_taken_suffixes_are_skipped(spark):
    from pagegauge.operators.ordering import suffix_collisions
    names = ["a.pdf", "a.pdf", "a_2.pdf", "a.pdf", "b", "b", "b_3", "b"]
    slugs = spark.createDataFrame([("f", n, f"s{k}") for k, n in enumerate(names)], "folder string, slug string, src string")
    got = {r.src: r.target for r in suffix_collisions(slugs).collect()}
    assert [got[f"s{k}"] for k in range(8)] == ["a.pdf", "a_3.pdf", "a_2.pdf", "a_4.pdf", "b", "b_2", "b_3", "b_4"]


def test_unfiltered_comparison_uses_model_means(spark):
    from pagegauge.operators.rollup import compare_models
    docs = spark.createDataFrame(
        [("m", "scan", "en", 0.9)] * 3 + [("m", "table", "en", 0.1)], "model string, uc_type string, lang string, cer double")
    assert compare_models(docs, ("cer",)).first().avg_cer == pytest.approx(0.7)
    assert compare_models(docs, ("cer",), lang="en").first().avg_cer == pytest.approx(0.5)
    assert compare_models(docs, ("cer",), uc_type="table").first().avg_cer == pytest.approx(0.1)


SCORES = "model string, uc_type string, lang string, doc_id string, page_num int, cer double"


def scores_of(spark, rows):
    return spark.createDataFrame([("m", "scan", lang, doc, page, cer) for lang, doc, page, cer in rows], SCORES)


def stored(spark, path):
    return sorted((r.lang, r.doc_id, r.page_num, r.cer) for r in results.read_scores(spark, path).collect())


def rows_in(spark, folder):
    return spark.read.parquet(str(folder)).count()


def test_a_save_writes_its_own_rows_only(spark, tmp_path):
    path, log = str(tmp_path / "scores"), tmp_path / "scores" / "log"
    keys = [*results.DOC_KEYS, "page_num"]
    results.save_scores(scores_of(spark, [("en", "d", k, 0.5) for k in range(1000)]), path, keys)
    results.save_scores(scores_of(spark, [("en", "d", k, 0.1) for k in range(10)]), path, keys, ("stream", 0))
    written = {f.name: rows_in(spark, f) for f in log.iterdir()}
    assert sorted(written.values()) == [10, 1000]
    assert sum(cer == 0.1 for *_, cer in stored(spark, path)) == 10 and len(stored(spark, path)) == 1000
    # A replayed batch changes nothing, the next one does.
    results.save_scores(scores_of(spark, [("en", "d", 0, 0.9)]), path, keys, ("stream", 0))
    assert len(list(log.iterdir())) == 2 and ("en", "d", 0, 0.1) in stored(spark, path)
    results.save_scores(scores_of(spark, [("en", "d", 0, 0.9)]), path, keys, ("stream", 1))
    results.save_scores(scores_of(spark, []), path, keys, ("stream", 2))
    assert ("en", "d", 0, 0.9) in stored(spark, path) and len(stored(spark, path)) == 1000


def test_a_key_brings_all_its_rows(spark, tmp_path):
    path = str(tmp_path / "scores")
    results.save_scores(scores_of(spark, [("en", "d", 1, 0.1), ("en", "d", 2, 0.2), ("ja", "e", 1, 0.3)]), path)
    results.save_scores(scores_of(spark, [("en", "d", 1, 0.4)]).withColumn("more", F.lit("x")), path)
    assert stored(spark, path) == [("en", "d", 1, 0.4), ("ja", "e", 1, 0.3)]
    assert {r.lang: r.more for r in results.read_scores(spark, path).collect()} == {"en": "x", "ja": None}


def test_a_job_that_ends_between_partitions_leaves_the_old_scores(spark, tmp_path, monkeypatch):
    from pagegauge.sources import score_log
    path = str(tmp_path / "scores")
    results.save_scores(scores_of(spark, [("en", "d", 1, 0.1), ("ja", "d", 1, 0.1)]), path)
    whole = score_log._write

    def broken(scores, *rest):
        whole(scores.where("lang = 'en'"), *rest)  # one partition is there, the other is not
        raise RuntimeError("lost")

    monkeypatch.setattr(score_log, "_write", broken)
    with pytest.raises(RuntimeError, match="lost"):
        results.save_scores(scores_of(spark, [("en", "d", 1, 0.7), ("ja", "d", 1, 0.7)]), path)
    monkeypatch.undo()
    assert stored(spark, path) == [("en", "d", 1, 0.1), ("ja", "d", 1, 0.1)]
    results.save_scores(scores_of(spark, [("en", "d", 1, 0.7), ("ja", "d", 1, 0.7)]), path)
    assert stored(spark, path) == [("en", "d", 1, 0.7), ("ja", "d", 1, 0.7)]
    assert score_log.remove_unlisted(spark, path) == 0 and score_log.remove_unlisted(spark, path, hours=0) == 1
    assert stored(spark, path) == [("en", "d", 1, 0.7), ("ja", "d", 1, 0.7)]


def test_a_second_writer_goes_on_from_the_first(spark, tmp_path, monkeypatch):
    from pagegauge.sources import score_log
    path, other = str(tmp_path / "scores"), scores_of(spark, [("en", "d", 1, 0.2), ("en", "e", 1, 0.2)])
    plain = score_log._write

    def late(*args):
        monkeypatch.undo()
        folders = plain(*args)
        results.save_scores(other, path)  # takes the number that this writer had in mind
        return folders

    monkeypatch.setattr(score_log, "_write", late)
    results.save_scores(scores_of(spark, [("en", "d", 1, 0.1)]), path)
    assert stored(spark, path) == [("en", "d", 1, 0.1), ("en", "e", 1, 0.2)]


def test_crowded_partitions_are_compacted(spark, tmp_path, monkeypatch):
    from pagegauge.sources import score_log
    monkeypatch.setattr(score_log, "MOST_COMMITS", 2)
    path = str(tmp_path / "scores")
    results.save_scores(scores_of(spark, [("ja", "d", 1, 0.9)]), path)
    for k in range(4):
        results.save_scores(scores_of(spark, [("en", "d", 1, k / 10), ("en", f"e{k}", 1, 0.5)]), path)
    want = [("en", "d", 1, 0.3), *[("en", f"e{k}", 1, 0.5) for k in range(4)], ("ja", "d", 1, 0.9)]
    assert stored(spark, path) == want
    manifest = score_log._manifest(score_log._Files(spark, path), path)
    assert max(score_log._commits(manifest["folders"]).values()) == 2
    score_log.compact(spark, path)
    assert stored(spark, path) == want
    assert "Window" not in results.read_scores(spark, path)._jdf.queryExecution().executedPlan().toString()
    assert [r.lang for r in score_log.partitions(spark, path).orderBy("lang").collect()] == ["en", "ja"]


def test_a_large_document_is_spread(spark):
    from pagegauge.operators.pairs import expected_pages
    pages = spark.range(5000).selectExpr("'scan' AS uc_type", "'en' AS lang", "'big' AS doc_id", "cast(id + 1 AS int) AS page_num")
    pages = pages.union(spark.range(3).selectExpr("'scan'", "'en'", "concat('d', id)", "1"))
    docs = spark.createDataFrame([("a", "scan", "en", "big"), ("a", "scan", "en", "big"), ("b", "scan", "en", "big"),
                                  ("b", "scan", "en", "d1"), ("b", "scan", "en", "gone")],
                                 "model string, uc_type string, lang string, doc_id string")
    got = expected_pages(pages, docs)
    want = pages.join(docs.distinct(), ["uc_type", "lang", "doc_id"])
    columns = ["model", "uc_type", "lang", "doc_id", "page_num"]
    assert sorted(map(tuple, got.select(columns).collect())) == sorted(map(tuple, want.select(columns).collect()))
