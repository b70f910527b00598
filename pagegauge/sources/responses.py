"""Stored OCR responses turned into predictions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pagegauge.functions import geometry, grids as G, patterns as P, text as X
from pagegauge.sources import schemas
from pagegauge.sources.documents import read_json


def _in_order(pos: str, value: Column) -> Column:
    """Values of a page in block order."""
    pairs = F.array_sort(F.collect_list(F.struct(F.col(pos).alias("pos"), value.alias("value"))))
    return F.transform(pairs, lambda p: p["value"])


# --- block trees -------------------------------------------------------------------

def read_block_trees(spark: SparkSession, root: str) -> DataFrame:
    trees = read_json(spark, root, schemas.BLOCK_TREE)
    doc = F.regexp_extract("_path", r"([^/]+)\.json$", 1)
    return trees.where(F.col("_corrupt_record").isNull()).select(doc.alias("doc_id"), "children")


def raw_blocks(trees: DataFrame) -> DataFrame:
    pages = trees.select("doc_id", F.posexplode("children").alias("page_pos", "p"))
    blocks = pages.select(
        "doc_id", "page_pos", F.col("p.bbox").alias("page_bbox"),
        F.posexplode("p.children").alias("block_pos", "b"))
    return blocks.select(
        "doc_id", "page_pos", "page_bbox", "block_pos",
        F.coalesce("b.block_type", F.lit("Text")).alias("block_type"), "b.bbox", "b.html",
        "b.markdown", "b.page", "b.lines")


def tree_blocks(trees: DataFrame) -> DataFrame:
    """Readable blocks: images and containers out, text extracted, boxes normalized."""
    raw = raw_blocks(trees).where(~F.col("block_type").isin(*P.IMAGE_AND_CONTAINER_BLOCKS))
    return raw.select(
        "doc_id", F.coalesce(F.col("page") + 1, F.col("page_pos") + 1).alias("page_num"),
        "page_pos", "block_pos", (F.col("block_pos") + 1).alias("block_id"), "block_type",
        geometry.normalize_box(F.col("bbox"), F.col("page_bbox")).alias("bbox"),
        X.block_text(F.col("markdown"), F.col("html"), F.col("lines")).alias("text"),
        F.coalesce("html", F.lit("")).alias("html"),
        (F.col("page_pos") * 1000000 + F.col("block_pos")).alias("pos"),
    ).where(F.col("text") != "")


def text_blocks(blocks: DataFrame) -> DataFrame:
    return blocks.where(~F.col("block_type").isin(*P.READABLE_TABLE_BLOCKS))


def table_blocks(blocks: DataFrame) -> DataFrame:
    return blocks.where(F.col("block_type").isin(*P.TABLE_BLOCKS))


def scan_prediction(blocks: DataFrame) -> DataFrame:
    """Page text: block texts in order, one per line."""
    return blocks.groupBy("doc_id", "page_num").agg(
        F.array_join(_in_order("pos", F.col("text")), "\n").alias("full_text"))


def text_layer_prediction(blocks: DataFrame) -> DataFrame:
    block = F.struct("block_id", "bbox", "text")
    return blocks.groupBy("doc_id", "page_num").agg(_in_order("pos", block).alias("blocks")).withColumn(
        "full_text", F.array_join(F.transform("blocks", lambda b: b["text"]), "\n"))


def table_prediction(blocks: DataFrame) -> DataFrame:
    """Tables of each page, numbered from 1, with their cells."""
    tables = table_blocks(blocks).groupBy("doc_id", "page_num").agg(
        _in_order("pos", F.col("html")).alias("_html"))
    return tables.select("doc_id", "page_num", F.transform("_html", lambda html, k: F.struct(
        (k + 1).alias("table_id"), html.alias("html"), G.html_cells(html).alias("cells"))).alias("tables"))


def readable_document(trees: DataFrame) -> DataFrame:
    """The whole response as one Markdown text; a document is one row on both ends."""
    def page_text(page: Column) -> Column:
        kept = F.filter(page["children"], lambda b: (
            ~F.coalesce(b["block_type"], F.lit("Text")).isin(*P.READABLE_SKIP_BLOCKS)
            & (F.coalesce(b["html"], F.lit("")) != "")))
        texts = F.transform(kept, lambda b: X.readable_block(
            F.coalesce(b["block_type"], F.lit("Text")), b["html"]))
        return F.array_join(F.filter(texts, lambda t: t != ""), "\n\n")
    pages = F.filter(F.transform("children", page_text), lambda t: t != "")
    return trees.select("doc_id", F.array_join(pages, "\n\n---\n\n").alias("markdown"))


def viewer_blocks(trees: DataFrame, orientations: DataFrame | None = None) -> DataFrame:
    """Boxes and previews for display, turned to the image orientation."""
    raw = raw_blocks(trees).where(~F.col("block_type").isin(*P.VIEWER_SKIP_BLOCKS))
    if orientations is not None:
        raw = raw.join(orientations, "doc_id", "left")
    turn = F.coalesce("orientation", F.lit(1)) if orientations is not None else F.lit(1)
    box = geometry.normalize_box(F.col("bbox"), F.col("page_bbox"), 4)
    return raw.select(
        "doc_id", (F.col("page_pos") + 1).alias("page_num"), F.col("block_pos").alias("block_id"),
        F.col("block_type").alias("type"), geometry.rotate_box(box, turn).alias("bbox"),
        X.block_preview(F.col("html")).alias("text"))


# --- page responses -----------------------------------------------------------------

def read_page_responses(spark: SparkSession, root: str) -> DataFrame:
    responses = read_json(spark, root, schemas.PAGE_RESPONSE)
    doc = F.regexp_extract("_path", r"([^/]+)\.json$", 1)
    return responses.where(F.col("_corrupt_record").isNull()).select(doc.alias("doc_id"), "pages")


def response_pages(responses: DataFrame) -> DataFrame:
    """One row per page; only real HTML tables, with inline ones as fallback."""
    pages = responses.select("doc_id", F.explode("pages").alias("p"))
    own = F.filter("p.tables", lambda t: F.lower(X.strip(F.coalesce(t["content"], F.lit("")))).startswith("<table"))
    inline = F.regexp_extract_all(F.coalesce("p.markdown", F.lit("")), F.lit(P.ANY_TABLE), F.lit(0))
    html = F.when(F.coalesce(F.size(own), F.lit(0)) > 0, F.transform(own, lambda t: t["content"])).otherwise(inline)
    return pages.select(
        "doc_id", (F.coalesce("p.index", F.lit(0)) + 1).alias("page_num"),
        X.response_page_text(F.col("p.header"), F.col("p.markdown"), F.col("p.footer")).alias("full_text"),
        F.transform(html, lambda h, k: F.struct(
            (k + 1).alias("table_id"), h.alias("html"),
            G.html_cells(h, "colspan").alias("cells"))).alias("tables"),
        F.col("p.dimensions").alias("dimensions"), F.col("p.blocks").alias("raw_blocks"))


def response_text_layer(pages: DataFrame) -> DataFrame:
    """A single block that covers the page."""
    box = F.array(*map(F.lit, (0.0, 0.0, 1.0, 1.0)))
    return pages.withColumn("blocks", F.array(F.struct(
        F.lit(1).alias("block_id"), box.alias("bbox"), F.col("full_text").alias("text"))))


def response_viewer_blocks(pages: DataFrame) -> DataFrame:
    rows = pages.select("doc_id", "page_num", "dimensions", F.posexplode("raw_blocks").alias("block_id", "b"))
    kind = F.coalesce("b.type", F.lit("text"))
    bbox = F.array("b.top_left_x", "b.top_left_y", "b.bottom_right_x", "b.bottom_right_y")
    page = F.array(F.lit(0.0), F.lit(0.0), F.col("dimensions.width"), F.col("dimensions.height"))
    return rows.where(~F.lower(kind).isin(*P.VIEWER_SKIP_RESPONSE_BLOCKS)).select(
        "doc_id", "page_num", "block_id", kind.alias("type"),
        geometry.normalize_box(bbox, page, 4).alias("bbox"), X.block_preview(F.col("b.content")).alias("text"))
