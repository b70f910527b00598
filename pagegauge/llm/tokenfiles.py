"""Flat token files: unsigned ids, 64-bit document offsets, partition bases by prefix sums.

``write_token_files`` range-partitions the documents by id, and each task
writes three files of its slice: ``part-N.bin`` (ids one after the other,
unsigned 16-bit where the vocabulary allows, else 32-bit, little-endian),
``part-N.off`` (signed 64-bit offsets in ids, one more than documents) and
``part-N.doc`` (signed 64-bit document ids).  It writes under a name of its
own attempt and renames at the end, so a repeated task replaces equal files.
The returned manifest has one row per file and its base: the number of ids in
all files before it, a prefix sum over the rows of the manifest.

``read_token_files`` maps the files into memory, one task per file.

Defined results: a null or empty text has only its end id; a null document id
comes first; rows with one document id stay separate, ordered by text; an empty
table gives an empty manifest; further columns are ignored.
"""

from __future__ import annotations

import os
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pagegauge.llm.batches import slices, texts_of
from pagegauge.llm.store import settled
from pagegauge.llm.tokens import encoder

#: Stored for a null document id.
NO_ID = -(1 << 63)


def _place(folder: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(folder) if "://" in folder or folder.startswith("file:") else (
        fs.LocalFileSystem(), folder)


def _mapped(folder: str, name: str, kind: str) -> np.ndarray:
    """A file as an array: mapped where the folder is mounted, read whole elsewhere."""
    system, base = _place(folder)
    path = f"{base}/{name}"
    if isinstance(system, fs.LocalFileSystem):
        return np.memmap(path, kind, "r") if os.path.getsize(path) else np.zeros(0, kind)
    with system.open_input_file(path) as file:
        return np.frombuffer(file.read(), kind)


def write_token_files(
    docs: DataFrame, folder: str, vocabulary: str, end_id: int, vocabulary_size: int, text: str = "text",
    key: str = "doc_id",
) -> DataFrame:
    kind = "<u2" if max(vocabulary_size, end_id + 1) <= 1 << 16 else "<u4"

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(vocabulary)
        system, base = _place(folder)
        system.create_dir(base, recursive=True)
        part, attempt = TaskContext.get().partitionId(), uuid.uuid4().hex
        doc_ids: list[np.ndarray] = []
        lengths: list[int] = []
        temporary = f"{base}/_{attempt}"
        with system.open_output_stream(f"{temporary}.bin") as file:
            for batch in batches:
                for piece in slices(batch, "text"):
                    doc_ids.append(piece.column("doc_id").fill_null(NO_ID).to_numpy(zero_copy_only=False))
                    for ids in enc.ids(texts_of(piece, "text")):
                        file.write(np.append(ids, np.uint32(end_id)).astype(kind).tobytes())
                        lengths.append(len(ids) + 1)
        offsets = np.concatenate([[0], np.cumsum(np.array(lengths, np.int64))]).astype("<i8")
        for suffix, value in (("off", offsets), ("doc", np.concatenate([np.zeros(0, np.int64), *doc_ids]))):
            with system.open_output_stream(f"{temporary}.{suffix}") as file:
                file.write(value.astype("<i8").tobytes())
        for suffix in ("bin", "off", "doc"):
            system.move(f"{temporary}.{suffix}", f"{base}/part-{part:06d}.{suffix}")
        yield pa.RecordBatch.from_arrays(
            [pa.array([part], pa.int32()), pa.array([len(lengths)], pa.int64()),
             pa.array([int(offsets[-1])], pa.int64())], ["part", "n_docs", "n_tokens"])

    rows = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    ordered = rows.repartitionByRange(F.col("doc_id").asc_nulls_first()).sortWithinPartitions(
        F.col("doc_id").asc_nulls_first(), "text")
    files = settled(ordered.mapInArrow(write, "part int, n_docs long, n_tokens long"), "token-manifest")
    # One row per file: a window over the manifest orders partitions, not documents.
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    return files.withColumn("base", F.coalesce(F.sum("n_tokens").over(before), F.lit(0))).withColumn(
        "kind", F.lit(kind))


def read_token_files(manifest: DataFrame, folder: str, with_ids: bool = False) -> DataFrame:
    """One row per document: its id, global start, number of ids and their checksum (ids too on request)."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                name = f"part-{row['part']:06d}"
                ids = _mapped(folder, f"{name}.bin", row["kind"])
                offsets = _mapped(folder, f"{name}.off", "<i8")
                doc_ids = _mapped(folder, f"{name}.doc", "<i8")
                for a in range(0, len(doc_ids), 1000):
                    cut = offsets[a:a + 1001]
                    raw = [ids[x:y].astype("<u4").tobytes() for x, y in zip(cut[:-1], cut[1:], strict=True)]
                    own = np.asarray(doc_ids[a:a + 1000])
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(own, mask=own == NO_ID), pa.array(cut[:-1] + row["base"]),
                         pa.array(np.diff(cut)), pa.array([zlib.crc32(x) for x in raw], pa.int64()),
                         pa.array(raw if with_ids else [None] * len(raw), pa.binary())],
                        ["doc_id", "start", "n_tokens", "ids_crc32", "ids"])

    # The manifest is tiny: without a number, all files would be read by one task.
    return manifest.repartitionByRange(max(1, manifest.count()), "part").mapInArrow(
        read, "doc_id long, start long, n_tokens long, ids_crc32 long, ids binary")
