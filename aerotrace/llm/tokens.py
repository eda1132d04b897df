"""Token ids as flat binary files.

A data set is a folder of triples, one for each range of document ids: `part-N.bin` has the ids of its documents,
one after the other, as little-endian unsigned 16-bit integers; `part-N.idx` has n + 1 unsigned 64-bit offsets of
documents in it, counted in ids; `part-N.doc` has the n document ids as signed 64-bit integers (the smallest such
integer stands for null). A part's base, its offset in the whole data set, is the sum of the sizes of the parts
before it. Files appear under their names only when complete, so a repeated task replaces its own file.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fresh_path
from .encoder import encoder, tokenizer_path

NULL_ID = -(2**63)


def _open(folder: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(folder)


def _write(fs: pafs.FileSystem, path: str, chunks: list[bytes]) -> None:
    mark = f"{path}.{TaskContext.get().taskAttemptId()}"
    with fs.open_output_stream(mark) as out:
        for chunk in chunks:
            out.write(chunk)
    fs.move(mark, path)


def _load(fs: pafs.FileSystem, path: str, kind: str) -> np.ndarray:
    """Memory-mapped where the file system is local, else read."""
    if isinstance(fs, pafs.LocalFileSystem):
        with pa.memory_map(path) as f:
            return np.frombuffer(f.read_buffer(), kind)
    with fs.open_input_file(path) as f:
        return np.frombuffer(f.read_buffer(), kind)


def write_tokens(docs: DataFrame, folder: str, end_id: int, path: str | None = None, id_col: str = "doc_id", text_col: str = "text", parts: int | None = None) -> list[tuple[int, int, int, int]]:
    """Write docs' ids in ascending order of id_col, each document followed by end_id; null texts count as empty.

    Returns (part, base, ids, documents) in order. Null document ids come first, rows with one id are neighbours in
    any order, other columns are ignored, an empty table gives no parts."""
    spark = docs.sparkSession
    path = path or tokenizer_path()
    parts = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    end = np.array([end_id], "<u2").tobytes()
    fs, place = _open(folder)
    fs.create_dir(place, recursive=True)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, part = encoder(path), TaskContext.get().partitionId()
        fs, place = _open(folder)
        name, sizes, ids = f"{place}/part-{part:06d}", [], []
        mark = f"{name}.bin.{TaskContext.get().taskAttemptId()}"
        with fs.open_output_stream(mark) as out:
            for batch in batches:
                for text in batch.column("text"):
                    data = enc.encode(text.as_py()) + end
                    out.write(data)
                    sizes.append(len(data) // 2)
                ids.append(batch.column("id").fill_null(NULL_ID).to_numpy(zero_copy_only=False))
        enc.rest()
        if sizes:
            fs.move(mark, f"{name}.bin")
            _write(fs, f"{name}.idx", [np.concatenate(([0], np.cumsum(sizes))).astype("<u8").tobytes()])
            _write(fs, f"{name}.doc", [np.concatenate(ids).astype("<i8").tobytes()])
            yield pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int64()), "n_ids": pa.array([sum(sizes)], pa.int64()), "n_docs": pa.array([len(sizes)], pa.int64())})
        else:
            fs.delete_file(mark)

    # ranges are cut between rows of one id as well (of null ids, say), so no id is one task's
    rows = docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).alias("text"), F.monotonically_increasing_id().alias("row"))
    done = rows.repartitionByRange(parts, "id", "row").sortWithinPartitions("id", "row").select("id", "text").mapInArrow(run, "part bigint, n_ids bigint, n_docs bigint")
    # three numbers for each file
    out, base = [], 0
    for part, n_ids, n_docs in sorted(map(tuple, done.collect())):
        out.append((part, base, n_ids, n_docs))
        base += n_ids
    return out


def read_tokens(spark: SparkSession, folder: str, manifest: list[tuple[int, int, int, int]]) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document, from the files; one task for each part."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, base in zip(batch.column("part").to_pylist(), batch.column("base").to_pylist(), strict=True):
                fs, place = _open(folder)
                name = f"{place}/part-{part:06d}"
                ids, idx, docs = (_load(fs, f"{name}.{kind}", t) for kind, t in (("bin", "<u2"), ("idx", "<u8"), ("doc", "<i8")))
                at = idx.astype(np.int64)
                for k in range(0, len(docs), 10_000):
                    end = min(len(docs), k + 10_000)
                    crc = [zlib.crc32(ids[a:b].astype("<u4")) for a, b in zip(at[k:end].tolist(), at[k + 1 : end + 1].tolist(), strict=True)]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(docs[k:end], mask=docs[k:end] == NULL_ID), pa.array(base + at[k:end]), pa.array(np.diff(at[k : end + 1])), pa.array(crc, pa.int64())],
                        ["doc_id", "start", "n_tokens", "ids_crc32"],
                    )

    schema = "part bigint, base bigint, n_ids bigint, n_docs bigint"
    if not manifest:
        return spark.createDataFrame([], "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint")
    tasks = spark.createDataFrame(spark.sparkContext.parallelize(manifest, len(manifest)), schema)
    return tasks.mapInArrow(run, "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint")


def token_digests(docs: DataFrame, end_id: int = 2, path: str | None = None) -> DataFrame:
    """Write docs' token files in the shared folder and describe each document as the files have it."""
    folder = fresh_path(docs.sparkSession, "tokens")
    return read_tokens(docs.sparkSession, folder, write_tokens(docs, folder, end_id, path))
