"""Best-fit packing by minimum bin slack.

Only the histogram of piece lengths reaches the driver: as many counts as the capacity at most, however many
documents there are. A bin is planned by fixing the longest length left and running a subset-sum dynamic program
over the available lengths, on bitsets (bit s: the sum s can be reached), until the fullest combination is
known. It is removed as often as the counts allow, so the number of plans is bounded by the capacity as well. Then
every piece gets its number among those of its length, from prefix sums over salted groups, and the number names
its bin and place.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import written
from .encoder import encoder, tokenizer_path

CAPACITY = 4096
#: Pieces of one length are numbered in groups of about so many.
GROUP = 512


def token_pieces(docs: DataFrame, end_id: int = 1, capacity: int = CAPACITY, path: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32): every document's ids and end_id, cut only if over the capacity."""
    path = path or tokenizer_path()
    end = np.array([end_id], "<u2").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        for batch in batches:
            docs, pieces, starts, lengths, crcs = [], [], [], [], []
            for doc, text in zip(batch.column("id").to_pylist(), batch.column("text"), strict=True):
                ids = np.frombuffer(enc.encode(text.as_py()) + end, "<u2").astype("<u4")
                for piece, at in enumerate(range(0, len(ids), capacity)):
                    part = ids[at : at + capacity]
                    docs.append(doc)
                    pieces.append(piece)
                    starts.append(at)
                    lengths.append(len(part))
                    crcs.append(zlib.crc32(part))
            yield pa.RecordBatch.from_arrays([pa.array(docs, pa.int64()), pa.array(pieces, pa.int32()), pa.array(starts, pa.int64()), pa.array(lengths, pa.int64()), pa.array(crcs, pa.int64())], ["doc_id", "piece", "start", "length", "ids_crc32"])
        enc.rest()

    rows = docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint")


def fullest(counts: dict[int, int], room: int) -> list[int]:
    """The multiset of available lengths with the largest sum up to room, by subset-sum over bitsets."""
    steps, reach, full = [], 1, (1 << (room + 1)) - 1
    for length in sorted((n for n, c in counts.items() if c and n <= room), reverse=True):
        left, chunk = min(counts[length], room // length), 1
        while left and not reach >> room & 1:
            take = min(chunk, left)
            steps.append((length, take, reach))
            reach |= reach << (length * take) & full
            left, chunk = left - take, chunk * 2
        if reach >> room & 1:
            break
    total, out = reach.bit_length() - 1, []
    for length, take, before in reversed(steps):
        if not before >> total & 1:
            out += [length] * take
            total -= length * take
    return out


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, list[int]]]:
    """(bins, lengths of each) for all pieces; every length from 1 to the capacity."""
    left, out = dict(counts), []
    for longest in sorted(left, reverse=True):
        while left[longest]:
            left[longest] -= 1
            lengths = [longest, *sorted(fullest(left, capacity - longest), reverse=True)]
            left[longest] += 1
            times = min(left[n] // lengths.count(n) for n in set(lengths))
            for n in set(lengths):
                left[n] -= times * lengths.count(n)
            out.append((times, lengths))
    return out


def _places(plans: list[tuple[int, list[int]]]) -> dict[str, np.ndarray]:
    """Rows (length, number of its first piece, bin of it, pieces a bin, offset), sorted; as few as the plans' lengths."""
    rows, seen, first = [], {}, 0
    for times, lengths in plans:
        offset = 0
        for n in dict.fromkeys(lengths):
            each = lengths.count(n)
            rows.append((n, seen.get(n, 0), first, each, offset))
            seen[n] = seen.get(n, 0) + each * times
            offset += n * each
        first += times
    table = np.array(sorted(rows), np.int64).reshape(-1, 5)
    return dict(zip(("length", "number", "bin", "each", "offset"), table.T, strict=True))


def numbered(pieces: DataFrame, order: list[str], group: int = GROUP) -> DataFrame:
    """Adds number: from 0 among the rows of one length. A length's rows are salted into groups, so none is hot."""
    lengths = pieces.groupBy("length").agg(F.count("*").alias("n"))
    salts = F.ceil(F.col("n") / F.lit(group)).cast("int")
    salted = pieces.join(F.broadcast(lengths), "length").withColumn("salt", F.pmod(F.xxhash64(*order, F.lit(9)), salts)).drop("n")
    sizes = salted.groupBy("length", "salt").agg(F.count("*").alias("size"))
    before = Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    bases = sizes.select("length", "salt", F.coalesce(F.sum("size").over(before), F.lit(0)).alias("base"))
    own = Window.partitionBy("length", "salt").orderBy(*order)
    return salted.withColumn("own", F.row_number().over(own) - 1).join(bases, ["length", "salt"]).withColumn("number", F.col("base") + F.col("own")).drop("salt", "own", "base")


def pack(pieces: DataFrame, order: list[str], capacity: int = CAPACITY) -> DataFrame:
    """Adds sequence_id and offset to pieces, which have a length from 1 to the capacity; no piece is cut or dropped.

    `order` names columns that tell pieces apart; equal rows share their places in any order. An empty table gives
    an empty one. The histogram of lengths and the plans have at most as many rows as the capacity allows."""
    counts = {int(n): int(c) for n, c in pieces.groupBy("length").count().collect()}
    table = _places(plan(counts, capacity))
    keys = table["length"] << 44 | table["number"] if counts else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, number = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("length", "number"))
            at = np.searchsorted(keys, length << 44 | number, side="right") - 1
            k = number - table["number"][at]
            sequence, offset = table["bin"][at] + k // table["each"][at], table["offset"][at] + k % table["each"][at] * length
            names = [n for n in batch.schema.names if n != "number"]
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in names), pa.array(sequence), pa.array(offset)], [*names, "sequence_id", "offset"])

    rows = numbered(pieces, order)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema if f.name != "number")
    return rows.mapInArrow(run, f"{schema}, sequence_id bigint, offset bigint")


def packed_documents(docs: DataFrame, end_id: int = 1, capacity: int = CAPACITY, path: str | None = None) -> DataFrame:
    """All documents packed; null and empty texts are pieces of end_id alone. Repeated rows and null ids have places of
    their own; other columns are ignored; an empty table gives an empty one."""
    # equal rows, of null ids say, are told apart by their place, so that no salt is hot
    pieces = written(token_pieces(docs, end_id, capacity, path).withColumn("row", F.monotonically_increasing_id()), "pieces")
    return pack(pieces, ["doc_id", "piece", "ids_crc32", "row"], capacity).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
