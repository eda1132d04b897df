"""SimHash near-duplicates found by pivot distance tables.

Every distinct fingerprint gets a table row of Hamming distances to reference fingerprints. One family of
references is a base and the fingerprints one bit away from it: how the distances to these differ from the
distance to the base is a coordinate vector. Fingerprints that agree on the coordinates of a family meet in a
bucket. For a radius of 3 the families follow from the pigeonhole principle twice over, so that any two
fingerprints within the radius share one of 16 buckets (28 coordinates each); no link is lost. For wider radii
the families are seeded random choices. In a bucket, pairs whose largest coordinate difference to a second,
unrelated set of references exceeds the radius are discarded (triangle inequality), and only survivors are
compared bit by bit. A bucket yields a spanning forest of its links, never all its pairs.

Buckets beyond `BLOCK` rows are cut into blocks; each pair of blocks is a task of its own.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import jaccard
from .common import packed, written
from .graph import FEW, connected_components

#: Rows of a bucket that one task compares at a time.
BLOCK = 2048
#: References of the second set, for the discard step.
PIVOTS = 16
#: Buckets up to so many rows are compared many at a time.
SMALL = 64
#: Rows that a task remembers to be connected; beyond that it may say a link again.
KNOWN = 500_000


def fingerprint(text: str | None, shingle: int = 3, words: int = 1) -> np.ndarray:
    """SimHash of a whole text as `words` unsigned 64-bit integers; null is the empty text, which has all bits 0."""
    out = np.zeros(words, "<u8")
    w = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not w:
        return out
    joined = b" ".join(w)
    ends = np.cumsum(np.fromiter(map(len, w), np.int64, len(w)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    n = max(1, len(w) - shingle + 1)
    spans = zip(starts[:n].tolist(), ends[-n:].tolist(), strict=True)
    if words == 1:
        h = np.array([xxhash.xxh64_intdigest(joined[a:b], 42) for a, b in spans], "<u8").view(np.uint8)
    else:
        pieces = [joined[a:b] for a, b in spans]
        h = np.frombuffer(b"".join([xxhash.xxh3_128_digest(s, 42 + i) for s in pieces for i in range(words // 2)]), np.uint8)
    h = h.reshape(n, 8 * words)
    counts = np.zeros(64 * words, np.int64)
    for i in range(0, n, 60_000):
        counts += np.unpackbits(h[i : i + 60_000], axis=1, bitorder="little").sum(axis=0, dtype=np.uint16)
    return np.packbits((2 * counts > n).astype(np.uint8), bitorder="little").view("<u8")


def fingerprint_column(text: Column, shingle: int = 3, words: int = 1) -> Column:
    """fingerprint() as an array of longs."""

    @F.pandas_udf("array<bigint>")
    def udf(texts: pd.Series) -> pd.Series:
        return pd.Series([fingerprint(t if isinstance(t, str) else None, shingle, words).view("<i8") for t in texts], dtype=object)

    return udf(text)


def families(bits: int, radius: int, seed: int = 7, wide: int = 48, coordinates: int = 17) -> list[np.ndarray]:
    """Sets of reference numbers. Radius up to 3: sets such that two fingerprints within it agree on one at least."""
    if radius > 3:
        rng = np.random.default_rng(seed)
        return [np.sort(rng.choice(bits, coordinates, replace=False)) for _ in range(wide)]
    out = []
    for block in np.array_split(np.arange(bits), radius + 1):
        rest = np.setdiff1d(np.arange(bits), block)
        out += [np.concatenate((block, part)) for part in np.array_split(rest, radius + 1)]
    return out


def pivot_table(fps: np.ndarray, references: np.ndarray) -> np.ndarray:
    """Hamming distances, fingerprints by references; both are matrices of unsigned 64-bit words."""
    out = np.zeros((len(fps), len(references)), np.int16)
    for k in range(fps.shape[1]):
        out += np.bitwise_count(fps[:, k, None] ^ references[None, :, k])
    return out


def _references(words: int, n: int, seed: int = 11) -> np.ndarray:
    return np.random.default_rng(seed).integers(0, 2**64, (n, words), dtype=np.uint64)


def _unit(words: int) -> np.ndarray:
    """The base (a random fingerprint) and those one bit away from it."""
    base = _references(words, 1, 5)
    flips = np.zeros((64 * words, words), np.uint64)
    flips[np.arange(64 * words), np.arange(64 * words) // 64] = np.uint64(1) << (np.arange(64 * words) % 64).astype(np.uint64)
    return np.concatenate((base, base ^ flips))


def _matrix(column: pa.Array, words: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype("<i8").view("<u8").reshape(-1, words)


def _keyed(words: int, sets: list[np.ndarray]):
    """Bucket keys: the family's number and a digest of its coordinates."""
    unit, weights = _unit(words), [np.uint64(1) << np.arange(len(s), dtype=np.uint64) for s in sets]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                part = batch.slice(at, 4096)
                fps = _matrix(part.column("fp"), words)
                table = pivot_table(fps, unit)
                relative = ((table[:, 1:] - table[:, :1] + 1) // 2).astype(np.uint64)
                keys = np.stack([(relative[:, s] * w).sum(axis=1) | np.uint64(i << 52) for i, (s, w) in enumerate(zip(sets, weights, strict=True))], axis=1)
                n = len(sets)
                take = pa.array(np.repeat(np.arange(part.num_rows), n))
                yield pa.RecordBatch.from_arrays([pa.array(keys.reshape(-1).view("<i8")), part.column("rep").take(take), part.column("fp").take(take)], ["key", "rep", "fp"])

    return run


def _forest(rep: np.ndarray, fps: np.ndarray, table: np.ndarray, radius: int) -> list[tuple[int, int]]:
    """Links that connect what the pairs within the radius connect, one for each row at most."""
    out, left = [], np.arange(len(rep))
    while len(left):
        frontier, left = [left[0]], left[1:]
        while frontier and len(left):
            i = frontier.pop()
            near = left[np.abs(table[left] - table[i]).max(axis=1) <= radius]
            near = near[np.bitwise_count(fps[near] ^ fps[i]).sum(axis=1) <= radius]
            if len(near):
                out += [(rep[i], rep[j]) for j in near]
                frontier += near.tolist()
                left = np.setdiff1d(left, near, assume_unique=True)
    return out


def _links(words: int, radius: int):
    references = _references(words, PIVOTS)

    def near(table, fps, i, j) -> np.ndarray:
        ok = np.abs(table[i] - table[j]).max(axis=1, initial=0) <= radius
        i, j = i[ok], j[ok]
        ok = np.bitwise_count(fps[i] ^ fps[j]).sum(axis=1) <= radius
        return np.stack((i[ok], j[ok]), axis=1)

    def groups(keys, rep, fps, joined: dict[int, int]) -> pa.RecordBatch | None:
        cut = np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1
        starts, ends = np.concatenate(([0], cut)), np.concatenate((cut, [len(keys)]))
        table, sizes = pivot_table(fps, references), ends - starts
        end, found = np.repeat(ends, sizes), []
        rows = np.flatnonzero(np.repeat((sizes > 1) & (sizes <= SMALL), sizes))
        step = 1
        while len(rows := rows[rows + step < end[rows]]):
            for at in range(0, len(rows), 1 << 16):
                some = rows[at : at + (1 << 16)]
                pairs = near(table, fps, some, some + step)
                found.append(rep[pairs])
            step += 1
        for a, b in zip(starts[sizes > SMALL], ends[sizes > SMALL], strict=True):
            if links := _forest(rep[a:b], fps[a:b], table[a:b], radius):
                found.append(np.array(links, np.int64))

        def root(x: int) -> int:
            while (up := joined.setdefault(x, x)) != x:
                joined[x] = x = joined[up]
            return x

        new = []
        if len(joined) > KNOWN:
            joined.clear()
        for a, b in np.concatenate(found).tolist() if found else []:
            if (x := root(a)) != (y := root(b)):  # what the task knows to be connected isn't said again
                joined[max(x, y)] = min(x, y)
                new.append((a, b))
        if not new:
            return None
        ab = np.array(new, np.int64)
        return pa.RecordBatch.from_arrays([pa.array(ab[:, 0]), pa.array(ab[:, 1])], ["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, joined = None, {}
        for batch in batches:
            if not batch.num_rows:
                continue
            now = (np.stack([batch.column(c).to_numpy(zero_copy_only=False) for c in ("key", "lo", "hi")], axis=1), batch.column("rep").to_numpy(zero_copy_only=False), _matrix(batch.column("fp"), words))
            if held is not None:
                now = tuple(np.concatenate(x) for x in zip(held, now, strict=True))
            last = int(np.flatnonzero((now[0] != now[0][-1]).any(axis=1))[-1]) + 1 if (now[0] != now[0][-1]).any() else 0
            held = tuple(x[last:] for x in now)
            if last and (found := groups(*(x[:last] for x in now), joined)):
                yield found
        if held is not None and (found := groups(*held, joined)):
            yield found

    return run


def similar_links(classes: DataFrame, words: int = 1, radius: int = 3, block: int = BLOCK) -> DataFrame:
    """Links (a, b) between the rows (rep long, fp array of longs, each once) whose fingerprints are within the radius.

    Up to a radius of 3 they connect all such rows; beyond it only those that share one of the seeded families' buckets."""
    keyed = classes.where("rep is not null").select("rep", "fp").mapInArrow(_keyed(words, families(64 * words, radius)), "key bigint, rep bigint, fp array<bigint>")
    # exact families have sparse buckets, of which those with one row are left out; sampled ones mostly have several
    sparse = radius <= 3
    sizes = written(keyed.groupBy("key").count().where(F.col("count") > (1 if sparse else block)), "buckets")
    blocks = F.coalesce(F.ceil(F.col("count") / F.lit(block)).cast("int"), F.lit(1))
    dealt = keyed.join(sizes, "key", "inner" if sparse else "left").select("key", "rep", "fp", blocks.alias("n"), F.pmod(F.xxhash64("rep", F.lit(3)), blocks).cast("int").alias("own"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("n") - 1)))
    dealt = dealt.select("key", F.least("own", "other").cast("bigint").alias("lo"), F.greatest("own", "other").cast("bigint").alias("hi"), "rep", "fp")
    return dealt.repartition("key", "lo", "hi").sortWithinPartitions("key", "lo", "hi").mapInArrow(_links(words, radius), "a bigint, b bigint")


def simhash_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, words: int = 1, radius: int = 3, few: int = 0) -> DataFrame:
    """(id, fp, component_id) for every row of docs.

    fp: SimHash of the whole text, A-Z lower-cased, over word shingles. component_id: the smallest id reachable
    over links of at most `radius` differing bits. Null and empty texts have the fingerprint 0 and are linked like
    any other; repeated rows stay repeated. A row with a null id gets the component of its fingerprint, null if no
    row with an id has that fingerprint. Other columns of docs are ignored, whatever their names. few: see connected_components()."""
    own = docs.select(F.col(id_col).cast("bigint").alias("id"), fingerprint_column(F.col(text_col), shingle, words).alias("fp"))
    own = written(own, "fingerprints")
    classes = written(own.groupBy("fp").agg(F.min("id").alias("rep")), "classes")
    found = connected_components(similar_links(classes, words, radius), few)
    named = classes.join(found, classes.rep == found.node, "left").select("fp", F.coalesce("component", "rep").alias("component_id"))
    return own.join(written(named, "components"), "fp").select("id", "fp", "component_id")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Drop near-duplicates: of each group linked by a Jaccard similarity of 0.8 (five-word shingles) the smallest id stays.

    Candidates are the components of the fingerprints, as simhash_components() has them, and what the fingerprints don't
    bring within their radius comes from the prefix filter: no link at 0.8 is lost, and every link is verified on the
    sets of shingles. Rows without an id can't be named and
    stay; null and empty texts have one set, the empty one, and are linked; repeated rows of the smallest id all stay;
    an empty table gives an empty one. Columns may have any names."""
    texts = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).alias("text"))
    marked = simhash_components(texts, "id", "text", few=FEW).select(F.col("id").alias("rep"), F.xxhash64("component_id", F.lit(7)).alias("component"))
    own, classes, met = jaccard.candidates(texts)
    marked = written(classes.select("rep").join(marked, "rep").distinct(), "near-marked")
    several = marked.groupBy("component").agg(F.count("*").alias("n")).where("n > 1").select("component")
    marked = marked.join(several, "component").select("rep", "component")
    drop = jaccard.drop_of(texts, own, classes, met.select("rep", "component").unionByName(marked)).select("id")
    return docs.select(packed(docs).alias("whole"), F.col(id_col).cast("bigint").alias("id")).join(drop, "id", "left_anti").select("whole.*")
