"""Exact duplicates by a persistent digest index.

The index is a Parquet table bucketed and sorted by SHA-256 of the normalised text. A batch is first reduced to one
row for each digest (with partial aggregation, so copies never meet in one task), then joined to the index by
sort-merge: the anti-join gives the digests to append, and the index side is read in its buckets without a shuffle.
DataFrame operations only.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import LOWER, UPPER, ascii_lower, fresh_path, packed, written


class DigestIndex:
    """(digest binary, keep_id bigint, batch string): the texts seen so far, the row that stays of each and the batch
    that brought it. Rows are in path/data; path/buckets says in how many buckets, so every session reads them alike."""

    def __init__(self, spark: SparkSession, path: str | None = None, buckets: int | None = None):
        """Opens the index at path, or starts an empty one there; without a path, one that goes with the application.

        ValueError if an existing index has another number of buckets than the one asked for."""
        self.spark, self.path = spark, (path or fresh_path(spark, "digests")).rstrip("/")
        stored = self._stored()
        if stored is None:
            stored = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
            spark.createDataFrame([(stored,)], "buckets int").coalesce(1).write.json(f"{self.path}/buckets")
        elif buckets not in (None, stored):
            raise ValueError(f"the index has {stored} buckets, not {buckets}: leave buckets out, or write its rows to an index of its own")
        self.buckets, self.name = stored, f"aerotrace_digests_{uuid.uuid4().hex}"
        spark.sql(
            f"CREATE TABLE {self.name} (digest BINARY, keep_id BIGINT, batch STRING) USING parquet "
            f"CLUSTERED BY (digest) SORTED BY (digest) INTO {self.buckets} BUCKETS LOCATION '{self.path}/data'"
        )

    def _stored(self) -> int | None:
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.path}/buckets/_SUCCESS")
        if not path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(path):
            return None
        return self.spark.read.schema("buckets int").json(f"{self.path}/buckets").first()[0]

    def __enter__(self) -> DigestIndex:
        return self

    def __exit__(self, *_) -> None:
        self.close()

    def close(self) -> None:
        """Forgets the catalogue's name; the data stay."""
        self.spark.sql(f"DROP TABLE IF EXISTS {self.name}")

    def rows(self) -> DataFrame:
        return self.spark.table(self.name)

    def append(self, new: DataFrame, batch: str) -> None:
        """new (digest, keep_id): digests that the index doesn't have from other batches, each once. What it has from
        this batch already stays as it is, so an append can be repeated."""
        mine = self.rows().where(F.col("batch") == batch).select("digest")
        rows = new.select("digest", "keep_id", F.lit(batch).alias("batch")).join(mine.hint("merge"), "digest", "left_anti")
        dealt = rows.repartition(self.buckets, "digest").sortWithinPartitions("digest")
        dealt.write.bucketBy(self.buckets, "digest").sortBy("digest").format("parquet").mode("append").option("path", f"{self.path}/data").saveAsTable(self.name)


def text_digest(text: Column) -> Column:
    """SHA-256 (hex) of the text in UTF-8 with A-Z lower-cased; null counts as empty."""
    return F.sha2(F.coalesce(ascii_lower(text), F.lit("")).cast("binary"), 256)


def digest_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, digest, row) of every row of docs, written; row tells rows apart."""
    return written(docs.select(F.col(id_col).cast("bigint").alias("id"), F.unhex(text_digest(F.col(text_col))).alias("digest"), F.monotonically_increasing_id().alias("row")), "digest-rows")


def admitted(own: DataFrame, index: DigestIndex, batch: str | None = None) -> DataFrame:
    """(digest, keep_id, keep_row, group_size) for every digest of own (see digest_rows); new digests join the index.

    keep_row is -1 where a batch before this one has the text; keep_id is that batch's then. The index is looked up
    without the rows that this batch itself brought, so a batch that is run again under its name gives the same."""
    batch = batch or uuid.uuid4().hex
    classes = own.groupBy("digest").agg(F.max(F.struct("id", "row")).alias("top"), F.count("*").alias("group_size"))
    classes = written(classes.select("digest", F.col("top.id").alias("keep_id"), F.col("top.row").alias("keep_row"), "group_size"), "digest-classes")
    known = index.rows().where(F.col("batch") != batch).select("digest", F.col("keep_id").alias("known_id"))
    new = classes.join(known.hint("merge"), "digest", "left_anti")
    old = classes.join(known.hint("merge"), "digest").select("digest", F.col("known_id").alias("keep_id"), F.lit(-1).cast("bigint").alias("keep_row"), "group_size")
    decided = written(new.select("digest", "keep_id", "keep_row", "group_size").unionByName(old), "digest-decisions")
    index.append(decided.where("keep_row >= 0"), batch)
    return decided


def deduplicate(docs: DataFrame, index: DigestIndex, id_col: str = "doc_id", text_col: str = "text", batch: str | None = None) -> DataFrame:
    """(doc_id, keep_id, group_size, kept, text_sha256) for every row of docs; the new digests join the index.

    Of equal texts the row with the largest id stays (of rows with that same id, one), unless the index already has
    the text from another batch: then none of this batch stays and keep_id is the index's. A batch that is repeated
    under its name (after a lost driver, say) gives the same rows again. A null id is smaller than any other.
    group_size counts the batch's rows. An empty table gives an empty result; other columns are ignored."""
    own = digest_rows(docs, id_col, text_col)
    return _judged(own, admitted(own, index, batch))


def _judged(own: DataFrame, decided: DataFrame) -> DataFrame:
    return own.join(decided, "digest").select(
        F.col("id").alias("doc_id"), "keep_id", "group_size", (F.col("row") == F.col("keep_row")).alias("kept"), F.lower(F.hex("digest")).alias("text_sha256")
    )


def deduplicate_backwards(docs: DataFrame, index: DigestIndex, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """deduplicate() of a whole table in two batches: the larger ids first, then the rest against the index.

    As the larger id stays, the rows are those of one batch; group_size counts the whole table's rows."""
    own = digest_rows(docs, id_col, text_col)
    least, most = own.agg(F.min("id"), F.max("id")).first()
    late = F.coalesce(F.col("id") > F.lit(None if least is None else (least + most) // 2), F.lit(False))
    both = admitted(own.where(late), index, "late").unionByName(admitted(own.where(~late), index, "early"))
    # a digest of both batches has the same keep_id in both, and keep_row -1 in the second
    decided = both.groupBy("digest").agg(F.max("keep_id").alias("keep_id"), F.max("keep_row").alias("keep_row"), F.sum("group_size").alias("group_size"))
    return _judged(own, decided)


def keep_new(docs: DataFrame, index: DigestIndex, id_col: str = "doc_id", text_col: str = "text", batch: str | None = None) -> DataFrame:
    """docs with the rows that deduplicate() keeps, whole, under any column names. Null texts count as empty ones.

    Rows without an id are told apart by their digests alone; of rows with one id and one digest one stays. An empty
    table gives an empty one."""
    own = digest_rows(docs, id_col, text_col)
    kept = admitted(own, index, batch).where("keep_row >= 0").select(_key(F.col("keep_id"), F.col("digest")).alias("key"))
    # rows that share id and digest with another are few, and only they are counted off
    repeated = own.groupBy(_key(F.col("id"), F.col("digest")).alias("key")).agg((F.count("*") > 1).alias("again"))
    kept = written(kept.join(repeated, "key"), "digest-kept")
    rows = docs.select(packed(docs).alias("whole"), _key(F.col(id_col).cast("bigint"), F.unhex(text_digest(F.col(text_col)))).alias("key"))
    single = rows.join(kept.where("NOT again").select("key"), "key", "left_semi").select("whole.*")
    first = rows.join(kept.where("again").select("key"), "key", "left_semi").withColumn("n", F.row_number().over(Window.partitionBy("key").orderBy("key"))).where("n = 1")
    return single.unionByName(first.select("whole.*"))


def _key(row_id: Column, digest: Column) -> Column:
    return F.concat_ws("|", F.hex(digest), row_id.cast("string"))


SQL = f"""
WITH n AS (SELECT doc_id, coalesce(translate(text, '{UPPER}', '{LOWER}'), '') AS t FROM documents)
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
  doc_id = max(doc_id) OVER w AS kept, sha256(t) AS text_sha256
FROM n WINDOW w AS (PARTITION BY t)
"""
