"""Mixing sources to target weights by Sainte-Laguë apportionment.

Words are dealt in blocks of equal size. A source's blocks are the quotients target / (2k + 1) that reach half a
block, which is Sainte-Laguë's rule for the house that has the block as its divisor. A source's blocks go to its lots
and each lot's to its shards by highest quotients (words / (2k + 1)), so every shard has an integer quota and quotas
add up. A shard holds its documents in a seeded order and takes its quota from that stream: whole rounds first, then
its first blocks. DataFrame operations only; windows are over one shard, the shards of a lot or the lots of a source.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, written

WEIGHTS, CAP, BLOCK, SEED = (5, 2, 1), 3, 64, 17
#: Words of a shard and shards of a lot, about.
SHARD, LOT = 32_768, 256


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("bigint")


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, cap: int = CAP) -> DataFrame:
    """sizes (source, source_size), one row a source. Adds weight and target.

    Sources by code point, null last, take the weights in turn. The targets share the sum of all sizes by weight; no
    target exceeds cap times its source's size, what is above is shared again by weight among the others: those whose
    limit for a unit of weight is lowest are at their limit. A source without words has the target 0."""
    by_name, all_rows = Window.orderBy(F.asc_nulls_last("source")), Window.partitionBy()
    turn = F.row_number().over(by_name) - 1
    weight = F.element_at(F.array(*map(F.lit, weights)), (turn % len(weights) + 1).cast("int")).cast("bigint")
    rows = sizes.withColumn("weight", weight).withColumn("most", F.lit(cap) * F.col("source_size"))
    by_limit = Window.orderBy(F.col("most") / F.col("weight"), F.asc_nulls_last("source")).rowsBetween(Window.unboundedPreceding, -1)
    total, weights_in_all = F.sum("source_size").over(all_rows), F.sum("weight").over(all_rows)
    rows = rows.withColumn("left", total - F.coalesce(F.sum("most").over(by_limit), F.lit(0))).withColumn("shares", weights_in_all - F.coalesce(F.sum("weight").over(by_limit), F.lit(0)))
    rows = rows.withColumn("full", F.col("most") * F.col("shares") <= F.col("left") * F.col("weight"))
    free = ~F.col("full")
    rest = (total - F.coalesce(F.sum(F.when(F.col("full"), F.col("most"))).over(all_rows), F.lit(0))) * F.col("weight")
    target = F.when(F.col("full"), F.col("most").cast("double")).otherwise(F.try_divide(rest, F.sum(F.when(free, F.col("weight"))).over(all_rows)))
    return rows.select("source", "source_size", "weight", target.alias("target"))


def apportioned(rows: DataFrame, parent: list[str], child: str, size: str, whole: str, seats: str, out: str) -> DataFrame:
    """Adds out: the seats of each child by highest quotients size / (2k + 1), ties to the smaller child.

    whole: the size of all n of a parent's children, W; S its seats. The last quotient that gets a seat, t, is above
    W / (2S + n), and at most W / (2S - n) where 2S > n: a child with a seats has size / t within 2a - 1 and 2a + 1,
    and these add up to W / t within 2S - n and 2S + n. So quotients above the upper limit have a seat, those below the lower one have none, and only
    those between are ranked: about 2n in all."""
    n = F.count("*").over(Window.partitionBy(*parent))
    low, high = 2 * F.col(seats) - n, 2 * F.col(seats) + n
    # one more on either side makes up for rounding
    sure = F.greatest(F.coalesce(F.floor(F.try_divide(F.col(size).cast("double") * low, 2 * F.col(whole)) + 0.5), F.lit(0)) - 1, F.lit(0))
    last = F.coalesce(F.ceil(F.try_divide(F.col(size).cast("double") * high, 2 * F.col(whole)) + 0.5), F.lit(0)) + 1
    own = rows.select(*parent, child, F.col(size).alias("size"), F.col(seats).alias("seats"), sure.cast("bigint").alias("sure"), last.cast("bigint").alias("last"))
    ranked = own.withColumn("k", F.explode(F.sequence("sure", F.greatest("sure", "last"))))
    rest = F.col("seats") - F.sum(F.when(F.col("k") == F.col("sure"), F.col("sure"))).over(Window.partitionBy(*parent))
    place = F.row_number().over(Window.partitionBy(*parent).orderBy((F.col("size") / (2 * F.col("k") + 1)).desc(), child, "k"))
    won = ranked.withColumn("won", (place <= rest) & (F.col("size") > 0)).groupBy(*parent, child).agg((F.first("sure") + F.count_if("won")).alias(out))
    return rows.join(won, [*parent, child])


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, cap: int = CAP, block: int = BLOCK, seed: int = SEED, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """(doc_id, source, size, source_size, target, taken) for every row of docs.

    size: words of the text (null: 0). taken: words of the document in the mix, at most cap times size; a source's
    taken words are its target up to half a block, or less by what a full shard can't take. A source whose target is
    under half a block takes its target from one shard. Reruns agree: the order is that of the md5 of seed and id, then of sizes; equal rows are
    interchangeable. A null source is a source, a null id counts as an empty one; an empty table gives an empty one."""
    digest = F.md5(F.concat_ws("|", F.lit(str(seed)), F.coalesce(F.col(id_col).cast("string"), F.lit(""))).cast("binary"))
    own = docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).cast("string").alias("source"), word_count(F.col(text_col)).alias("size"), digest.alias("mark"))
    own = written(own, "mix-rows")
    sources = source_targets(own.groupBy("source").agg(F.sum("size").alias("source_size")), weights, cap)
    sources = sources.withColumn("blocks", F.greatest(F.floor(F.col("target") / F.lit(block) + 0.5), F.least(F.lit(1), F.ceil("target")))).withColumn("shards", F.greatest(F.lit(1), F.ceil(F.col("source_size") / F.lit(SHARD))))
    sources = written(sources.withColumn("key", F.concat(F.when(F.col("source").isNull(), "-").otherwise("+"), F.coalesce("source", F.lit("")))), "mix-sources")
    keyed = own.withColumn("key", F.concat(F.when(F.col("source").isNull(), "-").otherwise("+"), F.coalesce("source", F.lit("")))).drop("source")
    dealt = keyed.join(sources, "key").withColumn("shard", F.conv(F.substring("mark", 1, 8), 16, 10).cast("bigint") % F.col("shards"))
    dealt = written(dealt.select("doc_id", "source", "key", "shard", "size", "mark", "source_size", "target", "blocks"), "mix-dealt")
    shards = dealt.groupBy("key", "shard").agg(F.sum("size").alias("words"), F.first("source_size").alias("source_size"), F.first("blocks").alias("blocks"), F.first("target").alias("target"))
    shards = written(shards.withColumn("lot", F.floor(F.col("shard") / F.lit(LOT))), "mix-shards")
    lots = shards.groupBy("key", "lot").agg(F.sum("words").alias("lot_words"), F.first("source_size").alias("source_size"), F.first("blocks").alias("blocks"))
    lots = apportioned(lots, ["key"], "lot", "lot_words", "source_size", "blocks", "lot_blocks").select("key", "lot", "lot_words", "lot_blocks")
    quotas = apportioned(shards.join(lots, ["key", "lot"]), ["key", "lot"], "shard", "words", "lot_words", "lot_blocks", "quota")
    quotas = written(quotas.select("key", "shard", "words", F.least(F.col("quota") * block, F.col("words") * cap, F.when(F.col("target") < block / 2, F.ceil("target"))).alias("quota")), "mix-quotas")
    order = Window.partitionBy("key", "shard").orderBy("mark", "size").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = dealt.withColumn("start", F.sum("size").over(order) - F.col("size")).join(quotas, ["key", "shard"])
    rounds = F.coalesce(F.floor(F.col("quota") / F.nullif(F.col("words"), F.lit(0))), F.lit(0))
    rest = F.col("quota") - rounds * F.col("words")
    taken = rounds * F.col("size") + F.least(F.greatest(rest - F.col("start"), F.lit(0)), F.col("size"))
    return placed.select("doc_id", "source", "size", "source_size", "target", taken.cast("bigint").alias("taken"))


def _seats_sql(name: str, rows: str, parent: str, child: str, size: str, seats: str, out: str) -> str:
    """Every quotient of every child is ranked."""
    return f"""{name}_k AS (SELECT {parent}, {child}, {size}, {seats}, unnest(range(CAST({seats} AS BIGINT))) AS k FROM {rows}),
{name}_p AS (SELECT {parent}, {child}, row_number() OVER (PARTITION BY {parent} ORDER BY {size} / (2 * k + 1) DESC, {child}, k) <= {seats} AND {size} > 0 AS won FROM {name}_k),
{name}_c AS (SELECT {parent}, {child}, count(*) FILTER (WHERE won) AS n FROM {name}_p GROUP BY {parent}, {child}),
{name} AS (SELECT r.*, coalesce(c.n, 0) AS {out} FROM {rows} r LEFT JOIN {name}_c c ON {" AND ".join(f"r.{x.strip()} IS NOT DISTINCT FROM c.{x.strip()}" for x in (parent + "," + child).split(","))})"""


SQL = rf"""
WITH own AS (SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '{WORD}')), 0) AS size, md5('{SEED}|' || coalesce(CAST(doc_id AS VARCHAR), '')) AS mark FROM documents),
by_source AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM own GROUP BY source),
weighted AS (SELECT *, {CAP} * source_size AS most, list_extract([{", ".join(map(str, WEIGHTS))}], CAST((row_number() OVER (ORDER BY source NULLS LAST) - 1) % {len(WEIGHTS)} + 1 AS BIGINT)) AS weight FROM by_source),
limited AS (SELECT *, sum(source_size) OVER () AS total,
  sum(source_size) OVER () - coalesce(sum(most) OVER b, 0) AS room, sum(weight) OVER () - coalesce(sum(weight) OVER b, 0) AS shares
  FROM weighted WINDOW b AS (ORDER BY most / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
judged AS (SELECT *, most * shares <= room * weight AS at_limit FROM limited),
sources AS (SELECT source, source_size, CASE WHEN at_limit THEN CAST(most AS DOUBLE)
    ELSE CAST((total - coalesce(sum(most) FILTER (WHERE at_limit) OVER (), 0)) * weight AS DOUBLE) / sum(weight) FILTER (WHERE NOT at_limit) OVER () END AS target FROM judged),
counted AS (SELECT *, greatest(CAST(floor(target / {BLOCK} + 0.5) AS BIGINT), least(1, CAST(ceil(target) AS BIGINT))) AS blocks, greatest(1, CAST(ceil(source_size / {SHARD}) AS BIGINT)) AS shards FROM sources),
dealt AS (SELECT o.*, source_size, target, blocks, CAST('0x' || left(mark, 8) AS BIGINT) % shards AS shard FROM own o JOIN counted c ON o.source IS NOT DISTINCT FROM c.source),
shard_sizes AS (SELECT source, shard, shard // {LOT} AS lot, CAST(sum(size) AS BIGINT) AS words, any_value(source_size) AS source_size, any_value(target) AS target, any_value(blocks) AS blocks FROM dealt GROUP BY source, shard),
lot_sizes AS (SELECT source, lot, CAST(sum(words) AS BIGINT) AS lot_words, any_value(source_size) AS source_size, any_value(blocks) AS blocks FROM shard_sizes GROUP BY source, lot),
{_seats_sql("lots", "lot_sizes", "source", "lot", "lot_words", "blocks", "lot_blocks")},
shard_lots AS (SELECT s.source, s.lot, s.shard, s.words, s.target, l.lot_blocks FROM shard_sizes s JOIN lots l ON s.source IS NOT DISTINCT FROM l.source AND s.lot = l.lot),
{_seats_sql("won", "shard_lots", "source, lot", "shard", "words", "lot_blocks", "seats")},
quotas AS (SELECT source, shard, words, CAST(least(seats * {BLOCK}, words * {CAP}, CASE WHEN target < {BLOCK} / 2 THEN ceil(target) END) AS BIGINT) AS quota FROM won),
placed AS (SELECT d.*, q.words, q.quota, coalesce(q.quota // nullif(q.words, 0), 0) AS rounds,
  sum(size) OVER (PARTITION BY d.source, d.shard ORDER BY mark, size ROWS UNBOUNDED PRECEDING) - size AS start
  FROM dealt d JOIN quotas q ON d.source IS NOT DISTINCT FROM q.source AND d.shard = q.shard)
SELECT doc_id, CAST(size AS BIGINT) AS size, source_size, target,
  CAST(rounds * size + least(greatest(quota - rounds * words - start, 0), size) AS BIGINT) AS taken FROM placed
"""
