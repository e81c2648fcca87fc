"""Shards by proportional stratified interleaving.

Within each source the rows are put in a seeded shuffled order; row r of n gets
the fraction (2r + 1) / 2n. All rows sorted by fraction interleave the sources
in their proportion, so each of the equal pieces into which the sorted rows are
cut holds the mixture of the whole.

Both ranks are exact and no group of rows is ever one task: rows fall into
ranges of the shuffled order (and of the fraction), a table with the rows of each
range gives where it starts, and rows are numbered inside a range only. Texts
are read once; what is shuffled is ids, sizes and checksums.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rollspark.llm.common import CRC_TABLE, crc32_sql, table, write_once

#: Rows of a range, as far as ``MOST_RANGES`` allows; the table of ranges is the only thing that one task sums up.
RANGE_ROWS, MOST_RANGES = 1000, 1 << 17
SEED = "rollspark"


def stratified_shards(docs: DataFrame, shards: int = 8, stratum: str = "source", doc_id: str = "doc_id", text: str = "text", seed: str = SEED) -> DataFrame:
    """``doc_id``, ``stratum``, ``size`` (UTF-8 bytes of the text plus 1), ``text_crc32``, ``fraction``, ``position``, ``shard`` and ``slot`` of every row.

    The numbers of rows in the shards differ by one at most, and so do a shard's
    rows of one stratum from its share, but for one row at each of its ends and
    each other stratum. A null stratum is a stratum of its own; a null text
    counts as empty, a null id as an id of its own. The shuffled order is that
    of a digest of seed, id and text; rows alike in these and in the stratum
    are interchangeable and are counted together before they are shuffled.
    Other columns are not read. An empty table gives no rows.
    """
    body = F.coalesce(F.col(text), F.lit(""))
    digest = F.md5(F.concat_ws("|", F.lit(seed), F.coalesce(F.col(doc_id).cast("string"), F.lit("-")), F.md5(body.cast("binary"))).cast("binary"))
    narrow = docs.select(
        F.col(doc_id).alias("doc_id"), F.coalesce(F.concat(F.lit("="), F.col(stratum).cast("string")), F.lit("")).alias("stratum"),
        (F.octet_length(body) + 1).cast("long").alias("size"), F.crc32(body.cast("binary")).alias("text_crc32"), digest.alias("dealt"))
    rows = write_once(narrow.groupBy("stratum", "dealt", "doc_id", "size", "text_crc32").agg(F.count("*").alias("copies")), "shard-rows")
    total = rows.agg(F.sum("copies")).first()[0] or 0
    ranges = min(max(1, -(-total // RANGE_ROWS)), MOST_RANGES)

    # rank in the stratum: rows of the ranges before, plus rows before in the range
    placed = rows.withColumn("range", F.expr(f"cast(conv(substr(dealt, 1, 8), 16, 10) as bigint) * {ranges}L div 4294967296L"))
    before = Window.partitionBy("stratum").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    starts = (placed.groupBy("stratum", "range").agg(F.sum("copies").alias("held"))
              .select("stratum", "range", F.coalesce(F.sum("held").over(before), F.lit(0)).alias("start"), F.sum("held").over(Window.partitionBy("stratum")).alias("n")))
    inside = Window.partitionBy("stratum", "range").orderBy("dealt", "doc_id", "size", "text_crc32").rowsBetween(Window.unboundedPreceding, -1)
    ranked = (placed.join(starts, ["stratum", "range"])
              .withColumn("rank", F.col("start") + F.coalesce(F.sum("copies").over(inside), F.lit(0)))
              .withColumn("rank", F.explode(F.sequence(F.col("rank"), F.col("rank") + F.col("copies") - 1)))
              .select("doc_id", "stratum", "size", "text_crc32", "rank", ((2 * F.col("rank") + 1).cast("double") / (2 * F.col("n")).cast("double")).alias("fraction")))
    ranked = write_once(ranked, "shard-ranks")

    # position among all rows, likewise by ranges of the fraction
    spread = ranked.withColumn("range", F.floor(F.col("fraction") * ranges))
    firsts = (spread.groupBy("range").agg(F.count("*").alias("held"))
              .select("range", F.coalesce(F.sum("held").over(Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("start")))
    order = Window.partitionBy("range").orderBy("fraction", "stratum", "rank")
    position = spread.join(firsts, "range").withColumn("position", F.col("start") + F.row_number().over(order) - 1)
    return (position.withColumn("shard", F.expr(f"position * {shards}L div {max(total, 1)}L").cast("int"))
            .withColumn("slot", F.expr(f"position - (shard * {total}L + {shards - 1}L) div {shards}L"))
            .select("doc_id", F.expr("nullif(substr(stratum, 2), if(stratum = '', '', null))").alias("stratum"), "size", "text_crc32", "fraction", "position", "shard", "slot"))


def op12_stratified_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = stratified_shards(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), F.col("stratum").alias("source"))


ORACLE = f"""
WITH {CRC_TABLE},
d AS (
  SELECT doc_id, source, encode(coalesce(text, '')) AS b, md5('{SEED}|' || coalesce(doc_id::VARCHAR, '-') || '|' || md5(coalesce(text, ''))) AS dealt FROM documents),
sized AS (SELECT doc_id, source, dealt, (octet_length(b) + 1)::BIGINT AS size, {crc32_sql("b")} AS text_crc32 FROM d, crc),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY source ORDER BY dealt, doc_id NULLS FIRST, size, text_crc32) - 1 AS r, count(*) OVER (PARTITION BY source) AS n FROM sized),
cut AS (
  SELECT *, row_number() OVER (ORDER BY (2 * r + 1)::DOUBLE / (2 * n)::DOUBLE, source NULLS FIRST, r) - 1 AS pos, count(*) OVER () AS total FROM ranked)
SELECT doc_id, size, text_crc32, 'rows' AS law, (pos * 8 // total)::INTEGER AS shard,
  (pos - ((pos * 8 // total) * total + 7) // 8)::BIGINT AS slot, NULL::INTEGER AS grown_shard, source
FROM cut
"""
