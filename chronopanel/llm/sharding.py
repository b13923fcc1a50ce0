"""Sharding by a two-pass external shuffle, in DataFrame functions alone.

The first pass scatters rows uniformly into buckets by a seeded hash of the key columns; the number of
buckets follows from the bytes of the table, all columns counted, so that a bucket fits in a task's memory. The second pass
shuffles each bucket (Spark's `shuffle` is a Fisher-Yates shuffle, seeded). Buckets in order, and rows in
their shuffled order, are one random permutation, which is cut into shards whose row counts differ by at
most one (the law `rows`).

A row's place is the place of its bucket plus its place there, so no task sees more than one bucket, and
only the table of bucket sizes is ordered as a whole. The hash takes the text too: rows that share an id,
or have none, scatter; rows equal in both differ in a salt, which follows the order in which they are read and has at least as
many values as there are buckets.
A bucket is written whole by one task, so a task that runs again cannot mix two permutations.

Null texts count zero bytes. All columns stay; columns named `shard` or `slot` are replaced. An empty
table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chronopanel.llm.common import stored

SHARDS = 16
SEED = 17
BUCKET_BYTES = 64 << 20
SALTS = 256
#: With more buckets than this, their places are joined by a shuffle instead of a broadcast.
BROADCAST_BUCKETS = 100_000
LAW = "rows"


def row_bytes(text_col: str = "text") -> Column:
    """UTF-8 bytes of the text (null: none) and 1."""
    return F.coalesce(F.octet_length(text_col), F.lit(0)).cast("bigint") + 1


def whole_bytes(docs: DataFrame) -> Column:
    """About the bytes of a row with all of its columns."""
    of = {"string": F.octet_length, "binary": F.octet_length}
    fixed = ("boolean", "tinyint", "smallint", "int", "bigint", "float", "double", "date", "timestamp", "timestamp_ntz")
    sizes = [of[kind](c) if kind in of else F.lit(8) if kind in fixed else F.octet_length(F.to_json(F.struct(c))) for c, kind in ((F.col(f"`{n}`"), k) for n, k in docs.dtypes)]
    return sum((F.coalesce(x, F.lit(0)).cast("bigint") for x in sizes), F.lit(8))


def shuffle_shards(docs: DataFrame, shards: int = SHARDS, id_col: str = "doc_id", text_col: str = "text", seed: int = SEED, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """docs with shard (int) and slot (bigint, gapless from 0 in a shard)."""
    docs = docs.drop("shard", "slot")
    total = docs.agg(F.sum(whole_bytes(docs))).first()[0] or 0
    buckets = -(-total // bucket_bytes) or 1
    salt = F.pmod(F.monotonically_increasing_id(), F.lit(max(SALTS, buckets)))
    key = F.xxhash64(F.lit(seed), F.col(id_col), F.col(text_col), salt)
    keyed = docs.select(key.alias("__key"), F.struct(*docs.columns).alias("__row")).withColumn("__bucket", F.pmod("__key", F.lit(buckets)))
    scattered = keyed.repartition(buckets, "__bucket").sortWithinPartitions("__bucket", "__key")
    shuffled = scattered.groupBy("__bucket").agg(F.shuffle(F.collect_list("__row"), F.lit(seed)).alias("__rows"))
    written = stored(shuffled.select("__bucket", F.posexplode("__rows").alias("__at", "__row")), "buckets")
    sizes = written.groupBy("__bucket").agg(F.count("*").alias("n"))
    before = Window.orderBy("__bucket").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    places = sizes.select("__bucket", (F.sum("n").over(before) - F.col("n")).alias("__before"), F.sum("n").over(Window.partitionBy()).alias("__of"))
    places = F.broadcast(places) if buckets <= BROADCAST_BUCKETS else places
    place, of, cut = F.col("__before") + F.col("__at"), F.col("__of"), F.lit(shards)
    least, longer = F.floor(of / cut), F.pmod(of, cut)
    in_long = place < longer * (least + 1)
    shard = F.when(in_long, F.floor(place / (least + 1))).otherwise(longer + F.floor((place - longer * (least + 1)) / F.greatest(least, F.lit(1))))
    start = F.col("shard") * least + F.least(F.col("shard"), longer)
    placed = written.join(places, "__bucket").withColumn("shard", shard.cast("int")).withColumn("slot", (place - start).cast("bigint"))
    return placed.select("__row.*", "shard", "slot")


def write_shards(docs: DataFrame, path: str, **options) -> None:
    """Shuffle docs and write them as Parquet, a folder for each shard, in order of slot within its files."""
    shuffle_shards(docs, **options).repartition("shard", F.floor(F.col("slot") / 100_000)).sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)
