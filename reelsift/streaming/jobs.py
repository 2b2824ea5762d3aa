"""Structured Streaming twins of the incremental batch operators.

Sources are file streams over the driver tables; sinks are parquet folders under the
session's shared checkpoint directory. Update-mode aggregates go through ``foreachBatch`` into a
:class:`KeyedTable` (idempotent upserts, merged in levels). ``run_available`` drives a
query with ``trigger(availableNow=True)`` (tests and backfills); a production job starts the
same query with a processing-time trigger.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window, functions as F
from pyspark.sql.types import FloatType, IntegerType, LongType, StructField, StructType

from reelsift.functions.labels import POSITIVE_RATING, reward_label
from reelsift.session import cut_lineage, ensure_checkpoint_dir
from reelsift.streaming.keyed import KeyedTable, fresh

WEEK_OFFSET = "4 days"  # epoch day 0 is a Thursday: windows of 7 days starting 4 days later begin on Mondays


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh folder under the shared checkpoint directory."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/streams/{name}-{uuid.uuid4().hex[:12]}"


def table_stream(spark: SparkSession, sf_dir: str, table: str, max_files: int | None = None) -> DataFrame:
    """File stream over one parquet table of ``sf_dir`` (schema from the footer)."""
    schema = spark.read.parquet(f"{sf_dir}/{table}.parquet").schema
    r = spark.readStream.schema(schema).option("pathGlobFilter", f"{table}.parquet")
    if max_files:
        r = r.option("maxFilesPerTrigger", max_files)
    return r.parquet(sf_dir)


def ratings_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Streaming twin of ``adapt.ratings``: lineitem stream joined to the static orders."""
    li = table_stream(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_quantity", "l_shipdate")
    od = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", "o_custkey")
    return (li.join(od, li.l_orderkey == od.o_orderkey)
            .select(F.col("o_custkey").cast("int").alias("userId"), F.col("l_partkey").cast("int").alias("movieId"),
                    (F.ceil(F.col("l_quantity") / 5) / 2).cast("float").alias("rating"),
                    F.unix_seconds(F.col("l_shipdate").cast("timestamp")).alias("timestamp")))


def events_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table_stream(spark, sf_dir, "events").select(
        "event_id", F.col("ts").cast("timestamp").alias("ts"), "user_id", "event_type", "value")


def run_available(query_df: DataFrame, out: str, mode: str = "update", keys: list[str] | None = None):
    """Run a streaming query to the end of the available input. With ``keys`` each micro-batch's rows are
    upserted into the :class:`KeyedTable` ``out``/table (update mode); without, they are appended to
    the parquet folder ``out``/data (append mode)."""
    w = query_df.writeStream.option("checkpointLocation", out + "/_ck").outputMode(mode)
    if keys is None:
        w = w.format("parquet").option("path", out + "/data")
    else:
        def write(batch: DataFrame, batch_id: int):
            KeyedTable(batch.sparkSession, out + "/table", keys).upsert(batch, batch_id)
        w = w.foreachBatch(write)
    q = w.trigger(availableNow=True).start()
    q.awaitTermination()
    return q


def current(spark: SparkSession, out: str, keys: list[str]) -> DataFrame:
    """The rows of a keyed sink."""
    return KeyedTable(spark, out + "/table", keys).now()


def stream_genre_week(events: DataFrame, watermark: str = "7 days") -> DataFrame:
    """SS-1: event-time weekly (Monday) windows per event type (used as genre): count and
    value sum; rows later than the watermark are dropped."""
    return (events.withWatermark("ts", watermark)
            .groupBy(F.window("ts", "7 days", "7 days", WEEK_OFFSET).alias("w"), F.col("event_type").alias("genre"))
            .agg(F.count(F.lit(1)).alias("event_count"), F.sum("value").alias("value_sum"))
            .select("genre", F.to_date(F.col("w.start")).alias("week_start"), "event_count", "value_sum"))


def stream_genre_week_ratings(ratings: DataFrame, pairs: DataFrame, watermark: str = "30 days") -> DataFrame:
    """SS-1 on ratings: stream-static join with the (movie, genre) pairs, Monday-aligned
    7-day event-time windows per genre, rating count and sum (equals AG-6 when nothing is
    late). The stream cannot aggregate twice, so the fan-out happens per rating here."""
    r = ratings.withColumn("event_time", F.timestamp_seconds("timestamp")).withWatermark("event_time", watermark)
    return (r.join(pairs, "movieId")
            .groupBy(F.window("event_time", "7 days", "7 days", WEEK_OFFSET).alias("w"), "genre")
            .agg(F.count(F.lit(1)).alias("rating_count"), F.sum(F.col("rating").cast("double")).alias("rating_sum"))
            .select("genre", F.to_date(F.col("w.start")).alias("week_start"), "rating_count", "rating_sum"))


def stream_user_stats(ratings: DataFrame, positive: float = POSITIVE_RATING) -> DataFrame:
    """SS-2: running per-user statistics (AG-1) in update mode."""
    from reelsift.operators.aggregates import user_stats
    return user_stats(ratings, positive)


def run_recent_items(ratings: DataFrame, out: str, n: int = 5):
    """SS-3: the n newest (timestamp, movie) pairs per user (ties: newer movie id first), kept up to date
    batch by batch in a keyed table of one row per user. A batch ranks its own rows first
    (``row_number <= n`` is cut before the shuffle, so a user's rows meet as n per task), then together
    with the stored pairs of its users, and only these users' rows are written. Run to the end of the input."""
    def keep(batch: DataFrame, batch_id: int):
        table = KeyedTable(batch.sparkSession, out + "/table", ["userId"])
        w = Window.partitionBy("userId").orderBy(F.col("timestamp").desc(), F.col("movieId").desc())
        own = batch.select("userId", "movieId", "timestamp").withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= n)
        pair = F.struct("timestamp", "movieId")
        newest = own.groupBy("userId").agg(F.collect_list(pair).alias("new"))  # n at most
        known, pairs = table.now(), F.col("a.new")
        both = newest.alias("a")
        if known is not None:
            both = both.join(known.alias("b"), F.expr("a.userId <=> b.userId"), "left")
            pairs = F.when(F.col("b.newest").isNull(), pairs).otherwise(F.concat(pairs, F.col("b.newest")))
        both = both.select(F.col("a.userId").alias("userId"), F.slice(F.sort_array(pairs, asc=False), 1, n).alias("newest"))
        table.upsert(both, batch_id)

    q = (ratings.select("userId", "movieId", "timestamp").writeStream.option("checkpointLocation", out + "/_ck").foreachBatch(keep)
         .trigger(availableNow=True).start())
    q.awaitTermination()
    return q


def recent_items_now(spark: SparkSession, out: str, n: int = 5) -> DataFrame:
    """The state of :func:`run_recent_items`, one row per user."""
    from reelsift.operators.windows import recent_items

    rows = current(spark, out, ["userId"]).select("userId", F.explode("newest").alias("p"))
    return recent_items(rows.select("userId", "p.movieId", "p.timestamp"), n)


def stream_interaction_log(ratings: DataFrame, segments: DataFrame, positive: float = POSITIVE_RATING) -> DataFrame:
    """SS-4: stream-static left join of each rating with its user's segment (append)."""
    return (ratings.withColumn("reward", reward_label("rating", positive))
            .join(segments.select("userId", "user_segment"), "userId", "left"))


RATING_KEY = ["userId", "movieId", "rating", "timestamp"]
#: Days of an output folder, and folders of late rows that are named to the scan, so that it reads no others.
PERIOD_DAYS, MOST_PERIODS = 30, 1000


def late_ratings(ratings: DataFrame, kept: DataFrame) -> DataFrame:
    """The distinct rows of the batch ``ratings`` that :func:`stream_dedup` dropped as late: exact
    anti-join with the rows it ``kept`` (nulls equal). Both together are the distinct ratings."""
    a, b = ratings.select(*RATING_KEY).distinct().alias("a"), kept.select(*RATING_KEY).distinct().alias("b")
    same = [F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")) for c in RATING_KEY]
    return a.join(b, same, "left_anti")


def stream_dedup(ratings: DataFrame, delay: str = "30 days") -> DataFrame:
    """SS-5: drop exact duplicate rating rows that arrive within the watermark delay; a key's state
    goes once the watermark has passed it by the delay.

    The watermark also drops late rows: one that a later micro-batch brings more than ``delay`` behind
    the newest rating of the batches before is lost, unique or not. :func:`late_ratings` finds them."""
    cols = RATING_KEY
    return (ratings.withColumn("event_time", F.timestamp_seconds("timestamp"))
            .withWatermark("event_time", delay).dropDuplicatesWithinWatermark(cols).select(*cols))


def run_dedup(ratings: DataFrame, out: str, delay_days: int = 30):
    """SS-5 with a side output: distinct ratings to ``out``/kept, and those that come late (more than the
    delay behind the newest rating of the batches before) to ``out``/late, each once. Nothing is lost:
    both together are the distinct ratings.

    The state is a keyed table of the ratings within the delay of the newest one; what has fallen behind
    goes when runs merge. Late rows are few: they are compared with the months of ``kept`` that they fall
    on and with the late rows so far. A folder's rows are written by one task, or by several if they are
    many. Every batch writes folders of its own and counts from the moment
    its state does, so replays are safe. Run to the end of the input."""
    delay = delay_days * 86400

    def live(notes: dict):
        return F.coalesce(F.col("timestamp") >= F.lit(notes["newest"] - delay), F.lit(True)) if notes.get("newest") is not None else F.lit(True)

    def write(batch: DataFrame, batch_id: int):
        spark = batch.sparkSession
        seen = KeyedTable(spark, out + "/seen", RATING_KEY, live)
        state = seen.manifest()
        if state["batch"] >= batch_id:
            return
        rows = cut_lineage(batch.select(*RATING_KEY).distinct(), "dedup-batch")
        newest = state["notes"].get("newest")
        behind = F.coalesce(F.col("timestamp") < F.lit(newest - delay), F.lit(False)) if newest is not None else F.lit(False)
        period = F.floor(F.col("timestamp") / (PERIOD_DAYS * 86400))
        new = cut_lineage(fresh(rows.where(~behind), seen.now(), RATING_KEY), "dedup-new")
        late = rows.where(behind)
        if newest is not None and late.limit(1).count():
            before = [spark.read.option("basePath", f"{out}/{side}").schema(rows.schema.add("period", "long").add("batch", "long")).parquet(f"{out}/{side}")
                      .where(F.col("batch") < batch_id) for side in ("kept", "late") if side == "kept" or state["notes"].get("late")]
            periods = [r[0] for r in late.select(period).distinct().limit(MOST_PERIODS + 1).collect()]
            for b in before:
                late = fresh(late, b.where(F.col("period").isin(periods)) if len(periods) <= MOST_PERIODS else b, RATING_KEY)
            late.withColumn("period", period).hint("rebalance", F.col("period")).write.mode("overwrite").partitionBy("period").parquet(f"{out}/late/batch={batch_id}")
            state["notes"]["late"] = True
        new.withColumn("period", period).hint("rebalance", F.col("period")).write.mode("overwrite").partitionBy("period").parquet(f"{out}/kept/batch={batch_id}")
        top = rows.agg(F.max("timestamp")).first()[0]
        state["notes"]["newest"] = max((x for x in (newest, top) if x is not None), default=None)
        seen.upsert(new, batch_id, state["notes"])

    q = (ratings.select(*RATING_KEY).writeStream.option("checkpointLocation", out + "/_ck").foreachBatch(write)
         .trigger(availableNow=True).start())
    q.awaitTermination()
    return q


def dedup_rows_now(spark: SparkSession, out: str) -> DataFrame:
    """The ratings of :func:`run_dedup` with ``late``."""
    schema = StructType([*ratings_schema(), StructField("period", LongType()), StructField("batch", LongType())])
    late = KeyedTable(spark, out + "/seen", RATING_KEY).manifest()["notes"].get("late")
    sides = [("kept", False), *([("late", True)] if late else [])]
    parts = [spark.read.schema(schema).option("basePath", f"{out}/{side}").parquet(f"{out}/{side}").select(*RATING_KEY, F.lit(flag).alias("late")) for side, flag in sides]
    return parts[0].unionByName(parts[1]) if late else parts[0]


def ratings_schema() -> list[StructField]:
    return [StructField("userId", IntegerType()), StructField("movieId", IntegerType()), StructField("rating", FloatType()), StructField("timestamp", LongType())]
