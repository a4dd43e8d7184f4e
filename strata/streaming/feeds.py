"""Incremental ingestion: micro-batches of items into an append-only store keyed on content hash."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.hashing import insert_ignore, key_hash


def stamped(items: DataFrame) -> DataFrame:
    """Items with the hash of feed, guid (else link) and title."""
    return items.withColumn("item_hash", key_hash(F.col("feed_id"), F.coalesce(F.nullif(F.col("guid"), F.lit("")), F.col("link")), F.col("title")))


def ingest(spark: SparkSession, source: str, schema, store: str, checkpoint: str, order: str = "item_no") -> StreamingQuery:
    """Runs what has arrived in ``source`` through once: each micro-batch appends the items that the store lacks.

    The store is Parquet in a folder all executors share, partitioned by the first two
    digits of the hash, so a batch reads only the partitions its items may lie in. A batch
    that is run again after a failure finds its items there and appends nothing twice. Only
    a store that doesn't exist counts as empty; one that can't be read raises its error.
    """
    stream = spark.readStream.schema(schema).parquet(source)

    def write(batch: DataFrame, _: int) -> None:
        fresh = stamped(batch).withColumn("part", F.substring("item_hash", 1, 2))
        at = spark._jvm.org.apache.hadoop.fs.Path(store)
        if at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at):
            asked = [r["part"] for r in fresh.select("part").distinct().collect()]  # at most 256
            have = spark.read.schema(fresh.schema).parquet(store).where(F.col("part").isin(asked))
        else:
            have = fresh.limit(0)
        insert_ignore(have, fresh, ["item_hash"], [order]).write.mode("append").partitionBy("part").parquet(store)

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def deduplicated(spark: SparkSession, source: str, schema) -> DataFrame:
    """The same as a stateful stream: state grows with the number of distinct items."""
    return stamped(spark.readStream.schema(schema).parquet(source)).dropDuplicates(["item_hash"])


def host_budget(requests: DataFrame, per_second: float, burst: float) -> DataFrame:
    """Token bucket for each host over a stream of (host, at): (host, at, allowed, tokens), state kept by host.

    Requests of a micro-batch are taken in order of time; a host unseen before starts with a full bucket.
    """
    from collections.abc import Iterator

    import pandas as pd
    from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

    def take(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        tokens, last = state.get if state.exists else (burst, None)
        rows = []
        for at in sorted(t for b in batches for t in b["at"]):
            seconds = at.timestamp()
            tokens = min(burst, tokens + (0.0 if last is None else max(0.0, seconds - last) * per_second))
            last = seconds if last is None else max(last, seconds)
            ok = tokens >= 1.0
            tokens -= 1.0 if ok else 0.0
            rows.append((key[0], at, ok, round(tokens, 6)))
        state.update((tokens, last))
        yield pd.DataFrame(rows, columns=["host", "at", "allowed", "tokens"])

    schema = "host string, at timestamp, allowed boolean, tokens double"
    return requests.select("host", "at").groupBy("host").applyInPandasWithState(take, schema, "tokens double, last double", "append", GroupStateTimeout.NoTimeout)
