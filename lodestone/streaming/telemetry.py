"""Structured Streaming over the event log: daily counts, session acknowledgments, incremental work."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

EVENT = "event_id long, ts timestamp, kind string, node_id long"
#: Fixed value: how long an injection waits for its acknowledgment.
SESSION = "6 hours"


def read_events(spark: SparkSession, folder: str, per_trigger: int = 16) -> DataFrame:
    """The append-only log as a stream; broken lines are dropped."""
    return spark.readStream.schema(EVENT).option("maxFilesPerTrigger", per_trigger).option("mode", "DROPMALFORMED").json(folder)


def daily(events: DataFrame, late: str = "1 day") -> DataFrame:
    """kind, day, n, in tumbling days."""
    return events.withWatermark("ts", late).groupBy("kind", F.window("ts", "1 day")).agg(F.count("*").alias("n")).select("kind", F.col("window.start").alias("day"), "n")


def trailing(events: DataFrame, late: str = "1 day", length: str = "7 days") -> DataFrame:
    """kind, until, n over a window that slides by days."""
    return events.withWatermark("ts", late).groupBy("kind", F.window("ts", length, "1 day")).agg(F.count("*").alias("n")).select("kind", F.col("window.end").alias("until"), "n")


def once_a_session(events: DataFrame, late: str = SESSION) -> DataFrame:
    """Acknowledgments, each node's once within the watermark."""
    return events.where("kind = 'acknowledgment'").withWatermark("ts", late).dropDuplicatesWithinWatermark(["node_id"])


def acknowledged(events: DataFrame, late: str = "1 day") -> DataFrame:
    """node_id, event_id, ack_id: acknowledgments up to six hours after an injection (interval join of two streams)."""
    i = events.where("kind = 'injection'").select("event_id", F.col("node_id").alias("i_node"), F.col("ts").alias("i_ts")).withWatermark("i_ts", late)
    a = events.where("kind = 'acknowledgment'").select(F.col("event_id").alias("ack_id"), "node_id", "ts").withWatermark("ts", late)
    near = F.expr(f"node_id = i_node AND ts >= i_ts AND ts <= i_ts + INTERVAL {SESSION}")
    return i.join(a, near).select("node_id", "event_id", "ack_id")


def refresh(stream: DataFrame, known: Callable[[], DataFrame], work: Callable[[DataFrame], None], checkpoint: str):
    """Runs `work` on the rows of each micro-batch whose content_hash is not known yet; ends when the input does."""

    def batch(rows: DataFrame, _: int) -> None:
        work(rows.dropDuplicates(["content_hash"]).join(known().select("content_hash"), "content_hash", "left_anti"))

    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


class _Latest:
    """Per key, the hash that was last worked on; passes a row on only if its hash is another. Forgets keys after a rest."""

    def __init__(self, rest_ms: int) -> None:
        self.rest_ms = rest_ms

    def init(self, handle) -> None:
        self.held = handle.getValueState("hash", "hash string", ttlDurationMs=self.rest_ms)

    def handleInputRows(self, key, rows, timer_values):
        import pandas as pd

        # Of a batch's versions of a key the last one counts.
        last, known = None, self.held.get()[0] if self.held.exists() else None
        for pdf in rows:
            top = pdf.sort_values(["ts", "content_hash"]).iloc[-1]
            if last is None or (top["ts"], top["content_hash"]) > (last["ts"], last["content_hash"]):
                last = top
        if last["content_hash"] != known:
            self.held.update((last["content_hash"],))
            yield pd.DataFrame({"node_id": [key[0]], "content_hash": [last["content_hash"]], "ts": [last["ts"]], "text": [last["text"]], "was": [known]})

    def handleInitialState(self, key, initial, timer_values) -> None:
        self.held.update((initial["content_hash"].iloc[0],))

    def close(self) -> None:
        pass


def changed(versions: DataFrame, known: DataFrame | None = None, rest: int = 0) -> DataFrame:
    """node_id, content_hash, ts, text, was: versions (node_id, content_hash, ts, text) whose hash differs from the one last seen of the node.

    State is a value a node, kept by Spark in its state store and in the checkpoint, so a restarted query goes on where it ended and no batch
    reads what earlier ones knew. known (node_id, content_hash) is the state to begin with, an earlier index; rest is after how many milliseconds a
    node that is not seen is forgotten (0: never), which bounds the state. Needs the RocksDB state store.
    """
    from pyspark.sql.streaming import StatefulProcessor

    processor = type("Latest", (_Latest, StatefulProcessor), {})(rest)
    start = known.groupBy("node_id") if known is not None else None
    return versions.groupBy("node_id").transformWithStateInPandas(processor, "node_id long, content_hash string, ts timestamp, text string, was string", "update", "processingTime" if rest else "none", start)


def drain(df: DataFrame, folder: str, checkpoint: str) -> None:
    """Writes all that is there to a parquet sink and returns."""
    df.writeStream.format("parquet").option("path", folder).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start().awaitTermination()
