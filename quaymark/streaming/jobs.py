"""Structured Streaming jobs: de-duplication, windows, and detectors with keyed state.

Each job takes a streaming (or static) DataFrame and gives one back; run_once
drives a stream over all files that are there and returns what it wrote.  State
is bounded: by a watermark, or by a fixed number of entries and a time to live.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from quaymark.session import ensure_checkpoint_dir


DELAY = "1 hour"  # how late a call may come; what is later than that is left out


def _keep_until(state: GroupState, rows: pd.DataFrame, ttl_ms: int) -> None:
    """State goes when the watermark is ``ttl_ms`` past the session's last call."""
    last = int(rows["ts"].astype("datetime64[us]").astype("int64").max()) // 1000
    state.setTimeoutTimestamp(max(last, state.getCurrentWatermarkMs()) + ttl_ms)


def read_stream(spark: SparkSession, folder: str, like: DataFrame, files_per_batch: int = 1, pattern: str = "*.parquet") -> DataFrame:
    """A stream of the parquet files of a folder, with the schema of a table."""
    return spark.readStream.schema(like.schema).option("maxFilesPerTrigger", files_per_batch).option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").parquet(folder)


def event_time(df: DataFrame, ts: str = "ts") -> DataFrame:
    """A time without zone as the zoned one that watermarks need; it means UTC."""
    return df.withColumn(ts, F.col(ts).cast("timestamp"))


def drop_redelivered(df: DataFrame, keys: Sequence[str], ts: str = "ts", delay: str = "1 hour") -> DataFrame:
    """The first row of each key; a key is remembered for ``delay`` after its time, so state stays bounded."""
    return event_time(df, ts).withWatermark(ts, delay).dropDuplicatesWithinWatermark(list(keys))


def windowed(df: DataFrame, value: str, length: str, slide: str | None = None, by: Sequence[str] = (), ts: str = "ts", delay: str = "1 hour") -> DataFrame:
    """Rows and total per tumbling or sliding window; rows later than ``delay`` are not counted any more."""
    w = F.window(F.col(ts), length, slide or length)
    return event_time(df, ts).withWatermark(ts, delay).groupBy(w, *by).agg(F.count("*").alias("n"), F.sum(value).alias("total")).select(F.col("window.start").alias("start"), *by, "n", "total")


def session_totals(df: DataFrame, by: str, gap: str, ts: str = "ts", delay: str = "1 hour") -> DataFrame:
    """Rows per session that ends after a gap of silence."""
    w = F.session_window(F.col(ts), gap)
    return event_time(df, ts).withWatermark(ts, delay).groupBy(w, by).agg(F.count("*").alias("n")).select(by, F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "n")


def repeated_calls(df: DataFrame, window: int = 10, times: int = 5, ttl_ms: int = 3_600_000) -> DataFrame:
    """session_key, call_id, most: calls at which a signature occurs ``times`` times among the session's last ``window``.

    State per session: the last signatures.  It is dropped after ``ttl_ms`` of
    silence in event time.  Rows of a micro-batch are put in order of time and call id.
    """

    def step(key: tuple, pdfs: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        last = list(state.get[0]) if state.exists else []
        rows = pd.concat(list(pdfs)).sort_values(["ts", "call_id"])
        out = []
        for call, sig in zip(rows["call_id"], rows["sig"]):
            last = [*last, sig][-window:]
            most = max(last.count(s) for s in set(last))
            if most >= times:
                out.append((key[0], call, most))
        state.update((last,))
        _keep_until(state, rows, ttl_ms)
        yield pd.DataFrame(out, columns=["session_key", "call_id", "most"])

    return event_time(df).withWatermark("ts", DELAY).groupBy("session_key").applyInPandasWithState(step, "session_key long, call_id long, most long", "sigs array<string>", "append", GroupStateTimeout.EventTimeTimeout)


def no_progress(df: DataFrame, ring: int = 8, times: int = 5, seconds: int = 90, ttl_ms: int = 3_600_000) -> DataFrame:
    """session_key, call_id, same: calls whose signature occurs ``times`` times among the last ``ring`` within ``seconds``."""

    def step(key: tuple, pdfs: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        sigs, at = (list(x) for x in state.get) if state.exists else ([], [])
        rows = pd.concat(list(pdfs)).sort_values(["ts", "call_id"])
        out = []
        for call, sig, ts in zip(rows["call_id"], rows["sig"], rows["ts"].astype("datetime64[us]").astype("int64")):
            sigs, at = [*sigs, sig][-ring:], [*at, int(ts)][-ring:]
            same = sum(s == sig and a >= ts - seconds * 1_000_000 for s, a in zip(sigs, at))
            if same >= times:
                out.append((key[0], call, same))
        state.update((sigs, at))
        _keep_until(state, rows, ttl_ms)
        yield pd.DataFrame(out, columns=["session_key", "call_id", "same"])

    return event_time(df).withWatermark("ts", DELAY).groupBy("session_key").applyInPandasWithState(step, "session_key long, call_id long, same long", "sigs array<string>, at array<long>", "append", GroupStateTimeout.EventTimeTimeout)


def error_streaks(df: DataFrame, least: int = 3, ttl_ms: int = 3_600_000) -> DataFrame:
    """session_key, call_id, streak: errors that are at least the ``least``-th in a row; once a session for each streak."""

    def step(key: tuple, pdfs: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        streak = state.get[0] if state.exists else 0
        rows = pd.concat(list(pdfs)).sort_values(["ts", "call_id"])
        out = []
        for call, bad in zip(rows["call_id"], rows["is_error"]):
            streak = streak + 1 if bad else 0
            if streak == least:
                out.append((key[0], call, streak))
        state.update((streak,))
        _keep_until(state, rows, ttl_ms)
        yield pd.DataFrame(out, columns=["session_key", "call_id", "streak"])

    return event_time(df).withWatermark("ts", DELAY).groupBy("session_key").applyInPandasWithState(step, "session_key long, call_id long, streak long", "streak long", "append", GroupStateTimeout.EventTimeTimeout)


def run_once(stream: DataFrame, mode: str = "append") -> DataFrame:
    """Runs a stream over what is there, into a table of the checkpoint folder, and reads that."""
    base = f"{ensure_checkpoint_dir(stream.sparkSession)}/stream-{uuid.uuid4().hex}"
    query = stream.writeStream.outputMode(mode).format("parquet").option("path", f"{base}/out").option("checkpointLocation", f"{base}/state").trigger(availableNow=True).start()
    query.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{base}/out")


def latest_table(stream: DataFrame, keys: Sequence[str], order: Sequence[str], path: str, checkpoint: str, slices: int = 64) -> Callable[[], DataFrame]:
    """Last write wins into a parquet table that is cut by the hash of its keys.

    A micro-batch rewrites only the slices it has keys of, as new versions of
    them, and leaves each slice with its last two versions.  A batch that is
    run again writes the same versions from the same ones before, so a restart
    at any point gives the same table.  Starts the stream over what is there
    and waits; the result reads the newest version of each slice, also where
    nothing was new.
    """
    from quaymark.operators.telemetry import latest_by

    spark = stream.sparkSession
    cols = stream.columns
    part = F.pmod(F.xxhash64(*keys), F.lit(slices)).cast("int")
    root = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = root.getFileSystem(spark._jsc.hadoopConfiguration())

    def versions() -> dict[int, list[int]]:
        """Finished versions of each slice; a folder without its mark was cut off."""
        out: dict[int, list[int]] = {}
        for s in fs.globStatus(spark._jvm.org.apache.hadoop.fs.Path(f"{path}/s*/v*/_SUCCESS")) or []:
            v = s.getPath().getParent()
            out.setdefault(int(v.getParent().getName()[1:]), []).append(int(v.getName()[1:]))
        return out

    def folder(s: int, n: int) -> str:
        return f"{path}/s{s}/v{n}"

    def merge(batch: DataFrame, n: int) -> None:
        rows = batch.withColumn("__s", part).persist()
        try:
            touched = sorted(r["__s"] for r in rows.select("__s").distinct().collect())  # at most ``slices``
            before = {s: [v for v in vs if v < n] for s, vs in versions().items()}
            for s in touched:
                mine = rows.where(F.col("__s") == s).drop("__s")
                if before.get(s):
                    mine = mine.unionByName(spark.read.schema(batch.schema).parquet(folder(s, max(before[s]))))
                latest_by(mine, keys, order, [c for c in cols if c not in keys]).select(*cols).write.mode("overwrite").parquet(folder(s, n))
                for v in sorted(before.get(s, ()))[:-1]:
                    fs.delete(spark._jvm.org.apache.hadoop.fs.Path(folder(s, v)), True)
        finally:
            rows.unpersist()

    stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()

    def newest() -> DataFrame:
        now = [folder(s, max(vs)) for s, vs in sorted(versions().items())]
        return spark.read.schema(stream.schema).parquet(*now) if now else spark.createDataFrame([], stream.schema)

    return newest
