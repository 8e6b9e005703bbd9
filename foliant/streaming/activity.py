"""Quotas, idle sessions, latest status and duplicate requests: as batch jobs and as streams.

Each function that takes a stream returns a streaming DataFrame; the batch
functions give what the stream has given once all input is in.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

TOKEN_CAP, REQUEST_CAP, IDLE, REUSE = 50_000, 40, "10 minutes", "6 hours"


def timed(rows: DataFrame) -> DataFrame:
    """Watermarks need an instant; times without a zone are taken in the session's."""
    return rows.withColumn("ts", F.col("ts").cast("timestamp"))


def daily_usage(events: DataFrame, token_cap: int = TOKEN_CAP, request_cap: int = REQUEST_CAP) -> DataFrame:
    """(user_id, day, tokens, requests, over): each request counts once; days are UTC."""
    return events.groupBy("user_id", F.to_date("ts").alias("day")).agg(F.sum("tokens").alias("tokens"), F.count("*").alias("requests")).withColumn("over", (F.col("tokens") >= token_cap) | (F.col("requests") >= request_cap))


def admitted(events: DataFrame, token_cap: int = TOKEN_CAP, request_cap: int = REQUEST_CAP) -> DataFrame:
    """Adds ``allowed`` to each request: whether the user's earlier requests of the day left room."""
    before = W.partitionBy("user_id", F.to_date("ts")).orderBy("ts", "event_id").rowsBetween(W.unboundedPreceding, -1)
    used, made = F.coalesce(F.sum("tokens").over(before), F.lit(0)), F.count("*").over(before)
    return events.withColumn("allowed", (used < token_cap) & (made < request_cap))


def daily_usage_stream(events: DataFrame, late: str = "1 hour") -> DataFrame:
    """Tumbling days with a watermark; write it in update mode, as an upsert by user and day."""
    return timed(events).withWatermark("ts", late).groupBy(F.window("ts", "1 day"), "user_id").agg(F.sum("tokens").alias("tokens"), F.count("*").alias("requests")).select("user_id", F.to_date("window.start").alias("day"), "tokens", "requests")


def sessions(events: DataFrame, idle: str = IDLE) -> DataFrame:
    """(user_id, opened, purged_at, events): activity without a gap of ``idle``; what a session holds is purged at its end."""
    return events.groupBy(F.session_window("ts", idle).alias("w"), "user_id").agg(F.count("*").alias("events")).select("user_id", F.col("w.start").alias("opened"), F.col("w.end").alias("purged_at"), "events")


def sessions_stream(events: DataFrame, idle: str = IDLE, late: str = "10 minutes") -> DataFrame:
    """A closed session gives one row, in append mode."""
    return sessions(timed(events).withWatermark("ts", late), idle)


def latest(updates: DataFrame, key: str = "finding_id") -> DataFrame:
    """The newest update of each key: by generation, then time, then id. Partial maxima go ahead of the shuffle."""
    newest = updates.groupBy(key).agg(F.max(F.struct("generation", "ts", "event_id", "status")).alias("u"))
    return newest.select(key, "u.generation", "u.ts", "u.status")


def latest_stream(updates: DataFrame, key: str = "finding_id") -> DataFrame:
    """The same as a stream in update mode; rows of an older generation change nothing."""
    return latest(updates, key)


def first_requests(requests: DataFrame, key: str = "request") -> DataFrame:
    """Requests that repeat none of the same key that began a reuse window: one for each key and six hours of the day."""
    slot = F.window("ts", REUSE).alias("slot")
    return requests.groupBy(key, slot).agg(F.min(F.struct("ts", "event_id")).alias("first")).select(key, F.col("slot.start").alias("slot"), F.col("first.event_id").alias("event_id"))


def first_requests_stream(requests: DataFrame, key: str = "request") -> DataFrame:
    """Each key once within the watermark of the reuse time."""
    return timed(requests).withWatermark("ts", REUSE).dropDuplicatesWithinWatermark([key])


ADMITTED = "user_id long, day date, event_id long, ts timestamp, allowed boolean"


def admitted_stream(events: DataFrame, token_cap: int = TOKEN_CAP, request_cap: int = REQUEST_CAP, late: str = "1 hour") -> DataFrame:
    """(user_id, day, event_id, ts, allowed): each request as it comes, against what the user's day has left.

    State for a user and a day holds tokens and requests: read, checked, added to.
    A request that is denied adds nothing. The state goes at the day's end (UTC),
    once the watermark has passed it. Requests of a batch are taken in the order of
    their time, then id; append mode.
    """

    def step(key, frames, state):
        used, made = state.get if state.exists else (0, 0)
        if state.hasTimedOut:
            state.remove()
            return
        rows = pd.concat(list(frames)).sort_values(["ts", "event_id"], kind="stable")
        allowed = []
        for n in rows["tokens"].fillna(0).astype(int).tolist():
            ok = used < token_cap and made < request_cap
            allowed.append(ok)
            used, made = used + n * ok, made + ok
        state.update((used, made))
        end = int((pd.Timestamp(key[1]) + pd.Timedelta(days=1)).timestamp() * 1000)
        state.setTimeoutTimestamp(max(end, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame({"user_id": key[0], "day": key[1], "event_id": rows["event_id"], "ts": rows["ts"], "allowed": allowed})

    rows = timed(events).withWatermark("ts", late).withColumn("day", F.to_date("ts"))
    return rows.groupBy("user_id", "day").applyInPandasWithState(step, ADMITTED, "tokens long, requests long", "append", "EventTimeTimeout")


def request_key(title, abstract):
    """What makes requests identical: the beginnings of title and abstract, case aside."""
    return F.lower(F.concat(F.substring(F.trim(title), 1, 120), F.lit("|"), F.substring(F.trim(abstract), 1, 200)))


REUSED = "request string, event_id long, ts timestamp, opened timestamp, reused boolean"


def reuse_windows(requests: DataFrame, hours: int = 6, key: str = "request") -> DataFrame:
    """(request, event_id, ts, opened, reused): which requests are answered by an earlier one of the same key.

    The first request of a key opens a window of six hours; those in it (its end
    included) are answered from it and don't prolong it; the next one after it opens
    the next. Keys are dealt out and sorted, and each task passes over its rows once,
    in batches, with the open window of the key at hand: a key may have any number.
    """
    span = np.timedelta64(hours, "h")

    def run(batches):
        import pyarrow as pa

        key_, opened = None, None
        for b in batches:
            keys, ts = np.array(b.column(0).to_pylist(), object), b.column(2).to_numpy(zero_copy_only=False).astype("datetime64[us]")
            out, reused = np.empty(len(ts), "datetime64[us]"), np.ones(len(ts), bool)
            new = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]]) if len(ts) else np.zeros(0, int)
            for lo, hi in zip(new, np.r_[new[1:], len(ts)], strict=True):
                if keys[lo] != key_:
                    key_, opened = keys[lo], None
                while lo < hi:
                    if opened is None or ts[lo] > opened + span:
                        opened, reused[lo] = ts[lo], False
                    stop = lo + np.searchsorted(ts[lo:hi], opened + span, "right")
                    out[lo:stop], lo = opened, stop
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), pa.array(out).cast(b.schema.field("ts").type), pa.array(reused)], ["request", "event_id", "ts", "opened", "reused"])

    rows = timed(requests).select(F.col(key).alias("request"), "event_id", "ts").filter("request IS NOT NULL AND ts IS NOT NULL")
    return rows.repartition("request").sortWithinPartitions("request", "ts", "event_id").mapInArrow(run, REUSED)


def reuse_windows_stream(requests: DataFrame, hours: int = 6, late: str = "10 minutes", key: str = "request") -> DataFrame:
    """The same as a stream: state for each key holds when its window opened, and goes once the watermark has passed the window's end; append mode."""
    span = pd.Timedelta(hours=hours)

    def step(name, frames, state):
        if state.hasTimedOut:
            state.remove()
            return
        opened = pd.Timestamp(state.get[0], unit="us") if state.exists else None
        rows = pd.concat(list(frames)).sort_values(["ts", "event_id"], kind="stable")
        begun, reused = [], []
        for t in rows["ts"]:
            again = opened is not None and t <= opened + span
            opened = opened if again else t
            begun.append(opened)
            reused.append(again)
        state.update((int(opened.value // 1000),))
        state.setTimeoutTimestamp(max(int((opened + span).value // 1_000_000) + 1, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame({"request": name[0], "event_id": rows["event_id"], "ts": rows["ts"], "opened": begun, "reused": reused})

    rows = timed(requests).withWatermark("ts", late).select(F.col(key).alias("request"), "event_id", "ts")
    return rows.groupBy("request").applyInPandasWithState(step, REUSED, "opened long", "append", "EventTimeTimeout")


def upsert(target: str, keys: list[str]):
    """A ``foreachBatch`` function: the newest rows by key replace those in a Parquet table.

    The table is written beside the old one and named by the batch, so a batch
    that is run again gives the same table.
    """

    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        new = batch.dropDuplicates(keys)
        if number > 0:
            old = spark.read.parquet(f"{target}/batch={number - 1}")
            new = old.join(new.select(*keys), keys, "left_anti").unionByName(new)
        new.write.mode("overwrite").parquet(f"{target}/batch={number}")

    return write
