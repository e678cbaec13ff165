"""Streaming forms of what is otherwise batch: detection, log-in windows, versions. An extension of the batch rules."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from sparkveil.operators import recognizers, rewrite, session


def detect_stream(docs: DataFrame) -> DataFrame:
    """Documents (doc_id, text) of a stream with their spans; stateless, so no watermark."""
    return recognizers.detect(docs)


def redact_stream(docs: DataFrame) -> DataFrame:
    return rewrite.redact(detect_stream(docs), mark=rewrite.by_entity).select("doc_id", "rewritten")


def login_windows(uses: DataFrame, delay: str = "1 hour") -> DataFrame:
    """(account, start, end, uses): half an hour without use closes a window; events later than the watermark are
    not waited for."""
    at = uses.withWatermark("ts", delay).groupBy(F.session_window("ts", f"{session.IDLE_MINUTES} minutes").alias("w"), "account").agg(F.count("*").alias("uses"))
    return at.select("account", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "uses")


def failure_windows(failures: DataFrame, delay: str = "15 minutes") -> DataFrame:
    """(account, start, end, failures, blocked) of sliding quarter hours."""
    at = failures.withWatermark("ts", delay).groupBy(F.window("ts", f"{session.FAILURE_MINUTES} minutes", "5 minutes").alias("w"), "account").agg(F.count("*").alias("failures"))
    return at.select("account", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "failures", (F.col("failures") >= session.FAILURES).alias("blocked"))


def latest_versions(edits: DataFrame, delay: str = "1 hour") -> DataFrame:
    """(doc_id, version): rises of a document's version as edits (doc_id, version, ts) arrive; late ones change nothing.
    State is one number a document and goes when the watermark is a review session's time past its last edit. Event
    time and not the clock's decides, so a run over what is there comes to an end."""

    def advance(key: tuple, batches: Iterator, state: GroupState) -> Iterator:
        import pandas as pd

        if state.hasTimedOut:
            state.remove()
            return
        before = now = state.get[0] if state.exists else -1
        last = state.getCurrentWatermarkMs()
        for pdf in batches:
            now = max([now, *(int(v) for v in pdf["version"].dropna())])
            last = max([last, *(int(t.timestamp() * 1000) for t in pdf["ts"].dropna())])
        state.update((now,))
        state.setTimeoutTimestamp(last + session.REVIEW_HOURS * 3_600_000)
        if now > before:
            yield pd.DataFrame({"doc_id": [key[0]], "version": [now]})

    at = edits.withWatermark("ts", delay)
    return at.groupBy("doc_id").applyInPandasWithState(advance, "doc_id bigint, version bigint", "version bigint", "append", GroupStateTimeout.EventTimeTimeout)
