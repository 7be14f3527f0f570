"""Streaming variants: pages to blocks as they arrive, incremental statistics, visits with state, and budgeted events."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from loomstead.functions import text as X
from loomstead.operators import index as ix
from loomstead.operators import parse


def block_stream(pages: DataFrame) -> DataFrame:
    """Blocks of a stream (or table) of pages with doc_id and html: the batch operator as it is."""
    return parse.blocks(pages)


def events(blocks: DataFrame, actions: DataFrame, budget: int | None = None) -> DataFrame:
    """(doc_id, seq, event, payload): progress, blocks up to the budget of tokens, budget_reached, actions, complete."""
    cost = X.tokens_by_length("text")
    w = Window.partitionBy("doc_id").orderBy("ord").rowsBetween(Window.unboundedPreceding, 0)
    b = blocks.withColumn("running", F.sum(cost).over(w))
    kept = b if budget is None else b.filter(F.col("running") <= budget)
    part = lambda d, stage, o, event, payload: d.select("doc_id", F.lit(stage).alias("stage"), o.alias("o"), F.lit(event).alias("event"), payload.cast("string").alias("payload"))
    docs = blocks.select("doc_id").distinct()
    out = part(docs, 0, F.lit(0), "progress", F.lit("started")).unionByName(part(kept, 1, F.col("ord"), "block", F.col("text"))).unionByName(part(actions, 3, F.col("ord"), "action", F.col("label"))).unionByName(part(docs, 4, F.lit(0), "complete", F.lit("")))
    if budget is not None:
        out = out.unionByName(part(b.filter(F.col("running") > budget).select("doc_id").distinct(), 2, F.lit(0), "budget_reached", F.lit(str(budget))))
    return out.select("doc_id", (F.row_number().over(Window.partitionBy("doc_id").orderBy("stage", "o")) - 1).alias("seq"), "event", "payload")


def upsert_index(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Keeps index tables under `path` by micro-batch: a block (key, text) replaces that of its key; each batch is a version of its own."""

    def apply(batch: DataFrame, epoch: int) -> None:
        spark = batch.sparkSession
        last = f"{path}/v{epoch - 1}"
        fs = spark._jvm.org.apache.hadoop.fs.Path(last)
        known = fs.getFileSystem(spark._jsc.hadoopConfiguration()).exists(fs)
        now = ix.add(ix.Index.read(spark, last), batch) if known else ix.build(batch)
        now.write(f"{path}/v{epoch}")

    return stream.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windowed_counts(events_: DataFrame, watermark: str = "10 minutes", window: str = "1 hour", slide: str | None = None) -> DataFrame:
    """Counts by event type and time window; late rows beyond the watermark are left out. An addition of this engine."""
    return events_.withWatermark("ts", watermark).groupBy(F.window("ts", window, slide) if slide else F.window("ts", window), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))


def sessions(events_: DataFrame, gap: str = "30 minutes", watermark: str = "1 hour") -> DataFrame:
    return events_.withWatermark("ts", watermark).groupBy(F.session_window("ts", gap), "user_id").agg(F.count("*").alias("n"))


def visit_state(visits: DataFrame, keep: int = 10) -> DataFrame:
    """Per domain the running number of visits and the last `keep` URLs, from a stream of (domain, url, seq)."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        n, urls = (state.get[0], list(state.get[1])) if state.exists else (0, [])
        for pdf in batches:
            for url in pdf.sort_values("seq")["url"]:
                n, urls = n + 1, [*urls, url][-keep:]
        state.update((n, urls))
        yield pd.DataFrame({"domain": [key[0]], "visits": [n], "recent": [urls]})

    return visits.groupBy("domain").applyInPandasWithState(step, "domain string, visits long, recent array<string>", "n long, urls array<string>", "update", "NoTimeout")
