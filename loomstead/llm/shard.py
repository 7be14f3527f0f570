"""Sharding by vector bin packing: bytes, tokens and rows of the shards are balanced jointly.

Method: groups of equal texts are placed, largest first, in the shard where the dot product of the group's
vector (bytes, tokens, rows; each as a share of the total) with the shard's residual capacity is highest, among
shards with room for it. A group is split only if it doesn't fit in any shard, being larger than a shard's share of the
bytes, rows or tokens; then its documents fall, by hash, into parts of 1/64 of a shard.

What is placed on the driver is of bounded number: groups above a fixed share of the total (at most `units` per dimension) are placed
by themselves; all others fall, by hash of their text, into `units` bundles that are placed as one. So equal texts stay together, and
the plan is the same work for any input.

The law kept is `bytes`: the shards' sizes are near equal (rows and tokens follow, as far as groups allow).
Slots number a shard's documents from 0 without gaps; they are made in sub-groups, so that no task holds a shard.

Edge cases: null text has size 1 and a null checksum, empty text size 1 and checksum 0; null texts are one
group; rows that repeat are placed each; a null doc_id is placed; other columns are ignored; an empty table
gives no rows. Tokens are runs between blanks, counted as blanks plus one.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

UNITS = 16_384
#: Parts, as a share of one shard, of a group that no shard can hold.
PART = 1 / 64


def place(vectors: np.ndarray, shards: int, weights: tuple[float, float, float] = (0.8, 0.1, 0.1)) -> np.ndarray:
    """Shard of each vector (rows of non-negative numbers): best dot product with what is left, largest first.

    Where the dot product would pick a shard without room in bytes, the one with most room is taken.
    """
    totals = np.maximum(vectors.sum(0), 1)
    share = vectors / totals * np.array(weights)
    room = np.tile(np.array(weights) / shards, (shards, 1))
    out = np.zeros(len(vectors), np.int64)
    for k in np.lexsort((np.arange(len(vectors)), -share.sum(1), -share[:, 0])):
        gain = room @ share[k]
        fits = room[:, 0] >= share[k, 0]
        best = int(np.argmax(np.where(fits, gain, -np.inf))) if fits.any() else int(np.argmax(room[:, 0]))
        out[k] = best
        room[best] -= share[k]
    return out


def shard_documents(docs: DataFrame, shards: int = 8, units: int = UNITS) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard (null), n_tokens, group_key: one row per document."""
    spark = docs.sparkSession
    text = F.col("text")
    base = common.pick(docs, doc_id="long", text="string").select(
        "doc_id",
        (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        (F.coalesce(F.octet_length(text) - F.octet_length(F.replace(text, F.lit(" "), F.lit(""))), F.lit(0)) + 1).cast("long").alias("n_tokens"),
        F.coalesce(F.xxhash64(F.octet_length(text), text), F.lit(0)).alias("key"),
    )
    base = common.save(base, "shard-sizes")
    vector = [F.sum("size").alias("bytes"), F.sum("n_tokens").alias("tokens"), F.count("*").alias("rows")]
    sums = base.agg(*vector).first()
    if not sums["rows"]:
        return base.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), F.lit(0).alias("shard"), F.lit(0).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"), "n_tokens", F.col("key").alias("group_key"))
    groups = base.groupBy("key").agg(*vector)
    # At most `units` groups can exceed this share of one total: the collected list is bounded.
    large = groups.filter((F.col("bytes") * units > int(sums["bytes"])) | (F.col("tokens") * units > int(sums["tokens"])) | (F.col("rows") * units > int(sums["rows"])))
    most = F.greatest(*[F.col(c) / F.lit(float(sums[c]) / shards) for c in ("bytes", "tokens", "rows")])  # in shards
    alone = large.withColumn("parts", F.when(most > 1, F.ceil(most / PART)).otherwise(1).cast("int")).select("key", "parts")
    known = F.broadcast(spark.createDataFrame([(int(r[0]), int(r[1])) for r in alone.collect()], "key long, parts int"))
    part = F.when(F.col("parts") > 1, F.pmod(F.xxhash64("doc_id"), "parts")).otherwise(0)  # rows equal in doc_id and text share a part
    unit = F.when(F.col("parts").isNotNull(), F.xxhash64("key", part.cast("long"))).otherwise(F.pmod("key", F.lit(units)))
    placed = base.join(known, "key", "left").withColumn("unit", unit).withColumn("alone", F.col("parts").isNotNull())
    # Units: bundles, large groups (at most units for each dimension), and parts of the fewer than 3 * shards groups that are split: at most shards / PART + 1 for each.
    listed = placed.groupBy("alone", "unit").agg(*vector).orderBy("alone", "unit").toPandas()
    listed["shard"] = place(listed[["bytes", "tokens", "rows"]].to_numpy(np.float64), shards)
    chosen = F.broadcast(spark.createDataFrame(listed[["alone", "unit", "shard"]]).withColumn("shard", F.col("shard").cast("int")))
    out = placed.join(chosen, ["alone", "unit"]).select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "n_tokens", F.col("key").alias("group_key"))
    numbered = common.number_within(out, ["shard"], ["doc_id", "group_key"], "slot")
    return numbered.select("doc_id", "size", "text_crc32", "law", "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "n_tokens", "group_key")
