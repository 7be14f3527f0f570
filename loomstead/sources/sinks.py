"""Sinks: files of published sites, memory and profiles as JSON, and a cache of compiled documents with freshness by tag and date."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomstead.functions import text as X


def site_files(outputs: dict[str, DataFrame]) -> DataFrame:
    """(site_id, name, content): the files of each site, from tables of (site_id, ..., content in the last column)."""
    every = None
    for name, df in outputs.items():
        part = df.select("site_id", F.lit(name).alias("name"), F.col(df.columns[-1]).alias("content"))
        every = part if every is None else every.unionByName(part)
    return every


def write_site_files(outputs: dict[str, DataFrame], path: str) -> None:
    """Text files under path/site=<slug>/name=<file>/, one per site and file."""
    files = site_files(outputs).withColumn("site", X.domain_slug("site_id"))
    files.select("site", "name", F.col("content").alias("value")).repartition("site", "name").write.mode("overwrite").partitionBy("site", "name").option("lineSep", "\n").text(path)


def write_memory(patterns: dict[str, DataFrame], path: str) -> None:
    """The tables of `memory_patterns` as JSON lines, one folder each."""
    for name, df in patterns.items():
        df.write.mode("overwrite").json(f"{path}/{name}")


def read_memory(spark, path: str, schemas: dict[str, str]) -> dict[str, DataFrame]:
    return {name: spark.read.schema(schema).json(f"{path}/{name}") for name, schema in schemas.items()}


def profile_json(profiles: DataFrame) -> DataFrame:
    """(domain, profile_json): keys of a domain by kind, and its template, as one object."""
    kinds = F.map_from_entries(F.array_sort(F.collect_list(F.struct("kind", "keys"))))
    by_kind = profiles.filter("kind is not null").groupBy("domain", "kind").agg(F.array_sort(F.collect_set("key")).alias("keys")).groupBy("domain").agg(kinds.alias("kinds"))
    template = profiles.groupBy("domain").agg(F.array_sort(F.collect_set(F.when(F.col("in_template"), F.col("key")))).alias("template"))
    return template.join(by_kind, "domain", "left").select("domain", F.to_json(F.struct("domain", "kinds", "template")).alias("profile_json"))


def read_profiles(df: DataFrame) -> DataFrame:
    """(domain, kind, key) of profile_json."""
    spec = F.from_json("profile_json", "domain string, kinds map<string,array<string>>, template array<string>")
    return df.select("domain", F.explode(spec["kinds"]).alias("kind", "keys")).select("domain", "kind", F.explode("keys").alias("key"))


CACHE = "content_hash string, config string, doc_id string, compiled string, etag string, last_modified string, cached_at timestamp, ttl_seconds long"


def cache_rows(docs: DataFrame, config: str, now: Column, ttl_seconds: int = 3600) -> DataFrame:
    """Entries of docs (doc_id, html, compiled; etag and last_modified if known), keyed by content and configuration."""
    known = lambda c: F.col(c) if c in docs.columns else F.lit(None)
    return docs.select(
        F.sha2("html", 256).alias("content_hash"), F.lit(config).alias("config"), "doc_id", "compiled", known("etag").cast("string").alias("etag"), known("last_modified").cast("string").alias("last_modified"),
        now.alias("cached_at"), F.lit(ttl_seconds).cast("long").alias("ttl_seconds"),
    )


def write_cache(entries: DataFrame, path: str) -> None:
    """Adds entries; of one key the newest counts when the cache is read."""
    entries.write.mode("append").partitionBy("config").parquet(path)


def newest(cache: DataFrame) -> DataFrame:
    return cache.groupBy("content_hash", "config").agg(F.max_by(F.struct("doc_id", "compiled", "etag", "last_modified", "ttl_seconds"), "cached_at").alias("e"), F.max("cached_at").alias("cached_at")).select("content_hash", "config", "e.*", "cached_at")


def freshness(cache: DataFrame, heads: DataFrame, now: Column) -> DataFrame:
    """Entries with `fresh`: by equal etag, else by equal last_modified, of what the server says now (doc_id, etag_now, last_modified_now), else by age."""
    both = cache.join(heads, "doc_id", "left")
    age = F.unix_timestamp(now) - F.unix_timestamp("cached_at") <= F.col("ttl_seconds")
    fresh = (
        F.when(F.col("etag").isNotNull() & F.col("etag_now").isNotNull(), F.col("etag") == F.col("etag_now"))
        .when(F.col("last_modified").isNotNull() & F.col("last_modified_now").isNotNull(), F.col("last_modified") == F.col("last_modified_now")).otherwise(age)
    )
    return both.withColumn("fresh", fresh).drop("etag_now", "last_modified_now")


def compile_cached(docs: DataFrame, cache: DataFrame, config: str, compile_: Callable[[DataFrame], DataFrame], now: Column, ttl_seconds: int = 3600) -> tuple[DataFrame, DataFrame]:
    """(compiled, new entries): what the cache has fresh is taken from it, the rest goes through compile_ (adds `compiled`). docs: doc_id, html."""
    keyed = docs.withColumn("content_hash", F.sha2("html", 256))
    live = newest(cache).filter((F.col("config") == config) & (F.unix_timestamp(now) - F.unix_timestamp("cached_at") <= F.col("ttl_seconds"))).select("content_hash", "compiled")
    done = compile_(keyed.join(live, "content_hash", "left_anti").drop("content_hash"))
    held = keyed.join(live, "content_hash").select("doc_id", "compiled", F.lit(True).alias("cached"))
    return held.unionByName(done.select("doc_id", "compiled", F.lit(False).alias("cached"))), cache_rows(done, config, now, ttl_seconds)
