"""Site-level aggregates: site records, per-visit memory, learned profiles, crawl frontiers and document quality."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomstead.functions import text as X

from .retrieve import first_of


def site_records(docs: DataFrame, actions: DataFrame | None = None) -> DataFrame:
    """site_id, doc_count, last_indexed, entry_points, and the first labels of its documents in order of arrival."""
    out = docs.groupBy("site_id").agg(F.count("*").alias("doc_count"), F.max("timestamp").alias("last_indexed"), F.sort_array(F.collect_set("url")).alias("entry_points"))
    if actions is None:
        return out
    w = Window.partitionBy("doc_id").orderBy("ord")
    firsts = actions.withColumn("_k", F.row_number().over(w)).filter("_k <= 5").join(docs.select("doc_id", "site_id", "timestamp"), "doc_id")
    labels = firsts.groupBy("site_id", "label").agg(F.min(F.struct("timestamp", "doc_id", "ord")).alias("first"))
    return out.join(labels.groupBy("site_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("first", "label"))), lambda x: x["label"]).alias("common_actions")), "site_id", "left")


def quality(blocks: DataFrame, action_counts: DataFrame | None = None) -> DataFrame:
    """Warnings and parse_confidence of each document."""
    b = blocks.filter(F.length(F.trim("text")) > 0)
    dup = b.groupBy("doc_id", "text").agg(F.count("*").alias("n")).groupBy("doc_id").agg(F.count_if(F.col("n") > 1).alias("dup_texts"))
    per = b.groupBy("doc_id").agg(F.count("*").alias("block_count"), F.count_if(F.col("type") == "heading").alias("headings"), F.max("importance").alias("best"), F.sum(F.length("text")).alias("chars"))
    df = per.join(dup, "doc_id")
    df = df.join(action_counts, "doc_id", "left").withColumn("action_count", F.coalesce("action_count", F.lit(0))) if action_counts is not None else df.withColumn("action_count", F.lit(0))
    w = F.array_compact(F.array(
        F.when(F.col("dup_texts") > 0, F.concat(F.col("dup_texts").cast("string"), F.lit(" duplicate block texts"))), F.when(F.col("headings") == 0, "no headings"), F.when(F.col("block_count") < 3, "fewer than 3 blocks"),
        F.when(F.col("action_count") > 3 * F.col("block_count"), "many actions"), F.when(F.col("best") <= 0.5, "nothing important"),
    ))
    ratio = F.col("chars") / F.greatest(F.lit(1), F.coalesce(F.col("html_chars") if "html_chars" in df.columns else F.lit(None), F.col("chars") * 10))
    return df.withColumn("warnings", w).withColumn("parse_confidence", 0.5 + 0.3 * F.least(F.lit(1.0), ratio / 0.1) + F.when(F.size("warnings") == 0, 0.2).otherwise(0.0))


def memory_patterns(blocks: DataFrame, actions: DataFrame, visits: DataFrame, min_pages: int = 3) -> dict[str, DataFrame]:
    """Patterns of domains with min_pages pages or more. blocks and actions carry domain; visits: domain, url, seq."""
    pages = blocks.groupBy("domain").agg(F.countDistinct("doc_id").alias("pages")).filter(F.col("pages") >= min_pages)
    texts = blocks.groupBy("domain", "text").agg(F.countDistinct("doc_id").alias("n")).join(pages, "domain").filter(F.col("n") >= 0.7 * F.col("pages")).select("domain", "text", (F.col("n") / F.col("pages")).alias("share"))
    roles = actions.filter("role is not null").groupBy("domain", "role").agg(F.countDistinct("doc_id").alias("n")).join(pages, "domain").filter(F.col("n") >= 0.5 * F.col("pages")).select("domain", "role", (F.col("n") / F.col("pages")).alias("share"))
    kinds = blocks.groupBy("domain", "type").agg(F.count("*").alias("n"))
    w = Window.partitionBy("domain").orderBy(F.desc("n"), "type")
    top = kinds.withColumn("rank", F.row_number().over(w)).filter("rank <= 3").join(pages.select("domain"), "domain", "left_semi")
    return {"pages": pages, "template_texts": texts, "roles": roles, "top_types": top, "sequences": url_pairs(visits)}


def url_pairs(visits: DataFrame, key: str = "domain", url: str = "url", order: tuple[str, ...] = ("seq",), top: int = 5) -> DataFrame:
    """Two-step sequences that occur more than once, the top ones of each key."""
    pairs = visits.withColumn("nxt", F.lead(url).over(Window.partitionBy(key).orderBy(*order))).filter(F.col("nxt").isNotNull())
    counted = pairs.groupBy(key, F.col(url).alias("first"), F.col("nxt").alias("second")).agg(F.count("*").alias("n")).filter("n > 1")
    w = Window.partitionBy(key).orderBy(F.desc("n"), "first", "second")
    return counted.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= top)


_NOISE_CLASSES = "ad ads advert banner breadcrumb comment consent cookie newsletter popup promo related share social sponsor widget".split()


def learn_profiles(children: DataFrame, min_pages: int = 2) -> DataFrame:
    """Per domain and body-child signature: share of distinct pages, kind (header, footer, sidebar, main, noise, template)."""
    pages = children.groupBy("domain").agg(F.countDistinct("doc_id").alias("pages"))
    keys = children.groupBy("domain", "key", "tag", "classes").agg(F.countDistinct("doc_id").alias("n"), F.countDistinct(F.md5("text")).alias("texts"), F.count("*").alias("occurrences")).join(pages, "domain").filter(F.col("pages") >= min_pages)
    share, unique = F.col("n") / F.col("pages"), F.col("texts") / F.col("occurrences")
    low = F.lower(F.concat_ws(" ", "tag", "classes"))
    w = Window.partitionBy("domain").orderBy(F.desc("unique_ratio"), F.desc("n"), "key")
    df = keys.withColumn("share", share).withColumn("unique_ratio", unique).withColumn("_r", F.row_number().over(w))
    noise = F.lit(False)
    for k in _NOISE_CLASSES:
        noise = noise | F.lower("classes").rlike(rf"(^|[\s_-]){k}($|[\s_-])")
    kind = (
        F.when(low.contains("header") | low.contains("navbar"), "header").when(low.contains("footer"), "footer").when(low.contains("sidebar") | low.contains("aside"), "sidebar").when(noise, "noise")
        .when((F.col("_r") == 1) & (F.col("unique_ratio") > 0.5), "main").when(F.col("share") >= 0.7, "template")
    )
    return df.select("domain", "key", "share", "unique_ratio", kind.alias("kind"), (F.col("share") >= 0.7).alias("in_template"))


def signatures(profiles: DataFrame) -> DataFrame:
    keys = F.array_join(F.array_sort(F.collect_list("key")), "\n")
    return profiles.filter("in_template").groupBy("domain").agg(F.substring(F.sha2(keys, 256), 1, 16).alias("template_signature"))


def links(pages: DataFrame, url: str = "url") -> DataFrame:
    """(url, link, pos): resolved targets of anchors, without leaving SQL."""
    found = pages.select(url, F.posexplode(F.regexp_extract_all("html", F.lit('<a [^>]*href="([^"]*)"'), F.lit(1))).alias("pos", "href"))
    return found.select(url, "href", resolve(F.col(url), F.col("href")).alias("link"), "pos")


def resolve(base: Column, href: Column) -> Column:
    """Absolute URL of href on a page: absolute, scheme-relative, rooted, fragment or relative to the page's folder."""
    origin = F.regexp_extract(base, r"^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*", 0)
    folder = F.regexp_replace(F.regexp_replace(base, r"[?#].*$", ""), r"([^/])/[^/]*$", "$1/")
    return (
        F.when(href.rlike(r"^[a-zA-Z][a-zA-Z0-9+.-]*:"), href).when(href.startswith("//"), F.concat(F.substring_index(base, ":", 1), F.lit(":"), href)).when(href.startswith("/"), F.concat(origin, href))
        .when(href.startswith("#") | (href == ""), F.concat(F.regexp_replace(base, "#.*$", ""), href)).otherwise(F.concat(folder, href))
    )


def crawl(pages: DataFrame, seeds: DataFrame, max_depth: int = 2, max_pages: int | None = None, include: str | None = None, exclude: str | None = None) -> DataFrame:
    """(url, depth): breadth-first over a stored page table, one round per depth, within the seeds' authorities.

    Rounds join the links of new pages with the table and drop what was visited. max_pages cuts by depth and URL.
    """
    table = pages.select(X.normalize_url("url").alias("url"), "html").dropDuplicates(["url"])
    out_links = links(table).select(F.col("url").alias("src"), X.normalize_url("link").alias("url")).distinct()
    hosts = F.broadcast(seeds.select(X.netloc("url").alias("host")).distinct())
    allowed = out_links.filter(~X.non_html("url")).withColumn("host", X.netloc("url")).join(hosts, "host")
    path = X.url_path("url")
    if include:
        allowed = allowed.filter(path.rlike(include))
    if exclude:
        allowed = allowed.filter(~path.rlike(exclude))
    seen = seeds.select(X.normalize_url("url").alias("url")).distinct().join(table.select("url"), "url", "left_semi").withColumn("depth", F.lit(0))
    front = seen
    for depth in range(1, max_depth + 1):
        front = front.select(F.col("url").alias("src")).join(allowed.select("src", "url"), "src").select("url").distinct().join(table.select("url"), "url", "left_semi").join(seen.select("url"), "url", "left_anti").withColumn("depth", F.lit(depth))
        seen = seen.unionByName(front)
    return seen.orderBy("depth", "url").limit(max_pages) if max_pages else seen


def cache_misses(pages: DataFrame, cache: DataFrame, config_hash: str, now: Column, ttl_seconds: int) -> DataFrame:
    """Pages whose content isn't in the cache for this configuration, or is there but expired."""
    fresh = cache.filter((F.col("config") == config_hash) & (F.unix_timestamp(now) - F.unix_timestamp("cached_at") <= ttl_seconds)).select(F.col("content_hash"))
    return pages.withColumn("content_hash", F.sha2("html", 256)).join(fresh.distinct(), "content_hash", "left_anti")


def recent_visits(visits: DataFrame, key: str, order: tuple[str, ...], keep: int = 10) -> DataFrame:
    w = Window.partitionBy(key).orderBy(*[F.desc(c) for c in order])
    return visits.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= keep).drop("_r")


def latest_snapshots(snapshots: DataFrame) -> DataFrame:
    return first_of(snapshots, ["url"], F.desc("captured_at"), F.desc("snapshot_id"))
