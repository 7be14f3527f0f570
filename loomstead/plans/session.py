"""A session over page tables: ingest, search, answer, plan, graph and publish; and a builder of custom pipelines."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomstead.functions import text as X
from loomstead.operators import budget, graph, index, parse, publish, retrieve, site
from loomstead.sources import readers

Transform = Callable[[DataFrame], DataFrame]


def scored_blocks(pages: DataFrame, blocks: DataFrame) -> DataFrame:
    """Blocks with url, site_id, salience as importance, entity flags and evidence scores."""
    w = Window.partitionBy("doc_id")
    n = blocks.withColumn("_i", F.row_number().over(w.orderBy("ord")) - 1).withColumn("_n", F.count("*").over(w))
    has = F.lit(False)
    for kind in X.ENTITY:
        has = has | (F.size(X.entities("text", kind)) > 0)
    scored = n.withColumn("importance", X.salience(F.col("type"), F.col("text"), F.col("_i"), F.col("_n"), F.col("section_path"), F.col("dom_path")))
    scored = scored.withColumn("evidence_score", X.evidence_score(F.col("type"), F.col("text"), has, F.lit(True))).drop("_i", "_n")
    first = pages.groupBy("doc_id").agg(F.min(F.struct("url", "site_id")).alias("f")).select("doc_id", "f.*")
    return scored.join(first, "doc_id")


def one_page(pages: DataFrame) -> DataFrame:
    """One row per doc_id: that of the first URL."""
    w = Window.partitionBy("doc_id").orderBy("url", "html")
    return parse.spread(pages, "doc_id").withColumn("_r", F.row_number().over(w)).filter("_r = 1").drop("_r")


@dataclass
class Session:
    spark: SparkSession
    pages: DataFrame | None = None
    blocks: DataFrame | None = None
    actions: DataFrame | None = None

    def ingest(self, pages: DataFrame) -> Session:
        """Adds pages (doc_id, site_id, url, html); a doc_id that is known is replaced.

        Equal pages at several URLs keep a row each in pages; blocks and actions are parsed once, and have the first URL.
        """
        first = F.first("html").over(Window.partitionBy("doc_id").orderBy("url", "html"))
        fresh = pages.withColumn("_h", first).filter(F.col("html").eqNullSafe(F.col("_h"))).drop("_h").dropDuplicates(["doc_id", "url"])
        parsed = one_page(fresh)
        gone = parsed.select("doc_id")
        every = fresh
        if self.pages is not None:
            old, new = self.pages.alias("o"), parsed.select("doc_id", "html").alias("n")
            other = (F.col("o.doc_id") == F.col("n.doc_id")) & ~F.col("o.html").eqNullSafe(F.col("n.html"))
            kept = old.join(new, other, "left_anti").join(fresh.select("doc_id", "url").alias("f"), (F.col("o.doc_id") == F.col("f.doc_id")) & F.col("o.url").eqNullSafe(F.col("f.url")), "left_anti")
            every = kept.unionByName(fresh, True)
        shown = one_page(every.join(gone, "doc_id", "left_semi"))
        b = scored_blocks(shown, parse.blocks(parsed))
        a = parse.actions(parsed).join(shown.select("doc_id", "url"), "doc_id")
        if self.pages is not None:
            keep = lambda d: d.join(gone, "doc_id", "left_anti")
            b, a = keep(self.blocks).unionByName(b), keep(self.actions).unionByName(a)
        self.pages, self.blocks, self.actions = every, b, a
        return self

    def save(self, path: str) -> None:
        for name in ("pages", "blocks", "actions"):
            getattr(self, name).write.mode("overwrite").parquet(f"{path}/{name}")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> Session:
        return cls(spark, *[spark.read.parquet(f"{path}/{name}") for name in ("pages", "blocks", "actions")])

    def plan(self, query: str) -> retrieve.Plan:
        return retrieve.plan(self.spark, query)

    def search_blocks(self, query: str, limit: int = 10, **filters) -> DataFrame:
        return retrieve.search(self.blocks, query, limit, self.plan(query).intent, index.block_filter(**filters))

    def search_actions(self, query: str, top_k: int = 10) -> DataFrame:
        text = F.concat_ws(" ", "label", "role")
        keyed = self.actions.withColumn("key", F.concat_ws(":", "doc_id", "action_id")).withColumn("text", text)
        return index.bm25(keyed, query, top_k=top_k).join(keyed.drop("text"), "key")

    def answer(self, query: str) -> DataFrame:
        return retrieve.answer(self.search_blocks(query), self.plan(query).intent)

    def stats(self) -> DataFrame:
        return self.pages.agg(F.countDistinct("doc_id").alias("documents"), F.countDistinct("site_id").alias("sites")).crossJoin(self.blocks.agg(F.count("*").alias("blocks"))).crossJoin(self.actions.agg(F.count("*").alias("actions")))

    def api_candidates(self) -> DataFrame:
        return graph.api_candidates(self.actions.drop("url").join(self.pages.select("doc_id", "url"), "doc_id"))

    def publish(self) -> dict[str, DataFrame]:
        docs = self.pages.select("doc_id", "site_id", "url", X.title_tag("html").alias("title"))
        return {
            "llms.txt": publish.llms_txt(docs, self.blocks, self.actions), "agent.json": publish.agent_json(docs, self.blocks, self.actions), "content.json": publish.content_feed(docs, self.blocks),
            "actions.json": publish.actions_feed(docs, self.actions), "agent-sitemap.xml": publish.sitemap(docs, self.blocks),
        }

    def markdown(self) -> DataFrame:
        return budget.markdown(self.blocks)

    def crawl(self, seeds: DataFrame, **options) -> DataFrame:
        return site.crawl(self.pages, seeds, **options)


@dataclass
class PipelineBuilder:
    """Stages as DataFrame functions; hooks run before or after a stage. Stages can be left out by name."""

    stages: list[tuple[str, Transform]] = field(default_factory=lambda: [("segment", parse.blocks)])
    hooks: dict[str, list[Transform]] = field(default_factory=dict)

    def with_stage(self, name: str, fn: Transform) -> PipelineBuilder:
        """Replaces the stage of that name, or adds it at the end."""
        names = [n for n, _ in self.stages]
        if name in names:
            self.stages[names.index(name)] = (name, fn)
        else:
            self.stages.append((name, fn))
        return self

    def _before(self, other: str, name: str, fn: Transform) -> PipelineBuilder:
        names = [n for n, _ in self.stages]
        if name in names:
            return self.with_stage(name, fn)
        self.stages.insert(names.index(other) if other in names else len(names), (name, fn))
        return self

    def with_fetcher(self, fn: Transform) -> PipelineBuilder:
        """Rows of sources to pages, before all else."""
        self.stages = [("fetch", fn), *[s for s in self.stages if s[0] != "fetch"]]
        return self

    def with_normalizer(self, fn: Transform) -> PipelineBuilder:
        return self._before("segment", "normalize", fn)

    def with_segmenter(self, fn: Transform) -> PipelineBuilder:
        return self.with_stage("segment", fn)

    def with_extractor(self, fn: Transform) -> PipelineBuilder:
        return self.with_stage("extract", fn)

    def with_aligner(self, fn: Transform) -> PipelineBuilder:
        return self.with_stage("align", fn)

    def with_skill_hints(self, selectors: DataFrame) -> PipelineBuilder:
        return self.with_stage("hints", lambda d: publish.apply_hints(d, selectors))

    def with_validator(self, check: Callable[[DataFrame], None]) -> PipelineBuilder:
        """check sees the result, and raises where it isn't as it should be."""

        def run(df: DataFrame) -> DataFrame:
            check(df)
            return df

        return self.with_stage(f"validate {len(self.stages)}", run)

    def skip(self, name: str) -> PipelineBuilder:
        self.stages = [s for s in self.stages if s[0] != name]
        return self

    def on(self, moment: str, fn: Transform) -> PipelineBuilder:
        """moment: before:<stage> or after:<stage>."""
        self.hooks.setdefault(moment, []).append(fn)
        return self

    def build(self) -> Transform:
        def run(df: DataFrame) -> DataFrame:
            for name, fn in self.stages:
                for f in self.hooks.get(f"before:{name}", []):
                    df = df.transform(f)
                df = df.transform(fn)
                for f in self.hooks.get(f"after:{name}", []):
                    df = df.transform(f)
            return df

        return run


class PluginRegistry:
    """Named sources, normalisers and extractors; `discover` lists those with a capability."""

    def __init__(self) -> None:
        self._plugins: dict[str, tuple[object, frozenset[str]]] = {}

    def register(self, name: str, plugin: object, capabilities: tuple[str, ...] = ()) -> None:
        if name in self._plugins:
            raise ValueError(f"{name} is registered already")
        self._plugins[name] = (plugin, frozenset(capabilities))

    def unregister(self, name: str) -> None:
        self._plugins.pop(name, None)

    def get(self, name: str):
        """The plugin, or None."""
        return self._plugins[name][0] if name in self._plugins else None

    def discover(self, capability: str) -> list[str]:
        return sorted(n for n, (_, c) in self._plugins.items() if capability in c)


def discover_entry_points(registry: PluginRegistry, group: str) -> list[str]:
    """Registers the installed plugins of a group; each entry point loads to (plugin, capabilities) or a plugin. Gives their names."""
    from importlib.metadata import entry_points

    found = []
    for e in sorted(entry_points(group=group), key=lambda e: e.name):
        loaded = e.load()
        plugin, capabilities = loaded if isinstance(loaded, tuple) else (loaded, ())
        registry.register(e.name, plugin, tuple(capabilities))
        found.append(e.name)
    return found


def embed(docs: DataFrame, batch: Callable[[list[str]], list[list[float]]], key: str = "key", text: str = "text", size: int = 256) -> DataFrame:
    """(key, embedding): batch turns up to `size` texts into vectors, in Arrow batches on the executors. A null text has a null vector."""

    def run(batches):
        import pyarrow as pa

        for part in batches:
            for lo in range(0, part.num_rows, size):
                some = part.slice(lo, size)
                texts = some.column(1).to_pylist()
                at = [k for k, t in enumerate(texts) if t is not None]
                out: list = [None] * len(texts)
                for k, v in zip(at, batch([texts[k] for k in at]) if at else []):
                    out[k] = [float(x) for x in v]
                yield pa.RecordBatch.from_arrays([some.column(0), pa.array(out, pa.list_(pa.float64()))], names=[key, "embedding"])

    kind = dict(docs.dtypes)[key]
    return docs.select(key, F.col(text).cast("string")).mapInArrow(run, f"`{key}` {kind}, embedding array<double>")


def register_source(name: str, fn: Callable[[SparkSession, str], DataFrame]) -> None:
    readers.FETCHERS[name] = fn
