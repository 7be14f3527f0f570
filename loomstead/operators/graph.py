"""Navigation and action graphs, and the endpoints that actions or network traces suggest."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomstead.functions import text as X

from .retrieve import first_of

API_PATH = r"(?i)/(?:api|graphql|rest|v\d+)(?:/|$)|\.(?:json|xml)$"
PAGINATION = r"(?i)[?&](?:page|offset|limit|cursor|start|per_page)="
STRUCTURED = ("application/atom+xml", "application/rss+xml", "text/xml", "application/xml", "application/json")


def node_id(kind: str, ref: Column) -> Column:
    return F.concat(F.lit(f"{kind}_"), F.substring(F.sha2(ref, 256), 1, 8))


def nav_edges(actions: DataFrame) -> DataFrame:
    """doc_id, action_id, ord, target (node), node_type, node_label, url, edge_label, requires_input, input_fields. Other actions make no edge."""
    t = F.col("type")
    kind = F.when(t == "navigate", "page").when(t == "submit", "form_result").when(t == "download", "download").when(F.col("may_open_modal"), "modal")
    ref = F.when(kind.isin("page", "download"), F.coalesce("target_url", "action_id")).otherwise(F.col("action_id"))
    name = F.when(kind == "page", node_id("nav", ref)).when(kind == "form_result", node_id("form", ref)).when(kind == "download", node_id("download", ref)).otherwise(node_id("modal", ref))
    label = F.col("label")
    node_label = F.when(kind == "form_result", F.concat(F.lit("Result: "), label)).when(kind == "download", F.concat(F.lit("Download: "), label)).when(kind == "modal", F.concat(F.lit("Modal: "), label)).otherwise(label)
    edge = F.when((t == "navigate") & F.col("role").isNotNull(), F.concat_ws(": ", "role", "label")).otherwise(label)
    return actions.withColumn("node_type", kind).filter(F.col("node_type").isNotNull()).select(
        "doc_id", "action_id", "ord", name.alias("target"), "node_type", node_label.alias("node_label"), F.when(F.col("node_type") != "modal", F.col("target_url")).alias("url"),
        edge.alias("edge_label"), (t == "submit").alias("requires_input"), F.when(t == "submit", F.col("required_fields")).alias("input_fields"),
    )


def nav_nodes(edges: DataFrame) -> DataFrame:
    return first_of(edges, ["doc_id", "target"], "ord").select("doc_id", F.col("target").alias("node_id"), "node_type", F.col("node_label").alias("label"), "url")


def form_flows(edges: DataFrame) -> DataFrame:
    return edges.filter("node_type = 'form_result'").groupBy("doc_id", "target").agg(F.sort_array(F.collect_list("action_id")).alias("action_ids"))


def pagination_chain(edges: DataFrame) -> DataFrame:
    """Edges labelled as paging, by either naming of the previous page."""
    return edges.filter(F.lower("edge_label").rlike("next_page|prev_page|previous_page"))


def effect(kind: Column, role: Column, may_navigate: Column, may_download: Column, may_open_modal: Column) -> Column:
    r = F.coalesce(role, F.lit(""))
    return (
        F.when(may_open_modal, "open_modal").when(may_navigate | (kind == "navigate"), "navigate").when(kind == "submit", "submit_form").when(may_download | (kind == "download"), "download")
        .when(kind == "toggle", "expand").when(r.contains("filter"), "filter").when(kind.isin("select", "input"), "filter").otherwise("unknown")
    )


def action_graph(docs: DataFrame, actions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(states, transitions): a state per document, linked across documents by URL; unknown targets are placeholders."""
    states = docs.select(F.concat(F.lit("state_"), F.substring(F.sha2("doc_id", 256), 1, 12)).alias("state_id"), "doc_id", "url", "title", F.lit(False).alias("placeholder"))
    target = states.groupBy(F.col("url").alias("target_url")).agg(F.max("state_id").alias("known"))
    own = states.select("doc_id", F.col("state_id").alias("from_state")).distinct()  # a document may have several URLs
    e = effect(F.col("type"), F.col("role"), F.col("may_navigate"), F.col("may_download"), F.col("may_open_modal"))
    t = actions.join(own, "doc_id").join(target, "target_url", "left")
    to = F.coalesce("known", F.when(F.col("target_url").isNotNull(), F.concat(F.lit("state_"), F.substring(F.sha2("target_url", 256), 1, 12))).otherwise(F.col("from_state")))
    transitions = t.select("from_state", to.alias("to_state"), "action_id", e.alias("effect"), "label", "confidence")
    missing = t.filter("known is null and target_url is not null").select(to.alias("state_id"), F.lit(None).cast("string").alias("doc_id"), F.col("target_url").alias("url"), F.lit(None).cast("string").alias("title"), F.lit(True).alias("placeholder")).distinct()
    return states.unionByName(missing), transitions


def reachable(transitions: DataFrame, start: DataFrame, hops: int = 1) -> DataFrame:
    """(state, hops): states within so many transitions of start (state); each round joins only what is new.

    Of the transitions only those out of the front are kept, before anything is made distinct, so that no table of all of them is held.
    """
    edges = transitions.select("from_state", "to_state")
    seen = start.select("state").distinct().withColumn("hops", F.lit(0))
    front = seen
    for k in range(1, hops + 1):
        front = edges.join(front.select(F.col("state").alias("from_state")), "from_state", "left_semi").select(F.col("to_state").alias("state")).distinct().join(seen.select("state"), "state", "left_anti").withColumn("hops", F.lit(k))
        seen = seen.unionByName(front)
    return seen


def query_keys(url: Column) -> Column:
    q = F.regexp_extract(url, r"\?([^#]*)", 1)
    keys = F.transform(F.filter(F.split(q, "&"), lambda p: F.length(p) > 0), lambda p: F.substring_index(p, "=", 1))
    return F.when(q == "", F.array().cast("array<string>")).otherwise(F.array_sort(F.array_distinct(keys)))


def recommend(safety: Column, confidence: Column) -> Column:
    return F.when((safety == "read_only") & (confidence >= 0.7), "api").when(safety.isin("write", "auth_required"), "confirm").otherwise("browser")


def api_candidates(actions: DataFrame) -> DataFrame:
    """Endpoints of actions (with doc url): the first of each method and endpoint in a document, by confidence."""
    t, target = F.col("type"), F.col("target_url")
    path = F.regexp_replace(target, r"[?#].*$", "")
    has_api, has_q, paging = path.rlike(API_PATH), target.contains("?"), target.rlike(PAGINATION)
    endpoint = F.when(t == "submit", F.coalesce(target, F.col("url"))).otherwise(target)
    method = F.when((t == "submit") & ~F.coalesce(F.col("role"), F.lit("")).isin("submit_search", "search"), "POST").otherwise("GET")
    fields = F.coalesce(F.size("required_fields"), F.lit(0)) > 0
    confidence = (
        F.when(t == "submit", F.least(F.lit(0.95), F.round(0.3 + F.when(endpoint.rlike(API_PATH), 0.3).otherwise(0.0) + 0.2 * F.col("confidence") + F.when(fields, 0.1).otherwise(0.0), 2)))
        .when(t == "download", 0.8).otherwise(F.least(F.lit(0.9), 0.5 + F.when(has_api, 0.2).otherwise(0.0) + F.when(has_q, 0.1).otherwise(0.0)))
    )
    keep = ((t == "submit") & (F.coalesce(endpoint, F.lit("")) != "")) | ((t == "navigate") & target.isNotNull() & (has_api | paging)) | ((t == "download") & target.isNotNull())
    safety = F.when(F.col("method") == "GET", "read_only").when(F.coalesce(F.col("role"), F.lit("")).contains("login"), "auth_required").otherwise("write")
    df = actions.filter(keep).withColumn("endpoint", endpoint).withColumn("method", method).withColumn("api_confidence", confidence).withColumn("safety", safety)
    params = F.when(t == "submit", F.col("required_fields")).otherwise(query_keys(F.col("endpoint")))
    one = first_of(df, ["doc_id", "method", "endpoint"], "ord")
    return one.select("doc_id", "action_id", "endpoint", "method", params.alias("params"), F.col("api_confidence").alias("confidence"), "safety", recommend(F.col("safety"), F.col("api_confidence")).alias("mode"))


def api_from_trace(requests: DataFrame) -> DataFrame:
    """Endpoints of network requests (ord, method, url, status, content_type, body_params, auth): one per method and address."""
    kind = F.trim(F.substring_index(F.lower("content_type"), ";", 1))
    structured, api = kind.isin(*STRUCTURED), X.url_path("url").rlike(API_PATH)
    address = F.regexp_replace("url", r"[?#].*$", "")
    confidence = 0.4 + F.when(F.col("status").between(200, 299), 0.2).otherwise(0.0) + F.when(structured, 0.2).otherwise(0.0) + F.when(F.col("url").rlike(API_PATH), 0.1).otherwise(0.0)
    safety = F.when(F.col("method").isin("GET", "HEAD", "OPTIONS"), "read_only").when(F.col("auth"), "auth_required").otherwise("write")
    df = requests.filter(api | structured).select("ord", "method", address.alias("endpoint"), F.array_sort(F.array_union(query_keys(F.col("url")), F.coalesce("body_params", F.array().cast("array<string>")))).alias("params"), F.round(F.least(F.lit(0.95), confidence), 2).alias("confidence"), safety.alias("safety"))
    return first_of(df, ["method", "endpoint"], "ord")


def call_specs(candidates: DataFrame, values: Column | None = None) -> DataFrame:
    """Candidates with call_url and body: the request that each is, its params with their known values (map), the others empty.

    GET, HEAD and OPTIONS carry what has a value in the URL, encoded; other methods carry all params in the body.
    """
    known = values if values is not None else F.create_map().cast("map<string,string>")
    params = F.map_from_arrays("params", F.transform("params", lambda p: F.coalesce(known[p], F.lit(""))))
    pairs = F.transform(F.filter(F.array_sort("params"), lambda p: F.coalesce(known[p], F.lit("")) != ""), lambda p: F.concat(F.url_encode(p), F.lit("="), F.url_encode(known[p])))
    encoded = F.array_join(pairs, "&")
    reads = F.col("method").isin("GET", "HEAD", "OPTIONS")
    mark = F.when(F.col("endpoint").contains("?"), "&").otherwise("?")
    url = F.when(reads & (encoded != ""), F.concat("endpoint", mark, encoded)).otherwise(F.col("endpoint"))
    return candidates.withColumn("call_url", url).withColumn("body", F.when(~reads, params))


def decide(actions: DataFrame, candidates: DataFrame, threshold: float = 0.7) -> DataFrame:
    """How to run each action: by its own candidate, else the best whose endpoint contains, or lies in, its target.

    The second join is within a document, whose actions are few.
    """
    c = candidates.select("doc_id", F.col("action_id").alias("c_action"), "endpoint", F.col("confidence").alias("c_conf"), "safety")
    both = actions.select("doc_id", "action_id", "target_url", "confidence").join(c, "doc_id", "left")
    own = F.col("c_action") == F.col("action_id")
    near = F.col("target_url").isNotNull() & (F.col("endpoint").contains(F.col("target_url")) | F.col("target_url").contains(F.col("endpoint")))
    ranked = both.withColumn("rank", F.when(own, 0).when(near, 1).otherwise(2))
    best = first_of(ranked, ["doc_id", "action_id"], "rank", F.desc("c_conf"), "c_action", "endpoint")
    has = F.col("rank") < 2
    safe = (F.col("safety") == "read_only") & (F.col("c_conf") >= 0.7)
    mode = F.when(has & safe, "api").when(has & F.col("safety").isin("write", "auth_required"), "confirm").when(has & (F.col("c_conf") >= threshold), "api").otherwise("browser")
    return best.select("doc_id", "action_id", mode.alias("mode"), F.when(mode == "browser", F.col("confidence")).otherwise(F.col("c_conf")).alias("confidence"), F.when(mode != "browser", F.col("endpoint")).alias("endpoint"))
