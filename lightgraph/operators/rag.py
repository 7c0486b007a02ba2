"""Retrieval over graph, vectors and users; reasoning paths."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import TINY, intensity_to_distance, strongest_first
from ..functions.lookups import INTENT_BINS, INTENT_PHRASES, OTHER_INTENT, related_bins_of
from ..params import BINS, LightParams, RagConfig, UserContext
from ..session import materialize
from .graph import Graph
from .influence import top_k
from .propagate import propagate, sources_of
from .users import boost
from .vectors import all_similarities, top_k_similar


def classify(text: str) -> str:
    """functions.lookups.intent for one text on the driver."""
    low = text.lower()
    return next((name for name, phrases in INTENT_PHRASES.items() if any(p in low for p in phrases)), OTHER_INTENT)


# Kinds of search that a tool may ask for, and the intent whose directions they take.
SEARCH_KINDS = {"definition": "Definition", "causal": "Causation", "similarity": "Similarity", "requirements": "Requirements", "composition": "Composition", "general": "Association"}


def _params(config: RagConfig, most: int | None = None) -> LightParams:
    hops = config.max_hops if most is None else min(config.max_hops, most)
    return LightParams(config.sharpness, config.min_relevance, hops, BINS)


def combined(graph: Graph, sources: DataFrame, params: LightParams, pvs: DataFrame | None = None) -> DataFrame:
    """(node_id, graph_intensity): weighted sums over all sources, one batch, divided by their maximum."""
    lit = propagate(graph, sources, params, "ordered", pvs).join(sources.select("qid", "weight"), "qid")
    total = lit.groupBy("node_id").agg(F.sum(F.col("intensity") * F.col("weight")).alias("sum"))
    total = materialize(total, "combined")
    most = F.broadcast(total.agg(F.max("sum").alias("most")))
    return total.crossJoin(most).select("node_id", F.when(F.col("most") > TINY, F.col("sum") / F.col("most")).otherwise(F.lit(0.0)).alias("graph_intensity"))


def hybrid_scores(graph: Graph, intensity: DataFrame, similarity: DataFrame | None, user: UserContext | None, config: RagConfig) -> DataFrame:
    """(alpha g + beta v) (1 + gamma (boost - 1)) of nodes with any signal that the user may see; the top_k, ties by id."""
    rows = graph.nodes.select("node_id", "room").join(intensity, "node_id", "left")
    rows = rows.join(similarity.select("node_id", F.col("similarity").alias("vector_similarity")), "node_id", "left") if similarity is not None else rows.withColumn("vector_similarity", F.lit(0.0))
    g, v = F.coalesce("graph_intensity", F.lit(0.0)), F.coalesce("vector_similarity", F.lit(0.0))
    rows = rows.select("node_id", "room", g.alias("graph_intensity"), v.alias("vector_similarity")).where((F.col("graph_intensity") >= config.min_relevance) | (F.col("vector_similarity") >= config.min_relevance))
    if user is None:
        rows = rows.withColumn("personalization_boost", F.lit(1.0))
    else:
        spark = graph.nodes.sparkSession
        pos = {n: i for i, n in reversed(list(enumerate(user.session)))}
        known = spark.createDataFrame([(n, user.interactions.get(n, 0), pos.get(n)) for n in sorted({*user.interactions, *user.session})], "node_id long, times long, pos int")
        value = boost(F.col("times"), F.col("pos"), user.decay)
        if user.rooms:
            value = F.when(F.col("room").isin(sorted(user.rooms)), value).otherwise(F.lit(0.0))
        rows = rows.join(known, "node_id", "left").withColumn("personalization_boost", value).where("personalization_boost > 0")
    score = (F.lit(config.alpha) * F.col("graph_intensity") + F.lit(config.beta) * F.col("vector_similarity")) * (F.lit(1.0) + F.lit(config.gamma) * (F.col("personalization_boost") - 1))
    out = rows.withColumn("score", score).withColumn("distance", intensity_to_distance(F.col("score")))
    return out.select("node_id", "score", "graph_intensity", "vector_similarity", "personalization_boost", "distance").orderBy(strongest_first(F.col("score")), "node_id").limit(config.top_k)


def _with_paths(graph: Graph, scored: DataFrame, starts: list[int], config: RagConfig) -> DataFrame:
    """reasoning_path from the first source that reaches a node; empty unless the config asks for paths."""
    if not config.include_paths or not starts:
        return scored.withColumn("reasoning_path", F.array().cast("array<long>"))
    paths = paths_from(graph, starts, config.max_hops)
    return scored.join(paths, "node_id", "left").withColumn("reasoning_path", F.coalesce("path", F.array().cast("array<long>"))).drop("path").orderBy(strongest_first(F.col("score")), "node_id")


def query(graph: Graph, stored: DataFrame, text: str, embedding: list[float], user: UserContext | None = None, config: RagConfig = RagConfig(), pvs: DataFrame | None = None, name: str | None = None) -> DataFrame:
    """Intent (the text's, unless one is given) chooses directions, vectors choose sources, light from all of them mixes with similarity."""
    name = name or classify(text)
    bins = related_bins_of(name) if config.use_related_bins else [INTENT_BINS[name]]
    near = top_k_similar(stored, embedding, config.num_sources).collect()  # num_sources rows
    if not near:
        return hybrid_scores(graph, graph.nodes.select("node_id", F.lit(0.0).alias("graph_intensity")).limit(0), None, user, config).limit(0).withColumn("reasoning_path", F.array().cast("array<long>"))
    rows = [(len(bins) * i + j, r.node_id, b, max(r.similarity, 0.0)) for i, r in enumerate(near) for j, b in enumerate(bins)]
    lit = combined(graph, sources_of(graph.nodes.sparkSession, rows), _params(config), pvs)
    return _with_paths(graph, hybrid_scores(graph, lit, all_similarities(stored, embedding), user, config), [r.node_id for r in near], config)


def search(graph: Graph, stored: DataFrame, text: str, embedding: list[float], kind: str | None = None, max_hops: int = 3, top_k: int = 10, user: UserContext | None = None) -> DataFrame:
    """The search tool: query() with a kind of search instead of the text's own intent, and its paths."""
    config = RagConfig(top_k=top_k, max_hops=max(1, min(5, max_hops)), include_paths=True)
    return query(graph, stored, text, embedding, user, config, name=SEARCH_KINDS[kind] if kind else None)


def plain_query(graph: Graph, text: str, k: int) -> DataFrame:
    """The legacy engine: the k strongest from node 0 in direction 0 for a text that speaks of a start, else nothing."""
    found = any(w in text.lower() for w in ("start", "beginning"))
    return top_k(graph, 0, 0, k if found else 0)


def query_from_sources(graph: Graph, sources: list[int], bin_: int, stored: DataFrame | None = None, embedding: list[float] | None = None, user: UserContext | None = None, config: RagConfig = RagConfig(), pvs: DataFrame | None = None) -> DataFrame:
    """Given sources and one direction, unweighted; without a query vector the vector term is 0."""
    lit = combined(graph, sources_of(graph.nodes.sparkSession, [(i, s, bin_) for i, s in enumerate(sources)]), _params(config), pvs)
    similar = all_similarities(stored, embedding) if stored is not None and embedding is not None else None
    return _with_paths(graph, hybrid_scores(graph, lit, similar, user, config), sources, config)


def feed(graph: Graph, user: UserContext, config: RagConfig = RagConfig(), pvs: DataFrame | None = None) -> DataFrame:
    """Light from the user's seeds in their three preferred directions, weighted by affinity; alpha 0.8, beta 0, gamma 0.2."""
    half = user.session[: config.num_sources // 2]
    seeds = half + [n for n, _ in sorted(user.interactions.items(), key=lambda kv: (-kv[1], kv[0])) if n not in half]
    seeds = seeds[: config.num_sources]
    best = sorted(range(BINS), key=lambda b: (-user.topic_affinities[b], b))[:3]
    rows = [(i * 3 + j, s, b, user.topic_affinities[b]) for i, s in enumerate(seeds) for j, b in enumerate(best) if user.topic_affinities[b] >= 0.1]
    own = RagConfig(config.top_k, config.max_hops, 0.8, 0.0, 0.2, config.min_relevance, config.sharpness, config.num_sources)
    lit = combined(graph, sources_of(graph.nodes.sparkSession, rows), _params(config, 3), pvs)
    scored = hybrid_scores(graph, lit, None, user, own)
    return scored if seeds else scored.limit(0)


def influence_results(results: DataFrame) -> DataFrame:
    return results.select(F.col("node_id").alias("node"), F.col("score").alias("intensity"), "distance")


def paths_from(graph: Graph, starts: list[int], max_depth: int, bins: list[int] | None = None, target: int | None = None) -> DataFrame:
    """(node_id, path): the shortest path to every node within max_depth hops, ties to the first found in walking order.

    A hop is a join of the frontier with the edges; a window picks each new node's first path, an anti-join keeps out
    nodes that have one. Each hop is written. With a target the walk ends when it is found.
    """
    spark = graph.nodes.sparkSession
    edges = graph.edges if bins is None else graph.edges.where(F.col("bin").isin(bins))
    first = spark.createDataFrame([(s, [s], [i]) for i, s in enumerate(dict.fromkeys(starts))], "node_id long, path array<long>, seq array<int>")
    frontier = materialize(first.join(graph.nodes.select("node_id"), "node_id", "left_semi"), "path-0")
    found = [frontier]
    for depth in range(1, max_depth + 1):
        if target is not None and not frontier.where(F.col("node_id") == target).isEmpty():
            break
        step = frontier.withColumnRenamed("node_id", "src").join(edges.select("src", "dst", "pos"), "src").select(F.col("dst").alias("node_id"), F.concat("path", F.array("dst")).alias("path"), F.concat("seq", F.array("pos")).alias("seq"))
        known = found[0].select("node_id")
        for f in found[1:]:
            known = known.unionByName(f.select("node_id"))
        new = step.join(known, "node_id", "left_anti").groupBy("node_id").agg(F.min(F.struct("seq", "path")).alias("s")).select("node_id", "s.path", "s.seq")
        frontier = materialize(new, f"path-{depth}")
        if frontier.isEmpty():
            break
        found.append(frontier)
    out = found[0]
    for f in found[1:]:
        out = out.unionByName(f)
    return out.select("node_id", "path")


def meeting_path(graph: Graph, source: int, target: int, max_depth: int) -> tuple[DataFrame, int]:
    """(one row (path), or none if the target is further than max_depth; rows of all frontiers): the path that paths_from finds.

    Frontiers go forward from the source and backward from the target; the smaller one takes the next hop, so neither grows to the
    whole graph where both ends are thin. Forward rows hold the first path to a node in walking order, backward rows the first path
    on from it. When the frontiers first share nodes, every shortest path runs through one of these, and as all forward parts are
    of one length, the first by both parts is the first of all.
    """
    spark, nodes = graph.nodes.sparkSession, graph.nodes.select("node_id")
    edges, sides = graph.edges.select("src", "dst", "pos"), {}
    for name, at in (("forward", source), ("backward", target)):
        first = spark.createDataFrame([(at, [at], [])], "node_id long, path array<long>, seq array<int>")
        sides[name] = [materialize(first.join(nodes, "node_id", "left_semi"), f"path-{name}")]
    sizes = {name: found[-1].count() for name, found in sides.items()}
    seen = sum(sizes.values())
    none = nodes.select(F.array("node_id").alias("path")).limit(0)
    for depth in range(max_depth + 1):
        if not all(sizes.values()):
            break
        ahead, back = (sides[name][-1] for name in ("forward", "backward"))
        met = ahead.join(back.select("node_id", F.col("path").alias("_path"), F.col("seq").alias("_seq")), "node_id")
        whole = F.struct(F.concat("seq", "_seq").alias("seq"), F.concat("path", F.slice("_path", F.lit(2), F.size("_path"))).alias("path"))
        best = met.agg(F.min(whole).alias("s")).collect()[0].s  # one path
        if best is not None:
            return spark.createDataFrame([(best.path,)], "path array<long>"), seen
        if depth == max_depth:
            break
        name = "forward" if sizes["forward"] <= sizes["backward"] else "backward"
        near, far = ("src", "dst") if name == "forward" else ("dst", "src")
        step = sides[name][-1].withColumnRenamed("node_id", near).join(edges, near)
        path, seq = (F.concat("path", F.array("dst")), F.concat("seq", F.array("pos"))) if name == "forward" else (F.concat(F.array("src"), "path"), F.concat(F.array("pos"), "seq"))
        new = step.select(F.col(far).alias("node_id"), path.alias("path"), seq.alias("seq"))
        for known in sides[name]:
            new = new.join(known.select("node_id"), "node_id", "left_anti")
        sides[name].append(materialize(new.groupBy("node_id").agg(F.min(F.struct("seq", "path")).alias("s")).select("node_id", "s.path", "s.seq"), f"path-{name}"))
        sizes[name] = sides[name][-1].count()
        seen += sizes[name]
    return none, seen


def reasoning_path(graph: Graph, source: int, target: int, max_depth: int) -> DataFrame:
    """One row (path), or none if the target is further than max_depth."""
    return meeting_path(graph, source, target, max_depth)[0]


def reasoning_path_between(graph: Graph, stored: DataFrame, source: list[float], target: list[float], max_depth: int) -> DataFrame:
    """The path between the nodes most similar to two vectors."""
    ends = [r.node_id for q in (source, target) for r in top_k_similar(stored, q, 1).collect()]
    if len(ends) < 2:
        return graph.nodes.select(F.array("node_id").alias("path")).limit(0)
    return reasoning_path(graph, *ends, max_depth)


def explore(graph: Graph, node: int, bins: list[int] | None = None, depth: int = 2) -> DataFrame:
    """(node_id, hops, path) of nodes within `depth` hops along edges of some directions, the start left out."""
    paths = paths_from(graph, [node], depth, bins).where(F.col("node_id") != node)
    return paths.select("node_id", (F.size("path") - 1).alias("hops"), "path")
