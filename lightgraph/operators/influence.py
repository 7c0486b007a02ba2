"""Influence queries: propagate, then rank, measure or mix."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import TINY, cosine, intensity_to_distance, strongest_first
from ..params import LightParams
from .graph import Graph
from .propagate import propagate, sources_of


def top_k(graph: Graph, source: int, bin_: int, k: int, params: LightParams = LightParams(), pvs: DataFrame | None = None, mode: str = "ordered") -> DataFrame:
    """(node_id, intensity, distance) of the k strongest above the threshold, the source included; ties by id."""
    lit = propagate(graph, sources_of(graph.nodes.sparkSession, [(0, source, bin_)]), params, mode, pvs)
    return lit.where(F.col("intensity") > params.min_intensity).select("node_id", "intensity", intensity_to_distance(F.col("intensity")).alias("distance")).orderBy(strongest_first(F.col("intensity")), "node_id").limit(k)


def top_k_others(graph: Graph, source: int, bin_: int, k: int = 20, params: LightParams = LightParams(), node_type: str | None = None, mode: str = "maxbin", eps: float = 1e-10) -> DataFrame:
    """The k strongest nodes other than the source, with label and type; only one type if given."""
    lit = propagate(graph, sources_of(graph.nodes.sparkSession, [(0, source, bin_)]), params, mode).where((F.col("intensity") > 0) & (F.col("node_id") != source))
    named = lit.join(graph.nodes.select("node_id", "label", "node_type"), "node_id")
    if node_type is not None:
        named = named.where(F.col("node_type") == node_type)
    return named.select("node_id", "label", "node_type", "intensity", intensity_to_distance(F.col("intensity"), eps).alias("distance")).orderBy(strongest_first(F.col("intensity")), "node_id").limit(k)


def distance(graph: Graph, source: int, target: int, bin_: int, params: LightParams = LightParams(), pvs: DataFrame | None = None) -> DataFrame:
    """One row (target, distance); null if the target is unknown or its intensity not above the threshold."""
    spark = graph.nodes.sparkSession
    lit = propagate(graph, sources_of(spark, [(0, source, bin_)]), params, "ordered", pvs).where((F.col("node_id") == target) & (F.col("intensity") > params.min_intensity))
    one = spark.createDataFrame([(target,)], "target long")
    return one.join(lit, F.col("node_id") == F.col("target"), "left").select("target", F.when(F.col("intensity").isNotNull(), intensity_to_distance(F.col("intensity"))).alias("distance"))


def distance_or_infinity(graph: Graph, source: int, target: int, bin_: int = 0, params: LightParams = LightParams(), mode: str = "maxbin", eps: float = 1e-10) -> DataFrame:
    """One row (target, distance); infinite where no light arrives."""
    spark = graph.nodes.sparkSession
    lit = propagate(graph, sources_of(spark, [(0, source, bin_)]), params, mode).where((F.col("node_id") == target) & (F.col("intensity") > 0))
    one = spark.createDataFrame([(target,)], "target long")
    return one.join(lit, F.col("node_id") == F.col("target"), "left").select("target", F.coalesce(intensity_to_distance(F.col("intensity"), eps), F.lit(float("inf"))).alias("distance"))


def hybrid(graph: Graph, source: int, bin_: int, embeddings: DataFrame, query: list[float], alpha: float, k: int, params: LightParams = LightParams(), pvs: DataFrame | None = None) -> DataFrame:
    """alpha * intensity / max + (1 - alpha) * cosine for every node with a vector; no threshold. The maximum is over all nodes."""
    spark = graph.nodes.sparkSession
    lit = propagate(graph, sources_of(spark, [(0, source, bin_)]), params, "ordered", pvs).select("node_id", "intensity")
    most = lit.agg(F.coalesce(F.max("intensity"), F.lit(0.0)).alias("most"))
    q = F.array(*(F.lit(float(x)) for x in query))
    scored = embeddings.select("node_id", cosine(F.col("embedding"), q).alias("similarity")).join(lit, "node_id", "left").crossJoin(F.broadcast(most))
    graph_part = F.when(F.col("most") > TINY, F.coalesce("intensity", F.lit(0.0)) / F.col("most")).otherwise(F.lit(0.0))
    score = F.lit(float(alpha)) * graph_part + F.lit(1.0 - alpha) * F.col("similarity")
    return scored.select("node_id", score.alias("score"), intensity_to_distance(score).alias("distance")).orderBy(strongest_first(F.col("score")), "node_id").limit(k)


def semantic_search(graph: Graph, embeddings: DataFrame, query: list[float], k: int) -> DataFrame:
    """The guide's recipe: hybrid from node 0 in direction 0, alpha 0.6."""
    return hybrid(graph, 0, 0, embeddings, query, 0.6, k)


def comparison(graph: Graph, sources: list[int], bin_: int, k: int = 20, params: LightParams = LightParams(), mode: str = "maxbin") -> DataFrame:
    """A column intensity_<source> each; the k nodes with the largest of them, sources left out."""
    lit = propagate(graph, sources_of(graph.nodes.sparkSession, [(s, s, bin_) for s in sources]), params, mode).where(~F.col("node_id").isin(sources))
    wide = lit.groupBy("node_id").agg(*(F.coalesce(F.max(F.when(F.col("qid") == s, F.col("intensity"))), F.lit(0.0)).alias(f"intensity_{s}") for s in sources))
    most: Column = F.greatest(*(F.col(f"intensity_{s}") for s in sources)) if len(sources) > 1 else F.col(f"intensity_{sources[0]}")
    return wide.where(most > 0).orderBy(strongest_first(most), "node_id").limit(k)


def multi_source(graph: Graph, sources: list[tuple[int, int]], k: int, params: LightParams = LightParams()) -> DataFrame:
    """The k strongest of each (node, bin) source, all together, then the k strongest of those; a node may come twice."""
    lit = propagate(graph, sources_of(graph.nodes.sparkSession, [(i, s, b) for i, (s, b) in enumerate(sources)]), params).where(F.col("intensity") > params.min_intensity)
    rank = F.row_number().over(Window.partitionBy("qid").orderBy(strongest_first(F.col("intensity")), "node_id"))
    best = lit.withColumn("rank", rank).where(F.col("rank") <= k)
    return best.select("qid", "node_id", "intensity", intensity_to_distance(F.col("intensity")).alias("distance")).orderBy(strongest_first(F.col("intensity")), "node_id", "qid").limit(k)


def contextual_embeddings(graph: Graph, sources: list[int], bins: list[int], params: LightParams = LightParams(), pvs: DataFrame | None = None, dim: int | None = None) -> DataFrame:
    """(node_id, embedding): for each source its intensities over their maximum; the first `dim` of them, padded with 0, if given."""
    pairs = list(zip(sources, bins, strict=False))
    lit = propagate(graph, sources_of(graph.nodes.sparkSession, [(i, s, b) for i, (s, b) in enumerate(pairs)]), params, "ordered", pvs)
    most = lit.groupBy("qid").agg(F.max("intensity").alias("most"))  # a row a source
    part = lit.join(most, "qid").withColumn("x", F.when(F.col("most") > 0, F.col("intensity") / F.col("most")).otherwise(F.lit(0.0)))
    wide = part.groupBy("node_id").agg(*(F.max(F.when(F.col("qid") == i, F.col("x"))).alias(f"x{i}") for i in range(len(pairs))))
    names = [f"x{i}" for i in range(len(pairs))][: dim if dim is not None else None]
    padding = [F.lit(0.0)] * max(0, (dim or 0) - len(names))
    return graph.nodes.select("node_id").join(wide, "node_id", "left").select("node_id", F.array(*(F.coalesce(c, F.lit(0.0)) for c in names), *padding).alias("embedding"))


