"""Graphs of the star schema: entities are nodes, foreign keys are edges."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.columns import directional_luminance
from ..operators.graph import Graph, complete_edges, complete_nodes
from ..session import table

#: node_id = place of the type * SPAN + key
SPAN = 1_000_000_000
TYPES = (("region", "r_regionkey", "r_name"), ("nation", "n_nationkey", "n_name"), ("customer", "c_custkey", "c_name"), ("orders", "o_orderkey", "o_orderstatus"), ("part", "p_partkey", "p_name"))
#: (table, type and column of the source, type and column of the target, bin)
KEYS = (
    ("nation", 0, "n_regionkey", 1, "n_nationkey", 6), ("nation", 1, "n_nationkey", 0, "n_regionkey", 8), ("customer", 1, "c_nationkey", 2, "c_custkey", 6),
    ("orders", 2, "o_custkey", 3, "o_orderkey", 6), ("lineitem", 3, "l_orderkey", 4, "l_partkey", 6),
)


def node_of(place: int, key) -> F.Column:
    return F.lit(place).cast("long") * F.lit(SPAN).cast("long") + F.col(key).cast("long")


def foreign_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(src, dst, attenuation, bin), an edge for each row of a key; repeated ones are kept."""
    out = None
    for name, a, src, b, dst, bin_ in KEYS:
        one = table(spark, sf_dir, name).select(node_of(a, src).alias("src"), node_of(b, dst).alias("dst"), F.lit(0.1).alias("attenuation"), F.lit(bin_).alias("bin"))
        out = one if out is None else out.unionByName(one)
    return out


def star_graph(spark: SparkSession, sf_dir: str) -> Graph:
    """region <-> nation -> customer -> orders -> part, all edges of weight 0.9."""
    nodes = None
    for place, (name, key, label) in enumerate(TYPES):
        one = table(spark, sf_dir, name).select(node_of(place, key).alias("node_id"), F.col(label).cast("string").alias("label"), F.lit(name).alias("node_type"), F.lit(place).alias("room"))
        nodes = one if nodes is None else nodes.unionByName(one)
    return Graph(complete_nodes(nodes), complete_edges(foreign_keys(spark, sf_dir), ("dst", "bin")))


def nation_graph(spark: SparkSession, sf_dir: str) -> Graph:
    """region <-> nation -> customer, with properties: regions contain, nations are, customers with even keys oppose and others are similar.
    Rooms are the regions."""
    r, n, c = (table(spark, sf_dir, t) for t in ("region", "nation", "customer"))
    home = n.select("n_nationkey", "n_regionkey")
    rows = r.select(node_of(0, "r_regionkey").alias("node_id"), F.lit("Contains").alias("prop"), F.col("r_regionkey").alias("room"))
    rows = rows.unionByName(n.select(node_of(1, "n_nationkey").alias("node_id"), F.lit("IsA").alias("prop"), F.col("n_regionkey").alias("room")))
    segment = F.when(F.col("c_custkey") % 2 == 0, "OppositeOf").otherwise("SimilarTo")
    rows = rows.unionByName(c.join(home, F.col("c_nationkey") == F.col("n_nationkey")).select(node_of(2, "c_custkey").alias("node_id"), segment.alias("prop"), F.col("n_regionkey").alias("room")))
    rows = rows.withColumn("dir_lum", directional_luminance(F.col("prop"), F.lit(2.0), F.lit(0.8)))
    out = None
    for name, a, src, b, dst, bin_ in KEYS[:3]:
        one = table(spark, sf_dir, name).select(node_of(a, src).alias("src"), node_of(b, dst).alias("dst"), F.lit(0.1).alias("attenuation"), F.lit(bin_).alias("bin"))
        out = one if out is None else out.unionByName(one)
    return Graph(complete_nodes(rows), complete_edges(out, ("dst", "bin")))


def plain(graph: Graph) -> Graph:
    """Without properties: emission from luminance, no gate."""
    return Graph(graph.nodes.withColumn("prop", F.lit(None).cast("string")), graph.edges)


def ring_graph(spark: SparkSession, n: int = 1000, out: int = 8, base: float = 0.1, step: float = 0.02, luminance: float = 2.0) -> Graph:
    """i -> i + 1 .. i + out around a ring, attenuation base + step j, bin (i + j) mod 16."""
    nodes = spark.range(n).select(F.col("id").alias("node_id"), F.lit(luminance).alias("luminance"))
    edges = spark.range(n).select(F.col("id").alias("src"), F.explode(F.sequence(F.lit(1), F.lit(out))).alias("j"))
    edges = edges.select("src", ((F.col("src") + F.col("j")) % n).alias("dst"), (F.col("j") - 1).alias("pos"), (F.lit(base) + F.lit(step) * F.col("j")).alias("attenuation"), ((F.col("src") + F.col("j")) % 16).alias("bin"))
    return Graph(complete_nodes(nodes), complete_edges(edges))


def vector_graph(spark: SparkSession, sf_dir: str, k: int = 3) -> tuple[Graph, DataFrame]:
    """embeddings as nodes, linked along their ids (v -> v + 1, v + 7, v + 31 of the same table); and their vectors."""
    e = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("node_id"), "embedding", "label")
    hops = (1, 7, 31)[:k]
    links = e.select(F.col("node_id").alias("src"), F.explode(F.array(*(F.struct(F.lit(h).alias("h"), F.lit(i).alias("pos")) for i, h in enumerate(hops)))).alias("s"), F.col("label"))
    links = links.select("src", (F.col("src") + F.col("s.h")).alias("dst"), "s.pos", F.lit(0.1).alias("attenuation"), ((F.col("label") + F.col("s.pos") * 4) % 16).alias("bin"))
    links = links.join(e.select(F.col("node_id").alias("dst")), "dst", "left_semi")
    return Graph(complete_nodes(e.select("node_id", F.col("label").alias("room"))), complete_edges(links)), e.select("node_id", "embedding")


def key_triples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(head, relation, tail) of the smaller foreign keys."""
    r, n, c, s = (table(spark, sf_dir, t) for t in ("region", "nation", "customer", "supplier"))
    named = lambda kind, key: F.concat(F.lit(f"{kind}:"), F.col(key).cast("string"))
    out = n.select(named("nation", "n_nationkey").alias("head"), F.lit("Part Of").alias("relation"), named("region", "n_regionkey").alias("tail"))
    out = out.unionByName(r.select(named("region", "r_regionkey").alias("head"), F.lit("is-a").alias("relation"), F.lit("area").alias("tail")))
    out = out.unionByName(c.select(named("customer", "c_custkey").alias("head"), F.lit("belongs_to").alias("relation"), named("nation", "c_nationkey").alias("tail")))
    return out.unionByName(s.select(named("nation", "s_nationkey").alias("head"), F.lit("Enables").alias("relation"), named("supplier", "s_suppkey").alias("tail")))
