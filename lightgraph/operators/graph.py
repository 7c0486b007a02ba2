"""Graphs as two tables: nodes and edges. Every change makes new DataFrames."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.columns import uniform_luminance
from ..functions.lookups import builder_bin
from ..params import BINS, GraphError
from ..session import materialize

NODES = "node_id long, label string, node_type string, luminance double, reflection double, refraction double, default_bin int, prop string, dir_lum array<double>, room int"
EDGES = "src long, dst long, pos int, attenuation double, bin int, is_portal boolean"
#: Columns of a node that a builder may set besides its luminance.
PROPS = {"reflection": "double", "refraction": "double", "default_bin": "int", "prop": "string", "dir_lum": "array<double>", "room": "int"}
MOST_NODES, MOST_EDGES = 10**8, 10**9


def _column(df: DataFrame, name: str, default: Column, kind: str) -> Column:
    return (F.coalesce(F.col(name), default) if name in df.columns else default).cast(kind).alias(name)


def complete_nodes(nodes: DataFrame) -> DataFrame:
    """The full node schema: given columns where there are, defaults elsewhere and for nulls."""
    null = lambda kind: F.lit(None).cast(kind)
    defaults = {
        "label": null("string"), "node_type": null("string"), "luminance": F.lit(1.0), "reflection": F.lit(1.0), "refraction": F.lit(1.0),
        "default_bin": F.lit(0), "prop": null("string"), "dir_lum": uniform_luminance(F.lit(1.0)), "room": F.lit(0),
    }
    kinds = dict(c.split(" ") for c in NODES.split(", "))
    return nodes.select(F.col("node_id").cast("long").alias("node_id"), *(_column(nodes, n, d, kinds[n]) for n, d in defaults.items()))


def complete_edges(edges: DataFrame, order: Iterable[str | Column] = ("dst", "bin", "attenuation")) -> DataFrame:
    """The full edge schema. Without a `pos`, edges of a node are numbered by `order`, which should tell them apart."""
    base = edges.select(
        F.col("src").cast("long").alias("src"), F.col("dst").cast("long").alias("dst"), *([F.col("pos").cast("int").alias("pos")] if "pos" in edges.columns else []),
        _column(edges, "attenuation", F.lit(0.0), "double"), _column(edges, "bin", F.lit(0), "int"), _column(edges, "is_portal", F.lit(False), "boolean"),
    )
    if "pos" not in base.columns:
        base = base.withColumn("pos", F.row_number().over(Window.partitionBy("src").orderBy(*order)) - 1)
    return base.select("src", "dst", "pos", "attenuation", "bin", "is_portal")


def document_nodes(documents: DataFrame) -> DataFrame:
    """Nodes of (node_id, text, embedding): luminance 1 + length / 1000 (bytes), the bin from the first component, held to 0 .. 255
    before it goes around the circle."""
    first = F.col("embedding")[0].cast("double") * 8 + 8
    held = F.greatest(F.lit(0), F.least(F.lit(255), F.coalesce(F.when(F.isnan(first), F.lit(0)).otherwise(first.cast("int")), F.lit(0))))
    return complete_nodes(documents.select("node_id", (F.octet_length("text") / F.lit(1000.0) + 1).alias("luminance"), F.lit(0.9).alias("reflection"), (held % BINS).alias("default_bin")))


@dataclass(frozen=True)
class Graph:
    nodes: DataFrame
    edges: DataFrame

    # construction

    @staticmethod
    def empty(spark: SparkSession, n: int) -> Graph:
        """n isolated nodes with default properties."""
        if not 0 < n <= MOST_NODES:
            raise GraphError(f"a graph has 1 to {MOST_NODES} nodes, not {n}")
        return Graph(complete_nodes(spark.range(n).withColumnRenamed("id", "node_id")), spark.createDataFrame([], EDGES))

    @staticmethod
    def of(nodes: DataFrame, edges: DataFrame) -> Graph:
        return Graph(complete_nodes(nodes), complete_edges(edges))

    @staticmethod
    def from_adjacency(nodes: DataFrame, adjacency: DataFrame) -> Graph:
        """adjacency: (node_id, neighbors array<struct<dst, attenuation, bin>>); order in the array is the edges' order."""
        edges = adjacency.select(F.col("node_id").alias("src"), F.posexplode("neighbors").alias("pos", "e")).select("src", "pos", "e.*")
        return Graph(complete_nodes(nodes), complete_edges(edges))

    @staticmethod
    def from_csr(nodes: DataFrame, row_ptr: DataFrame, col_idx: DataFrame) -> Graph:
        """row_ptr: (node_id, first, past); col_idx: (at, dst, attenuation, bin). A node owns the places first <= at < past."""
        owned = row_ptr.where("past > first").select(F.col("node_id").alias("src"), "first", F.explode(F.sequence("first", F.col("past") - 1)).alias("at"))
        edges = owned.join(col_idx, "at").withColumn("pos", (F.col("at") - F.col("first")).cast("int"))
        return Graph(complete_nodes(nodes), complete_edges(edges))

    def materialized(self) -> Graph:
        """Both tables written once to the shared folder; what follows reads them."""
        return Graph(materialize(self.nodes, "nodes"), materialize(self.edges, "edges"))

    # access

    def neighbors(self, node: int) -> DataFrame:
        return self.edges.where(F.col("src") == node).orderBy("pos")

    def edge(self, src: int, dst: int) -> DataFrame:
        """The first edge between two nodes, or no row."""
        return self.edges.where((F.col("src") == src) & (F.col("dst") == dst)).orderBy("pos").limit(1)

    def first_edges(self) -> DataFrame:
        """The first of the parallel edges of each pair."""
        first = self.edges.groupBy("src", "dst").agg(F.min_by(F.struct("pos", "attenuation", "bin", "is_portal"), "pos").alias("e"))
        return first.select("src", "dst", "e.*")

    def counts(self) -> DataFrame:
        return self.nodes.agg(F.count("*").alias("num_nodes")).crossJoin(self.edges.agg(F.count("*").alias("num_edges")))

    def csr(self) -> DataFrame:
        """(node_id, degree, row_ptr): out-degrees and where a node's edges start, by node_id; a running sum that no task takes over all nodes."""
        degree = self.nodes.select("node_id").join(self.edges.groupBy(F.col("src").alias("node_id")).agg(F.count("*").alias("degree")), "node_id", "left").na.fill(0, ["degree"])
        return sum_before(degree, "node_id", "degree", "row_ptr").select("node_id", "degree", "row_ptr")

    def summary(self) -> DataFrame:
        """Nodes of each type, most first."""
        return self.nodes.groupBy("node_type").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "node_type")

    def lookup(self, keys: DataFrame) -> DataFrame:
        """(node_id, label, node_type) of the nodes that keys (a column node_id, label or node_type) names; unknown ones give no row."""
        return self.nodes.select("node_id", "label", "node_type").join(keys.distinct(), keys.columns, "left_semi")

    # change

    def with_nodes(self, overrides: DataFrame) -> Graph:
        """Properties of some nodes set anew; a null in an override keeps what was. Unknown ids are an error."""
        fields = [c for c in overrides.columns if c != "node_id"]
        unknown = overrides.join(self.nodes, "node_id", "left_anti").limit(1).collect()
        if unknown:
            raise GraphError(f"no node {unknown[0].node_id}")
        named = overrides.select("node_id", *(F.col(c).alias(f"_{c}") for c in fields))
        joined = self.nodes.join(named, "node_id", "left")
        return replace(self, nodes=joined.select(*(F.coalesce(F.col(f"_{c}"), F.col(c)).alias(c) if c in fields else F.col(c) for c in self.nodes.columns)))

    def with_rooms(self, rooms: DataFrame) -> Graph:
        """rooms: (node_id, room)."""
        return self.with_nodes(rooms.select("node_id", F.col("room").cast("int").alias("room")))

    def with_edge(self, src: int, dst: int, attenuation: float = 0.0, bin_: int = 0) -> Graph:
        """One more edge, after the others of its node. Unknown nodes are an error."""
        spark = self.nodes.sparkSession
        if self.nodes.where(F.col("node_id").isin(src, dst)).count() < len({src, dst}):
            raise GraphError(f"no node {src} or {dst}")
        one = spark.createDataFrame([(src, dst)], "src long, dst long").crossJoin(self.edges.where(F.col("src") == src).agg(F.coalesce(F.max("pos") + 1, F.lit(0)).alias("pos")))
        return replace(self, edges=self.edges.unionByName(complete_edges(one.withColumns({"attenuation": F.lit(attenuation), "bin": F.lit(bin_)}))))

    def _first(self, src: int, dst: int) -> Column:
        first = self.edge(src, dst).collect()
        return F.lit(False) if not first else (F.col("src") == src) & (F.col("pos") == first[0].pos)

    def with_edge_props(self, src: int, dst: int, attenuation: float, bin_: int) -> Graph:
        """The first edge between two nodes changed."""
        at = self._first(src, dst)
        return replace(self, edges=self.edges.withColumns({"attenuation": F.when(at, F.lit(attenuation)).otherwise(F.col("attenuation")), "bin": F.when(at, F.lit(bin_)).otherwise(F.col("bin"))}))

    def without_edge(self, src: int, dst: int) -> Graph:
        """The first edge between two nodes removed; later positions keep their numbers."""
        return replace(self, edges=self.edges.where(~self._first(src, dst)))

    def isolate(self, node: int) -> Graph:
        """All edges from and to a node removed."""
        return replace(self, edges=self.edges.where((F.col("src") != node) & (F.col("dst") != node)))

    def isolated(self) -> DataFrame:
        """Nodes without an edge from them, and none to them from another node."""
        left = self.nodes.select("node_id").join(self.edges.select(F.col("src").alias("node_id")), "node_id", "left_anti")
        return left.join(self.edges.where("src <> dst").select(F.col("dst").alias("node_id")), "node_id", "left_anti")

    # validation

    def violations(self) -> DataFrame:
        """(rule, n) for each broken rule: unknown ends, bins or attenuation out of range, repeated ids or places."""
        ends = self.edges.select(F.explode(F.array("src", "dst")).alias("node_id"))
        found = [
            ("unknown node", ends.join(self.nodes, "node_id", "left_anti").agg(F.count("*").alias("n"))),
            ("bin out of range", self.edges.where(~F.col("bin").between(0, BINS - 1)).agg(F.count("*").alias("n"))),
            ("attenuation out of range", self.edges.where(~F.col("attenuation").between(0.0, 1.0)).agg(F.count("*").alias("n"))),
            ("repeated node", self.nodes.groupBy("node_id").count().where("count > 1").agg(F.count("*").alias("n"))),
            ("repeated place", self.edges.groupBy("src", "pos").count().where("count > 1").agg(F.count("*").alias("n"))),
        ]
        out = None
        for rule, df in found:
            one = df.select(F.lit(rule).alias("rule"), "n")
            out = one if out is None else out.unionByName(one)
        return out

    def validate(self) -> None:
        bad = self.violations().where("n > 0").collect()
        if bad:
            raise GraphError("; ".join(f"{r.n} x {r.rule}" for r in bad))


class GraphBuilder:
    """Labelled graphs from DataFrames: nodes are `type:value` labels, relations map to bins."""

    def __init__(self, spark: SparkSession) -> None:
        self.spark = spark
        self._nodes: list[DataFrame] = []
        self._edges: list[DataFrame] = []
        self._props: dict[str, dict] = {}  # of single nodes, as a caller adds them one by one
        self._order = 0

    def _put_nodes(self, labels: DataFrame) -> None:
        self._nodes.append(labels.withColumn("step", F.lit(self._order)))
        self._order += 1

    def add_node(self, label: str, node_type: str = "default", luminance: float | None = None, **props) -> GraphBuilder:
        """A node; props are other columns of a node (reflection, refraction, default_bin, prop, dir_lum, room), and the last ones given hold."""
        if unknown := set(props) - PROPS.keys():
            raise GraphError(f"a node has no {', '.join(sorted(unknown))}")
        self._put_nodes(self.spark.createDataFrame([(label, node_type, luminance)], "label string, node_type string, luminance double"))
        for name, value in props.items():
            self._props.setdefault(name, {})[label] = value
        return self

    def add_nodes(self, df: DataFrame, id_col: str, node_type: str, luminance: float = 1.0) -> GraphBuilder:
        """A node for each distinct value that isn't null."""
        own = F.lit(None).cast("double") if luminance == 1.0 else F.lit(luminance)
        self._put_nodes(df.where(F.col(id_col).isNotNull()).select(F.concat(F.lit(f"{node_type}:"), F.col(id_col).cast("string")).alias("label"), F.lit(node_type).alias("node_type"), own.alias("luminance")).distinct())
        return self

    def add_edges(self, df: DataFrame, src_col: str, dst_col: str, src_type: str, dst_type: str, relation: str, attenuation: float = 0.1, bidirectional: bool = False) -> GraphBuilder:
        """An edge for each row with both values, repeated rows too; missing nodes come to be, a reverse edge has the same bin."""
        rows = df.where(F.col(src_col).isNotNull() & F.col(dst_col).isNotNull()).select(
            F.concat(F.lit(f"{src_type}:"), F.col(src_col).cast("string")).alias("a"), F.concat(F.lit(f"{dst_type}:"), F.col(dst_col).cast("string")).alias("b")
        )
        null = F.lit(None).cast("double")
        for side, kind in (("a", src_type), ("b", dst_type)):
            self._put_nodes(rows.select(F.col(side).alias("label"), F.lit(kind).alias("node_type"), null.alias("luminance")).distinct())
        made = rows.withColumns({"attenuation": F.lit(attenuation), "bin": builder_bin(F.lit(relation)), "step": F.lit(self._order)})
        self._edges.append(made)
        if bidirectional:
            self._edges.append(made.select(F.col("b").alias("a"), F.col("a").alias("b"), "attenuation", "bin", F.lit(self._order + 1).alias("step")))
        self._order += 2
        return self

    def add_edge(self, src: str, dst: str, relation: str, attenuation: float = 0.1, bidirectional: bool = False) -> GraphBuilder:
        """An edge between two labels; unknown labels are skipped when the graph is built."""
        made = self.spark.createDataFrame([(src, dst)], "a string, b string").withColumns({"attenuation": F.lit(attenuation), "bin": builder_bin(F.lit(relation)), "step": F.lit(self._order)})
        self._edges.append(made)
        if bidirectional:
            self._edges.append(made.select(F.col("b").alias("a"), F.col("a").alias("b"), "attenuation", "bin", F.lit(self._order + 1).alias("step")))
        self._order += 2
        return self

    def build(self) -> Graph:
        """Ids are dense, by (type, label) in order; a label's first type stays, its last luminance holds.

        Dense ids need one total order of the labels. They are numbered within ranges of (type, label): Spark's range
        partitioning deals them out, and partition sizes give the offsets.
        """
        if not self._nodes:
            raise GraphError("a graph has a node at least")
        every = self._nodes[0]
        for n in self._nodes[1:]:
            every = every.unionByName(n)
        labels = every.groupBy("label").agg(F.min_by("node_type", "step").alias("node_type"), F.max_by("luminance", F.when(F.col("luminance").isNotNull(), F.col("step"))).alias("luminance"))
        for name, values in self._props.items():
            labels = labels.join(self.spark.createDataFrame(list(values.items()), f"label string, {name} {PROPS[name]}"), "label", "left")
        nodes = materialize(dense_ids(labels, "node_type", "label"), "builder-nodes")
        edges = None
        for e in self._edges:
            edges = e if edges is None else edges.unionByName(e)
        if edges is None:
            edges = self.spark.createDataFrame([], "a string, b string, attenuation double, bin int, step int")
        ids = nodes.select("label", "node_id")
        joined = edges.join(ids.select(F.col("label").alias("a"), F.col("node_id").alias("src")), "a").join(ids.select(F.col("label").alias("b"), F.col("node_id").alias("dst")), "b")
        place = F.row_number().over(Window.partitionBy("src").orderBy("step", "dst", "bin", "attenuation")) - 1
        return Graph(complete_nodes(nodes), complete_edges(joined.withColumn("pos", place)))


def sum_before(df: DataFrame, order: str, value: str, name: str) -> DataFrame:
    """Rows with the sum of `value` over all rows before them in the order of a column. Sorted ranges are summed each, then
    one after the other, so no task sees more rows than a range has or there are ranges."""
    ranged = materialize(df.repartitionByRange(order).withColumn("_part", F.spark_partition_id()), "ranges")
    sums = ranged.groupBy("_part").agg(F.sum(value).alias("_sum"))
    start = sums.select("_part", F.coalesce(F.sum("_sum").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    inside = F.coalesce(F.sum(value).over(Window.partitionBy("_part").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return ranged.withColumn(name, inside).join(start, "_part").withColumn(name, F.col(name) + F.col("_before")).drop("_part", "_before")


def dense_ids(df: DataFrame, *order: str, name: str = "node_id", first: int = 0) -> DataFrame:
    """Rows numbered from `first` in the order given, without one task that sees all: sorted ranges are counted, then
    numbered from the sum of those before them."""
    keyed = materialize(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumns({"_part": F.spark_partition_id(), "_at": F.monotonically_increasing_id()}), "dense-ids")
    sizes = keyed.groupBy("_part").agg(F.count("*").alias("n"), F.min("_at").alias("_from"))
    before = sizes.withColumn("_before", F.coalesce(F.sum("n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).select("_part", "_before", "_from")
    return keyed.join(F.broadcast(before), "_part").withColumn(name, F.col("_before") + F.col("_at") - F.col("_from") + first).drop("_part", "_at", "_before", "_from")
