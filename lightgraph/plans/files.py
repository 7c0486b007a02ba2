"""Queries that write the sources and sinks and read them again, and those of small operators beside the main ones; and their SQL."""

from __future__ import annotations

import posixpath

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import lookups as lk
from ..operators import kge, rag, rooms, text, triples, users, vectors
from ..operators.graph import Graph, complete_edges, complete_nodes
from ..session import shared_path, table
from ..sources import binary, tables
from ..sources.documents import load_and_chunk, load_directory
from ..sources.triples import read_triples
from . import graphs, sql
from .queries import BUILT, COS, NATION, ORACLE_SQL, PHASES, PVS_SQL, QUERY_VECTOR, SEEN, SHALLOW, STAR, TRIPLES, VOCAB, built, documents, interactions, mapped, query, r6, vector_triples


def file_path(spark: SparkSession, name: str) -> str:
    """A new file's path in the shared folder, whose parent is there."""
    folder = shared_path(spark, name)
    store, at = binary._open(folder)
    store.create_dir(at, recursive=True)
    return f"{folder}/{name}"


ROW = "(row_number() OVER (ORDER BY vec_id) - 1)::BIGINT"


@query(f"SELECT {ROW} AS node_id, list_transform(embedding::DOUBLE[], lambda x: round(x, 6) + 0.0) AS embedding FROM embeddings")
def emb_file(spark, d):
    """All vectors through a binary file; rows by id."""
    path = file_path(spark, "vectors.emb")
    binary.write_emb(graphs.vector_graph(spark, d)[1], path, normalize=False)
    return binary.read_emb(spark, path)


@query(f"SELECT {ROW} AS node_id, {r6('sqrt(list_inner_product(e, e))', 'norm')} FROM (SELECT vec_id, embedding::DOUBLE[] AS v, sqrt(list_inner_product(v, v)) AS n, list_transform(v, lambda x: (x / n)::FLOAT::DOUBLE) AS e FROM embeddings)")
def emb_file_normalized(spark, d):
    """With a header, vectors made unit ones; their norms as read."""
    path = file_path(spark, "unit.emb")
    binary.write_emb(graphs.vector_graph(spark, d)[1], path, header=True)
    return vectors.store(binary.read_emb(spark, path, check_header=True)).select("node_id", "norm")


@query("SELECT count(*) AS num_nodes, max(len(embedding))::BIGINT AS dim, (16 + 4 * sum(len(embedding)))::BIGINT AS bytes, 16::BIGINT AS start FROM embeddings")
def emb_file_info(spark, d):
    path = file_path(spark, "info.emb")
    binary.write_emb(graphs.vector_graph(spark, d)[1], path, header=True)
    return spark.createDataFrame([binary.emb_info(path, check_header=True)], "num_nodes long, dim long, bytes long, start long")


def level(spark: SparkSession, d: str) -> str:
    """The graph of customers and nations as a level file; nations are room 1."""
    graph = built(spark, d).materialized()
    graph = graph.with_rooms(graph.nodes.select("node_id", (F.col("node_type") == "nation").cast("int").alias("room")))
    path = file_path(spark, "graph.level")
    binary.write_level(rooms.mark_portals(graph), path)
    return path


LEVEL_EDGES = "x AS (SELECT a.node_id AS src, b.node_id AS dst, row_number() OVER (PARTITION BY a.node_id ORDER BY step, b.node_id) - 1 AS pos FROM e JOIN v a ON a.label = a JOIN v b ON b.label = b)".replace("a.label = a", "a.label = e.a").replace("b.label = b", "b.label = e.b")


@query(BUILT + f", {LEVEL_EDGES} SELECT src, dst, pos::INTEGER AS pos, {r6('0.1', 'attenuation')}, 8 AS bin, true AS is_portal FROM x")
def level_file_edges(spark, d):
    return binary.read_level(spark, level(spark, d))[0].edges


@query(BUILT + "SELECT node_id, CASE WHEN node_type = 'nation' THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS luminance, 1.0::DOUBLE AS reflection, (node_type = 'nation')::INTEGER AS room FROM v")
def level_file_nodes(spark, d):
    return binary.read_level(spark, level(spark, d))[0].nodes.select("node_id", "luminance", "reflection", "room")


@query(BUILT + "SELECT room, (CASE room WHEN 0 THEN 0 ELSE (SELECT count(*) FROM v WHERE node_type <> 'nation') END)::BIGINT AS node_start, count(*) AS node_count FROM (SELECT (node_type = 'nation')::INTEGER AS room FROM v) GROUP BY room")
def level_file_rooms(spark, d):
    return binary.read_level(spark, level(spark, d))[1]


@query(BUILT + ", c AS (SELECT (SELECT count(*) FROM v) AS n, (SELECT count(*) FROM e) AS m) SELECT n AS num_nodes, m AS num_edges, 2::BIGINT AS num_rooms, 16::BIGINT AS bins, 64 + 16 * n AS edges_at, 64 + 16 * n + 4 * (n + 1) + 12 * m + 4 + 4 * n AS rooms_at FROM c")
def level_file_header(spark, d):
    h = binary.level_header(level(spark, d))
    names = ("num_nodes", "num_edges", "num_rooms", "bins", "edges_at", "rooms_at")
    return spark.createDataFrame([tuple(h[n] for n in names)], ", ".join(f"{n} long" for n in names))


@query(f"WITH {STAR} SELECT src, dst, pos, attenuation, bin FROM edges")
def graph_tables(spark, d):
    """A graph written as Parquet tables and read again."""
    path = shared_path(spark, "graph")
    tables.write_graph(graphs.star_graph(spark, d), path)
    return tables.read_graph(spark, path).edges.select("src", "dst", "pos", "attenuation", "bin")


@query(f"{PVS_SQL} SELECT from_room, bin, to_room FROM pvs")
def pvs_tables(spark, d):
    path, graph = shared_path(spark, "graph"), graphs.plain(graphs.nation_graph(spark, d))
    tables.write_graph(graph, path, rooms.compute_pvs(graph, SHALLOW))
    return tables.read_pvs(spark, path)


@query(f"WITH {TRIPLES} SELECT head, relation, tail FROM t")
def triples_csv(spark, d):
    path = shared_path(spark, "triples")
    graphs.key_triples(spark, d).coalesce(1).write.csv(f"{path}.csv", header=True)
    return read_triples(spark, f"{path}.csv")


@query(f"WITH {TRIPLES} SELECT head, relation, tail FROM t")
def triples_json(spark, d):
    """An array of objects, as the compatible form has it, written in one piece."""
    path = shared_path(spark, "triples")
    one = graphs.key_triples(spark, d).agg(F.to_json(F.collect_list(F.struct(F.col("head").alias("subject"), F.col("relation").alias("predicate"), F.col("tail").alias("object")))).alias("value"))
    one.coalesce(1).write.text(f"{path}.json")
    return read_triples(spark, f"{path}.json")


def folder_of(spark: SparkSession, d: str) -> str:
    """Every text of the benchmark as a file, and every page; written by the tasks that read them."""
    folder = shared_path(spark, "files")

    def write(batches):
        for batch in batches:
            names = []
            for name, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                store, at = binary._open(f"{folder}/{name}")
                store.create_dir(posixpath.dirname(at), recursive=True)
                with store.open_output_stream(at, compression=None) as out:
                    out.write(data)
                names.append(name)
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.string())], names=["name"])

    items = table(spark, d, "benchmark").select(F.concat(F.lit("items/"), F.col("item_id").cast("string"), F.lit(".txt")).alias("name"), F.encode("text", "utf-8").alias("data"))
    pages = table(spark, d, "pages").select(F.concat(F.lit("pages/"), F.col("page_id").cast("string"), F.lit(".html")).alias("name"), F.encode("html", "utf-8").alias("data"))
    others = table(spark, d, "region").select(F.concat(F.lit("other/"), F.col("r_regionkey").cast("string"), F.lit(".bin")).alias("name"), F.encode("r_name", "utf-8").alias("data"))
    items.unionByName(pages).unionByName(others).mapInArrow(write, "name string").write.format("noop").mode("overwrite").save()
    return folder


@query("SELECT item_id::VARCHAR || '.txt' AS filename, left(md5(text), 12) AS document_id, text AS content, octet_length(encode(text))::VARCHAR AS size FROM benchmark")
def directory_texts(spark, d):
    """The text files of a folder with others beside them."""
    found = load_directory(spark, folder_of(spark, d)).where("metadata.extension = '.txt'")
    return found.select("metadata.filename", "document_id", "content", "metadata.size")


@query("SELECT 'items' AS folder, count(*) AS files FROM benchmark UNION ALL SELECT 'pages', count(*) FROM pages")
def directory_files(spark, d):
    """Files of known kinds by folder; those of other kinds are left out."""
    found = load_directory(spark, folder_of(spark, d))
    return found.groupBy(F.element_at(F.split("source_path", "/"), -2).alias("folder")).agg(F.count("*").alias("files"))


CHUNKED = (
    "w AS (SELECT {id} AS document_id, {words} AS w FROM {table}), s AS (SELECT document_id, w, unnest(range(0, greatest(0, ceil((len(w) - {size}) / {stride}.0))::BIGINT + 1)) AS i FROM w WHERE len(w) > 0), "
    "c AS (SELECT document_id, i::INTEGER AS chunk_id, w[i * {stride} + 1 : i * {stride} + {size}] AS p FROM s), t AS (SELECT document_id, chunk_id, array_to_string(p, ' ') AS text, len(p)::INTEGER AS token_count FROM c), "
    "b AS (SELECT *, coalesce(sum(length(text) + 1) OVER (PARTITION BY document_id ORDER BY chunk_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::INTEGER AS start_char FROM t) "
)
WORDS = r"list_filter(regexp_split_to_array(text, '[ \t\n\x0B\f\r]+'), lambda w: w <> '')"


@query("WITH " + CHUNKED.format(id="left(md5(text), 12)", words=WORDS, table="(SELECT DISTINCT text FROM benchmark)", size=12, stride=9) + "SELECT document_id, chunk_id, text, start_char FROM b WHERE token_count >= 3")
def directory_chunks(spark, d):
    """Chunks of the text files of a folder."""
    folder = folder_of(spark, d)
    return load_and_chunk(spark, f"{folder}/items", 12, 3, least=3).select("document_id", "chunk_id", "text", "start_char").distinct()


@query("WITH " + CHUNKED.format(id="doc_id::VARCHAR", words=WORDS, table="documents", size=120, stride=100) + "SELECT document_id, chunk_id, text, start_char, (start_char + length(text))::INTEGER AS end_char FROM b WHERE token_count >= 50")
def chunks_json(spark, d):
    path = shared_path(spark, "chunks")
    tables.write_chunks(text.chunk_words(documents(spark, d), 120, 20, 50), path)
    return tables.read_chunks(spark, path).select("document_id", "chunk_id", "text", "start_char", "end_char")


@query(ORACLE_SQL["chunks_json"])
def chunks_json_arrays(spark, d):
    """The same chunks from files that hold an array each: a file for every hundred documents, or about as many."""
    path = shared_path(spark, "chunk-arrays")
    chunks = text.chunk_words(documents(spark, d), 120, 20, 50)
    rows = chunks.withColumn("file", F.pmod(F.xxhash64("document_id"), F.lit(max(1, chunks.select("document_id").distinct().count() // 100))))
    listed = rows.groupBy("file").agg(F.collect_list(F.to_json(F.struct(*chunks.columns))).alias("all"))
    listed.select("file", F.concat(F.lit("[\n"), F.array_join("all", ",\n"), F.lit("\n]")).alias("value")).write.partitionBy("file").text(path)
    return tables.read_chunks(spark, path).select("document_id", "chunk_id", "text", "start_char", "end_char")


@query(f"WITH {TRIPLES}, {VOCAB} SELECT entity, entity_id FROM v")
def vocab_file(spark, d):
    path = shared_path(spark, "vocab")
    tables.vocab_json(triples.entity_vocab(graphs.key_triples(spark, d))).write.text(path)
    return tables.read_vocab_json(spark, path)


@query(ORACLE_SQL["rotate_scores"])
def model_tables(spark, d):
    """A model saved and loaded; its scores of every link."""
    path = shared_path(spark, "model")
    kge.save_model((graphs.vector_graph(spark, d)[1], PHASES), path)
    entities, phases = kge.load_model(spark, path)
    return kge.scored(vector_triples(spark, d), entities, phases)


# small operators


@query(f"WITH {STAR}, k AS (SELECT node_type, label FROM nodes) SELECT node_id, label, node_type FROM nodes WHERE label IN ('EUROPE', 'GERMANY', 'FRANCE', 'nobody') OR label IN (SELECT c_name FROM customer)")
def node_lookup(spark, d):
    """Nodes by label, among them labels that no node has."""
    wanted = spark.createDataFrame([("EUROPE",), ("GERMANY",), ("FRANCE",), ("nobody",)], "label string")
    return graphs.star_graph(spark, d).lookup(wanted.unionByName(table(spark, d, "customer").select(F.col("c_name").alias("label"))))


@query(f"WITH {NATION}, s AS (SELECT room, coalesce(sum(n) OVER (ORDER BY room ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS node_start, n AS node_count FROM (SELECT room, count(*) AS n FROM nodes GROUP BY room)) SELECT *, (SELECT count(*) FROM s) AS num_rooms FROM s WHERE room = 3")
def room_lookup(spark, d):
    graph = graphs.nation_graph(spark, d)
    return rooms.room(graph, 3).withColumn("num_rooms", F.lit(rooms.num_rooms(graph)).cast("long"))


@query("SELECT * FROM (VALUES " + ", ".join(f"('{p}', {n}, {len(lk.PROPERTY_BINS)})" for n, p in enumerate(lk.PROPERTY_BINS)) + ") t(property, place, properties)")
def property_places(spark, d):
    return spark.createDataFrame([(p, lk.property_place(p), lk.property_count()) for p in lk.PROPERTY_BINS], "property string, place int, properties int")


@query(f"WITH nodes AS (SELECT 'r' || r_regionkey AS label FROM region UNION ALL SELECT 'c' || c_custkey FROM customer) SELECT label FROM nodes WHERE label[1] = 'r' OR substr(label, 2)::BIGINT NOT IN (SELECT o_custkey FROM orders)")
def isolated_customers(spark, d):
    """Regions, which have no edge here, and customers without an order."""
    r, c, o = (table(spark, d, t) for t in ("region", "customer", "orders"))
    nodes = r.select(graphs.node_of(0, "r_regionkey").alias("node_id"), F.concat(F.lit("r"), F.col("r_regionkey").cast("string")).alias("label"))
    nodes = nodes.unionByName(c.select(graphs.node_of(2, "c_custkey").alias("node_id"), F.concat(F.lit("c"), F.col("c_custkey").cast("string")).alias("label")))
    placed = o.select(graphs.node_of(3, "o_orderkey").alias("node_id")).withColumn("label", F.lit(None).cast("string"))
    edges = o.select(graphs.node_of(2, "o_custkey").alias("src"), graphs.node_of(3, "o_orderkey").alias("dst"), F.lit(0.1).alias("attenuation"), F.lit(6).alias("bin"))
    graph = Graph(complete_nodes(nodes.unionByName(placed)), complete_edges(edges, ("dst", "bin")))
    return graph.isolated().join(graph.nodes.select("node_id", "label"), "node_id").select("label")


WALK_ALL = "w AS (SELECT 0::BIGINT AS node_id, [0::BIGINT] AS path, []::INTEGER[] AS seq, 0 AS hops UNION ALL SELECT e.dst, list_append(path, e.dst), list_append(seq, e.pos), hops + 1 FROM w JOIN edges e ON e.src = w.node_id WHERE hops < 2 AND e.bin IN (6, 8) AND NOT list_contains(path, e.dst)), best AS (SELECT *, row_number() OVER (PARTITION BY node_id ORDER BY hops, seq) AS k FROM w)"


@query(f"WITH RECURSIVE {STAR}, {WALK_ALL} SELECT node_id, hops::INTEGER AS hops, path FROM best WHERE k = 1 AND node_id <> 0")
def explore_region(spark, d):
    """Two hops from region 0 along keys: its nations and their customers."""
    return rag.explore(graphs.star_graph(spark, d), 0, [6, 8], 2)


ODD = "SELECT vec_id, CASE vec_id % 5 WHEN 0 THEN list_transform(embedding::DOUBLE[], lambda x: 'nan'::DOUBLE) WHEN 1 THEN list_concat(['inf'::DOUBLE, '-inf'::DOUBLE], (embedding::DOUBLE[])[3:]) WHEN 2 THEN list_transform(embedding::DOUBLE[], lambda x: 0.0::DOUBLE) ELSE embedding::DOUBLE[] END AS v FROM embeddings"


@query(f"SELECT count(*) AS num_rows, sum(len(list_filter(v, lambda x: isnan(x))))::BIGINT AS num_nan, sum(len(list_filter(v, lambda x: isinf(x))))::BIGINT AS num_inf, sum((len(list_filter(v, lambda x: x <> 0)) = 0)::BIGINT)::BIGINT AS num_zero FROM ({ODD})")
def embedding_stats_odd(spark, d):
    """Vectors of which a fifth each are not numbers, hold infinities, or are zero."""
    e = table(spark, d, "embeddings").withColumn("embedding", F.col("embedding").cast("array<double>"))
    kind = F.pmod("vec_id", F.lit(5))
    odd = F.when(kind == 0, F.transform("embedding", lambda x: F.lit(float("nan")))).when(kind == 1, F.concat(F.array(F.lit(float("inf")), F.lit(float("-inf"))), F.slice("embedding", 3, 1 << 20)))
    odd = odd.when(kind == 2, F.transform("embedding", lambda x: F.lit(0.0))).otherwise(F.col("embedding"))
    return vectors.statistics(e.select(odd.alias("embedding"))).select("num_rows", "num_nan", "num_inf", "num_zero")


@query("SELECT vec_id AS node_id, list_transform(CASE WHEN vec_id % 2 = 0 THEN list_transform(embedding::DOUBLE[], lambda x: -x) ELSE embedding::DOUBLE[] END, lambda x: round(x, 6) + 0.0) AS embedding FROM embeddings")
def embedding_updates(spark, d):
    """Even ids get their vector's opposite; updates of unknown ids and of other lengths change nothing."""
    e = graphs.vector_graph(spark, d)[1].withColumn("embedding", F.col("embedding").cast("array<double>"))
    new = e.where("node_id % 2 = 0").withColumn("embedding", F.transform("embedding", lambda x: -x))
    wrong = e.where("node_id % 2 = 1").withColumn("embedding", F.slice("embedding", 1, 3)).unionByName(e.withColumn("node_id", F.col("node_id") + 10**12))
    return vectors.set_embeddings(vectors.store(e), new.unionByName(wrong), 64).select("node_id", "embedding")


@query(f"WITH {SEEN} SELECT * FROM seen WHERE user_id <> (SELECT min(user_id) FROM seen)")
def user_removed(spark, d):
    seen = users.history(interactions(spark, d))
    return users.without_user(seen, seen.agg(F.min("user_id")).collect()[0][0])


@query(f"SELECT vec_id AS node, {r6(COS, 'intensity')}, {r6(f'-ln({COS} + 1e-6)', 'distance')} FROM embeddings WHERE {COS} > 0")
def similarity_results(spark, d):
    """Similarities as results of an influence query."""
    found = vectors.all_similarities(vectors.store(graphs.vector_graph(spark, d)[1]), QUERY_VECTOR).where("similarity > 0")
    return rag.influence_results(found.select("node_id", F.col("similarity").alias("score"), (-F.log(F.col("similarity") + 1e-6)).alias("distance")))


@query(f"{PVS_SQL} SELECT from_room, bin, to_room FROM pvs WHERE from_room IN (1, 2)")
def pvs_updated(spark, d):
    """Visibility of room 1 alone, then with what room 2 sees."""
    graph = graphs.plain(graphs.nation_graph(spark, d))
    return rooms.update_pvs(graph, rooms.compute_pvs(graph, SHALLOW, [1]), 2, SHALLOW)


MAPPED = f"m AS (SELECT a.entity_id AS head_id, {sql.relation_bin('relation')} AS angle_bin, b.entity_id AS tail_id FROM t JOIN v a ON a.entity = head JOIN v b ON b.entity = tail)"


@query(f"WITH {TRIPLES}, {VOCAB}, {MAPPED} SELECT head_id, angle_bin, tail_id, 4::BIGINT AS n, 4::BIGINT AS invalid, (SELECT count(*) FROM v) AS entities FROM (SELECT DISTINCT * FROM m)")
def negative_counts(spark, d):
    """Of every triple, its negatives, and those of them that are no valid tail: all, as there are many more entities than tails."""
    m = mapped(spark, d)
    n = m.agg(F.greatest(F.max("head_id"), F.max("tail_id")) + 1).collect()[0][0]
    made = triples.negatives(m, n, 4).where(F.col("negative").between(0, n - 1))
    valid = m.select("head_id", "angle_bin", F.col("tail_id").alias("negative"), F.lit(1).alias("valid")).distinct()
    told = made.join(valid, ["head_id", "angle_bin", "negative"], "left")
    return told.groupBy("head_id", "angle_bin", "tail_id").agg(F.count("*").alias("n"), F.count(F.when(F.col("valid").isNull(), 1)).alias("invalid")).withColumn("entities", F.lit(n).cast("long"))


@query("WITH " + CHUNKED.format(id="doc_id::VARCHAR", words=WORDS, table="documents", size=100, stride=80) + ", n AS (SELECT document_id, count(*) AS n FROM b GROUP BY 1) SELECT document_id, n AS chunks, n AS positives, CASE WHEN n = 1 THEN n ELSE 0 END AS themselves, n AS elsewhere FROM n")
def contrastive_counts(spark, d):
    """Of every document, its chunks, those with a positive in it, those that are their own positive (only a sole one), and those
    whose negative is in another document."""
    chunks = text.chunk_words(documents(spark, d), 100, 20, 1).select("document_id", "chunk_id")
    made = triples.contrastive(chunks)
    there = chunks.select("document_id", F.col("chunk_id").alias("positive_chunk"), F.lit(1).alias("there"))
    far = chunks.select(F.col("document_id").alias("negative_document"), F.col("chunk_id").alias("negative_chunk"), F.lit(1).alias("far"))
    told = made.join(there, ["document_id", "positive_chunk"], "left").join(far, ["negative_document", "negative_chunk"], "left")
    return told.groupBy("document_id").agg(
        F.count("*").alias("chunks"), F.count("there").alias("positives"), F.count(F.when(F.col("positive_chunk") == F.col("chunk_id"), 1)).alias("themselves"),
        F.count(F.when(F.col("far").isNotNull() & (F.col("negative_document") != F.col("document_id")), 1)).alias("elsewhere"),
    )
