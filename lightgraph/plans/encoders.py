"""Queries of encoders with fixed weights, of their training, and of the tools around retrieval; and their SQL."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import encoders, kge, rag, rooms, text, triples, vectors
from ..operators.graph import GraphBuilder
from ..params import LightParams, TrainConfig
from ..session import table
from . import graphs, sql
from .queries import COS, MAPPED, NEAR, PHASES, PVS_SQL, QUERY_VECTOR, RAG_BINS, SHALLOW, TRIPLES, VOCAB, WALK, WORDS, documents, mapped, query, r6, scored_sql

DIM = 64


def weight(b: int, rows: int, columns: int) -> np.ndarray:
    """A matrix by rule, as the SQL has it: ((5 b + 3 i + 7 j) mod 11 - 5) / 20."""
    i, j = np.indices((rows, columns))
    return ((b * 5 + i * 3 + j * 7) % 11 - 5) / 20


def bias(columns: int) -> np.ndarray:
    return np.arange(columns) % 5 / 10


def times(v: str, b: str, rows: int, columns: int) -> str:
    """SQL: a list times weight(b)."""
    return f"list_transform(range(0, {columns}), lambda j: list_sum(list_transform(range(0, {rows}), lambda i: {v}[i + 1] * ((({b}) * 5 + i * 3 + j * 7) % 11 - 5) / 20.0::DOUBLE)))"


def unit(v: str) -> str:
    return f"list_transform({v}, lambda x: round(x / greatest(sqrt(list_inner_product({v}, {v})), 1e-10), 6) + 0.0)"


def plus_bias(v: str, columns: int) -> str:
    return f"list_transform(range(0, {columns}), lambda j: {v}[j + 1] + (j % 5) / 10.0::DOUBLE)"


# One layer over `h` (node_id, v): messages by component, then the layer's norm.
MESSAGES = (
    f"msg AS (SELECT e.dst AS node_id, {times('h.v', 'e.bin', DIM, DIM)} AS m FROM edges e JOIN h ON h.node_id = e.src), parts AS (SELECT node_id, unnest(range(0, {DIM})) AS j, unnest(m) AS x FROM msg), "
    "sums AS (SELECT node_id, j, sum(x) / (count(*) + 1e-8) AS x FROM parts GROUP BY 1, 2), pooled AS (SELECT node_id, list(x ORDER BY j) AS p FROM sums GROUP BY 1), "
    f"raw AS (SELECT node_id, list_transform(range(0, {DIM}), lambda j: h.v[j + 1] + coalesce(p[j + 1], 0.0) + (j % 5) / 10.0::DOUBLE) AS v FROM h LEFT JOIN pooled USING (node_id)), "
    f"mean AS (SELECT node_id, v, list_sum(v) / {DIM} AS m FROM raw), dev AS (SELECT *, sqrt(list_sum(list_transform(v, lambda x: (x - m) * (x - m))) / {DIM} + 1e-5) AS s FROM mean), "
    "normed AS (SELECT node_id, list_transform(v, lambda x: (x - m) / s) AS v FROM dev)"
)


@query(f"WITH {sql.vectors()}, h AS (SELECT vec_id AS node_id, embedding::DOUBLE[] AS v FROM embeddings), {MESSAGES} SELECT node_id, {unit('v')} AS embedding FROM normed")
def graph_encoder(spark, d):
    """One message layer over the vector graph, with weights by rule."""
    graph, e = graphs.vector_graph(spark, d)
    w = np.stack([weight(b, DIM, DIM) for b in range(16)])
    return kge.encode_graph(e, graph.edges, [(w, bias(DIM))]).select("node_id", "embedding")


@query(
    f"WITH {sql.vectors()}, x AS (SELECT src, dst, pos, list_sum(list_transform(range(0, {DIM}), lambda i: (h.embedding::DOUBLE[])[i + 1] * ((e.bin * 5 + i * 3) % 11 - 5) / 20.0::DOUBLE)) AS x FROM edges e JOIN embeddings h ON h.vec_id = e.src) "
    f"SELECT src, dst, pos, {r6('1e4 * exp(x - (SELECT max(x) FROM x)) / (SELECT sum(exp(x - (SELECT max(x) FROM x))) FROM x)', 'weight')} FROM x"
)
def edge_attention(spark, d):
    """Every edge's share of the softmax over all edges, in ten-thousandths."""
    graph, e = graphs.vector_graph(spark, d)
    found = kge.edge_attention(graph.edges, e, [weight(b, DIM, 1)[:, 0].tolist() for b in range(16)])
    return found.select("src", "dst", "pos", (F.col("weight") * 1e4).alias("weight"))


# One head over `h` (node_id, v), whose queries, keys and values are v times weight(0), weight(1) and weight(2), and the way out weight(3).
ATTENDED = (
    f"side AS (SELECT node_id, v, {times('v', '0', 8, 8)} AS q, {times('v', '1', 8, 8)} AS k, {times('v', '2', 8, 8)} AS w FROM h), "
    "score AS (SELECT e.dst AS node_id, list_inner_product(b.q, a.k) / sqrt(8) + e.bin / 16.0::DOUBLE AS s, a.w FROM edges e JOIN side a ON a.node_id = e.src JOIN side b ON b.node_id = e.dst), "
    "top AS (SELECT max(s) AS t FROM score), over AS (SELECT sum(exp(s - t)) AS o FROM score, top), "
    "parts AS (SELECT node_id, unnest(range(0, 8)) AS j, unnest(list_transform(w, lambda x: x * exp(s - t) / o)) AS x FROM score, top, over), "
    "pooled AS (SELECT node_id, list(x ORDER BY j) AS p FROM (SELECT node_id, j, sum(x) AS x FROM parts GROUP BY 1, 2) GROUP BY 1), "
    f"sent AS (SELECT node_id, v, {times('coalesce(p, list_transform(range(8), lambda z: 0.0::DOUBLE))', '3', 8, 8)} AS p FROM h LEFT JOIN pooled USING (node_id)), "
    "raw AS (SELECT node_id, list_transform(range(0, 8), lambda j: v[j + 1] + p[j + 1] + (j % 5) / 10.0::DOUBLE) AS v FROM sent), "
    "mean AS (SELECT node_id, v, list_sum(v) / 8 AS m FROM raw), dev AS (SELECT *, sqrt(list_sum(list_transform(v, lambda x: (x - m) * (x - m))) / 8 + 1e-5) AS s FROM mean), "
    "normed AS (SELECT node_id, list_transform(v, lambda x: (x - m) / s) AS v FROM dev)"
)
INWARD = f"h AS (SELECT vec_id AS node_id, list_transform({plus_bias(times('(embedding::DOUBLE[])', '4', DIM, 8), 8)}, lambda x: greatest(x, 0.0)) AS v FROM embeddings)"


@query(f"WITH {sql.vectors()}, {INWARD}, {ATTENDED}, y AS (SELECT node_id, {plus_bias(times('v', '5', 8, 4), 4)} AS v FROM normed) SELECT node_id, {unit('v')} AS embedding FROM y")
def attention_encoder(spark, d):
    """Vectors sent in, one attention layer over the vector graph, sent out; weights by rule."""
    graph, e = graphs.vector_graph(spark, d)
    plain = [(weight(b, 8, 8), np.zeros(8)) for b in range(3)]
    layer = kge.Attention(*plain, (weight(3, 8, 8), bias(8)), np.arange(16)[:, None] / 16)
    return kge.encode_with_attention(e, graph.edges, (weight(4, DIM, 8), bias(8)), [layer], (weight(5, 8, 4), bias(4))).select("node_id", "embedding")


@query(f"WITH y AS (SELECT vec_id AS node_id, label, {plus_bias(times('(embedding::DOUBLE[])', 'label', DIM, 8), 8)} AS v FROM embeddings) SELECT node_id, label AS bin, {unit('v')} AS embedding FROM y")
def projected_vectors(spark, d):
    """A head with a projection for each direction: every vector by its label's."""
    e = table(spark, d, "embeddings").select(F.col("vec_id").alias("node_id"), F.col("label").alias("bin"), "embedding")
    return kge.projected(e, np.stack([weight(b, DIM, 8) for b in range(16)]), bias(8))


SHORT = [p[:4] for p in PHASES]
TURNED = "list_concat(list_transform(range(1, 5), lambda i: h[i] * cos(phi[i]) - h[i + 4] * sin(phi[i])), list_transform(range(1, 5), lambda i: h[i] * sin(phi[i]) + h[i + 4] * cos(phi[i])))"


@query(
    "WITH p AS (SELECT * FROM (VALUES " + ", ".join(f"({b}, {v}::DOUBLE[])" for b, v in enumerate(SHORT)) + f") t(b, phi)), r AS (SELECT vec_id AS node_id, {times('(embedding::DOUBLE[])', '0', DIM, 8)} AS h, phi FROM embeddings JOIN p ON b = label) "
    f"SELECT node_id, list_transform({TURNED}, lambda x: round(x, 6) + 0.0) AS embedding FROM r"
)
def rotated_projections(spark, d):
    """Every vector as a text's, projected to entities' size and rotated by its label's direction."""
    e = table(spark, d, "embeddings").select(F.col("vec_id").alias("node_id"), "label", "embedding")
    return kge.rotated_texts(e, SHORT, F.col("label"), weight(0, DIM, 8)).select("node_id", "embedding")


@query(f"WITH {TRIPLES}, {VOCAB} SELECT count(*) AS entities, count(*) * 16 AS numbers, count(*) * 16 AS within, count(*) AS distinct_vectors, 1 AS near_zero_mean FROM v")
def entity_init(spark, d):
    """First vectors of all entities: their number, size and bounds, and whether their mean is within six deviations of 0."""
    n = triples.entity_vocab(graphs.key_triples(spark, d)).count()
    e = kge.initial_entities(spark, n, 16)
    inside = F.size(F.filter("embedding", lambda x: F.abs(x) <= 0.25))
    mean = F.abs(F.sum(F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x)) / (n * 16))
    return e.agg(
        F.count("*").alias("entities"), F.sum(F.size("embedding")).alias("numbers"), F.sum(inside).alias("within"), F.countDistinct("embedding").alias("distinct_vectors"),
        (mean < 6 * 0.25 / 3**0.5 / (n * 16) ** 0.5).cast("int").alias("near_zero_mean"),
    )


@query()
def encoder_training(spark, d):
    """(epoch, loss) of a dense and a message layer, trained so that linked vectors meet: all links, three epochs."""
    graph, e = graphs.vector_graph(spark, d)
    edges = graph.edges.select("src", "dst", "pos", "bin")
    history = kge.History()
    layers = encoders.initial_layers((DIM, 16), 1)
    config = TrainConfig(epochs=3, learning_rate=0.02, batch_size=256, optimizer="adamw")
    encoders.train_encoder(e, edges, edges.select(F.col("src").alias("query"), F.col("dst").alias("document")), layers, config, [history], fanout=2)
    return history.frame(spark)


# tools


HOPS = 2
CAUSES = f"SELECT (i * 3 + j)::BIGINT AS qid, vec_id AS node_id, ({RAG_BINS})[j + 1] AS bin FROM near, (SELECT unnest(range(3)) AS j)"
WALKED = (
    f"w AS (SELECT vec_id AS node_id, [vec_id] AS path, [i::INTEGER] AS seq, 0 AS hops FROM near UNION ALL SELECT e.dst, list_append(path, e.dst), list_append(seq, e.pos), hops + 1 FROM w JOIN edges e ON e.src = w.node_id WHERE hops < {HOPS} AND NOT list_contains(path, e.dst)), "
    "best AS (SELECT *, row_number() OVER (PARTITION BY node_id ORDER BY hops, seq) AS k FROM w)"
)


@query(
    f"WITH RECURSIVE {sql.vectors()}, {NEAR}, {WALKED}, {sql.light(CAUSES, LightParams(max_depth=HOPS))}, total AS (SELECT node_id, sum(intensity * greatest(s, 0.0)) AS total FROM lit JOIN near ON i = qid // 3 GROUP BY 1), "
    f"sim AS (SELECT vec_id, {COS} AS s FROM embeddings) " + scored_sql("sim.s", "1.0", ", sim WHERE sim.vec_id = n.node_id", 0.5, 0.4, 0.1, 12, "coalesce((SELECT path FROM best WHERE best.node_id = q.node_id AND k = 1), []::BIGINT[])")
)
def search_tool(spark, d):
    """The search tool: causes within two hops, each with its path."""
    graph, e = graphs.vector_graph(spark, d)
    return rag.search(graph, vectors.store(e), "Tell me more", QUERY_VECTOR, "causal", HOPS, 12)


def nearest_sql(node: int) -> str:
    return f"(SELECT a.vec_id FROM embeddings a, embeddings q WHERE q.vec_id = {node} ORDER BY round(list_cosine_similarity(a.embedding::DOUBLE[], q.embedding::DOUBLE[]), 9) DESC, a.vec_id LIMIT 1)"


@query(f"WITH RECURSIVE {sql.vectors()}, {WALK.format(start=nearest_sql(3), depth=4, more='')} SELECT path FROM best WHERE k = 1 AND node_id = {nearest_sql(73)}")
def path_between(spark, d):
    """The path tool: from the node nearest to one vector to the node nearest to another."""
    graph, e = graphs.vector_graph(spark, d)
    ends = {r.node_id: list(r.embedding) for r in e.where(F.col("node_id").isin(3, 73)).collect()}  # two vectors, the tool's arguments
    return rag.reasoning_path_between(graph, vectors.store(e), ends[3], ends[73], 4)


@query(
    "WITH l AS (SELECT DISTINCT 'customer' AS node_type, 'customer:' || c_custkey AS label FROM customer UNION SELECT 'nation', 'nation:' || n_nationkey FROM nation), v AS (SELECT *, row_number() OVER (ORDER BY node_type, label) - 1 AS node_id FROM l), "
    "e AS (SELECT 'customer:' || c_custkey AS a, 'nation:' || c_nationkey AS b, 0 AS step, 8 AS bin, 0.1::DOUBLE AS attenuation FROM customer UNION ALL "
    "SELECT * FROM (VALUES ('nation:1', 'nation:2', 2, 4, 0.3::DOUBLE), ('nation:2', 'nation:1', 3, 4, 0.3::DOUBLE), ('nation:1', 'nowhere', 4, 4, 0.1::DOUBLE)) t(a, b, step, bin, attenuation)) "
    f"SELECT x.node_id AS src, y.node_id AS dst, (row_number() OVER (PARTITION BY x.node_id ORDER BY step, y.node_id) - 1)::INTEGER AS pos, e.bin, {r6('e.attenuation', 'attenuation')} FROM e JOIN v x ON x.label = a JOIN v y ON y.label = b"
)
def builder_edge(spark, d):
    """All of a builder's edges after one was added both ways between nations, and one to a label that isn't there."""
    c = table(spark, d, "customer")
    made = GraphBuilder(spark).add_nodes(table(spark, d, "nation"), "n_nationkey", "nation", 2.0).add_edges(c, "c_custkey", "c_nationkey", "customer", "nation", "belongs_to")
    made = made.add_edge("nation:1", "nation:2", "followed_by", 0.3, bidirectional=True).add_edge("nation:1", "nowhere", "followed_by")
    return made.build().edges.select("src", "dst", "pos", "bin", "attenuation")


def by_characters() -> tuple:
    """A tokenizer whose tokens are characters."""
    return list, "".join


@query(
    "WITH s AS (SELECT doc_id::VARCHAR AS document_id, text, unnest(range(0, greatest(1, length(text) - 50), 150)) AS place FROM documents WHERE trim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) <> ''), "
    f"c AS (SELECT document_id, (place // 150)::INTEGER AS chunk_id, substr(text, place + 1, 200) AS text FROM s), t AS (SELECT *, len({WORDS})::INTEGER AS token_count FROM c), "
    "b AS (SELECT *, coalesce(sum(length(text) + 1) OVER (PARTITION BY document_id ORDER BY chunk_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::INTEGER AS start_char FROM t) "
    "SELECT document_id, chunk_id, text, start_char, (start_char + length(text))::INTEGER AS end_char, token_count FROM b WHERE token_count >= 5"
)
def chunk_tokens(spark, d):
    """Windows of 200 tokens, 50 of them shared; tokens are characters."""
    return text.chunk_tokens(documents(spark, d), by_characters, 200, 50, 5)


# negatives by rank and visibility as bitmaps


@query(
    f"WITH {TRIPLES}, {VOCAB}, {MAPPED}, k AS (SELECT DISTINCT head_id, angle_bin FROM m), f AS (SELECT head_id, angle_bin, list(entity_id ORDER BY entity_id) AS free, count(*) AS c FROM k, v "
    "WHERE NOT EXISTS (SELECT 1 FROM m WHERE m.head_id = k.head_id AND m.angle_bin = k.angle_bin AND m.tail_id = v.entity_id) GROUP BY 1, 2), "
    "a AS (SELECT DISTINCT head_id, angle_bin, tail_id FROM m), n AS (SELECT *, unnest(range(0, least(4, c))) AS n FROM a JOIN f USING (head_id, angle_bin)), "
    "w AS (SELECT *, n * c // 4 AS start, (n + 1) * c // 4 - n * c // 4 AS width, (head_id * 48271 % 2147483647 + angle_bin * 8191 + tail_id * 131071 + n * 524287 + 42) % 2147483647 AS x FROM n) "
    "SELECT head_id, angle_bin, tail_id, n::INTEGER AS n, free[1 + CASE WHEN c <= 4 THEN n ELSE start + (x * 48271 % 2147483647) * 48271 % 2147483647 % width END] AS negative FROM w"
)
def complement_negatives(spark, d):
    """Four entities for each triple that aren't valid tails, by rank."""
    m = mapped(spark, d)
    return triples.complement_negatives(m, triples.entity_vocab(graphs.key_triples(spark, d)).count(), 4)


@query(f"{PVS_SQL} SELECT from_room, bin, count(*)::INTEGER AS n, list(to_room ORDER BY to_room) AS rooms FROM pvs GROUP BY ALL")
def pvs_bitmaps(spark, d):
    """Visibility as bitmaps, read back as lists."""
    return rooms.bitmap_rooms(rooms.visibility_bitmaps(rooms.compute_pvs(graphs.plain(graphs.nation_graph(spark, d)), SHALLOW)))


@query(f"{PVS_SQL} SELECT bin, count(DISTINCT to_room)::INTEGER AS n, list(DISTINCT to_room ORDER BY to_room) AS rooms FROM pvs GROUP BY 1")
def pvs_union(spark, d):
    """What any room sees, for each direction: the union of bitmaps."""
    maps = rooms.visibility_bitmaps(rooms.compute_pvs(graphs.plain(graphs.nation_graph(spark, d)), SHALLOW))
    return rooms.bitmap_rooms(rooms.seen_by_any(maps, "bin"), "bin")


CUT = PVS_SQL.replace("edges AS (", "uncut AS (", 1).replace(", sources AS (", f", edges AS (SELECT * FROM uncut WHERE NOT (src = 0 AND dst = {graphs.SPAN + 5})), sources AS (", 1)


@query(f"{CUT} SELECT from_room, bin, to_room FROM pvs")
def pvs_refreshed(spark, d):
    """Visibility kept up after an edge from region 0 to a nation is gone: only rooms that the change can reach are computed again."""
    before = graphs.plain(graphs.nation_graph(spark, d))
    pvs = rooms.compute_pvs(before, SHALLOW)
    return rooms.refresh_pvs(before, graphs.plain(graphs.nation_graph(spark, d).without_edge(0, graphs.SPAN + 5)), pvs, SHALLOW)[0]
