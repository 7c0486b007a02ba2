import json
import struct

import numpy as np
import pytest

from lightgraph.operators import rooms
from lightgraph.operators.graph import Graph
from lightgraph.params import GraphError
from lightgraph.sources import binary, documents, tables
from lightgraph.sources.triples import read_triples


def vectors(spark, n=9, dim=3):
    return spark.createDataFrame([(i, [float(i + j) for j in range(dim)]) for i in range(n)], "node_id long, embedding array<double>")


@pytest.mark.parametrize("header", [False, True])
def test_emb(spark, tmp_path, header):
    path = str(tmp_path / "x.emb")
    binary.write_emb(vectors(spark), path, normalize=False, header=header)
    assert binary.emb_info(path, header)["num_nodes"] == 9
    got = binary.read_emb(spark, path, header)
    assert [tuple(r.embedding) for r in got.orderBy("node_id").collect()] == [(i, i + 1.0, i + 2.0) for i in range(9)]
    binary.write_emb(vectors(spark), path)
    assert all(abs(np.linalg.norm(r.embedding) - 1) < 1e-6 for r in binary.read_emb(spark, path).collect())


def test_emb_errors(spark, tmp_path):
    path = str(tmp_path / "x.emb")
    with pytest.raises(GraphError):
        binary.write_emb(vectors(spark, 0), path)
    (tmp_path / "short.emb").write_bytes(struct.pack("<II", 5, 4) + b"\0" * 12)
    with pytest.raises(GraphError):
        binary.emb_info(str(tmp_path / "short.emb"))
    with pytest.raises(GraphError):
        binary.emb_info(str(tmp_path / "short.emb"), True)


def small(spark):
    nodes = spark.createDataFrame([(i, 1.0 + i, i % 2) for i in range(4)], "node_id long, luminance double, room int")
    edges = spark.createDataFrame([(0, 1, 0, 0.25, 3), (0, 2, 1, 0.5, 4), (2, 3, 0, 0.125, 15)], "src long, dst long, pos int, attenuation double, bin int")
    return rooms.mark_portals(Graph.of(nodes, edges))


def test_level_files(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(binary, "ROWS", 3)
    path, graph = str(tmp_path / "x.lvl"), small(spark)
    binary.write_level(graph, path)
    back, summary = binary.read_level(spark, path)
    key = lambda df, *c: sorted(map(tuple, df.select(*c).collect()))
    assert key(back.edges, *graph.edges.columns) == key(graph.edges, *graph.edges.columns)
    names = ("node_id", "luminance", "reflection", "refraction", "default_bin", "room")
    assert key(back.nodes, *names) == key(graph.nodes, *names)
    assert key(summary, "room", "node_start", "node_count") == [(0, 0, 2), (1, 2, 2)]
    data = bytearray((tmp_path / "x.lvl").read_bytes())
    at = binary.level_header(path)["rooms_at"]
    data[at + 8] = 5  # the first room's start; the nodes' rooms stay as they are
    (tmp_path / "z.lvl").write_bytes(data)
    assert key(binary.read_level(spark, str(tmp_path / "z.lvl"))[1], "room", "node_start", "node_count") == [(0, 5, 2), (1, 2, 2)]
    data[at] = 3
    (tmp_path / "w.lvl").write_bytes(data)
    with pytest.raises(GraphError):
        binary.read_level(spark, str(tmp_path / "w.lvl"))
    data = bytearray((tmp_path / "x.lvl").read_bytes())
    data[4] = 9
    (tmp_path / "y.lvl").write_bytes(data)
    with pytest.raises(GraphError):
        binary.level_header(str(tmp_path / "y.lvl"))


def test_tables(spark, tmp_path):
    graph, path = small(spark), str(tmp_path / "g")
    pvs = rooms.compute_pvs(graph)
    tables.write_graph(graph, path, pvs)
    back = tables.read_graph(spark, path)
    assert back.nodes.exceptAll(graph.nodes).count() == 0 and back.edges.exceptAll(graph.edges).count() == 0
    assert tables.read_pvs(spark, path).exceptAll(pvs).count() == 0
    tables.write_csv(vectors(spark, 2), str(tmp_path / "csv"))
    assert [r.value for r in spark.read.text(str(tmp_path / "csv")).collect()] == ["0.000000,1.000000,2.000000", "1.000000,2.000000,3.000000"]


def test_csv_rounds_ties_to_even(spark):
    """As C's printf does, from the exact binary value; nulls are left out."""
    rows = [(0, [-0.0703125, 0.0078125, 0.0234375]), (1, [0.1234565, 5e-7, -1e-9]), (2, [1.0, None, float("nan")]), (3, []), (4, None), (5, [1e22, float("inf"), 123456789.0078125])]
    got = {r.node_id: r.line for r in tables.csv_lines(spark.createDataFrame(rows, "node_id long, embedding array<double>")).collect()}
    assert got == {
        0: "-0.070312,0.007812,0.023438", 1: "0.123456,0.000000,-0.000000", 2: "1.000000,nan", 3: "", 4: None, 5: "10000000000000000000000.000000,inf,123456789.007812",
    }
    one = spark.createDataFrame([(0, [-0.0703125])], "node_id long, embedding array<float>")
    assert tables.csv_lines(one).collect()[0].line == "-0.070312"


def test_triples(spark, tmp_path):
    rows = [("a", "is_a", "b"), ("c", "requires", "d")]
    files = {
        "h.csv": "head,relation,tail\na,is_a,b\nc , requires, d\n", "n.csv": "a,is_a,b\nc,requires,d,more\nx,y\n", "o.json": json.dumps([{"head": "a", "relation": "is_a", "tail": "b"}, {"subject": "c", "predicate": "requires", "object": "d"}]),
        "l.json": json.dumps([["a", "is_a", "b"], ["c", "requires", "d"]]), "s.txt": json.dumps([{"h": "a", "r": "is_a", "t": "b"}, {"h": "c", "r": "requires", "t": "d"}]), "c.txt": "a,is_a,b\nc,requires,d\n",
    }
    for name, body in files.items():
        (tmp_path / name).write_text(body)
        assert sorted(map(tuple, read_triples(spark, str(tmp_path / name)).collect())) == rows, name


def test_documents(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "a.txt").write_text("alpha")
    (tmp_path / "in" / "b.md").write_bytes("é".encode("latin-1"))
    (tmp_path / "c.html").write_text("<p>x &amp; y &eacute;</p><script>z</script>")
    (tmp_path / "d.xyz").write_text("no")
    got = {r.metadata["filename"]: r for r in documents.load_directory(spark, str(tmp_path)).collect()}
    assert {k: v.content for k, v in got.items()} == {"a.txt": "alpha", "b.md": "é", "c.html": "x & y é"}
    assert got["a.txt"].document_id == "2c1743a391305fbf367df8e4f069f9f9"[:12] and got["a.txt"].metadata["extension"] == ".txt"
    assert documents.load_directory(spark, str(tmp_path), recursive=False).count() == 2
    assert documents.load_and_chunk(spark, str(tmp_path), 5, 1, least=1).count() == 3


def test_chunks_and_vocabulary(spark, tmp_path):
    chunks = spark.createDataFrame([("t", 0, "d", 0, 1, {"k": "v"})], "text string, chunk_id int, document_id string, start_char int, end_char int, metadata map<string,string>")
    tables.write_chunks(chunks, str(tmp_path / "chunks"))
    assert tables.read_chunks(spark, str(tmp_path / "chunks")).collect() == chunks.collect()
    vocab = spark.createDataFrame([("a", 0), ("b", 1)], "entity string, entity_id long")
    (tmp_path / "v.json").write_text(tables.vocab_json(vocab).collect()[0].json)
    assert {tuple(r) for r in tables.read_vocab_json(spark, str(tmp_path / "v.json")).collect()} == {("a", 0), ("b", 1)}


def test_chunks_of_both_forms(spark, tmp_path):
    """Many rows and files, lines and arrays (on one line and on many), together and apart."""
    chunks = spark.range(90).selectExpr("concat('[', id, ']') AS text", "cast(id AS int) AS chunk_id", "concat('d', id % 7) AS document_id", "0 AS start_char", "3 AS end_char", "map('k', concat('{', id)) AS metadata")
    rows = lambda df: sorted((r.chunk_id, r.text, r.document_id, r.metadata["k"]) for r in df.collect())
    lines, mixed = tmp_path / "some lines", tmp_path / "both"
    tables.write_chunks(chunks.repartition(5), str(lines))
    assert rows(tables.read_chunks(spark, str(lines))) == rows(chunks)
    mixed.mkdir()
    objects = [json.loads(r.j) for r in chunks.orderBy("chunk_id").selectExpr("to_json(struct(*)) AS j").collect()]
    (mixed / "a b.json").write_text(json.dumps(objects[:30], indent=2))
    (mixed / "c.json").write_text("  " + json.dumps(objects[30:50]))
    assert rows(tables.read_chunks(spark, str(mixed))) == rows(chunks.where("chunk_id < 50"))
    (mixed / "d.json").write_text("\n".join(map(json.dumps, objects[50:])))
    assert rows(tables.read_chunks(spark, str(mixed))) == rows(chunks)


def test_command_line(spark, tmp_path, capsys):
    from lightgraph import cli

    (tmp_path / "t.csv").write_text("head,relation,tail\n" + "".join(f"n{i},is_a,n{(i + 1) % 6}\n" for i in range(6)))
    cli.main(["train", str(tmp_path / "t.csv"), str(tmp_path / "m"), "--dim", "8", "--epochs", "2"])
    cli.main(["evaluate", str(tmp_path / "t.csv"), str(tmp_path / "m")])
    assert 0 < json.loads(capsys.readouterr().out.strip().splitlines()[-1])["mrr"] <= 1
    cli.main(["export", str(tmp_path / "m"), str(tmp_path / "m.emb")])
    cli.main(["info", str(tmp_path / "m.emb")])
    assert json.loads(capsys.readouterr().out.strip().splitlines()[-1])["num_nodes"] == 6
