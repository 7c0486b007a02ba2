"""python -m lightgraph.cli process | train | evaluate | export | info"""

from __future__ import annotations

import argparse
import json

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from .logs import setup_logging
from .operators import kge, triples, vectors
from .params import TrainConfig
from .session import prepare
from .sources import binary, documents, tables
from .sources.triples import read_triples


def main(args: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(prog="lightgraph")
    commands = parser.add_subparsers(dest="command", required=True)
    process = commands.add_parser("process", help="chunk a folder of documents")
    process.add_argument("input")
    process.add_argument("output")
    process.add_argument("--size", type=int, default=512)
    process.add_argument("--overlap", type=int, default=50)
    process.add_argument("--least", type=int, default=50)
    train = commands.add_parser("train", help="train rotation embeddings on triples")
    train.add_argument("triples")
    train.add_argument("output")
    train.add_argument("--dim", type=int, default=64)
    train.add_argument("--epochs", type=int, default=10)
    evaluate = commands.add_parser("evaluate", help="link prediction of a trained model")
    evaluate.add_argument("triples")
    evaluate.add_argument("model")
    export = commands.add_parser("export", help="a trained model's entities as an .emb file")
    export.add_argument("model")
    export.add_argument("output")
    info = commands.add_parser("info", help="what an .emb file holds")
    info.add_argument("file")
    a = parser.parse_args(args)
    setup_logging()
    if a.command == "info":
        print(json.dumps(binary.emb_info(a.file)))
        return
    spark = prepare(SparkSession.builder.appName("lightgraph").getOrCreate())
    if a.command == "process":
        tables.write_chunks(documents.load_and_chunk(spark, a.input, a.size, a.overlap, least=a.least), a.output)
    elif a.command == "train":
        known = read_triples(spark, a.triples)
        vocab = triples.entity_vocab(known)
        model = kge.train_rotation(triples.map_triples(known, vocab), vocab.count(), TrainConfig(dim=a.dim, epochs=a.epochs), [kge.Log(), kge.EarlyStop()])
        kge.save_model(model, a.output)
        vocab.write.mode("overwrite").parquet(f"{a.output}/vocab")
    elif a.command == "evaluate":
        entities, phases = kge.load_model(spark, a.model)
        mapped = triples.map_triples(read_triples(spark, a.triples), spark.read.parquet(f"{a.model}/vocab"))
        print(json.dumps(kge.link_metrics(kge.link_ranks(mapped, entities, phases)).collect()[0].asDict()))
    elif a.command == "export":
        entities = kge.load_model(spark, a.model)[0]
        if not vectors.is_valid(entities):
            raise SystemExit("the embeddings hold values that are not finite")
        binary.write_emb(entities.select(F.col("node_id"), "embedding"), a.output)


if __name__ == "__main__":
    main()
