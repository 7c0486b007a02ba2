"""Quality classifier: two zstandard dictionaries, one of good and one of bad labelled text.

A text is cut into blocks; every block is compressed with both dictionaries. The normalised
differences of the summed sizes, (bad - good) / (bad + good) and log(raw / (bad + good)), which
repeated text drives up, go through a logistic curve fitted on labelled rows: each half of them is
measured with dictionaries of the other half, and the final dictionaries come from both.

Defined cases: a null or empty text has differences 0, so it scores the curve's value there; with
no labelled rows of one class every text scores 0.5; labels that contradict each other for one
doc_id, null ids and values other than 0 and 1 are not learned from; of several texts with one
labelled doc_id one is learned from; repeated rows are scored one
by one; an empty table gives an empty result; only doc_id and text of the documents are read.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialize
from .common import filter_batches, held_out, map_batches

#: Bytes a block; a dictionary then counts alike at the start and the end of a long text.
BLOCK = 2048
#: Most labelled rows a class that the fit reads, most blocks that build a dictionary, its bytes.
SAMPLE_ROWS, SAMPLE_BLOCKS, DICTIONARY = 4000, 3000, 112_640
LEVEL = 3


@dataclass(frozen=True)
class Model:
    """good and bad: dictionary bytes (empty: nothing learned); score = 1 / (1 + exp(-(weights . d + bias)))."""

    good: bytes
    bad: bytes
    weights: tuple[float, float]
    bias: float


def blocks(data: bytes) -> list[bytes]:
    return [data[i : i + BLOCK] for i in range(0, len(data), BLOCK)]


def dictionary(samples: list[bytes], size: int = DICTIONARY) -> bytes:
    """A trained dictionary; the samples themselves where they are too few to train on."""
    try:
        return zstandard.train_dictionary(size, samples, k=64, d=8).as_bytes()
    except zstandard.ZstdError:
        return b"".join(samples)[:size]


class Scorer:
    def __init__(self, model: Model) -> None:
        self.model, self.pair = model, []
        for raw in (model.good, model.bad):
            own = zstandard.ZstdCompressionDict(raw)
            own.precompute_compress(level=LEVEL)
            self.pair.append(zstandard.ZstdCompressor(dict_data=own, write_checksum=False, write_content_size=False, write_dict_id=False).compress)
        self.frame = [len(c(b"")) for c in self.pair]

    def differences(self, text: str | None) -> tuple[float, float]:
        if not text or not self.model.good or not self.model.bad:
            return 0.0, 0.0
        good, bad, data = 1, 1, text.encode()
        for block in blocks(data):  # less what a frame takes by itself, which would make short texts look alike
            good += len(self.pair[0](block)) - self.frame[0]
            bad += len(self.pair[1](block)) - self.frame[1]
        return (bad - good) / (bad + good), math.log(2 * len(data) / (bad + good))

    def scores(self, texts: list[str | None]) -> np.ndarray:
        d = np.array([self.differences(t) for t in texts]).reshape(-1, 2)
        return 1 / (1 + np.exp(-np.clip(d @ np.array(self.model.weights) + self.model.bias, -40, 40)))


def logistic(d: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[tuple[float, float], float]:
    """Weighted Platt curve by Newton steps, with a weak prior that keeps separable data finite."""
    scale = np.maximum(np.abs(d).max(0), 1e-9)
    x = np.hstack([d / scale, np.ones((len(d), 1))])
    w = np.zeros(3)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -40, 40)))
        gradient = x.T @ (weight * (y - p)) - 1e-3 * w
        hessian = (x * (weight * p * (1 - p) + 1e-9)[:, None]).T @ x + 1e-3 * np.eye(3)
        step = np.linalg.solve(hessian, gradient)
        w += np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-8:
            break
    return (float(w[0] / scale[0]), float(w[1] / scale[1])), float(w[2])


def fit(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS, most_blocks: int = SAMPLE_BLOCKS) -> Model:
    """Learn from labels whose doc_id is outside the held-out fold: at most `rows` documents of a class, by
    hash order. Half of them give the dictionaries' blocks, the other half the curve."""
    known = (
        labels.select(F.col("doc_id"), F.col("quality").alias("y")).where(F.col("doc_id").isNotNull() & F.col("y").isin(0, 1) & ~held_out("doc_id", 3, 1))
        .groupBy("doc_id").agg(F.min("y").alias("y"), F.max("y").alias("most")).where("y = most").select("doc_id", "y")
    )
    total = {r.y: r.n for r in known.groupBy("y").agg(F.count("*").alias("n")).collect()}
    # first a share of a class by hash, about twice the sample, so that no task sorts more
    share = lambda y: F.pmod(F.xxhash64(F.col("doc_id"), F.lit(19)), F.lit(1 << 30)) < int(min(1.0, (2 * rows + 100) / max(1, total.get(y, 0))) * (1 << 30))
    ordered = [known.where((F.col("y") == y) & share(y)).orderBy(F.xxhash64(F.col("doc_id"), F.lit(17)), "doc_id").limit(rows) for y in (0, 1)]
    few = F.broadcast(ordered[0].unionByName(ordered[1]))  # 2 * rows ids at most
    seen = docs.select("doc_id", F.col("text").cast("string").alias("text")).join(few, "doc_id").where("text is not null and text <> ''")
    # of several rows with one id the one whose text comes first by hash is learned from, so that one label stays one row
    seen = seen.groupBy("doc_id", "y").agg(F.min_by("text", F.struct(F.xxhash64("text"), F.length("text"))).alias("text"))
    seen = seen.withColumn("half", F.pmod(F.xxhash64(F.col("doc_id"), F.lit(23)), F.lit(2)))
    # 2 * rows documents at most, written so that the passes below don't read the whole table again
    seen = materialize(seen.select("text", "y", "half"), "quality-sample")

    def cut():
        def run(batch):
            out: tuple[list, list, list] = ([], [], [])
            for text, *row in zip(*(batch.column(c).to_pylist() for c in ("text", "y", "half")), strict=True):
                for b in blocks(text.encode()):
                    for to, v in zip(out, (*row, b), strict=True):
                        to.append(v)
            return out

        return run

    kinds = (F.col("y").cast("int").alias("y"), F.col("half").cast("int").alias("half"))
    pieces = map_batches(seen.select("text", *kinds), cut, "y int, half int, b binary").groupBy("b").agg(F.min(F.struct("y", "half")).alias("of")).select("b", "of.y", "of.half")
    samples: dict[tuple[int, int], list[bytes]] = {}
    for y in (0, 1):
        for half in (0, 1):
            some = pieces.where((F.col("y") == y) & (F.col("half") == half)).orderBy(F.xxhash64("b", F.lit(29)), "b").limit(most_blocks // 2)
            samples[y, half] = [bytes(r.b) for r in some.collect()]
    both = {y: samples[y, 0] + samples[y, 1] for y in (0, 1)}
    if not both[0] or not both[1]:
        return Model(b"", b"", (0.0, 0.0), 0.0)
    model = Model(dictionary(both[1]), dictionary(both[0]), (1.0, 0.0), 0.0)
    other = [Model(dictionary(samples[1, 1 - h] or both[1]), dictionary(samples[0, 1 - h] or both[0]), (1.0, 0.0), 0.0) for h in (0, 1)]

    def measure():
        own = [Scorer(m) for m in other]
        return lambda batch: [*zip(*(own[h].differences(t) for t, h in zip(batch.column("text").to_pylist(), batch.column("half").to_pylist(), strict=True)), strict=True), batch.column("y")]

    points = map_batches(seen.select("text", *kinds), measure, "d double, r double, y int").toArrow()
    d, y = np.stack([points.column("d").to_numpy(), points.column("r").to_numpy()], 1), points.column("y").to_numpy()
    if len(set(y.tolist())) < 2:
        return Model(model.good, model.bad, (20.0, 0.0), 0.0)
    weight = np.where(y == 1, total[1] / max(1, (y == 1).sum()), total[0] / max(1, (y == 0).sum()))
    weights, bias = logistic(d, y.astype(float), weight * len(y) / weight.sum())
    return Model(model.good, model.bad, weights, bias)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, score, predicted for every document."""

    def make():
        own = Scorer(model)

        def run(batch):
            s = own.scores(batch.column("text").to_pylist())
            return [batch.column("doc_id"), batch.column("held_out"), s, (s >= 0.5).astype(np.int32)]

        return run

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), held_out("doc_id", 3, 1).alias("held_out"))
    return map_batches(rows, make, "doc_id long, held_out boolean, score double, predicted int")


def keep(docs: DataFrame, model: Model, least: float = 0.5) -> DataFrame:
    """The documents that score at least `least`, with all their columns."""

    def make():
        own = Scorer(model)
        return lambda batch: (own.scores(batch.column("text").to_pylist()) >= least).tolist()

    return filter_batches(docs, make)
