"""Language identification by hierarchical discrimination.

Features are square-rooted, normalised counts of hashed byte n-grams of the lower-cased text. A
linear support vector machine for each family predicts the family first; inside it, one-versus-one
linear machines separate the related languages by votes, ties by margins. Platt curves fitted on
vectors that trained no machine turn margins into the score: family's share times the least of
the winner's pair probabilities.

Defined cases: a null text or one without a letter is `und` with score 0, as is every text when
nothing could be learned; a null lang is not learned from; repeated rows are predicted one by
one; an empty table gives an empty result; only doc_id, text and lang are read.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import filter_batches, held_out, map_batches

# Branches of language families by ISO 639-1 code. A code that is not here is a family of its own.
FAMILIES = {
    "germanic": "en de nl sv da no nb nn is af fy lb yi",
    "romance": "fr es it pt ro ca gl oc co",
    "slavic": "ru uk be pl cs sk sl hr sr bs bg mk",
    "baltic": "lt lv",
    "celtic": "ga gd cy br",
    "uralic": "fi et hu",
    "turkic": "tr az kk ky uz tk tt",
    "indic": "hi bn pa gu mr ne ur si or as",
    "iranian": "fa ps ku tg",
    "semitic": "ar he am mt",
    "dravidian": "ta te kn ml",
    "austronesian": "id ms jv su tl mg",
}
FAMILY_OF = {code: family for family, codes in FAMILIES.items() for code in codes.split()}

UNKNOWN = "und"
DIM = 4096
#: Documents that train all languages, dealt evenly, and the least for each, however many languages there are.
TRAIN_DOCS, LEAST_DOCS = 1600, 12
#: Characters of the snippets that join each training document, so that short texts are learned too.
SNIPPETS = (24, 80, 240)
#: ASCII bytes other than letters become spaces.
LETTERS = bytes(c if c >= 128 or 97 <= c <= 122 else 32 for c in range(256))


def features(texts: list[str]) -> np.ndarray:
    """A row of DIM float32 for each text: n-grams of 1 to 4 bytes, counted over the whole text."""
    out = np.zeros((len(texts), DIM), np.float32)
    for row, text in zip(out, texts, strict=True):
        data = np.frombuffer((" " + text.lower() + " ").encode().translate(LETTERS), np.uint8)
        for at in range(0, len(data), 1 << 20):  # in pieces, three bytes of overlap: bounded memory
            code = part = data[at : at + (1 << 20) + 3].astype(np.uint32)
            for n in range(1, 5):
                row += np.bincount((code * np.uint32(2654435761) + np.uint32(n * 40503)) >> np.uint32(20), minlength=DIM)
                if len(part) <= n:
                    break
                code = code[:-1] * np.uint32(16777619) ^ part[n:]
        np.sqrt(row, out=row)
        row /= np.linalg.norm(row)
    return out


def has_letter(text: str | None) -> bool:
    return bool(text) and any(map(str.isalpha, text))


@dataclass
class Model:
    """families[i] has languages members[i]; machine rows end in the bias; curves are (slope, bias) of Platt."""

    families: list[str] = field(default_factory=list)
    members: list[list[str]] = field(default_factory=list)
    family_machines: np.ndarray = field(default_factory=lambda: np.zeros((0, DIM + 1), np.float32))
    family_curves: list[tuple[float, float]] = field(default_factory=list)
    pairs: list[tuple[int, str, str]] = field(default_factory=list)
    pair_machines: np.ndarray = field(default_factory=lambda: np.zeros((0, DIM + 1), np.float32))
    pair_curves: list[tuple[float, float]] = field(default_factory=list)

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        langs, scores = [UNKNOWN] * len(texts), [0.0] * len(texts)
        able = [i for i, t in enumerate(texts) if self.families and has_letter(t)]
        for s in range(0, len(able), 256):
            some = able[s : s + 256]
            x = features([texts[i] for i in some])
            family = _curve(_margins(x, self.family_machines), self.family_curves) if len(self.families) > 1 else np.ones((len(some), 1))
            pair = _margins(x, self.pair_machines)
            chance = _curve(pair, self.pair_curves)
            share = family / np.maximum(family.sum(1, keepdims=True), 1e-12)
            for row, i in enumerate(some):
                f = int(family[row].argmax())
                langs[i], least = self._within(f, pair[row], chance[row])
                scores[i] = float(share[row, f] * least)
        return langs, scores

    def _within(self, family: int, margin: np.ndarray, chance: np.ndarray) -> tuple[str, float]:
        members = self.members[family]
        votes = {m: [0, 0.0, 1.0] for m in members}
        for k, (f, a, b) in enumerate(self.pairs):
            if f == family:
                won = a if margin[k] >= 0 else b
                votes[won][0] += 1
                votes[a][1] += margin[k]
                votes[b][1] -= margin[k]
                votes[a][2] = min(votes[a][2], chance[k])
                votes[b][2] = min(votes[b][2], 1 - chance[k])
        best = max(members, key=lambda m: (votes[m][0], votes[m][1]))
        return best, float(votes[best][2])


def _margins(x: np.ndarray, machines: np.ndarray) -> np.ndarray:
    return x @ machines[:, :-1].T + machines[:, -1]


def _curve(margins: np.ndarray, curves: list[tuple[float, float]]) -> np.ndarray:
    c = np.array(curves, float).reshape(-1, 2)
    return 1 / (1 + np.exp(-np.clip(margins * c[:, 0] + c[:, 1], -40, 40)))


def machine(x: np.ndarray, y: np.ndarray, regularization: float = 1e-3, rounds: int = 120) -> np.ndarray:
    """A linear support vector machine (squared hinge, classes weighted alike) by accelerated gradients; y is 1 or -1, and 0
    for rows that take no part, so that no subset of x is copied. The last weight is the bias."""
    weight = np.where(y > 0, 0.5 / max(1, (y > 0).sum()), np.where(y < 0, 0.5 / max(1, (y < 0).sum()), 0.0)).astype(np.float32)
    w = last = np.zeros(x.shape[1] + 1, np.float32)
    step = 1 / (4 + regularization)
    for n in range(rounds):
        ahead = w + np.float32(n / (n + 3)) * (w - last)
        pull = 2 * weight * y * np.maximum(0, 1 - y * (x @ ahead[:-1] + ahead[-1]))
        last, w = w, ahead - np.float32(step) * (np.float32(regularization) * ahead - np.append(pull @ x, pull.sum()))
    return w.astype(np.float32)


def platt(margin: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and bias of a logistic curve, by Newton steps with a weak prior."""
    x, target, w = np.stack([margin, np.ones_like(margin)], 1).astype(float), (y > 0).astype(float), np.array([1.0, 0.0])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -40, 40)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + 0.1 * np.eye(2), x.T @ (target - p) - 0.1 * w)
        w += np.clip(step, -3, 3)
    return float(max(w[0], 1e-3)), float(w[1])


def _trained(x: np.ndarray, y: np.ndarray, apart: np.ndarray) -> tuple[np.ndarray, tuple[float, float]]:
    """A machine from the rows not set apart, its curve from those that are; rows of y 0 take no part."""
    w = machine(x, np.where(apart, 0, y).astype(np.float32))
    test = apart & (y != 0)
    if len(set(y[test].tolist())) < 2:
        return w, (3.0, 0.0)
    return w, platt((x @ w[:-1] + w[-1])[test], y[test])


def fit(docs: DataFrame, train_docs: int = TRAIN_DOCS) -> Model:
    """Learn from text and lang outside the held-out fold: at most `train_docs` documents (LEAST_DOCS a language at least),
    dealt evenly to all languages, chosen by a hash of the id."""
    known = docs.select(F.col("doc_id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang")).where(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out("doc_id", 4, 2))
    total = {r.lang: r.n for r in known.groupBy("lang").agg(F.count("*").alias("n")).collect()}  # a row a language
    if not total:
        return Model()
    each = max(LEAST_DOCS, train_docs // len(total))
    draw = F.pmod(F.xxhash64(F.col("doc_id"), F.lit(41)), F.lit(1 << 30))
    chance = known.sparkSession.createDataFrame([(k, int(min(1.0, 3 * each / n + 20 / n) * (1 << 30))) for k, n in total.items()], "lang string, below long")
    drawn = known.join(F.broadcast(chance), "lang").withColumn("draw", draw).where("draw < below")
    few = drawn.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy("draw", "doc_id", F.length("text")))).where(F.col("rank") <= each)

    def make():
        def run(batch):
            out: tuple[list, list, list] = ([], [], [])
            for text, lang, draw in zip(*(batch.column(c).to_pylist() for c in ("text", "lang", "draw")), strict=True):
                if has_letter(text):
                    cuts = [text] + [text[s : s + n] for n in SNIPPETS if len(text) > n for s in [draw % (len(text) - n)]]
                    cuts = [c for c in cuts if has_letter(c)]
                    for to, v in zip(out, ([lang] * len(cuts), [draw] * len(cuts), [v.tobytes() for v in features(cuts).astype(np.float16)]), strict=True):
                        to.extend(v)
            return out

        return run

    got = map_batches(few.select("text", "lang", "draw"), make, "lang string, draw long, vector binary").toArrow()
    if not got.num_rows:
        return Model()
    lang = np.array(got.column("lang").to_pylist(), object)
    x = np.empty((len(lang), DIM), np.float32)
    for row, vector in zip(x, got.column("vector"), strict=True):
        row[:] = np.frombuffer(vector.as_py(), np.float16)
    apart = got.column("draw").to_numpy() // 8 % 5 == 0
    del got
    langs = sorted(set(lang.tolist()))
    family_of = np.array([FAMILY_OF.get(c, c) for c in lang], object)
    model = Model(families=sorted({FAMILY_OF.get(c, c) for c in langs}))
    model.members = [[c for c in langs if FAMILY_OF.get(c, c) == f] for f in model.families]
    machines = []
    if len(model.families) > 1:
        for f in model.families:
            w, c = _trained(x, np.where(family_of == f, 1, -1).astype(np.float32), apart)
            machines.append(w)
            model.family_curves.append(c)
        model.family_machines = np.stack(machines)
    machines = []
    for k, members in enumerate(model.members):
        for n, a in enumerate(members):
            for b in members[n + 1 :]:
                w, c = _trained(x, np.where(lang == a, 1, np.where(lang == b, -1, 0)).astype(np.float32), apart)
                machines.append(w)
                model.pairs.append((k, a, b))
                model.pair_curves.append(c)
    if machines:
        model.pair_machines = np.stack(machines)
    return model


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, lang_pred, score for every document."""

    def make():
        def run(batch):
            return [batch.column("doc_id"), batch.column("held_out"), *model.predict(batch.column("text").to_pylist())]

        return run

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), held_out("doc_id", 4, 2).alias("held_out"))
    return map_batches(rows, make, "doc_id long, held_out boolean, lang_pred string, score double")


def keep(docs: DataFrame, model: Model, least: float = 0.3) -> DataFrame:
    """The documents whose language is told with a score of `least` or more, with all their columns."""

    def make():
        def run(batch):
            langs, scores = model.predict(batch.column("text").to_pylist())
            return [la != UNKNOWN and s >= least for la, s in zip(langs, scores, strict=True)]

        return run

    return filter_batches(docs, make)
