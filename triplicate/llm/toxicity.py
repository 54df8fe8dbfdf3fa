"""Toxic texts by a support vector machine over a subsequence string kernel with Nyström landmarks.

The kernel of two words counts their common subsequences of ``LENGTH`` letters, each gap letter costing a factor of
``DECAY``, so an insult with letters put in or left apart stays close to the plain one. A text is scored by the words
in it (and by runs of single letters, which may be a word spelled apart): the machine gives each a margin, and the
largest margins together with the text's greatest closeness to each landmark give its score.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from triplicate.llm.common import map_batches, plainly_named, prepare, table, texts

#: Labelled documents to learn from at most, of each label; drawn by a hash of doc_id.
SAMPLE = 1000
#: Landmark words that toxic documents set apart, and common ones of other documents.
LANDMARKS = (32, 8)
LENGTH, DECAY = 3, 0.8
#: Letters compared at once; longer words are learned from and scored in overlapping stretches.
STRETCH = 20
TOP = 3
_KEPT = 150_000
_EDGES = "".join(chr(c) for c in range(33, 127) if not chr(c).isalnum()) + "¡¿«»„“”‘’…"
#: Three or more single letters in a row, and the cheap sign that there may be some.
_APART = re.compile(r"(?<!\S)[^\W\d_](?:\s{1,2}[^\W\d_](?!\S)){2,}")
_APART_HINT = re.compile(r"\s[^\W\d_]\s{1,2}[^\W\d_](?!\S)")
_FILL = re.compile(r"[\W_]+")


def stretches_of(word: str) -> list[str]:
    """A word, or, where it is longer than ``STRETCH``, stretches of it that overlap by half and leave no letter out."""
    if len(word) <= STRETCH:
        return [word]
    return [word[at : at + STRETCH] for at in range(0, len(word) - STRETCH // 2, STRETCH // 2)]


def words(text: str) -> set[str]:
    """The distinct words of a text in lower case, without marks around and inside, and what runs of single letters spell.

    Long words go in as their stretches.
    """
    lower = text.lower()
    found = set()
    for w in set(lower.split()):
        if not w.isalpha():
            w = w.strip(_EDGES)
            if not w.isalnum():
                found.add(_FILL.sub("", w))
        found.add(w)
    if len(lower) < 20 or _APART_HINT.search(lower):
        found.update(_FILL.sub("", m[0]) for m in _APART.finditer(lower))
    found.discard("")
    for w in [w for w in found if len(w) > STRETCH]:
        found.remove(w)
        found.update(stretches_of(w))
    return found


def _letters(stretches: list[str]) -> np.ndarray:
    """Code points, a stretch to a column, zero past its end."""
    width = max(LENGTH, max(map(len, stretches), default=0))
    padded = "".join(s.ljust(width, "\0") for s in stretches)
    return np.ascontiguousarray(np.frombuffer(padded.encode("utf-32-le"), "<u4").reshape(-1, width).T)


def kernel(stretches: list[str], landmarks: list[str]) -> np.ndarray:
    """The subsequence kernel of each stretch with each landmark, by dynamic programming over all stretches at once.

    A state is, for each place in a stretch, the weight of common subsequences that end before it; it depends on a
    landmark's beginning alone, so landmarks that begin alike share it.
    """
    letters = _letters(stretches)
    width = len(letters)
    d = np.float32(DECAY)
    gaps = np.tril(DECAY ** np.abs(np.subtract.outer(np.arange(width), np.arange(width)))).astype(np.float32)
    hits = {c: (letters == ord(c)).astype(np.float32) for c in set("".join(landmarks))}
    singles = {c: gaps @ h * (d * d) for c, h in hits.items()}
    zero = np.zeros((width, len(stretches)), np.float32)
    path: list[tuple] = [(zero, zero, np.zeros(len(stretches), np.float32))]
    out = np.zeros((len(stretches), len(landmarks)))
    before = ""
    for k in sorted(range(len(landmarks)), key=landmarks.__getitem__):
        landmark = landmarks[k]
        shared = next((i for i, (a, b) in enumerate(zip(before, landmark, strict=False)) if a != b), min(len(before), len(landmark)))
        del path[shared + 1 :]
        for c in landmark[shared:]:
            one, two, total = path[-1]
            total = total + np.einsum("ij,ij->j", hits[c][1:], two[:-1]) * (d * d)
            pairs = hits[c].copy()
            pairs[0] = 0
            pairs[1:] *= one[:-1]
            path.append((one * d + singles[c], two * d + (gaps * (d * d)) @ pairs, total))
        out[:, k] = path[-1][2]
        before = landmark
    return out


def _own(stretches: list[str]) -> np.ndarray:
    """Each stretch's kernel with itself."""
    letters = _letters(stretches)
    width, n = letters.shape
    d = np.float32(DECAY)
    same = ((letters[:, None] == letters[None]) & (letters != 0)[:, None]).astype(np.float32) * (d * d)
    step = same
    for _ in range(LENGTH - 1):
        inner = np.zeros((width + 1, width + 1, n), np.float32)
        for i in range(1, width + 1):
            run = np.zeros(n, np.float32)
            for j in range(1, width + 1):
                run = d * run + step[i - 1, j - 1]
                inner[i, j] = run + d * inner[i - 1, j]
        step = same * inner[:-1, :-1]
    return step.sum((0, 1), dtype=np.float64)


@dataclass
class Model:
    landmarks: list[str]
    #: From kernel values with the landmarks, normalized, to the margin.
    weights: np.ndarray
    bias: float
    #: From what :func:`_pooled` tells of a text to its score.
    scale: np.ndarray
    offset: float

    def points(self, found: list[str]) -> np.ndarray:
        """A row for each word: its closeness to every landmark and, last, its margin."""
        near = features(found, self.landmarks)
        return np.hstack([near, np.maximum(near @ self.weights + self.bias, _FLOOR)[:, None]])

    def score(self, pooled: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(pooled @ self.scale + self.offset, -40, 40)))


#: The margin of a text's missing words.
_FLOOR = -2.0


def _pooled(points: np.ndarray) -> np.ndarray:
    """A text by its words' points: the greatest closeness to each landmark, cubed so that near misses count little, and
    the ``TOP`` largest margins, largest first."""
    out = np.zeros(points.shape[1] - 1 + TOP)
    out[-TOP:] = _FLOOR
    if len(points):
        out[:-TOP] = points[:, :-1].max(0) ** 3
        top = np.sort(points[:, -1])[::-1][:TOP]
        out[-TOP : len(out) - TOP + len(top)] = top
    return out


def features(stretches: list[str], landmarks: list[str]) -> np.ndarray:
    """Kernel values, normalized by what both have with themselves; stretches of about one length go together."""
    out = np.zeros((len(stretches), len(landmarks)))
    own = np.sqrt(_own(landmarks))
    order = sorted(range(len(stretches)), key=lambda k: len(stretches[k]))
    for a in range(0, len(order), 1024):
        these = order[a : a + 1024]
        part = [stretches[k] for k in these]
        out[these] = kernel(part, landmarks) / np.sqrt(np.maximum(_own(part), 1e-12))[:, None] / own
    return out


def _squared_hinge(x: np.ndarray, y: np.ndarray, cost: np.ndarray, ridge: float) -> np.ndarray:
    """Weights, the last one the bias, of a linear machine with squared hinge loss, by Newton's method."""
    x = np.hstack([x, np.ones((len(x), 1))])
    w = np.zeros(x.shape[1])

    def loss(w: np.ndarray) -> float:
        return float(ridge / 2 * w @ w + (cost * np.maximum(0, 1 - y * (x @ w)) ** 2).sum())

    for _ in range(100):
        gap = 1 - y * (x @ w)
        on = gap > 0
        gradient = ridge * w - 2 * x[on].T @ (cost[on] * y[on] * gap[on])
        step = np.linalg.solve(ridge * np.eye(len(w)) + 2 * (x[on] * cost[on, None]).T @ x[on], gradient)
        size, now = 1.0, loss(w)
        while size > 1e-4 and loss(w - size * step) > now - 1e-4 * size * float(gradient @ step):
            size /= 2
        w = w - size * step
        if np.abs(size * step).max() < 1e-6:
            break
    return w


def _logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 1e-2) -> np.ndarray:
    x = np.hstack([x, np.ones((len(x), 1))])
    w = np.zeros(x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -40, 40)))
        gradient = x.T @ (weight * (p - y)) + ridge * w
        step = np.linalg.solve((x * (weight * p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w)), gradient)
        w -= np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-8:
            break
    return w


def fit(docs: list[set[str]], toxic: list[int], share: float) -> Model:
    """Learn from documents, given as their words, and their labels; ``share`` is that of label 1 where they come from.

    Landmarks are the words that set toxic documents apart most, so far as they are unlike one another, and common
    words of the others. Which words make a document toxic isn't labelled: at first all that are set apart count,
    then, in turns, the one of largest margin and those near it; words of other documents never do. Without both
    labels the score is the share of label 1.
    """
    y = np.array(toxic, float)
    if not 0 < y.sum() < len(y):
        return Model(["aaa"], np.zeros(1), _FLOOR, np.zeros(1 + TOP), math.log((share + 1e-3) / (1 + 1e-3 - share)))
    counts = (Counter(), Counter())
    for found, label in zip(docs, toxic, strict=True):
        counts[label].update(w for w in found if len(w) >= LENGTH)
    sizes = [max(1.0, float((y == k).sum())) for k in (0, 1)]

    def apart(w: str) -> float:
        a, b = counts[1][w] / sizes[1], counts[0][w] / sizes[0]
        return (a - b) / math.sqrt((a + b) / 2 * (1 / sizes[0] + 1 / sizes[1]) + 1e-12)

    ranked = sorted((w for w, c in counts[1].items() if c >= 3), key=lambda w: (-apart(w), w))[:600]
    ranked = [w for w in ranked if apart(w) > 2.5] or ranked[: LANDMARKS[0]] or sorted(counts[1])[:1] or ["aaa"]
    landmarks: list[str] = []
    for w in ranked:
        if len(landmarks) < LANDMARKS[0] and (not landmarks or features([w], landmarks).max() < 0.45):
            landmarks.append(w)
    common = [w for w, _ in sorted(counts[0].items(), key=lambda c: (-c[1], c[0]))[:400]]
    landmarks += common[:: max(1, len(common) // LANDMARKS[1])][: LANDMARKS[1]]
    landmarks = list(dict.fromkeys(landmarks))

    # Nyström: coordinates in which the inner product of words is the kernel's projection on the landmarks.
    values, vectors = np.linalg.eigh(features(landmarks, landmarks))
    good = values > 1e-6 * values.max()
    whiten = vectors[:, good] / np.sqrt(values[good])

    vocabulary = sorted({w for found in docs for w in found if len(w) >= LENGTH})
    index = {w: k for k, w in enumerate(vocabulary)}
    near = features(vocabulary, landmarks)
    points = near @ whiten
    clean = np.array(sorted({index[w] for found, label in zip(docs, toxic, strict=True) if not label for w in found if w in index}), int)
    bags = [np.array(sorted(index[w] for w in found if w in index), int) for found, label in zip(docs, toxic, strict=True) if label]
    seeds = {index[w] for w in ranked if counts[0][w] / sizes[0] <= 0.1 * counts[1][w] / sizes[1]}
    chosen = seeds
    w = np.zeros(points.shape[1] + 1)
    w[-1] = _FLOOR
    for turn in range(3):
        if turn:
            margin = points @ w[:-1] + w[-1]
            chosen = seeds | {int(k) for bag in bags for k in bag[margin[bag] >= 0]} - set(clean.tolist())
        positive = np.array(sorted(chosen), int)
        negative = np.setdiff1d(clean, positive)
        if not len(positive) or not len(negative):
            break
        x = points[np.concatenate((positive, negative))]
        t = np.concatenate((np.ones(len(positive)), -np.ones(len(negative))))
        heavy = np.array([counts[1][vocabulary[k]] for k in positive], float)
        cost = np.concatenate((heavy / heavy.sum(), np.full(len(negative), 40 / len(negative))))
        w = _squared_hinge(x, t, cost, 1e-5)
    model = Model(landmarks, whiten @ w[:-1], float(w[-1]), np.zeros(0), 0.0)
    margin = np.maximum(points @ w[:-1] + w[-1], _FLOOR)
    of_word = np.hstack([near, margin[:, None]])
    texts_ = np.array([_pooled(of_word[[index[v] for v in found if v in index]]) for found in docs])
    s = _logistic(texts_, y, np.where(y == 1, share / y.sum(), (1 - share) / (1 - y).sum()) * len(y), 0.1)
    model.scale, model.offset = s[:-1], float(s[-1])
    return model


class Scorer:
    """Scores texts with a model; the points of words met lately are kept, at most ``_KEPT`` or a batch's."""

    def __init__(self, model: Model) -> None:
        self.model = model
        self.row: dict[str, int] = {}
        self.points = np.zeros((_KEPT, len(model.landmarks) + 1), np.float32)

    def score(self, batch: list[str]) -> np.ndarray:
        bags = [[w for w in words(t) if len(w) >= LENGTH] for t in batch]
        new = list({w for bag in bags for w in bag if w not in self.row})
        if len(self.row) + len(new) > len(self.points):
            self.row.clear()
            new = list({w for bag in bags for w in bag})
            if len(new) > len(self.points):
                self.points = np.zeros((len(new), self.points.shape[1]), np.float32)
        if new:
            first = len(self.row)
            self.row.update(zip(new, range(first, first + len(new)), strict=True))
            self.points[first : first + len(new)] = self.model.points(new)
        row = self.row
        pooled = [_pooled(self.points[np.fromiter(map(row.__getitem__, bag), np.int64, len(bag))]) for bag in bags]
        return self.model.score(np.array(pooled).reshape(len(batch), -1)) if batch else np.zeros(0)


def _bags():
    def step(batch: pa.RecordBatch) -> dict:
        bags = [sorted(words(t)) for t in batch.column("text").to_pylist()]
        return {"doc_id": batch.column("doc_id"), "toxic": batch.column("toxic"), "words": bags}

    return step


def held_out(doc_id="doc_id"):
    """Whether a document is kept from learning: crc32 of its doc_id as text leaves remainder 0 by 5."""
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 0


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    """Fit on at most ``sample`` labelled documents of each label, drawn by a hash of doc_id, none of them held out.

    The draw is a top-k in Spark; only it is broadcast, and only the distinct words of its whole texts come to the driver. Null texts count as
    empty, null labels as no label. Without labels every score is next to nothing.
    """
    prepare(docs.sparkSession)
    label = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic"))
    usable = label.where(~held_out() & F.col("toxic").isin(0, 1)).withColumn("draw", F.xxhash64("doc_id"))
    counts = {r["toxic"]: r["count"] for r in usable.groupBy("toxic").count().collect()}
    share = counts.get(1, 0) / max(1, sum(counts.values()))
    drawn = [usable.where(F.col("toxic") == k).orderBy("draw", "doc_id").limit(sample) for k in (0, 1)]
    picked = drawn[0].unionAll(drawn[1]).select("doc_id", "toxic")  # 2 * sample rows at most
    rows = map_batches(texts(docs).join(F.broadcast(picked), "doc_id"), _bags, "doc_id long, toxic int, words array<string>").collect()
    rows.sort(key=lambda r: (r.doc_id, len(r.words)))
    return fit([set(r.words) for r in rows], [r.toxic for r in rows], share)


def _scores(model: Model):
    def make():
        scorer = Scorer(model)

        def step(batch: pa.RecordBatch) -> dict:
            return {c: batch.column(c) for c in batch.schema.names if c != "text"} | {"score": scorer.score(batch.column("text").to_pylist())}

        return step

    return make


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id and score (0 to 1) of every row, from its whole text alone; null and empty texts have a score too."""
    prepare(docs.sparkSession)
    return map_batches(texts(docs), _scores(model), "doc_id long, score double")


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's toxicity, learned from labels of documents that are not held out.

    Null and empty texts have a score; repeated rows are scored alike, each for itself; an empty table gives no rows;
    further columns have no effect; labels of no document only take places in the sample.
    """
    docs = table(spark, sf_dir, "documents")
    scored = score(docs, train(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def _keep_clean(model: Model, name: str):
    def make():
        scorer = Scorer(model)

        def step(batch: pa.RecordBatch) -> dict:
            found = scorer.score([t or "" for t in batch.column("text").to_pylist()])
            return {c: batch.column(c) for c in batch.schema.names} | {name: found}

        return step

    return make


def drop_toxic(docs: DataFrame, model: Model, least: float = 0.5) -> DataFrame:
    """The same columns, whatever their names, without rows whose text scores ``least`` or more.

    A null text counts as empty and stays null; rows are judged one by one, repeated ones alike; an empty table gives
    no rows.
    """
    prepare(docs.sparkSession)
    plain = plainly_named(docs)
    schema = StructType([*plain.schema.fields, StructField("score", DoubleType())])
    return map_batches(plain, _keep_clean(model, "score"), schema).where(F.col("score") < least).drop("score").toDF(*docs.columns)
