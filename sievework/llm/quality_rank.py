"""Quality classifier: document scores learned from preference pairs (Bradley-Terry).

A pair says that one document is better than another. The probability of that is modelled as
sigmoid(s(better) - s(worse)) with scores s linear in features of the text, so the scores are learned
by logistic loss on feature differences. A document passes if its score reaches a quantile of the
scores of labelled documents, the quantile at which the labels are told apart best.

Labels become pairs: a document of label 1 is preferred to one of label 0. Every labelled document
teaches: all are dealt into blocks by a hash of doc_id, in which each of label 1 makes a pair with each
of label 0. Newton's steps add slopes and curves of the blocks; they start from a fit on at most about
``FIT_DOCS`` documents of each label and ``PAIRS`` pairs, which saves steps and decides nothing. The
threshold is the best of all cuts through all labelled documents. Scoring reads every whole text, in
Arrow batches.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sievework.llm.common import arrow_map, table
from sievework.scratch import materialize

#: Expected labelled documents of each label that the model is fitted on, and the pairs made of them.
FIT_DOCS, PAIRS = 3000, 20_000
#: Documents of the commoner label in a block, and at least how many of the rarer one are expected there.
BLOCK_DOCS, BLOCK_RARE = 2000, 64
#: Sums of blocks that reach the driver, and ranges that scores are cut in.
SUMS, RANGES = 16, 256
#: Ridge on the weights of standardised features, and the most Newton steps.
RIDGE, STEPS = 1e-3, 30
#: The score that the threshold is mapped to.
PASS = 0.7
#: Features: the square roots of the shares of the 256 byte values, then those of ``shape``.
N_SHAPE = 9
N_FEATURES = 256 + N_SHAPE


def shape(text: str) -> list[float]:
    """Repetition and lengths of words and lines."""
    words = text.split()
    lines = text.split("\n")
    n = len(words)
    counts = Counter(words)
    equal = sum(map(str.__eq__, words, words[1:]))
    longest = max(map(len, words), default=0)
    return [
        math.log1p(n), len(counts) / max(n, 1), max(counts.values(), default=0) / max(n, 1), equal / max(n - 1, 1), sum(map(len, words)) / max(n, 1), math.log1p(longest),
        len(set(lines)) / len(lines), math.log1p(n / len(lines)), len({a + " " + b for a, b in zip(words, words[1:])}) / max(n - 1, 1),
    ]


def features(text: str | None) -> np.ndarray:
    """Of the whole text; a null text is empty, whose shares are all 0."""
    text = text or ""
    raw = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
    return np.concatenate([np.sqrt(np.bincount(raw, minlength=256) / max(len(raw), 1)), shape(text)])


class RankModel:
    """Scores of documents: weights of standardised features, and the score at the threshold."""

    def __init__(self, mean: np.ndarray, scale: np.ndarray, weights: np.ndarray, threshold: float = 0.0):
        self.mean, self.scale, self.weights, self.threshold = mean, scale, weights, threshold

    def raw(self, x: np.ndarray) -> np.ndarray:
        # beyond four deviations a feature says no more
        return np.clip((x - self.mean) * self.scale, -4, 4) @ self.weights

    def score(self, x: np.ndarray) -> np.ndarray:
        """0 to 1, ``PASS`` at the threshold."""
        z = np.clip(self.raw(x) - self.threshold, -500, 500)
        return 1 / (1 + np.exp(-z) * (1 - PASS) / PASS)


def fit_preferences(x: np.ndarray, better: np.ndarray, worse: np.ndarray) -> RankModel:
    """Newton's method on the mean of log(1 + exp(-(s(better) - s(worse)))) plus a ridge.

    ``better`` and ``worse`` are rows of ``x``. A feature without spread gets no weight; without pairs
    every weight is 0.
    """
    used = x[np.union1d(better, worse)] if len(better) else x[:0]
    mean, sd = (used.mean(0), used.std(0)) if len(used) else (np.zeros(x.shape[1]), np.zeros(x.shape[1]))
    model = RankModel(mean, np.where(sd > 1e-12, 1 / np.maximum(sd, 1e-12), 0.0), np.zeros(x.shape[1]))
    if not len(better):
        return model
    varied = np.flatnonzero(model.scale)
    z = np.clip((x - model.mean) * model.scale, -4, 4)[:, varied]
    d = z[better] - z[worse]
    w = np.zeros(len(varied))
    for _ in range(STEPS):
        p = 1 / (1 + np.exp(np.clip(d @ w, -500, 500)))  # of the wrong order
        slope = RIDGE * w - d.T @ p / len(d)
        curve = (d * (p * (1 - p))[:, None]).T @ d / len(d) + RIDGE * np.eye(len(w))
        step = np.linalg.solve(curve, slope)
        step *= min(1.0, 5 / max(np.abs(d @ step).max(initial=0), 1e-12))  # no pair moves by more than 5 at a time
        w = w - step
        if not len(w) or np.abs(step).max() < 1e-4:
            break
    model.weights[varied] = w
    return model


def best_quantile(scores: np.ndarray, label: np.ndarray, weight: np.ndarray) -> float:
    """The score in the middle between the two at the quantile that tells the labels apart best: by the weighted share told right, then the lowest."""
    order = np.argsort(scores, kind="stable")
    s, y, w = scores[order], label[order] == 1, weight[order]
    right = np.concatenate([[0.0], np.cumsum(np.where(y, -w, w))])  # told right below a cut less label 1 lost there
    cut = np.concatenate([[True], s[1:] > s[:-1], [True]])  # equal scores stay together
    at = int(np.argmax(np.where(cut, right, -np.inf)))
    if at == 0 or at == len(s):
        return float(s[0] - 1e-9 if at == 0 else s[-1] + 1e-9)
    return float((s[at - 1] + s[at]) / 2)


def remainder(doc_id: str = "doc_id") -> Column:
    """crc32(doc_id as text) mod 4; null for a row without doc_id."""
    return F.pmod(F.crc32(F.col(doc_id).cast("string").cast("binary")), F.lit(4))


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        x = [features(t).astype("<f8").tobytes() for t in b.column("text").to_pylist()]
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("label"), pa.array(x, pa.binary())], ["doc_id", "label", "x"])


def _blocks(docs: DataFrame, known: DataFrame, size: dict[int, int]) -> DataFrame:
    """block, y, own and x (features in 32 bits) of all ``known`` documents, one row for each block, by doc_id within it.

    Where a label is rare its documents stand in several blocks, so that no block lacks it; own is 1 in the first.
    """
    rare = min(size, key=size.get)
    blocks = -(-max(size.values()) // BLOCK_DOCS)
    copies = min(blocks, -(-BLOCK_RARE * blocks // size[rare]))
    dealt = known.select("of", "label", F.explode(F.sequence(F.lit(0), F.when(F.col("label") == rare, copies - 1).otherwise(0))).alias("copy"))
    dealt = dealt.withColumn("block", F.pmod(F.pmod(F.xxhash64("of", F.lit("block")), F.lit(blocks)) + F.col("copy"), F.lit(blocks)).cast("long"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array([features(t).astype("<f4").tobytes() for t in b.column("text").to_pylist()], pa.binary())], ["doc_id", "x"])

    def packed(p: pd.DataFrame) -> pd.DataFrame:
        p = p.sort_values(["of", "x"]).drop_duplicates("of")
        y, own = p["label"].to_numpy(np.int8), (p["copy"] == 0).to_numpy(np.int8)
        return pd.DataFrame({"block": [p["block"].iat[0]], "y": [y.tobytes()], "own": [own.tobytes()], "x": [b"".join(p["x"])]})

    # features are joined, not texts, which are larger
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where("doc_id is not null")
    own = arrow_map(texts, run, "doc_id long, x binary").join(dealt, F.col("doc_id") == F.col("of")).select("block", "of", "label", "copy", "x")
    return materialize(own.repartition(min(blocks, 2000), "block").groupBy("block").applyInPandas(packed, "block long, y binary, own binary, x binary"), "rank-blocks")


def _unpacked(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    for b in batches:
        for block, y, own, x in zip(*(b.column(c).to_pylist() for c in ("block", "y", "own", "x"))):
            yield block, np.frombuffer(y, np.int8), np.frombuffer(own, np.int8), np.frombuffer(x, "<f4").astype(float).reshape(-1, N_FEATURES)


def _summed(blocks: DataFrame, of) -> np.ndarray:
    """The sum over blocks of the array ``of`` (features, labels), in the order of blocks, so that reruns agree; ``SUMS`` arrays reach the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block, y, _, x in _unpacked(batches):
            yield pa.RecordBatch.from_arrays([pa.array([block], pa.int64()), pa.array([of(x, y).astype("<f8").tobytes()], pa.binary())], ["block", "a"])

    def add(p: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"g": [p["block"].iat[0] % SUMS], "a": [sum(np.frombuffer(a, "<f8") for a in p.sort_values("block")["a"]).tobytes()]})

    parts = arrow_map(blocks, run, "block long, a binary").groupBy(F.col("block") % SUMS).applyInPandas(add, "g long, a binary").collect()
    return sum((np.frombuffer(r.a, "<f8") for r in sorted(parts)), np.zeros(1))


def refined(start: RankModel, blocks: DataFrame) -> RankModel:
    """Newton's method over the pairs of all ``blocks``, from the weights of ``start``; a step that does not lower the loss is halved."""
    n, *both = np.split(_summed(blocks, lambda x, y: np.concatenate([[len(x)], x.sum(0), (x * x).sum(0)])), [1, 1 + N_FEATURES])
    mean = both[0] / n
    sd = np.sqrt(np.maximum(both[1] / n - mean * mean, 0))
    scale = np.where(sd > 1e-6, 1 / np.maximum(sd, 1e-6), 0.0)
    varied = np.flatnonzero(scale)
    k = len(varied)
    model = RankModel(mean, scale, np.zeros(N_FEATURES))

    def at(w: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
        def of(x: np.ndarray, y: np.ndarray) -> np.ndarray:
            z = np.clip((x - mean) * scale, -4, 4)[:, varied]
            g, b = z[y == 1], z[y == 0]
            m = (g @ w)[:, None] - b @ w
            p = 1 / (1 + np.exp(np.clip(m, -500, 500)))  # of the wrong order
            q = p * (1 - p)
            cross = g.T @ (q @ b)
            curve = (g.T * q.sum(1)) @ g + (b.T * q.sum(0)) @ b - cross - cross.T
            return np.concatenate([[m.size, np.logaddexp(0, -m).sum()], b.T @ p.sum(0) - g.T @ p.sum(1), curve.ravel()])

        pairs, loss, slope, curve = np.split(_summed(blocks, of), [1, 2, 2 + k])
        pairs = max(pairs[0], 1)
        return loss[0] / pairs + RIDGE / 2 * w @ w, slope / pairs + RIDGE * w, curve.reshape(k, k) / pairs + RIDGE * np.eye(k)

    w = (start.weights * start.scale)[varied] / scale[varied]
    loss, slope, curve = at(w)
    for _ in range(STEPS if k else 0):
        step = np.linalg.solve(curve, slope)
        while True:
            now = at(w - step)
            if now[0] <= loss + 1e-12 or np.abs(step).max() < 1e-4:
                break
            step = step / 2
        w, (loss, slope, curve) = w - step, now
        if np.abs(step).max() < 1e-3:
            break
    model.weights[varied] = w
    return model


def best_cut(scored: DataFrame) -> float:
    """``best_quantile`` of a table (s, y) by equal weights: the running sums of ranges of scores, then the ranges' one after another."""
    net = materialize(scored.groupBy("s").agg(F.sum(F.when(F.col("y") == 1, -1).otherwise(1)).alias("net")), "rank-scores")
    ends = sorted(set(net.agg(F.percentile_approx("s", [i / RANGES for i in range(1, RANGES)])).first()[0]))  # only deals the scores

    def run(p: pd.DataFrame) -> pd.DataFrame:
        p = p.sort_values("s")
        s, net = p["s"].to_numpy(), p["net"].to_numpy()
        before = np.cumsum(net) - net  # told right below each score less what is lost there
        i = int(np.argmax(before))
        return pd.DataFrame({"last": [s[-1]], "net": [int(net.sum())], "best": [int(before[i])], "low": [s[i - 1] if i else None], "high": [s[i]]})

    ranged = net.groupBy(F.size(F.filter(F.array(*map(F.lit, ends)), lambda e: e < F.col("s"))).alias("r")).applyInPandas(run, "last double, net long, best long, low double, high double")
    rows = sorted(ranged.collect(), key=lambda r: r.last)
    told, most, cut, last = 0, -1, 0.0, None
    for r in rows:
        if told + r.best > most:
            low = last if r.low is None or np.isnan(r.low) else r.low
            most, cut = told + r.best, r.high - 1e-9 if low is None else (low + r.high) / 2
        told, last = told + r.net, r.last
    return float(last + 1e-9 if told > most else cut)


def fit_labels(docs: DataFrame, labels: DataFrame, label: str = "quality") -> RankModel:
    """Learn from ``docs`` (doc_id, text) and ``labels`` (doc_id and ``label``, 0 or 1).

    Only rows whose ``remainder`` is not 2 teach, and all of them do. Null labels and doc_ids are left
    out; of several labels of a document the largest counts, of several texts that of the smallest
    bytes of features. For the start about ``FIT_DOCS`` documents of each label are drawn by a hash of
    doc_id; features of these, not texts, reach the driver, and of all others only sums. Without
    documents of both labels there is no preference and the model scores every text alike.
    """
    known = labels.where(F.col("doc_id").isNotNull() & F.col(label).isin(0, 1) & (remainder() != 2)).groupBy(F.col("doc_id").cast("long").alias("of")).agg(F.max(F.col(label).cast("int")).alias("label"))
    size = {r[0]: r[1] for r in known.groupBy("label").count().collect()}
    if len(size) < 2:
        return fit_preferences(np.zeros((0, N_FEATURES)), np.zeros(0, int), np.zeros(0, int))
    draw = F.pmod(F.xxhash64("of", F.lit("fit")), F.lit(1_000_003)) / F.lit(1_000_003.0)
    share = F.when(F.col("label") == 1, min(1.0, FIT_DOCS / size[1])).otherwise(min(1.0, FIT_DOCS / size[0]))
    drawn = F.broadcast(known.where(draw < share))  # about 2 x FIT_DOCS rows
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).join(drawn, F.col("doc_id") == F.col("of"))
    one = arrow_map(texts.select("doc_id", "label", "text"), _features, "doc_id long, label int, x binary").groupBy("doc_id", "label").agg(F.min("x").alias("x"))
    rows = sorted(map(tuple, one.collect()))
    y = np.array([r[1] for r in rows], int)
    x = np.stack([np.frombuffer(r[2], "<f8") for r in rows]) if rows else np.zeros((0, N_FEATURES))
    good, bad = np.flatnonzero(y == 1), np.flatnonzero(y == 0)
    r = np.random.default_rng(11)
    n = min(PAIRS, len(good) * len(bad))
    start = fit_preferences(x, r.choice(good, n), r.choice(bad, n)) if n else fit_preferences(x, good[:0], bad[:0])
    blocks = _blocks(docs, known, size)
    n_label = _summed(blocks, lambda x, y: np.array([(y == 0).sum(), (y == 1).sum()]))
    if not np.all(n_label) or len(n_label) < 2:
        return fit_preferences(x, good[:0], bad[:0])
    model = refined(start, blocks)

    def scores(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, y, own, x in _unpacked(batches):
            yield pa.RecordBatch.from_arrays([pa.array(model.raw(x)[own == 1]), pa.array(y[own == 1].astype(np.int32))], ["s", "y"])

    model.threshold = best_cut(arrow_map(blocks, scores, "s double, y int"))
    return model


def score_texts(docs: DataFrame, model: RankModel) -> DataFrame:
    """doc_id, held_out, score and predicted of each row of ``docs`` (doc_id, text); repeated rows all stay.

    A null text scores as an empty one; a row without doc_id is not held out. predicted is 1 from a
    score of ``PASS``. An empty table gives no rows; other columns are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = [features(t) for t in b.column("text").to_pylist()]
            s = model.score(np.stack(x)) if x else np.zeros(0)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("held_out"), pa.array(s), pa.array((s >= PASS).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(remainder() == 2, F.lit(False)).alias("held_out"), F.col("text").cast("string").alias("text"))
    return arrow_map(own, run, "doc_id long, held_out boolean, score double, predicted int")


def op11_quality_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return score_texts(docs, fit_labels(docs, table(spark, sf_dir, "labels")))
