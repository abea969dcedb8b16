"""Toxic passages by maximum-scoring segments.

Tokens get log-odds between toxic and clean training documents under an informative Dirichlet
prior, the pooled counts. Tokens whose log-odds are sure (``|z|`` at or above a limit) keep them, all
others share one negative score, so that a passage has to earn its length. A linear scan finds
every maximal scoring segment of a text. Extreme-value theory says how large a segment of
chance gets: with ``sum p exp(lambda s) = 1`` over the tokens of clean documents and a fitted K, a
segment of score S among n tokens is expected ``K n exp(-lambda S)`` times. Segments expected less
than ``expect`` times are significant; a text's evidence is the sum of their ``lambda S - ln(K n)``, and a
logistic curve turns evidence into a probability.

The classifier is fitted on a bounded sample: the ``sample`` labelled training rows with the smallest
hash of the id, and at most ``lexicon`` tokens. Every text is scanned whole. Null and empty texts have
no evidence and get the score of that. Repeated rows are scored each; documents with several labels
count as toxic if one says so; null labels and null ids teach nothing. An empty table gives no rows;
without both classes every score is the share of toxic rows (0.5 without any). Other columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from plumbrow.llm import text as T


FLAT = 0.5  # the part of the prior that every token has, so that a class without it stays uncertain


@dataclass(frozen=True)
class Settings:
    sample: int = 32_768  # labelled rows that the classifier is fitted on
    lexicon: int = 65_536  # tokens with a score of their own
    prior: float = 500.0  # weight of the pooled counts, in tokens
    z: float = 3.0
    drift: float = -0.25  # score of every other token
    expect: float = 0.05


def maximal_segments(position: list[int], score: list[float], drift: float) -> list[tuple[int, int, float]]:
    """All maximal scoring segments (first token, last token, score), in order.

    ``position`` and ``score`` list the tokens that have a score of their own; those between score
    ``drift``. Linear: every listed token is pushed once, and candidates are merged from the
    top of the stack. A candidate remembers the total before and after it.
    """
    stack: list[tuple[int, int, float, float]] = []
    lower: list[int] = []  # for each candidate, the nearest one below whose left total is smaller
    total, at = 0.0, 0
    for p, s in zip(position, score):
        total += (p - at) * drift
        at = p + 1
        if s <= 0:
            total += s
            continue
        first, left, right = p, total, total + s
        total = right
        j = len(stack) - 1
        while True:
            while j >= 0 and stack[j][2] >= left:
                j = lower[j]
            if j < 0 or stack[j][3] >= right:
                del lower[len(stack):]
                lower.append(j)
                stack.append((first, p, left, right))
                break
            first, _, left, _ = stack[j]
            del stack[j:], lower[j:]
            j = len(stack) - 1
    return [(a, b, r - l) for a, b, l, r in stack]


@dataclass
class Model:
    """Scores of tokens and the calibration of segments and texts."""

    tokens: np.ndarray
    scores: np.ndarray
    drift: float
    rate: float  # lambda
    k: float
    expect: float
    offset: float
    slope: float

    def token_scores(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Place among the row's tokens, score and row of every token of the lexicon; and the tokens of each row."""
        h, row = T.word_hashes(column, letters=True)
        counts = np.bincount(row, minlength=len(column))
        if not len(self.tokens) or not len(h):
            none = np.empty(0, np.int64)
            return none, none.astype(float), none, counts
        at = np.searchsorted(self.tokens, h)
        at[at == len(self.tokens)] = 0
        hit = np.flatnonzero(self.tokens[at] == h)
        first = np.concatenate([[0], np.cumsum(counts)])
        return hit - first[row[hit]], self.scores[at[hit]], row[hit], counts

    def segments(self, column: pa.Array) -> list[list[tuple[int, int, float]]]:
        """Maximal segments of every row."""
        place, score, row, counts = self.token_scores(column)
        edges = np.searchsorted(row, np.arange(len(column) + 1))
        return [
            maximal_segments(place[a:b].tolist(), score[a:b].tolist(), self.drift) if b > a else []
            for a, b in zip(edges[:-1], edges[1:])
        ], counts

    def expected(self, score: float, n: int) -> float:
        """How many segments of at least this score chance puts into n clean tokens."""
        return self.k * max(n, 1) * math.exp(-min(self.rate * score, 700.0))

    def evidence(self, column: pa.Array) -> tuple[np.ndarray, list[list[tuple[int, int, float]]]]:
        """Sum of ``-ln(expected)`` over the significant segments of every row, and these segments."""
        found, counts = self.segments(column)
        kept = [[s for s in segments if self.expected(s[2], int(n)) < self.expect] for segments, n in zip(found, counts)]
        sums = [sum(-math.log(max(self.expected(s[2], int(n)), 1e-300)) for s in own) for own, n in zip(kept, counts)]
        return np.array(sums, float), kept

    def probability(self, evidence: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-(self.offset + self.slope * np.log1p(evidence))))


def _labelled(docs: DataFrame, labels: DataFrame, train: Column, settings: Settings, label: str, doc_id: str, text: str):
    marks = labels.select(F.col(doc_id).alias("doc_id"), F.col(label).alias("y")).filter("doc_id IS NOT NULL AND y IS NOT NULL")
    marks = marks.filter(train).groupBy("doc_id").agg(F.max("y").cast("int").alias("y"))
    chosen = marks.orderBy(F.xxhash64("doc_id"), "doc_id").limit(settings.sample).toArrow()
    spark = docs.sparkSession
    sample = spark.createDataFrame(chosen.to_pandas(), marks.schema)
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    return rows.join(F.broadcast(sample), "doc_id").select("text", "y")


def _token_counts(rows: DataFrame) -> DataFrame:
    """Documents of either class that hold a token."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in T.pieces(batch, limit=T.HASH_BYTES):
                h, row = T.word_hashes(piece.column("text"), letters=True)
                y = piece.column("y").to_numpy(zero_copy_only=False).astype(np.int64)
                order = np.lexsort((h, row))
                h, row = h[order], row[order]
                new = np.ones(len(h), bool)
                new[1:] = (h[1:] != h[:-1]) | (row[1:] != row[:-1])
                token, toxic, clean = T.pooled(h[new], y[row[new]], 1 - y[row[new]])
                yield pa.record_batch([pa.array(token.view(np.int64)), pa.array(toxic), pa.array(clean)], ["h", "toxic", "clean"])

    counted = rows.mapInArrow(count, "h long, toxic long, clean long")
    return counted.groupBy("h").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))


def _rate(scores: np.ndarray, counts: np.ndarray, drift: float, total: int) -> float:
    """The positive solution of ``sum p exp(rate s) = 1``."""
    p = np.append(counts, max(total - counts.sum(), 1)) / max(total, 1)
    s = np.append(scores, drift)
    low, high = 1e-6, 50.0
    for _ in range(200):
        rate = (low + high) / 2
        low, high = (rate, high) if float(np.sum(p * np.exp(np.minimum(rate * s, 600)))) < 1 else (low, rate)
    return low


def _logistic(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Offset and slope (not negative) of a logistic curve, by Newton steps with a weak ridge."""
    a, b = math.log((y.sum() + 0.5) / (len(y) - y.sum() + 0.5)), 0.0
    for _ in range(50):
        p = 1 / (1 + np.exp(-(a + b * x)))
        w = p * (1 - p) + 1e-9
        g = np.array([np.sum(y - p), np.sum((y - p) * x) - 0.01 * b])
        h = np.array([[w.sum(), (w * x).sum()], [(w * x).sum(), (w * x * x).sum() + 0.01]])
        step = np.linalg.solve(h + 1e-9 * np.eye(2), g)
        a, b = a + float(np.clip(step[0], -2, 2)), b + float(np.clip(step[1], -2, 2))
    return (a, b) if b > 0 else (math.log((y.sum() + 0.5) / (len(y) - y.sum() + 0.5)), 0.0)


def fit(
    docs: DataFrame, labels: DataFrame, train: Column | None = None, settings: Settings = Settings(),
    label: str = "toxic", doc_id: str = "doc_id", text: str = "text",
) -> Model:
    """Learn from the labelled rows of ``docs`` where ``train`` (a condition on ``doc_id``) holds."""
    rows = _labelled(docs, labels, F.lit(True) if train is None else train, settings, label, doc_id, text)
    counts = _token_counts(rows)
    size = counts.agg(F.sum("toxic"), F.sum("clean")).first()
    n1, n0 = (int(x or 0) for x in size)
    pooled = F.lit(settings.prior) * (F.col("toxic") + F.col("clean")) / max(n1 + n0, 1) + FLAT
    odds = lambda own, n: F.log((F.col(own) + pooled) / F.greatest(n + settings.prior - F.col(own), F.lit(1.0)))
    scored = counts.select("h", "toxic", "clean", (odds("toxic", n1) - odds("clean", n0)).alias("s"), pooled.alias("a"))
    scored = scored.withColumn("z", F.col("s") / F.sqrt(1 / (F.col("toxic") + F.col("a")) + 1 / (F.col("clean") + F.col("a"))))
    best = scored.filter(F.abs("z") >= settings.z).orderBy(F.desc(F.abs("z")), "h").limit(settings.lexicon).toArrow()
    h = best["h"].to_numpy().view(np.uint64)
    order = np.argsort(h)
    tokens, scores = h[order], best["s"].to_numpy()[order]
    clean = best["clean"].to_numpy()[order].astype(float)
    rate = _rate(scores, clean, settings.drift, n0) if (scores > 0).any() and n0 else 1.0
    model = Model(tokens, scores, settings.drift, rate, 1.0, settings.expect, 0.0, 0.0)

    def strongest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in T.pieces(batch, limit=T.HASH_BYTES):
                found, n = model.segments(piece.column("text"))
                top = np.array([max((s[2] for s in own), default=0.0) for own in found], float)
                yield pa.record_batch([piece.column("y"), pa.array(top), pa.array(n.astype(np.int64))], ["y", "top", "n"])

    tops = rows.mapInArrow(strongest, "y int, top double, n long").filter("n > 0").filter("y = 0")
    law = tops.agg(F.count("*"), F.sum(F.col("n") * F.exp(-rate * F.col("top")))).first()
    model.k = float(np.clip(law[0] / law[1], 1e-6, 1.0)) if law[0] and law[1] else 1.0

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in T.pieces(batch, limit=T.HASH_BYTES):
                yield pa.record_batch([piece.column("y"), pa.array(model.evidence(piece.column("text"))[0])], ["y", "x"])

    seen = rows.mapInArrow(weigh, "y int, x double").toArrow()
    y, x = seen["y"].to_numpy().astype(float), seen["x"].to_numpy()
    order = np.lexsort((y, x))
    if len(y):
        model.offset, model.slope = _logistic(np.log1p(x[order]), y[order])
    return model


def score(docs: DataFrame, model: Model, keep: Column | str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, score (the probability of the toxic class) and the significant passages of every row.

    A passage is (first token, last token, score); tokens are runs of letters and digits.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = sent.value
        passage = pa.list_(pa.struct([("first", pa.int64()), ("last", pa.int64()), ("score", pa.float64())]))
        for batch in batches:
            for piece in T.pieces(batch, limit=T.HASH_BYTES):
                evidence, kept = model.evidence(piece.column("text"))
                spans = pa.array([[dict(zip(("first", "last", "score"), s)) for s in own] for own in kept], passage)
                yield pa.record_batch(
                    [piece.column("doc_id"), pa.array(model.probability(evidence)), spans], ["doc_id", "score", "passages"]
                )

    rows = docs.select((F.col(keep) if isinstance(keep, str) else keep).alias("doc_id"), F.col(text).alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"doc_id {kind}, score double, passages array<struct<first:long,last:long,score:double>>")


def without_toxic(docs: DataFrame, model: Model, at: float, text: str = "text") -> DataFrame:
    """The rows of ``docs``, all columns, whose score is below ``at``. Nothing is shuffled."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in T.pieces(batch, text, T.HASH_BYTES):
                evidence, _ = sent.value.evidence(piece.column(text))
                yield piece.filter(pa.array(sent.value.probability(evidence) < at))

    return docs.mapInArrow(run, docs.schema)
