"""Quality by ordinal regression: one score per text, ordered thresholds for the grades.

P(grade <= k) = sigmoid(threshold_k - score). The score is a sum of weights over hashed features, shared by all grades. Features of a text:
each of its tokens gives its word, the word's first four and five letters, and, where it is not a plain word, its
shape; the text gives bucketed counts of repeated neighbours, upper-case words and marks. A feature counts once per text. Only the features whose grades differ most
from chance get a weight, so that a long text does not add up noise.

The fit runs over a bounded sample of labelled rows, the first ``max_fit_rows`` in the order of a hash of their ids. Spark chooses the
features, the driver fits their weights; these have a fixed size and go to the tasks, which score every row and whole text. Selection uses the expected
grade or the probability of a grade and above.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from operator import eq

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliant.llm.common import keep


@dataclass(frozen=True)
class QualitySpec:
    #: Grades are 0 to this.
    top: int = 2
    bits: int = 31
    #: The bound of the sample that is fitted on.
    max_fit_rows: int = 20_000
    #: A feature is in so many texts of the sample, and the best so many features are fitted.
    min_texts: int = 4
    #: Features in more hundredths of the sample's texts than this say how long a text is rather than what it is.
    max_percent: int = 10
    max_features: int = 2_000
    l2: float = 3e-5
    rounds: int = 150
    #: A text is kept if its probability of the top grade is at least this.
    keep_at: float = 0.8


_PLAIN = re.compile(r"[^\W\d_]+[.,;:!?]?")
_EDGES = ".,;:!?\"'()[]{}<>|*#%&$@/\\-_=+~^`"
_CACHE = 200_000


def _feature(text: str, bits: int) -> int:
    return xxhash.xxh32_intdigest(text) >> (32 - bits)


def token_features(token: str, bits: int) -> tuple[int, ...]:
    word = token.lower().strip(_EDGES)
    out = [_feature("w:" + word, bits), _feature("4:" + word[:4], bits), _feature("5:" + word[:5], bits)] if word else []
    if not _PLAIN.fullmatch(token):
        shape = re.sub(r"(.)\1+", r"\1", re.sub(r"\d+", "0", re.sub(r"[^\W\d_]+", "a", token)))[:12]
        out.append(_feature("s:" + shape, bits))
    return tuple(out)


def text_features(tokens: list[str], distinct: set[str], bits: int) -> list[int]:
    """Buckets of the logarithm of a few counts."""
    n = len(tokens)
    if not n:
        return [_feature("empty", bits)]
    counts = {
        "same": sum(map(eq, tokens, tokens[1:])),
        "upper": sum(map(str.isupper, distinct)),
        "marks": sum(not t[-1].isalnum() and t[-1] not in ".,;:!?" for t in distinct),
        "few": n // len(distinct),
    }
    return [_feature(f"{k}:{v.bit_length()}", bits) for k, v in counts.items()]


class _Weights:
    """Scores texts; remembers which features with a weight each token it has seen gives."""

    def __init__(self, weights: dict[int, float], bits: int) -> None:
        self.weights, self.bits, self.seen = weights, bits, {}

    def score(self, text: str | None) -> float:
        tokens = (text or "").split()
        distinct = set(tokens)
        if len(self.seen) > _CACHE:
            self.seen.clear()
        seen, w = self.seen, self.weights
        for t in distinct.difference(seen):
            seen[t] = tuple(f for f in token_features(t, self.bits) if f in w)
        found = {f for t in distinct for f in seen[t]}.union(text_features(tokens, distinct, self.bits))
        return sum(w[f] for f in sorted(found.intersection(w)))


@dataclass(frozen=True)
class QualityModel:
    """``weights`` by feature, and the ordered ``thresholds``."""

    weights: dict[int, float]
    thresholds: tuple[float, ...]

    def tails(self, score: np.ndarray) -> np.ndarray:
        """P(grade >= k) for k from 1, a column each."""
        return 1 / (1 + np.exp(np.clip(np.array(self.thresholds)[None, :] - score[:, None], -40, 40)))


def sample(docs: DataFrame, labels: DataFrame, spec: QualitySpec, id_col: str = "doc_id", text_col: str = "text", grade_col: str = "grade") -> DataFrame:
    """Features and grades of the sample: ``grade, features``."""
    graded = labels.where(F.col(grade_col).between(0, spec.top) & F.col(id_col).isNotNull())
    graded = graded.groupBy(F.col(id_col).alias("__id")).agg(F.min(grade_col).cast("int").alias("grade"))
    first = keep(graded.orderBy(F.xxhash64("__id"), "__id").limit(spec.max_fit_rows), "sample")
    texts = docs.select(F.col(id_col).alias("__id"), F.col(text_col).alias("text")).join(first, "__id").select("grade", "text")
    bits = spec.bits

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[str, tuple[int, ...]] = {}
        for batch in batches:
            lists = []
            for text in batch.column("text").to_pylist():
                tokens = (text or "").split()
                distinct = set(tokens)
                if len(seen) > _CACHE:
                    seen.clear()
                for t in distinct.difference(seen):
                    seen[t] = token_features(t, bits)
                lists.append(sorted({f for t in distinct for f in seen[t]}.union(text_features(tokens, distinct, bits))))
            yield pa.RecordBatch.from_arrays([batch.column("grade"), pa.array(lists, pa.list_(pa.int32()))], names=["grade", "features"])

    return texts.mapInArrow(run, "grade int, features array<int>")


def _best_features(rows: DataFrame, sizes: dict[int, int], spec: QualitySpec) -> list[int]:
    """The features whose texts' grades differ most from what chance gives (chi square), counted by Spark."""
    n, at = sum(sizes.values()), F.col("f")
    per = rows.select("grade", F.explode("features").alias("f")).groupBy("f").agg(F.count(F.lit(1)).alias("texts"), *[F.count_if(F.col("grade") == g).alias(f"g{g}") for g in range(spec.top + 1)])
    per = per.where((F.col("texts") >= min(spec.min_texts, n)) & (F.col("texts") * 100 <= spec.max_percent * n))
    chi = F.lit(0.0)
    for g in range(spec.top + 1):
        expected = F.col("texts") * (sizes.get(g, 0) / n)
        chi = chi + F.when(expected > 0, (F.col(f"g{g}") - expected) * (F.col(f"g{g}") - expected) / expected).otherwise(0.0)
    best = per.select(at, chi.alias("chi")).where("chi > 0").orderBy(F.desc("chi"), "f").limit(spec.max_features)
    return sorted(r["f"] for r in best.collect())


def fit(rows: DataFrame, spec: QualitySpec) -> QualityModel:
    """The model of a bounded sample; without labelled rows every text gets the top grade.

    Only the chosen features of the sample come to the driver: some dozen numbers per text.
    """
    rows = keep(rows, "features")
    sizes = {r["grade"]: r["n"] for r in rows.groupBy("grade").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not sizes:
        return QualityModel({}, tuple(-20.0 for _ in range(spec.top)))
    best = _best_features(rows, sizes, spec)
    chosen = frozenset(best)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            few = [[f for f in x if f in chosen] for x in batch.column("features").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("grade"), pa.array(few, pa.list_(pa.int32()))], names=["grade", "features"])

    table = rows.mapInArrow(run, "grade int, features array<int>").toArrow()
    grade = table.column("grade").to_numpy().astype(np.int64)
    lists = table.column("features").combine_chunks()
    offsets, feature = np.array(lists.offsets), np.array(lists.values)
    row = np.repeat(np.arange(len(grade)), np.diff(offsets))
    col = np.searchsorted(best, feature) if best else np.zeros(0, dtype=np.int64)
    x, _ = _minimise(lambda x: _loss(x, row, col, grade, len(best), spec), len(best) + spec.top, spec)
    w, theta = x[: len(best)], _thresholds(x[len(best):])
    return QualityModel({int(f): float(v) for f, v in zip(best, w) if v}, tuple(float(t) for t in theta))


def _thresholds(x: np.ndarray) -> np.ndarray:
    """Ordered by construction: the first as it is, then steps of exp."""
    return x[0] + np.concatenate(([0.0], np.cumsum(np.exp(x[1:]))))


def _loss(x: np.ndarray, row: np.ndarray, col: np.ndarray, grade: np.ndarray, k: int, spec: QualitySpec) -> tuple[float, np.ndarray]:
    """Mean negative log likelihood of the grades with an L2 penalty, and its gradient."""
    n, w, theta = len(grade), x[:k], _thresholds(x[k:])
    score = np.bincount(row, weights=w[col], minlength=n)
    upto = 1 / (1 + np.exp(-np.clip(theta[None, :] - score[:, None], -40, 40)))
    full = np.concatenate((np.zeros((n, 1)), upto, np.ones((n, 1))), axis=1)
    slope = full * (1 - full)
    here = np.arange(n)
    p = np.maximum(full[here, grade + 1] - full[here, grade], 1e-15)
    up, down = slope[here, grade + 1] / p, slope[here, grade] / p
    g_w = np.bincount(col, weights=((up - down) / n)[row], minlength=k) + spec.l2 * w
    g_t = np.array([(down[grade == i + 1].sum() - up[grade == i].sum()) / n for i in range(spec.top)])
    after = np.cumsum(g_t[::-1])[::-1]
    g_x = np.concatenate((after[:1], after[1:] * np.exp(x[k + 1:])))
    return float(-np.log(p).mean() + spec.l2 / 2 * (w @ w)), np.concatenate((g_w, g_x))


def _minimise(f, size: int, spec: QualitySpec, memory: int = 10) -> tuple[np.ndarray, float]:
    """Limited-memory BFGS with backtracking."""
    x = np.zeros(size)
    x[size - spec.top] = -2.0
    loss, g = f(x)
    pairs: list[tuple[np.ndarray, np.ndarray]] = []
    for _ in range(spec.rounds):
        d, kept = -g, []
        for s, y in reversed(pairs):
            a = (s @ d) / (s @ y)
            kept.append(a)
            d = d - a * y
        if pairs:
            s, y = pairs[-1]
            d = d * ((s @ y) / (y @ y))
        for (s, y), a in zip(pairs, reversed(kept)):
            d = d + (a - (y @ d) / (s @ y)) * s
        slope, step = g @ d, 1.0 if pairs else min(1.0, 1 / max(np.abs(g).sum(), 1e-12))
        while step > 1e-10:
            new_loss, new_g = f(x + step * d)
            if new_loss <= loss + 1e-4 * step * slope:
                break
            step /= 2
        else:
            break
        s, y = step * d, new_g - g
        if s @ y > 1e-12:
            pairs = [*pairs, (s, y)][-memory:]
        done = loss - new_loss < 1e-7 * max(loss, 1e-3)
        x, loss, g = x + s, new_loss, new_g
        if done:
            break
    return x, loss


def grade(docs: DataFrame, model: QualityModel, spec: QualitySpec, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: ``doc_id, score, expected_grade, tails`` (P(grade >= k) for k from 1) and ``kept``.

    A null text is an empty one; rows that are there twice are graded twice; a null id stays null. Other columns of the input are not
    looked at; an empty table gives an empty result.
    """
    bits, keep_at = spec.bits, spec.keep_at
    shared = docs.sparkSession.sparkContext.broadcast((model.weights, model.thresholds))  # at most max_features weights

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = QualityModel(*shared.value)
        scorer = _Weights(own.weights, bits)
        for batch in batches:
            score = np.array([scorer.score(t) for t in batch.column("text").to_pylist()], dtype=np.float64)
            tails = own.tails(score)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(score) + 1, dtype=np.int32) * tails.shape[1]), pa.array(tails.ravel()))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(score), pa.array(tails.sum(axis=1)), lists, pa.array(tails[:, -1] >= keep_at)],
                                             names=["doc_id", "score", "expected_grade", "tails", "kept"])

    slim = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    kind = slim.schema["doc_id"].dataType.simpleString()
    return slim.mapInArrow(run, f"doc_id {kind}, score double, expected_grade double, tails array<double>, kept boolean")


def keep_good(docs: DataFrame, model: QualityModel, spec: QualitySpec, text_col: str = "text") -> DataFrame:
    """The documents that are good enough, with all their columns."""
    bits, keep_at = spec.bits, spec.keep_at
    shared = docs.sparkSession.sparkContext.broadcast((model.weights, model.thresholds))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = QualityModel(*shared.value)
        scorer = _Weights(own.weights, bits)
        for batch in batches:
            score = np.array([scorer.score(t) for t in batch.column(text_col).to_pylist()], dtype=np.float64)
            yield batch.filter(pa.array(own.tails(score)[:, -1] >= keep_at))

    return docs.mapInArrow(run, docs.schema)
