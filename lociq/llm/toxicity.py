"""Toxic passages by maximum-scoring segment search.

Words and their beginnings get the log-odds of toxic against other training texts under an
informative Dirichlet prior, shrunk by their own uncertainty, less a small constant so that ordinary
text scores below zero. Ruzzo and Tompa's scan finds all maximal scoring segments of a text in linear
time. How high the best segment of n harmless words comes follows an extreme-value (Gumbel)
distribution, P(S >= s) = 1 - exp(-K n exp(-lambda s)); chance gives a segment of score S or more
K n exp(-lambda S) times. A text's calibrated value is lambda S - ln(K n) of its best segment or, where
segments are expected less than once, the sum of -ln(expected number) over all of these. The parameters,
and then the rising curve from calibrated values to a probability (isotonic regression), are fitted on
training texts that the log-odds haven't seen.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bounded_batches, byte_flags, id_mod, mix64, read_table, slices, span_hashes, text_bytes, word_spans
from .counts import class_counts, labelled, lower_latin

BITS = 20
LETTER_BYTES = byte_flags([(0x61, 0x7A), (0x80, 0xFF)])
#: Bytes of a word's beginnings that are features beside the word.
BEGINNINGS = (4, 5, 6)
PRIOR = 1000.0
#: Evidence (likelihood ratio statistic) below which a log-odds counts as 0; above it is shrunk by it.
SHRINK = 8.0
DRIFT = 0.15
#: Labelled rows that are learnt from: labels are broadcast up to this number, a hash sample beyond.
MAX_LABELS = 500_000
#: Scored rows that the calibration is fitted on.
MAX_CALIBRATION = 50_000
#: A passage counts if chance gives one as good in a text of its length less often than this.
SIGNIFICANT = 0.01


def features(data: np.ndarray, offsets: np.ndarray):
    """Buckets of each word: the word and its beginnings."""
    data = lower_latin(data)
    starts, ends, first = word_spans(data, offsets, LETTER_BYTES)
    columns = [span_hashes(data, starts, ends)]
    columns += [mix64(span_hashes(data, starts, np.minimum(starts + k, ends)) + np.uint64(k)) for k in BEGINNINGS]
    return (np.stack(columns, 1) >> np.uint64(64 - BITS)).astype(np.int64), first


def log_odds(counts: np.ndarray) -> np.ndarray:
    """Shrunk log-odds of each bucket; counts: rows other, toxic."""
    other, toxic = counts.astype(float)
    share = (other + toxic) / max(1.0, other.sum() + toxic.sum())
    a, b = toxic + PRIOR * share + 1e-9, other + PRIOR * share + 1e-9
    delta = np.log(a / (toxic.sum() + PRIOR)) - np.log(b / (other.sum() + PRIOR))
    gain = lambda n: n * np.log(np.maximum(n, 1e-9) / (share * n.sum() + 1e-12))
    evidence = 2 * (gain(toxic) + gain(other))
    return (delta * np.clip(1 - SHRINK / np.maximum(evidence, 1e-9), 0, 1)).astype(np.float32)


def maximal_segments(scores: np.ndarray) -> list[tuple[int, int, float]]:
    """All maximal scoring segments (start, end, score), by Ruzzo and Tompa's stack; linear time."""
    places = np.flatnonzero(scores > 0)
    sums = np.concatenate([[0.0], np.cumsum(scores, dtype=np.float64)])
    # start, end, sum before, sum after, and the place of the last one below with a smaller sum before
    stack: list[tuple[int, int, float, float, int]] = []
    for i, before, after in zip(places.tolist(), sums[places].tolist(), sums[places + 1].tolist()):
        start, j = i, len(stack) - 1
        while True:
            while j >= 0 and stack[j][2] >= before:
                j = stack[j][4]
            if j < 0 or stack[j][3] >= after:
                stack.append((start, i + 1, before, after, j))
                break
            start, _, before, _, below = stack[j]
            del stack[j:]
            j = below
    return [(a, b, after - before) for a, b, before, after, _ in stack]


@dataclass
class ToxicityModel:
    """weights: score of each bucket; gumbel: (lambda, ln K); curve: calibrated values, probabilities."""

    weights: np.ndarray
    gumbel: tuple[float, float] = (1.0, 0.0)
    curve: tuple[np.ndarray, np.ndarray] = (np.zeros(1), np.zeros(1))

    def word_scores(self, data: np.ndarray, offsets: np.ndarray):
        ids, first = features(data, offsets)
        return self.weights[ids].mean(1, dtype=np.float64) - DRIFT, first

    def best_segments(self, data: np.ndarray, offsets: np.ndarray):
        """The highest segment score of each text, word scores, and words before each text."""
        scores, first = self.word_scores(data, offsets)
        n = np.diff(first)
        text = np.repeat(np.arange(len(n)), n)
        sums = np.cumsum(scores)
        apart = (np.abs(scores).sum() + 1) * text  # keeps the running minimum of one text out of the next
        lowest = np.minimum.accumulate(sums - scores - apart) + apart
        best = np.zeros(len(n))
        np.maximum.at(best, text, sums - lowest)
        return best, scores, first

    def calibrated(self, best: np.ndarray, scores: np.ndarray, first: np.ndarray):
        """The calibrated value of each text, and its maximal segments that are expected less than
        once: first word, end word, score, -ln(expected number)."""
        rate, ln_k = self.gumbel
        value = rate * best - np.log(np.diff(first) + 1.0) - ln_k
        found: list[list[tuple[int, int, float, float]]] = [[] for _ in value]
        for i in np.flatnonzero(value > 0).tolist():
            a, b = int(first[i]), int(first[i + 1])
            chance = math.log(b - a + 1.0) + ln_k
            found[i] = [(start, stop, s, rate * s - chance) for start, stop, s in maximal_segments(scores[a:b]) if rate * s > chance]
            value[i] = sum(x for *_, x in found[i])
        return value, found

    def probability(self, x: np.ndarray) -> np.ndarray:
        """From the curve; a thousandth is left to tell values on a flat part apart."""
        return 0.999 * np.interp(x, *self.curve) + 0.001 / (1 + np.exp(-np.clip(x / 20, -30, 30)))


def fit_gumbel(best: np.ndarray, n: np.ndarray) -> tuple[float, float]:
    """lambda and ln K from the best segments of harmless texts: S - ln(n) / lambda has the quantiles
    (ln K - ln(-ln p)) / lambda of a Gumbel distribution. The median and the ninth decile are matched,
    so that some wrongly labelled texts don't matter."""
    if len(best) < 20 or np.quantile(best, 0.9) <= 0:
        return 1.0, 0.0
    length, rate = np.log(n + 1.0), 1.0
    middle, high = (-np.log(-np.log(p)) for p in (0.5, 0.9))
    for _ in range(100):
        low, top = np.quantile(best - length / rate, [0.5, 0.9])
        rate = 0.5 * rate + 0.5 * float(np.clip((high - middle) / max(1e-6, top - low), 0.05, 50))
    return rate, rate * float(np.quantile(best - length / rate, 0.5)) - middle


def fit_isotonic(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Knots of a rising curve from x to the share of y: neighbouring values are pooled where shares
    fall; each pool's share is that of its rows and one more of the average share."""
    pools: list[list[float]] = []  # [ones, rows, mean x]
    order = np.argsort(x, kind="stable")
    for value, one in zip(x[order].tolist(), y[order].tolist()):
        pools.append([one, 1.0, value])
        while len(pools) > 1 and pools[-2][0] * pools[-1][1] >= pools[-1][0] * pools[-2][1]:
            ones, rows, mean = pools.pop()
            last = pools[-1]
            pools[-1] = [last[0] + ones, last[1] + rows, (last[2] * last[1] + mean * rows) / (last[1] + rows)]
    ones, rows, at = np.array(pools).T
    return at, (ones + y.mean()) / (rows + 1)


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", *, max_labels: int = MAX_LABELS, max_calibration: int = MAX_CALIBRATION) -> ToxicityModel:
    """Learns from labelled texts, by default only from ids with crc32(id) mod 5 of 1 to 4: log-odds
    from 1 to 3, calibration from 4. Texts or labels that are null aren't learnt from. Without any
    toxic or any other text, the model calls nothing toxic."""
    source = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).where("text IS NOT NULL")
    rows = labelled(source, labels, id_col, label_col, max_labels).withColumn("fold", id_mod("id", 5))
    counts = class_counts(rows.where("fold IN (1, 2, 3)").select(F.col("label").alias("cls"), "text"), 2, 1 << BITS, features)
    model = ToxicityModel(log_odds(counts))
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def measure(batches):
        for batch in batches:
            for part in slices(batch, "text"):
                best, _, first = sent.value.best_segments(*text_bytes(part.column("text")))
                yield pa.RecordBatch.from_arrays([pa.array(best), pa.array(np.diff(first).astype(np.int64)), part.column("label")], names=["best", "n", "label"])

    def values(batches):
        model = replace(sent.value, gumbel=gumbel)
        for batch in batches:
            for part in slices(batch, "text"):
                value, _ = model.calibrated(*model.best_segments(*text_bytes(part.column("text"))))
                yield pa.RecordBatch.from_arrays([pa.array(value), part.column("label")], names=["value", "label"])

    part = min(1.0, max_calibration * 5 / max(1, min(labels.count(), max_labels)))
    few = rows.where("fold = 4").where(F.pmod(F.xxhash64("id", F.lit(1)), F.lit(1 << 20)) < int(part * (1 << 20)))
    few = few.select("text", "label")
    got = few.mapInArrow(measure, "best double, n long, label int").toArrow()
    best, n, y = (got.column(c).to_numpy() for c in ("best", "n", "label"))
    if counts.sum(1).min() == 0 or not len(y) or y.min() == y.max():
        return model
    gumbel = fit_gumbel(best[y == 0], n[y == 0])
    got = few.mapInArrow(values, "value double, label int").toArrow()
    return replace(model, gumbel=gumbel, curve=fit_isotonic(*(got.column(c).to_numpy() for c in ("value", "label"))))


def _scored(docs: DataFrame, text: str, model: ToxicityModel, finish, schema: str) -> DataFrame:
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        model = sent.value
        for batch in batches:
            for part in slices(batch, text):
                value, found = model.calibrated(*model.best_segments(*text_bytes(part.column(text))))
                yield finish(part, model.probability(value), found)

    return bounded_batches(docs).mapInArrow(run, schema)


def toxicity_scores(docs: DataFrame, model: ToxicityModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, score (0 to 1) and significant passages (start, stop: words; score; expected: how many such by
    chance) of each row of docs; no shuffle. The score is of all passages expected less than once.

    Words are runs of letters a-z and characters beyond ASCII, in lower case. Null and empty texts
    have no words and get the score of a text without any toxic word. Rows with the same text have the
    same score. Any length is read whole. Other columns are left out.
    """
    source = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32()), ("score", pa.float64()), ("expected", pa.float64())]))

    def finish(part, score, found):
        passages = [[{"start": a, "stop": b, "score": s, "expected": math.exp(-x)} for a, b, s, x in row if math.exp(-x) < SIGNIFICANT] for row in found]
        return pa.RecordBatch.from_arrays([part.column("id"), pa.array(score), pa.array(passages, kind)], names=[id_col, "score", "passages"])

    return _scored(source, "text", model, finish, f"`{id_col}` {source.schema['id'].dataType.simpleString()}, score double, passages array<struct<start:int,stop:int,score:double,expected:double>>")


def without_toxic(docs: DataFrame, model: ToxicityModel, text_col: str = "text", *, threshold: float = 0.5) -> DataFrame:
    """docs, all columns as they are, without rows whose score is `threshold` or more; scores as in
    toxicity_scores()."""
    names = docs.columns
    plain = docs.toDF(*(f"c{i}" for i in range(len(names))))
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in plain.schema)
    return _scored(plain, f"c{names.index(text_col)}", model, lambda part, score, _: part.filter(pa.array(score < threshold)), schema).toDF(*names)


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    model = fit(docs, read_table(spark, sf_dir, "labels"))
    return toxicity_scores(docs, model).select(
        "doc_id", (id_mod("doc_id", 5) == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), F.size("passages").cast("long").alias("n_passages")
    )


QUERIES = {"op8_toxicity": op8_toxicity}
ORACLES: dict[str, str] = {}
