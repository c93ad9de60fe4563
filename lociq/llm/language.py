"""Language identification by multilingual mixture inference.

Each learned language is a distribution over hashed byte trigrams. A word's likelihood under a
language is the product over its trigrams; a document is a mixture of languages that draws a language
for each word. Expectation-maximisation estimates the proportions, for the documents of a batch side
by side. Which languages a document has: its strongest language, then the next strongest as long as the
likelihood, less the penalty of the Bayesian information criterion for each further language, goes
on rising; its language is the largest of that set.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bounded_batches, byte_flags, id_mod, read_table, slices, text_bytes, word_spans
from .counts import class_counts, lower_latin

BUCKETS = 1 << 16
LETTER_BYTES = byte_flags([(0x61, 0x7A), (0x80, 0xFF)])
ASCII_LETTERS = byte_flags([(0x41, 0x5A), (0x61, 0x7A)])
SMOOTHING = 0.5
#: Rounds of EM at most, and the change of a text's proportions below which it is done.
ROUNDS, TOLERANCE = 12, 1e-3
#: Numbers in a model at most: with more languages than MODEL_SIZE / BUCKETS, trigrams share buckets.
MODEL_SIZE, LEAST_BUCKETS = 1 << 25, 1 << 8
UNKNOWN = "und"
CHUNK = 1_000_000


def _word_trigrams(data: np.ndarray, offsets: np.ndarray, buckets: int = BUCKETS):
    """Buckets of the trigrams of all words, where each word's begin, and words before each text.
    Words are runs of letters; a word of n bytes has n + 1 trigrams, with two spaces before and one after it,
    whatever stands around it."""
    low = lower_latin(data)
    starts, ends, first = word_spans(low, offsets, LETTER_BYTES)
    sizes = ends - starts
    before = np.cumsum(sizes) - sizes
    spread = np.full(int(sizes.sum()) + 2 * len(sizes) + 1, 0x20, np.uint8)  # two spaces before each word, one at the end
    letter = np.zeros(len(spread), bool)
    letter[np.arange(int(sizes.sum())) + np.repeat(2 * np.arange(len(sizes)) + 2, sizes)] = True
    spread[letter] = low[LETTER_BYTES[low].astype(bool)]
    code = spread.astype(np.uint32)
    tri = ((code[:-2] << 16 | code[1:-1] << 8 | code[2:]) * np.uint32(2654435761) >> np.uint32(33 - int(buckets).bit_length())).astype(np.int32)
    return tri[letter[2:] | letter[1:-1]], before + np.arange(len(sizes)), first  # up to the space after a word


def features(data: np.ndarray, offsets: np.ndarray, buckets: int = BUCKETS):
    ids, begins, first = _word_trigrams(data, offsets, buckets)
    return ids[:, None], np.append(begins, len(ids))[first]


@dataclass
class LanguageModel:
    names: list[str]
    log_p: np.ndarray  # buckets x languages

    def word_likelihoods(self, data: np.ndarray, offsets: np.ndarray):
        """Log-likelihood of each word under each language, and words before each text."""
        ids, begins, first = _word_trigrams(data, offsets, len(self.log_p))
        if not len(begins):
            return np.zeros((0, len(self.names)), np.float32), first
        return np.add.reduceat(self.log_p[ids], begins, axis=0), first


def _mixture(like: np.ndarray, text: np.ndarray, begins: np.ndarray, n: np.ndarray, pi: np.ndarray, rounds: int):
    """EM for all texts at once, each until its proportions move by less than TOLERANCE, or for so many
    rounds. like: words x languages, pi: texts x languages (0: not in the set). Returns proportions and
    log-likelihoods (without what is common to all sets)."""
    pi = pi.copy()
    at, words, of, first = np.arange(len(pi)), like, text, begins  # texts that still move, and their words
    for _ in range(rounds):
        share = words * pi[at][of]
        share /= share.sum(1, keepdims=True)
        now = np.add.reduceat(share, first, axis=0) / n[at][:, None]
        moves = np.abs(now - pi[at]).max(1) >= TOLERANCE
        pi[at] = now
        if not moves.any():
            break
        if moves.sum() < 0.8 * len(at):
            words, size = words[moves[of]], np.diff(np.append(first, len(of)))[moves]
            at, of, first = at[moves], np.repeat(np.arange(len(size)), size), np.cumsum(size) - size
    return pi, np.add.reduceat(np.log((like * pi[text]).sum(1)), begins)


def infer(loglike: np.ndarray, first: np.ndarray, rounds: int = ROUNDS):
    """Language (-1: no words), its proportion, and the chosen proportions of each text."""
    words = np.diff(first)
    out, sure = np.full(len(words), -1), np.zeros(len(words))
    chosen = np.zeros((len(words), loglike.shape[1]))
    have = np.flatnonzero(words)
    if not len(have):
        return out, sure, chosen
    begins, n = first[have], words[have].astype(float)
    text = np.repeat(np.arange(len(have)), words[have])
    like = np.exp(np.maximum(loglike - loglike.max(1, keepdims=True), -60)).astype(np.float64)
    languages = like.shape[1]
    full, _ = _mixture(like, text, begins, n, np.full((len(have), languages), 1 / languages), rounds)
    rank = np.argsort(np.argsort(-full, axis=1, kind="stable"), axis=1)
    best, best_value = np.zeros_like(full), np.full(len(have), -np.inf)
    on = np.arange(len(have))  # texts whose criterion still rises
    for k in range(1, languages + 1):
        mine = like if len(on) == len(have) else like[np.isin(text, on)]
        sizes = words[have][on]
        pi = np.where(rank[on] < k, np.maximum(full[on], 1e-3), 0)
        pi, value = _mixture(mine, np.repeat(np.arange(len(on)), sizes), np.cumsum(sizes) - sizes, n[on], pi / pi.sum(1, keepdims=True), 0 if k == 1 else rounds // 2)
        value = value - 0.5 * (k - 1) * np.log(n[on] + 1)
        better = value > best_value[on]
        on, pi, value = on[better], pi[better], value[better]
        best[on], best_value[on] = pi, value
        if not len(on):
            break
    top = best.argmax(1)
    out[have], chosen[have] = top, best
    share = np.take_along_axis(np.minimum(best, full + 1 / (n[:, None] + 1)), top[:, None], 1)[:, 0]
    sure[have] = (share * n + 0.5) / (n + 0.5 * languages)
    return out, sure, chosen


def fit(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", *, model_size: int = MODEL_SIZE) -> LanguageModel:
    """One distribution for each non-null value of lang, from all its texts. Rows whose text or lang is
    null aren't learnt from. Without any, the model has no language and calls every text unknown.

    A model has BUCKETS numbers for each language, or half, a quarter, ... of that where there are so many
    languages that they would be more than `model_size` together (down to LEAST_BUCKETS)."""
    rows = docs.select(F.col(text_col).alias("text"), F.col(lang_col).alias("lang")).where("lang IS NOT NULL AND text IS NOT NULL")
    names = sorted(r[0] for r in rows.select("lang").distinct().collect())
    buckets = BUCKETS
    while buckets > LEAST_BUCKETS and buckets * len(names) > model_size:
        buckets //= 2
    numbers = docs.sparkSession.createDataFrame([(name, i) for i, name in enumerate(names)], "name string, cls int")
    counts = class_counts(rows.join(F.broadcast(numbers), F.col("lang").cast("string") == F.col("name")).select("cls", "text"), len(names), buckets, partial(features, buckets=buckets))
    total = counts.sum(1, keepdims=True)
    return LanguageModel(names, np.ascontiguousarray(np.log((counts + SMOOTHING) / (total + SMOOTHING * buckets)).T.astype(np.float32)))


def languages(docs: DataFrame, model: LanguageModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, lang_pred, score (0 to 1) and proportions (of the languages in the chosen set) of each row of
    docs; no shuffle.

    A text without any letter, an empty and a null one are `und` with score 0 and no proportions, and so
    is every text if no language was learnt. Equal languages go to the first in alphabetical order.
    Rows with the same text have the same result. Whole texts are read; other columns are left out.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def lettered(data: np.ndarray, offsets: np.ndarray, texts) -> np.ndarray:
        ascii_before = np.concatenate([[0], np.cumsum(ASCII_LETTERS[data], dtype=np.int64)])
        has = ascii_before[offsets[1:]] > ascii_before[offsets[:-1]]
        for i in np.flatnonzero(~has & (np.diff(offsets) > 0)).tolist():
            has[i] = any(c.isalpha() for c in texts[i].as_py() or "")
        return has

    def run(batches):
        model = sent.value
        names = np.array([*model.names, UNKNOWN], object)
        for batch in batches:
            for part in slices(batch, "text", CHUNK):
                data, offsets = text_bytes(part.column("text"))
                if model.names:
                    top, sure, chosen = infer(*model.word_likelihoods(data, offsets))
                else:
                    top, sure, chosen = np.full(len(part), -1), np.zeros(len(part)), np.zeros((len(part), 0))
                ok = lettered(data, offsets, part.column("text")) & (top >= 0)
                top, sure = np.where(ok, top, len(model.names)), np.where(ok, sure, 0.0)
                which, lang = np.nonzero((chosen > 0) & ok[:, None])
                ends = np.concatenate([[0], np.cumsum(np.bincount(which, minlength=len(part)))]).astype(np.int32)
                items = pa.StructArray.from_arrays([pa.array(names[lang], pa.string()), pa.array(chosen[which, lang])], ["lang", "share"])
                yield pa.RecordBatch.from_arrays([part.column("id"), pa.array(names[top], pa.string()), pa.array(sure), pa.ListArray.from_arrays(ends, items)], names=[id_col, "lang_pred", "score", "proportions"])

    source = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return bounded_batches(source).mapInArrow(run, f"`{id_col}` {source.schema['id'].dataType.simpleString()}, lang_pred string, score double, proportions array<struct<lang:string,share:double>>")


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    model = fit(docs.where(id_mod("doc_id", 4) != 2))
    return languages(docs, model).select("doc_id", (id_mod("doc_id", 4) == 2).alias("held_out"), "lang_pred", "score", F.size("proportions").cast("long").alias("n_languages"))


QUERIES = {"op4_language_id": op4_language_id}
ORACLES: dict[str, str] = {}
