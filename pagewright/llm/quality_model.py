"""Operator 6, quality classifier: positive-unlabelled learning with the non-negative risk estimator."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagewright.llm.common import hash_sample, map_arrow, split_words, spread, steps, word_hashes
from pagewright.llm.text_stats import text_counts

#: Trusted positives and unlabelled texts that the model is fitted on in the mean (chosen by a hash of doc_id). The unlabelled sample is as much part of
#: a bounded fit as the labelled one; statistics of the corpus are not taken from it, and scoring covers every text.
SAMPLE_POSITIVE, SAMPLE_UNLABELLED = 5_000, 5_000
#: Buckets of hashed words.
WORD_BUCKETS = 256
#: Ratio features as (numerator, denominator, upper edges of the buckets). Fixed values.
SCALES = [
    ("n_symbols", "word_chars", [0.0, 0.002, 0.01, 0.03, 0.06, 0.1, 0.2]),
    ("n_upper", "word_chars", [0.0, 0.01, 0.02, 0.04, 0.08, 0.15, 0.3, 0.6]),
    ("n_digits", "word_chars", [0.0, 0.005, 0.02, 0.05, 0.1, 0.3]),
    ("n_shouts", "word_chars", [0.0, 0.005, 0.02, 0.05, 0.1]),
    ("n_stops", "word_chars", [0.0, 0.01, 0.02, 0.03, 0.04, 0.06, 0.1]),
    ("word_chars", "n_words", [2, 3, 4, 4.5, 5, 5.5, 6, 7, 8]),
    ("n_words", "n_lines", [1, 2, 4, 8, 16, 32, 64, 128]),
    ("n_dup_lines", "n_lines", [0.0, 0.05, 0.1, 0.2, 0.4, 0.7]),
    ("n_repeat_words", "n_words", [0.0, 0.01, 0.05, 0.1, 0.2, 0.4, 0.8]),
    ("n_distinct", "n_words", [0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9]),
    ("n_words", None, [0, 5, 10, 20, 50, 100, 400]),
]
WIDTH = WORD_BUCKETS + sum(len(s[2]) + 1 for s in SCALES) + 1


def features(texts: pa.Array) -> np.ndarray:
    """Dense features of each whole text: shares of hashed words (signed), bucketed ratios, 1. Never id, language or source."""
    counts = text_counts(texts)
    words, starts = split_words(texts, lower=True)
    out = np.zeros((len(texts), WIDTH), np.float32)
    h = word_hashes(words, seed=6)
    text = np.repeat(np.arange(len(texts)), np.diff(starts))
    sign = np.where(h & np.uint64(1), 1.0, -1.0)
    cell = text * WORD_BUCKETS + ((h >> np.uint64(8)) % np.uint64(WORD_BUCKETS)).astype(np.int64)
    share = np.bincount(cell, sign, minlength=len(texts) * WORD_BUCKETS).reshape(len(texts), WORD_BUCKETS)
    out[:, :WORD_BUCKETS] = share / np.maximum(np.linalg.norm(share, axis=1, keepdims=True), 1)
    at = WORD_BUCKETS
    for num, den, edges in SCALES:
        v = counts[num] / np.maximum(counts[den], 1) if den else counts[num].astype(np.float64)
        out[np.arange(len(texts)), at + np.searchsorted(edges, v, side="left")] = 1
        at += len(edges) + 1
    out[:, at] = 1
    return out


def descend(gradient: Callable[[np.ndarray], np.ndarray], width: int, turns: int = 400, rate: float = 0.05) -> np.ndarray:
    """Full-batch Adam from zero."""
    w, m, s = np.zeros(width), np.zeros(width), np.zeros(width)
    for turn in range(1, turns + 1):
        g = gradient(w)
        m, s = 0.9 * m + 0.1 * g, 0.999 * s + 0.001 * g * g
        w = w - rate * (m / (1 - 0.9**turn)) / (np.sqrt(s / (1 - 0.999**turn)) + 1e-8)
    return w


def risk(w: np.ndarray, positive: np.ndarray, unlabelled: np.ndarray, prior: float) -> tuple[float, float, np.ndarray, np.ndarray]:
    """The two parts of the unbiased risk under the logistic loss, and their gradients.

    The first is prior * mean_P loss(+); the second, mean_U loss(-) - prior * mean_P loss(-), stands for the risk on negatives.
    """
    zp, zu = positive @ w, unlabelled @ w
    sp, su = 1 / (1 + np.exp(-zp)), 1 / (1 + np.exp(-zu))
    on_positive = prior * np.logaddexp(0, -zp).mean()
    on_negative = np.logaddexp(0, zu).mean() - prior * np.logaddexp(0, zp).mean()
    return on_positive, on_negative, prior * (positive.T @ (sp - 1)) / len(zp), unlabelled.T @ su / len(zu) - prior * (positive.T @ sp) / len(zp)


def fit(positive: np.ndarray, unlabelled: np.ndarray, prior: float, decay: float = 1e-4) -> np.ndarray:
    """Weights that minimise the non-negative risk: where the part on negatives falls below 0, its gradient is reversed, as in the published method."""
    if not len(positive) or not len(unlabelled):
        return np.zeros(positive.shape[1])

    def gradient(w: np.ndarray) -> np.ndarray:
        _, on_negative, g_pos, g_neg = risk(w, positive, unlabelled, prior)
        return (g_pos + g_neg if on_negative >= 0 else -g_neg) + decay * w

    return descend(gradient, positive.shape[1])


def estimate_prior(positive: np.ndarray, unlabelled: np.ndarray, decay: float = 1e-3, slack: float = 0.1) -> float:
    """The share of positives among the unlabelled, from both samples and no negative label.

    A classifier of positives against unlabelled is fitted on one half of each. On the other half, the share of unlabelled
    above a score over the share of positives above it is no less than the prior, and is the prior where
    only positives score so high; the score is chosen where this ratio and its confidence bound (at ``slack``) are least.
    """
    if len(positive) < 4 or len(unlabelled) < 4:
        return 0.5
    p, u, held_p, held_u = positive[::2], unlabelled[::2], positive[1::2], unlabelled[1::2]

    def gradient(w: np.ndarray) -> np.ndarray:
        sp, su = 1 / (1 + np.exp(-(p @ w))), 1 / (1 + np.exp(-(u @ w)))
        return p.T @ (sp - 1) / len(p) + u.T @ su / len(u) + decay * w

    w = descend(gradient, positive.shape[1], turns=200)
    zp, zu = np.sort(held_p @ w), np.sort(held_u @ w)
    above_p = 1 - np.searchsorted(zp, zp) / len(zp)
    above_u = 1 - np.searchsorted(zu, zp) / len(zu)
    bound = sum(np.sqrt(np.log(4 / slack) / (2 * n)) for n in (len(zp), len(zu)))
    best = int(np.argmin((above_u + bound) / above_p))
    return float(np.clip(above_u[best] / above_p[best], 0.01, 0.99))


def held_out(doc_id: str = "doc_id"):
    """Rows whose labels are never learned from: crc32 of the id as text leaves 1 modulo 3. A null id is not held out."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def score_quality(docs: DataFrame, labels: DataFrame, sample_positive: int = SAMPLE_POSITIVE, sample_unlabelled: int = SAMPLE_UNLABELLED) -> DataFrame:
    """``held_out, score, predicted`` of every whole text, one row for each row of ``docs``.

    The class prior is estimated from the trusted positives and the unlabelled texts (:func:`estimate_prior`); labels of class 0 are
    never used. ``class_prior`` says what it came to. The two samples are bounded, chosen by a hash over all ids, one row an id (that with the least hash of its text), and the only data that reach the driver;
    scoring is one pass without a shuffle. Without positives every score is 0.5. Null texts count as
    empty and are scored; labels without a class are left out; of repeated labels the lowest counts. Other columns are not read; an empty
    table gives no rows; repeated rows get one score each; texts of any length are scored whole.
    """
    taught = labels.filter("quality is not null and doc_id is not null").filter(~held_out()).groupBy("doc_id").agg(F.min("quality").alias("quality"))
    chosen_p = hash_sample(taught.filter("quality >= 1"), sample_positive, salt=6).select("doc_id", F.lit(True).alias("trusted"))
    ids = docs.select("doc_id").filter(~held_out() & F.col("doc_id").isNotNull()).distinct()
    chosen_u = hash_sample(ids, sample_unlabelled, salt=7).select("doc_id", F.lit(False).alias("trusted"))
    chosen, keyed = F.broadcast(chosen_p.unionByName(chosen_u)), docs.select("doc_id", "text", F.xxhash64("text").alias("text_key"))
    least = keyed.select("doc_id", "text_key").join(chosen, "doc_id").groupBy("doc_id", "trusted").agg(F.min("text_key").alias("text_key"))
    sample = keyed.join(F.broadcast(least), ["doc_id", "text_key"])

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[tuple] = set()
        for b in steps(batches, "text"):
            names = zip(b.column("doc_id").to_pylist(), b.column("trusted").to_pylist(), strict=True)
            b = b.filter(pa.array([n not in seen and not seen.add(n) for n in names], pa.bool_()))  # rows that repeat id and text
            x = features(b.column("text"))
            yield pa.RecordBatch.from_arrays([b.column("doc_id").cast(pa.string()), b.column("trusted"), pa.array([r.tobytes() for r in x], pa.binary())], ["doc_id", "trusted", "x"])

    rows = sorted(map_arrow(sample.select("doc_id", "trusted", "text"), extract, "doc_id string, trusted boolean, x binary").dropDuplicates(["doc_id", "trusted"]).collect())
    of = lambda trusted: np.frombuffer(b"".join(r.x for r in rows if r.trusted == trusted), np.float32).reshape(-1, WIDTH)
    prior = estimate_prior(of(True), of(False))
    weights = fit(of(True), of(False), prior)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in steps(batches, "text"):
            z = features(b.column("text")) @ weights
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(1 / (1 + np.exp(-np.clip(z, -50, 50))))], ["doc_id", "score"])

    narrow = docs.select("doc_id", "text")
    out = map_arrow(spread(narrow), score, f"doc_id {narrow.schema['doc_id'].dataType.simpleString()}, score double")
    return out.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), F.lit(prior).alias("class_prior"))
