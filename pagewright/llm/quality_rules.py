"""Operator 8, quality rules: base counts, and a decision list learned by sequential covering."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagewright.llm.common import hash_sample, save
from pagewright.llm.text_stats import BASE, with_text_counts

#: Ratios that rules may test: name, numerator, denominator.
RATIOS = [
    ("symbol_share", "n_symbols", "word_chars"),
    ("upper_share", "n_upper", "word_chars"),
    ("digit_share", "n_digits", "word_chars"),
    ("shout_share", "n_shouts", "word_chars"),
    ("stop_share", "n_stops", "word_chars"),
    ("word_length", "word_chars", "n_words"),
    ("line_words", "n_words", "n_lines"),
    ("dup_line_share", "n_dup_lines", "n_lines"),
    ("repeat_share", "n_repeat_words", "n_words"),
    ("distinct_share", "n_distinct", "n_words"),
]
#: Labelled rows that a list is learned from in the mean (chosen by a hash of doc_id).
SAMPLE_ROWS = 20_000
#: A rule must be right for this share of the rows it covers, in the growing and in the pruning part, and cover so many.
PRECISION, SUPPORT = 0.9, 8

Rule = list[tuple[str, str, float]]


def ratios(df: DataFrame) -> DataFrame:
    """Add the ratios; a ratio over nothing is 0."""
    return df.withColumns({name: F.when(F.col(d) > 0, F.col(n) / F.col(d)).otherwise(F.lit(0.0)) for name, n, d in RATIOS})


def _covers(rule: Rule, x: pd.DataFrame) -> np.ndarray:
    out = np.ones(len(x), bool)
    for name, op, t in rule:
        v = x[name].to_numpy()
        out &= v >= t if op == ">=" else v < t
    return out


def _grow(x: pd.DataFrame, y: np.ndarray, names: list[str], most: int) -> Rule:
    """Add the threshold with the most information gained for the covered target rows, until only these are covered."""
    rule: Rule = []
    inside = np.ones(len(x), bool)
    while len(rule) < most:
        p, n = int(y[inside].sum()), int((~y[inside]).sum())
        if not p or not n:
            break
        before, best = np.log2(p / (p + n)), (1e-9, None)
        for name in names:
            v = x[name].to_numpy()[inside]
            t = y[inside]
            order = np.argsort(v, kind="stable")
            v, t = v[order], t[order]
            cut = np.flatnonzero(np.diff(v) > 0) + 1
            below = np.cumsum(t)[cut - 1]
            for op, pos, size in (("<", below, cut), (">=", p - below, len(v) - cut)):
                with np.errstate(divide="ignore", invalid="ignore"):
                    gain = np.where(pos > 0, pos * (np.log2(pos / size) - before), 0)
                if len(gain) and gain.max() > best[0]:
                    k = int(gain.argmax())
                    best = (float(gain[k]), (name, op, float((v[cut[k] - 1] + v[cut[k]]) / 2)))
        if best[1] is None:
            break
        rule.append(best[1])
        inside &= _covers([best[1]], x)
    return rule


def _prune(rule: Rule, x: pd.DataFrame, y: np.ndarray) -> Rule:
    """The shortest beginning of the rule that is worth most on rows it was not grown on."""

    def worth(r: Rule) -> float:
        c = _covers(r, x)
        return (int(y[c].sum()) - int((~y[c]).sum())) / max(1, int(c.sum()))

    return max((rule[:k] for k in range(len(rule), 0, -1)), key=lambda r: (round(worth(r), 6), -len(r)), default=[])


def learn_list(rows: pd.DataFrame, target: str = "bad", most_rules: int = 12, most_tests: int = 4) -> list[Rule]:
    """Ordered conjunctions for the target rows by sequential covering: grow on two thirds, prune on the rest, remove what is covered.

    The order of the rows decides the parts, so sort them. Stops at the first rule that is not precise enough; no rows or one class: no rules.
    """
    names = [r[0] for r in RATIOS]
    x, y, rules = rows[names].reset_index(drop=True), rows[target].to_numpy(bool), []
    left = np.ones(len(x), bool)
    part = np.arange(len(x)) % 3 == 2
    while len(rules) < most_rules and (y & left).sum() >= SUPPORT:
        g, p = left & ~part, left & part
        rule = _prune(_grow(x[g], y[g], names, most_tests), x[p], y[p])
        if not rule:
            break
        c, cp = _covers(rule, x) & left, _covers(rule, x) & p
        if c.sum() < SUPPORT or y[c].mean() < PRECISION or not cp.any() or y[cp].mean() < PRECISION:
            break
        rules.append(rule)
        left &= ~c
    return rules


def as_expression(rules: list[Rule]) -> Column:
    """The list as one ordered conditional: the first rule that fits rejects, none keeps."""
    test = {">=": lambda n, t: F.col(n) >= F.lit(t), "<": lambda n, t: F.col(n) < F.lit(t)}
    conditions = [reduce(lambda a, b: a & b, (test[op](n, t) for n, op, t in rule)) for rule in rules]
    if not conditions:
        return F.lit(True)
    out = F.when(conditions[0], F.lit(False))
    for c in conditions[1:]:
        out = out.when(c, F.lit(False))
    return out.otherwise(F.lit(True))


def judge_quality(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS, with_key: bool = False) -> DataFrame:
    """Base counts, ``base_failed`` and ``kept`` of every document, one row for each row of ``docs``; ``with_key`` adds a hash of the text.

    One pass over the whole texts gives narrow counts, which are saved; the labels join these, never the
    texts. The list is learned on the driver from about ``sample_rows`` labelled rows, one an id, and applied as an
    expression. Null or empty texts have no words, so the base rule fails them. Null ids and labels
    without a class teach nothing; without labels only the base rule counts. Other columns are not read. Repeated rows get one
    result each, an empty table none; texts of any length are counted whole.
    """
    counts = ratios(save(with_text_counts(docs), "text-counts"))
    taught = labels.filter("quality is not null and doc_id is not null").groupBy("doc_id").agg(F.min("quality").alias("quality"))
    sample = hash_sample(taught, sample_rows)
    names = [r[0] for r in RATIOS]
    labelled = counts.join(sample, "doc_id").select("doc_id", F.struct("text_key", (F.col("quality") < 1).alias("bad"), *names).alias("row"))
    once = labelled.groupBy("doc_id").agg(F.min("row").alias("row"))  # of rows that repeat an id, that with the least hash of its text
    rows = once.select("doc_id", F.xxhash64("doc_id").alias("turn"), "row.bad", *[f"row.{n}" for n in names]).toPandas().sort_values(["turn", "doc_id", "word_length"]).reset_index(drop=True)
    verdict = as_expression(learn_list(rows))
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    return counts.withColumn("base_failed", failed).select("doc_id", *BASE, "base_failed", (~F.col("base_failed") & verdict).alias("kept"), *["text_key"] * with_key)
