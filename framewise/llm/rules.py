"""Quality rules: a decision list learned from labelled text statistics.

Statistics are counted over whole texts in Arrow batches. Sequential covering learns the list from a
bounded sample of labelled rows: a rule is grown, one threshold at a time, on two thirds of the rows
that no rule covers yet, pruned on the other third, and kept while it is precise there. The rules
become one ordered Spark conditional expression over the statistics.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bounded_rows, tidied

SYMBOLS = "[#*$%&|<>]"
SPACES = "\t\n\x0b\x0c\r "
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_upper", "n_marks")
#: Ratios that rules may test: name -> (count, count it is divided by).
RATIOS = {
    "word_length": ("word_chars", "n_words"), "symbol_ratio": ("n_symbols", "n_words"), "dup_line_ratio": ("n_dup_lines", "n_words"),
    "repeat_ratio": ("n_repeat_words", "n_words"), "upper_ratio": ("n_upper", "word_chars"), "mark_ratio": ("n_marks", "n_words"),
}
#: Labelled rows that the rules are learned from, at most: those of the smallest hashed ids.
SAMPLE_ROWS = 20_000


def repeated_words(words: list[bytes]) -> int:
    """Words inside 3-word windows that occur twice or more in the text."""
    if len(words) < 4:
        return 0
    number: dict[bytes, int] = {}
    ids = np.fromiter((number.setdefault(w, len(number)) for w in words), np.int64, len(words))
    pair = np.unique(ids[:-1] * len(number) + ids[1:], return_inverse=True)[1]
    _, window, times = np.unique(pair[:-1] * len(number) + ids[2:], return_inverse=True, return_counts=True)
    twice = times[window] > 1
    covered = np.zeros(len(words), bool)
    for k in range(3):
        covered[k : k + len(twice)] |= twice
    return int(covered.sum())


def count_text(text: str | None) -> tuple[int, ...]:
    """COUNTS of one text; a null counts as empty."""
    if not text:
        return (0,) * len(COUNTS)
    words = text.encode("utf-8", "surrogatepass").split()  # bytes split at ASCII white space only
    lines = [x for x in text.split("\n") if x.strip(SPACES)] if "\n" in text else ()
    return (
        len(words), len(text) - sum(map(text.count, SPACES)), sum(map(text.count, SYMBOLS[1:-1])), len(lines) - len(set(lines)),
        repeated_words(words), sum(map(str.isupper, text)), text.count("!") + text.count("?"),
    )


def with_counts(docs: DataFrame, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """``keep`` (all columns by default) and COUNTS. A column of docs named like a count is replaced."""
    kept = [c for c in (docs.columns if keep is None else keep) if c not in COUNTS]
    source = docs.select(*[F.col(f"`{c}`") for c in kept], F.col(text_col).alias("__text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [count_text(t.as_py()) for t in batch.column(batch.num_columns - 1)]
            columns = zip(*rows, strict=True) if rows else [()] * len(COUNTS)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *(pa.array(c, pa.int64()) for c in columns)], names=[*kept, *COUNTS])

    schema = source.drop("__text").schema
    for c in COUNTS:
        schema = schema.add(c, "long")
    return source.mapInArrow(tidied(run), schema)


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


@dataclass(frozen=True)
class Rule:
    """Rejects rows for which every (statistic, is_at_least, threshold) holds."""

    tests: tuple[tuple[str, bool, float], ...]

    def holds(self, x: dict[str, np.ndarray]) -> np.ndarray:
        return np.logical_and.reduce([x[n] >= t if up else x[n] < t for n, up, t in self.tests])

    def column(self) -> Column:
        out = F.lit(True)
        for n, up, t in self.tests:
            out = out & (statistic(n) >= t if up else statistic(n) < t)
        return out


def statistic(name: str) -> Column:
    if name in RATIOS:
        a, b = RATIOS[name]
        return F.when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(0.0)
    return F.col(name).cast("double")


def gain(inside: np.ndarray, bad: np.ndarray, before: float) -> float:
    p = int((inside & bad).sum())
    n = int(inside.sum())
    return p * (np.log2((p + 1) / (n + 2)) - before) if p else -np.inf


def grow(x: dict[str, np.ndarray], bad: np.ndarray, most_tests: int) -> Rule:
    """Adds the threshold of largest information gain until no bad row is joined by a good one."""
    tests: tuple = ()
    inside = np.ones(len(bad), bool)
    while len(tests) < most_tests and (inside & ~bad).any():
        before = np.log2((int((inside & bad).sum()) + 1) / (int(inside.sum()) + 2))
        best = (1e-9, None, None)
        for name, v in x.items():
            cuts = np.unique(np.quantile(v[inside & bad], np.linspace(0, 1, 33))) if (inside & bad).any() else ()
            for t in cuts:
                for up in (True, False):
                    held = inside & (v >= t if up else v < t)
                    if (g := gain(held, bad, before)) > best[0]:
                        best = (g, (name, up, float(t)), held)
        if best[1] is None:
            break
        (name, up, t), held = best[1:]
        v = x[name]
        apart = v[inside & ~held]  # the threshold goes half way to the nearest row left out
        t = (t + float(apart.max() if up else apart.min())) / 2 if len(apart) and up else (t + float(v[held].max())) / 2 if len(apart) else t
        tests, inside = (*tests, (name, up, t)), held
    return Rule(tests)


def worth(rule: Rule, x: dict[str, np.ndarray], bad: np.ndarray) -> float:
    held = rule.holds(x) if rule.tests else np.ones(len(bad), bool)
    p, n = int((held & bad).sum()), int((held & ~bad).sum())
    return (p - n) / max(p + n, 1)


def learn_rules(x: dict[str, np.ndarray], bad: np.ndarray, most_rules: int = 12, most_tests: int = 4, precision: float = 0.9, least_rows: int = 3) -> list[Rule]:
    """Sequential covering over the statistics ``x`` of labelled rows; ``bad`` marks those to reject."""
    rules: list[Rule] = []
    part = np.arange(len(bad)) % 3 == 2
    left = np.ones(len(bad), bool)
    while len(rules) < most_rules and (left & ~part & bad).sum() >= least_rows:
        fit, check = left & ~part, left & part
        rule = grow({k: v[fit] for k, v in x.items()}, bad[fit], most_tests)
        xc, bc = {k: v[check] for k, v in x.items()}, bad[check]
        while len(rule.tests) > 1 and worth(shorter := Rule(rule.tests[:-1]), xc, bc) >= worth(rule, xc, bc):
            rule = shorter
        if not rule.tests:
            break
        held = left & rule.holds(x)
        n = int(held.sum())
        if n < least_rows or int((held & bad).sum()) < precision * n:
            break
        rules.append(rule)
        left &= ~held
    return rules


def labelled_counts(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS) -> DataFrame:
    """Counts and quality of at most ``rows`` different labelled rows, chosen by hashed id."""
    chosen = labels.where("quality is not null and doc_id is not null").groupBy("doc_id").agg(F.min("quality").alias("quality"))
    chosen = chosen.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    labelled = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")  # at most ``rows`` ids
    return with_counts(bounded_rows(labelled, "doc_id", "text", rows, "quality"), keep=["doc_id", "quality"])


def fit_rules(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS) -> list[Rule]:
    """Learns the list from at most ``rows`` labelled documents; without any the list is empty.

    Rows that the fixed base test already rejects teach nothing and are left out.
    """
    got = labelled_counts(docs, labels, rows).where(~base_failed()).toPandas()
    got = got.sort_values(["doc_id", *COUNTS]).reset_index(drop=True)
    if got.empty or got["quality"].nunique() < 2:
        return []
    x = {c: got[c].to_numpy(float) for c in COUNTS}
    x |= {n: np.divide(x[a], x[b], out=np.zeros(len(got)), where=x[b] > 0) for n, (a, b) in RATIOS.items()}
    x = {n: x[n] for n in RATIOS}
    return learn_rules(x, got["quality"].to_numpy() == 0)


def verdict(rules: list[Rule]) -> Column:
    """The ordered conditional expression: the first rule that holds rejects, else the row is kept."""
    out = F.when(base_failed(), F.lit(False))
    for rule in rules:
        out = out.when(rule.column(), F.lit(False))
    return out.otherwise(F.lit(True))


def fired(rules: list[Rule]) -> Column:
    """Number of the rule that rejects: 0 for the base test, 1 and up for learned ones, null if none."""
    out = F.when(base_failed(), F.lit(0))
    for i, rule in enumerate(rules, 1):
        out = out.when(rule.column(), F.lit(i))
    return out.otherwise(F.lit(None).cast("int"))


def quality_rules(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS) -> DataFrame:
    """doc_id, COUNTS, base_failed, kept and rule per row of ``docs``.

    A null or empty text has zero counts and fails the base test. Repeated rows and null ids are scored as
    they are; labels of null id or quality teach nothing; extra columns are not read.
    """
    rules = fit_rules(docs, labels, rows)
    counted = with_counts(docs, keep=["doc_id"])
    return counted.withColumn("base_failed", base_failed()).withColumn("kept", verdict(rules)).withColumn("rule", fired(rules))
