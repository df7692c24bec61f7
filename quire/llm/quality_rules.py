"""Quality rules whose cutoffs carry a risk guarantee.

Every rule compares one measure of a text with a cutoff. Cutoffs are chosen on
labelled good texts, per stratum of text length, so that an exact binomial
bound on the share of good texts that all rules together reject stays under
``risk``. In a stratum the rules are tightened step by step along a path fixed
beforehand; what they reject only grows, so the steps are tested in this order
at the full level until one fails, and only the strata share the level out.
Neighbouring strata with too few texts for any test are one. Copies of a text
are one trial.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField

from quire.llm.common import stored, with_text_columns

SPACE = b" \t\n\x0b\x0c\r"
SYMBOLS = b"#*$%&|<>"
UPPER = bytes(range(ord("A"), ord("Z") + 1))
MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper")
#: Lower ends of the length strata, in words.
STRATA = (0, 100, 200, 400, 800, 1600)


@dataclass(frozen=True)
class Rule:
    """Rejects a text when ``sign * numerator / denominator`` is over the cutoff, in a grid fixed beforehand.

    The grid runs from the most to the least aggressive cutoff."""
    name: str
    numerator: str
    denominator: str
    grid: tuple[float, ...]
    sign: int = 1

    def value(self) -> Column:
        return self.sign * F.col(self.numerator) / F.greatest(F.col(self.denominator), F.lit(1))


RULES = (
    Rule("symbols_per_word", "n_symbols", "n_words", (0.05, 0.1, 0.2, 0.3, 0.5, 0.8, 1.2, 2.0)),
    Rule("upper_share", "n_upper", "word_chars", (0.1, 0.15, 0.2, 0.3, 0.4, 0.5, 0.7)),
    Rule("duplicate_lines", "n_dup_lines", "n_lines", (0.05, 0.1, 0.2, 0.3, 0.5, 0.7)),
    Rule("repeated_words", "n_repeat_words", "n_words", (0.05, 0.1, 0.15, 0.2, 0.3, 0.4)),
    Rule("long_words", "word_chars", "n_words", (8.0, 10.0, 12.0, 15.0, 20.0, 40.0)),
    Rule("short_words", "word_chars", "n_words", (-4.0, -3.5, -3.0, -2.5, -2.0, -1.5), -1),
)
#: Bound on the share of good texts that all rules may reject in a stratum, and the chance that any bound fails.
RISK, DELTA = 0.01, 0.05


def repeated_words(words: list[bytes]) -> int:
    """Words that lie in a three-word window found twice or more."""
    n, seen = len(words), set(words)
    if n < 4 or len(seen) == n:
        return 0
    number = dict(zip(seen, range(len(seen))))
    a = np.fromiter(map(number.__getitem__, words), np.int64, n)
    key = a[:-2] * len(seen) + a[1:-1]
    if len(seen) ** 3 >= 1 << 62:
        key = np.unique(key, return_inverse=True)[1]
    key = key * len(seen) + a[2:]
    order = np.sort(key)
    twice = order[1:][order[1:] == order[:-1]]
    if not len(twice):
        return 0
    hit = np.isin(key, twice)
    cover = np.zeros(n, bool)
    for shift in range(3):
        cover[shift:n - 2 + shift] |= hit
    return int(cover.sum())


def measures_of(text: bytes) -> tuple[int, ...]:
    """The values of MEASURES for one UTF-8 text."""
    words = text.split()
    lines = [x for x in text.split(b"\n") if x.strip(SPACE)]
    solid = text.translate(None, SPACE)
    return (len(words), len(solid.decode("utf-8", "replace")), len(text) - len(text.translate(None, SYMBOLS)),
            len(lines) - len(set(lines)), repeated_words(words), len(lines),
            len(text) - len(text.translate(None, UPPER)))


def measured(docs: DataFrame, text_col: str = "text", prefix: str = "") -> DataFrame:
    """``docs`` with the measures of each whole text appended, their names after ``prefix``."""
    def compute(raw):
        return [pa.array(c, pa.int64()) for c in zip(*map(measures_of, raw))]

    return with_text_columns(docs, text_col, [StructField(prefix + m, LongType()) for m in MEASURES], compute)


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def stratum() -> Column:
    out = F.lit(0)
    for i, low in enumerate(STRATA):
        out = F.when(F.col("n_words") >= low, F.lit(i)).otherwise(out)
    return out


def binomial_tail(k: int, n: int, p: float) -> float:
    """P(X <= k) for X ~ Binomial(n, p). At most delta exactly if the Clopper-Pearson bound at delta is at most p."""
    if k >= n:
        return 1.0
    logs = [math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1)
            + i * math.log(p) + (n - i) * math.log1p(-p) for i in range(k + 1)]
    top = max(logs)
    return min(1.0, math.exp(top) * math.fsum(math.exp(x - top) for x in logs))


def path(rules: tuple[Rule, ...]) -> list[tuple[Rule, float]]:
    """The order in which cutoffs are tested: all rules' least aggressive ones, then all the next ones, and so on."""
    deepest = max(len(r.grid) for r in rules)
    return [(r, r.grid[-1 - i]) for i in range(deepest) for r in rules if i < len(r.grid)]


def merged_strata(sizes: list[int], risk: float, delta: float) -> list[list[int]]:
    """Neighbouring strata, joined until each group has enough texts to pass a test if none is rejected. Looks at sizes
    only, so it changes no error rate; without enough texts in all there are no groups."""
    for parts in range(len(sizes), 0, -1):
        need = math.log(delta / parts) / math.log1p(-risk)
        groups, held = [], []
        for s in range(len(sizes)):
            held.append(s)
            if sum(sizes[i] for i in held) >= need:
                groups.append(held)
                held = []
        if groups:
            groups[-1] += held
        while len(groups) > parts:
            last = groups.pop()
            groups[-1] += last
        if len(groups) == parts:
            return groups
    return []


def chosen_cutoffs(counts: dict[tuple[int, int | None], int], rules: tuple[Rule, ...], risk: float,
                   delta: float) -> dict[tuple[int, str], float]:
    """Cutoffs by (stratum, rule) from how many good texts of a stratum are first rejected at each step of the path."""
    steps = path(rules)
    sizes = [sum(n for (s, _), n in counts.items() if s == i) for i in range(len(STRATA))]
    chosen: dict[tuple[int, str], float] = {}
    groups = merged_strata(sizes, risk, delta)
    for group in groups:
        n, k = sum(sizes[s] for s in group), 0
        for i, (rule, cutoff) in enumerate(steps):
            k += sum(counts.get((s, i), 0) for s in group)
            if binomial_tail(k, n, risk) > delta / len(groups):
                break
            chosen |= {(s, rule.name): cutoff for s in group}
    return chosen


def calibrate(good: DataFrame, rules: tuple[Rule, ...] = RULES, risk: float = RISK,
              delta: float = DELTA) -> dict[tuple[int, str], float]:
    """Cutoffs by (stratum, rule), from the measures of labelled good texts, one row for each different text.

    With a chance of at least 1 - ``delta``, the rules together reject at most a
    share ``risk`` of the good texts of each group of strata. A step of the path
    is taken if the exact binomial test rejects that the share is over ``risk``;
    the first step that fails ends the path. Without enough labels nothing is
    rejected. Only counts come to the driver: one row per stratum and step.
    """
    first = F.lit(None).cast("int")
    for i, (rule, cutoff) in reversed(list(enumerate(path(rules)))):
        first = F.when(rule.value() > cutoff, i).otherwise(first)
    rows = (good.where(~base_failed()).groupBy(stratum().alias("stratum"), first.alias("step"))
            .agg(F.count("*").alias("n")).collect())
    return chosen_cutoffs({(r["stratum"], r["step"]): r["n"] for r in rows}, rules, risk, delta)


def verdict(cutoffs: dict[tuple[int, str], float], rules: tuple[Rule, ...] = RULES) -> Column:
    """True for texts that pass the base rules and every calibrated rule of their stratum."""
    by_name = {r.name: r for r in rules}
    rejected = base_failed()
    for (s, name), cutoff in sorted(cutoffs.items()):
        rejected = rejected | ((stratum() == s) & (by_name[name].value() > cutoff))
    return ~rejected


def good_labels(labels: DataFrame) -> DataFrame:
    """Ids labelled good by every label they have; null ids and null labels teach nothing."""
    return (labels.where("doc_id is not null and quality is not null").groupBy("doc_id")
            .agg(F.min("quality").alias("least")).where("least = 1").select("doc_id"))


def measure_table(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """(doc_id, measures, text_hash) of every row, stored."""
    return stored(measured(docs.select("doc_id", text_col), text_col)
                  .select("doc_id", *MEASURES, F.xxhash64(text_col).alias("text_hash")), "measures")


def good_texts(found: DataFrame, labels: DataFrame) -> DataFrame:
    """The measures of labelled good texts, once for each different text however many copies are labelled."""
    return found.join(good_labels(labels), "doc_id").select("text_hash", *MEASURES).distinct()


def judge(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, measures, base_failed, kept) for every row of ``docs``.

    A null or empty text has no words and fails the base rules. Repeated rows
    are judged each; a null doc_id is judged but has no label. No labels, or an
    empty table, give the base rules alone.
    """
    found = measure_table(docs)
    cutoffs = calibrate(good_texts(found, labels))
    return found.drop("text_hash").withColumn("base_failed", base_failed()).withColumn("kept", verdict(cutoffs))


def accepted(docs: DataFrame, labels: DataFrame, text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, all columns and in its order, that ``judge`` keeps. Texts are measured twice: once to
    calibrate, from a narrow table of measures, and once more beside the rows, so that no text is shuffled."""
    names = docs.columns
    plain = docs.toDF(*[f"c{i}" for i in range(len(names))])
    cutoffs = calibrate(good_texts(measure_table(docs, text_col), labels))
    kept = measured(plain, f"c{names.index(text_col)}").where(verdict(cutoffs))
    return kept.drop(*MEASURES).toDF(*names)
