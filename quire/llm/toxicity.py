"""Toxicity: a support vector machine over a subsequence string kernel with Nystroem landmarks.

The kernel counts the letter triples that two words share in order, each
weighted by DECAY for every character skipped, so insults with gaps or
inserted characters stay close to their plain forms. A sentence is as toxic as
its worst word. Labels are per document: words that stand out in toxic
documents begin as witnesses, and each round of training takes as witnesses
the worst words of toxic sentences against the worst of clean ones.

A linear function of the Nystroem features is a linear function of the
triples, so the trained machine is one table of weights over triples, and a
text is scored in a few vector operations per character.
"""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField

from quire.llm.common import labelled_sample, with_text_columns

#: Weight of each skipped character, and the longest stretch that a triple spans.
DECAY, SPAN = 0.5, 7
#: Landmarks taken from words that stand out in toxic documents, and from common words.
TOXIC_LANDMARKS, COMMON_LANDMARKS = 160, 64
#: Bounds on the labelled rows of one class, and on the clean words, that train the machine.
TRAIN_PER_CLASS, TRAIN_WORDS = 2_500, 8_000
#: Rounds of training, clean words that each adds at most for their wrong margin, and the weight of a witness.
ROUNDS, HARD_WORDS, WITNESS_WEIGHT = 4, 2_000, 8.0
SEED = 11
#: Log-likelihood ratio from which a word stands out (chi-square, under one in a million, as so many words are tried).
STANDS_OUT = 25.0
RIDGE, COST = 1e-3, 10.0
CODES = 64
SPACED = re.compile(r"(?:(?<=\s)|^)(?:\w[\s.\-_*]){2,}\w(?=\s|$)")


def _alphabet() -> np.ndarray:
    """A code for each character below U+10000: 0 for white space, 1 for other signs, letters and digits from 2."""
    table = np.ones(1 << 16, np.int32)
    for c in range(1 << 16):
        ch = chr(c)
        if ch.isspace():
            table[c] = 0
        elif "a" <= ch <= "z":
            table[c] = 2 + c - ord("a")
        elif ch.isalnum():
            table[c] = 28 + c % (CODES - 28)
    return table


def prepared(text: str) -> str:
    """Lower case, white space as single spaces, with letters that were spaced out joined again, inside two spaces."""
    t = " ".join(text.lower().split())
    if SPACED.search(t):
        t = SPACED.sub(lambda m: re.sub(r"[\s.\-_*]", "", m.group()), t)
    return f" {t} "


class Triples:
    """The triples of prepared texts, by pairs of offsets."""

    def __init__(self):
        self.alphabet = _alphabet()

    def codes(self, text: str) -> np.ndarray:
        """Codes of a prepared text; signs are left out, so they neither part nor change a word."""
        points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
        codes = self.alphabet[np.minimum(points, 0xFFFF)]
        return codes[codes != 1]

    def each(self, c: np.ndarray):
        """(start positions' mask, triple numbers, weight) for each pair of offsets; no triple crosses white space."""
        gaps = np.cumsum(c == 0)
        high, mid = c * (CODES * CODES), c * CODES
        for last in range(2, SPAN):
            n = len(c) - last
            if n <= 0:
                return
            inside = gaps[last - 1:last - 1 + n] == gaps[:n]
            ends = high[:n] + c[last:]
            for middle in range(1, last):
                yield inside, ends + mid[middle:middle + n], DECAY ** (last - 2)


TRIPLES = CODES ** 3


def norms(length: np.ndarray) -> np.ndarray:
    """Length of a word's kernel vector, by its characters and the space before, as if no triple came twice."""
    n = length.astype(np.float32) + 1
    total = np.full(len(n), 1e-3, np.float32)
    for last in range(2, SPAN):
        total += np.maximum(n - last, 0) * ((last - 1) * DECAY ** (2 * (last - 2)))
    return np.sqrt(total)


class StringSvm:
    """weights over triples, a bias, and the logistic that turns the worst words and their number into a score."""

    def __init__(self, weights: np.ndarray, bias: float):
        self.weights, self.bias = weights.astype(np.float32), bias
        self.logistic = (np.zeros(3), np.zeros(3), np.ones(3))
        self.triples = Triples()

    def word_margins(self, text: str) -> np.ndarray:
        """The machine's margin for each word of a prepared text, in order."""
        c = self.triples.codes(text)
        total = np.zeros(len(c), np.float32)
        for inside, triple, weight in self.triples.each(c):
            total[:len(triple)] += self.weights[triple] * inside * np.float32(weight)
        first = np.flatnonzero(c[:-1] == 0)
        if not len(first):
            return np.zeros(0, np.float32)
        return np.add.reduceat(total, first) / norms(np.diff(np.append(first, len(c) - 1))) + self.bias

    def facts(self, text: str) -> tuple[float, float, float]:
        """Of a whole text: its two greatest margins, and the log of the number of words over zero."""
        t = prepared(text)
        if not t.strip():
            return -1.0, -1.0, 0.0
        margins = np.clip(self.word_margins(t), -1, 1)
        top = np.sort(margins)[-2:]
        return float(top[-1]), float(top[0]), float(np.log1p((margins > 0).sum()))

    def score(self, text: str) -> float:
        w, mean, scale = self.logistic
        z = (np.array([*self.facts(text)]) - mean) / scale
        return float(1 / (1 + np.exp(-np.clip(z @ w + self.offset, -30, 30))))

    offset = 0.0


def _features(words: list[str], triples: Triples, number: np.ndarray, table: np.ndarray) -> np.ndarray:
    """Kernel of each word with each landmark: table holds the landmarks' weights by triple number."""
    out = np.zeros((len(words), table.shape[1]), np.float32)
    for at in range(0, len(words), 2_000):
        part = words[at:at + 2_000]
        c = triples.codes(" " + " ".join(part) + " ")
        word = np.cumsum(c == 0) - 1
        for inside, triple, weight in triples.each(c):
            known = number[triple]
            hit = np.flatnonzero(inside & (known >= 0))
            np.add.at(out, at + word[hit], table[known[hit]] * np.float32(weight))
        first = np.flatnonzero(c[:-1] == 0)
        out[at:at + len(part)] /= norms(np.diff(np.append(first, len(c) - 1)))[:, None]
    return out


def _triple_table(words: list[str], triples: Triples) -> tuple[np.ndarray, np.ndarray]:
    """Numbers for the triples of the words, and each word's weight of each (triples by words)."""
    found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    c = triples.codes(" " + " ".join(words) + " ")
    word = np.cumsum(c == 0) - 1
    for inside, triple, weight in triples.each(c):
        at = np.flatnonzero(inside)
        found.append((triple[at], word[at], np.full(len(at), weight)))
    triple, word, weight = (np.concatenate(x) for x in zip(*found))
    used, row = np.unique(triple, return_inverse=True)
    number = np.full(TRIPLES, -1, np.int32)
    number[used] = np.arange(len(used))
    table = np.zeros((len(used), len(words)), np.float32)
    np.add.at(table, (row, word), weight)
    return number, table


def _svm(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Linear squared-hinge machine (the last entry is the bias) by Newton steps on the rows inside the margin."""
    x = np.hstack([x, np.ones((len(x), 1))])
    w = np.zeros(x.shape[1])
    ridge = np.eye(len(w))
    ridge[-1, -1] = 1e-6
    for _ in range(25):
        inside = y * (x @ w) < 1
        a = x[inside] * weight[inside, None]
        new = np.linalg.solve(ridge + COST * a.T @ x[inside], COST * a.T @ y[inside])
        if np.allclose(new, w, atol=1e-6):
            break
        w = new
    return w


def standing_out(toxic: list[set], clean: list[set]) -> list[tuple[float, str]]:
    """(log-likelihood ratio, word) of the words that more toxic than clean documents hold, strongest first."""
    a, b = Counter(), Counter()
    for words in toxic:
        a.update(words)
    for words in clean:
        b.update(words)
    na, nb = len(toxic), len(clean)
    out = []
    for word, k in a.items():
        m = b[word]
        if k < 3 or k * nb <= m * na:
            continue
        expected = (k + m) * na / (na + nb)
        ratio = 2 * (k * np.log(k / expected) + (m * np.log(m / (k + m - expected)) if m else 0))
        if ratio >= STANDS_OUT:
            out.append((float(ratio), word))
    return sorted(out, key=lambda x: (-x[0], x[1]))


def _logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, float]:
    """Lightly penalised logistic regression by Newton steps."""
    x = np.hstack([x, np.ones((len(x), 1))])
    w = np.zeros(x.shape[1])
    ridge = np.diag([1.0] * (len(w) - 1) + [1e-3])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (weight * p * (1 - p))[:, None]).T @ x + ridge,
                               x.T @ (weight * (y - p)) - ridge @ w)
        w = w + step
        if np.abs(step).max() < 1e-8:
            break
    return w[:-1], float(w[-1])


def bare_words(text: str) -> set[str]:
    """The words of a prepared text without signs."""
    return {w for w in (re.sub(r"[\W_]+", "", x) for x in set(text.split())) if w}


def with_insertions(word: str, rng: np.random.Generator) -> list[str]:
    """Two forms of a longer word, each with one letter put in."""
    if len(word) < 4:
        return []
    letters = "abcdefghijklmnopqrstuvwxyz"
    places = rng.integers(1, len(word), 2)
    return [word[:p] + letters[rng.integers(26)] + word[p:] for p in places]


def train_machine(toxic: list[str], clean: list[str], seed: int) -> StringSvm | None:
    """The machine over words, from prepared texts of both classes; None if no word stands out."""
    rng = np.random.default_rng(seed)
    clean_words = [bare_words(t) for t in clean]
    marked = [w for _, w in standing_out([bare_words(t) for t in toxic], clean_words)]
    common = Counter(w for words in clean_words for w in words)
    vocabulary = sorted(common)
    if not marked or not vocabulary:
        return None
    triples = Triples()
    usual = [w for w, _ in common.most_common(COMMON_LANDMARKS)]
    number, table = _triple_table(marked[:TOXIC_LANDMARKS] + usual, triples)
    table /= np.maximum(np.sqrt((table ** 2).sum(0)), 1e-6)
    values, vectors = np.linalg.eigh((table.T @ table).astype(np.float64))
    root = vectors / np.sqrt(np.maximum(values, RIDGE)) @ vectors.T
    picked = rng.choice(len(vocabulary), min(TRAIN_WORDS, len(vocabulary)), replace=False)
    negative = ({vocabulary[i] for i in picked} | set(usual)) - set(marked)
    everything = " " + " ".join(vocabulary) + " "
    witness = marked + [v for w in marked[:TOXIC_LANDMARKS] for v in with_insertions(w, rng) if v not in common]
    machine = None
    for _ in range(ROUNDS):
        words = witness + sorted(negative)
        y = np.where(np.arange(len(words)) < len(witness), 1.0, -1.0)
        weight = np.where(y > 0, WITNESS_WEIGHT, 1.0)
        w = _svm(_features(words, triples, number, table) @ root, y, weight)
        dense = np.zeros(TRIPLES)
        dense[number >= 0] = table @ (root @ w[:-1])
        machine = StringSvm(dense, float(w[-1]))
        margins = machine.word_margins(everything)
        worst = np.argsort(-margins, kind="stable")[:HARD_WORDS]
        negative |= {vocabulary[i] for i in worst if margins[i] > -0.9} - set(marked)
    return machine


def train(sample: list[tuple[int, str, int]], prior: float | None = None, seed: int = SEED) -> StringSvm:
    """Fit on (id, text, label) rows; equal texts count once.

    The logistic learns from margins that machines trained on the other half
    of the rows give; the machine that is returned has seen all rows. Without
    words that stand out, every score is the prior.
    """
    rows = sorted({(label, prepared(text)) for _, text, label in sample})
    by_class = {k: [t for label, t in rows if label == k] for k in (0, 1)}
    p = min(max(0.1 if prior is None else prior, 1e-3), 1 - 1e-3)
    machine = train_machine(by_class[1], by_class[0], seed)
    if machine is None:
        machine = StringSvm(np.zeros(TRIPLES), -1.0)
        machine.offset = float(np.log(p / (1 - p)))
        return machine
    x, y = [], []
    for half in (0, 1):
        other = train_machine(by_class[1][1 - half::2], by_class[0][1 - half::2], seed) or machine
        for label in (0, 1):
            x += [other.facts(t) for t in by_class[label][half::2]]
            y += [label] * len(by_class[label][half::2])
    x, y = np.array(x), np.array(y, float)
    share = min(max(y.mean(), 1e-3), 1 - 1e-3)
    mean, scale = x.mean(0), np.maximum(x.std(0), 1e-6)
    w, machine.offset = _logistic((x - mean) / scale, y, np.ones(len(y)))
    machine.logistic = (w, mean, scale)
    machine.offset += float(np.log(p / (1 - p)) - np.log(share / (1 - share)))
    return machine


def fit(docs: DataFrame, labels: DataFrame, learn: Column, target: str = "toxic",
        per_class: int = TRAIN_PER_CLASS) -> StringSvm:
    """Train on at most ``per_class`` labelled rows of each class that satisfy ``learn``, a condition on doc_id."""
    known = labels.where(learn & F.col(target).isin(0, 1)).agg(F.avg(target).alias("p")).first()["p"]
    return train(labelled_sample(docs, labels, target, learn, per_class, SEED), prior=known)


def scored(docs: DataFrame, machine: StringSvm, text_col: str = "text", score_col: str = "score") -> DataFrame:
    """``docs`` with the column ``score_col`` (replaced if there), in input order: the toxicity of the whole text.

    A null text counts as empty and gets the score of an empty text. Repeated
    rows, null ids and extra columns pass through; an empty table stays empty.
    """
    def compute(raw):
        return [pa.array([machine.score(t.decode("utf-8", "replace")) for t in raw], pa.float64())]

    return with_text_columns(docs.drop(score_col), text_col, [StructField(score_col, DoubleType())], compute)
