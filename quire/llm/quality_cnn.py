"""Quality classifier: a byte-level convolutional network in numpy.

Every text is cut into overlapping chunks that cover all of its bytes. Bytes
are embedded, learned filters run over the chunk, and each filter keeps its
maximum. The greatest and the mean chunk value of each filter go through one
hidden layer into a single probability.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField

from quire.llm.common import labelled_sample, with_text_columns

CHUNK, OVERLAP = 512, 64
EMBED, WIDTH, STEP, FILTERS, HIDDEN = 4, 8, 2, 24, 16
#: Bound on the labelled rows of one class that train the network.
TRAIN_PER_CLASS = 2_500
EPOCHS, BATCH, RATE, SEED = 8, 32, 4e-3, 7
#: Chunks that are convolved at once.
CHUNKS_AT_ONCE = 256


def chunks_of(raw: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Chunk rows (zero-filled at a text's end) and the number of chunks of each text; an empty text has one."""
    size = np.fromiter(map(len, raw), np.int64, len(raw))
    count = np.maximum(1, -(-(size - OVERLAP) // (CHUNK - OVERLAP)))
    rank = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
    begin = np.repeat(np.cumsum(size) - size, count) + rank * (CHUNK - OVERLAP)
    flat = np.frombuffer(b"".join(raw) + bytes(CHUNK), np.uint8)
    rows = np.lib.stride_tricks.sliding_window_view(flat, CHUNK)[begin]
    left = np.repeat(size, count) - rank * (CHUNK - OVERLAP)
    short = np.flatnonzero(left < CHUNK)
    rows[short] = np.where(np.arange(CHUNK) < left[short, None], rows[short], 0)
    return rows, count


class ByteCnn:
    """The network; its parameters are plain arrays, small enough to send to every task."""

    def __init__(self, rng: np.random.Generator):
        wide = EMBED * WIDTH
        self.p = {
            "embed": rng.normal(0, 0.5, (256, EMBED)), "filter": rng.normal(0, wide ** -0.5, (wide, FILTERS)),
            "shift": np.zeros(FILTERS), "w1": rng.normal(0, (2 * FILTERS) ** -0.5, (2 * FILTERS, HIDDEN)),
            "b1": np.zeros(HIDDEN), "w2": rng.normal(0, HIDDEN ** -0.5, HIDDEN), "b2": np.zeros(1),
        }
        self.p = {k: v.astype(np.float32) for k, v in self.p.items()}

    def _windows(self, rows: np.ndarray) -> np.ndarray:
        x = self.p["embed"][rows].reshape(len(rows), CHUNK * EMBED)
        return np.lib.stride_tricks.sliding_window_view(x, WIDTH * EMBED, axis=1)[:, ::STEP * EMBED]

    def pooled(self, rows: np.ndarray, where: bool = False) -> tuple[np.ndarray, np.ndarray | None]:
        """The rectified maximum of each filter in each chunk, and its place if asked for."""
        out = np.empty((len(rows), FILTERS), np.float32)
        at = np.empty((len(rows), FILTERS), np.int64) if where else None
        for i in range(0, len(rows), CHUNKS_AT_ONCE):
            part = slice(i, i + CHUNKS_AT_ONCE)
            x = self._windows(rows[part])
            y = (np.ascontiguousarray(x).reshape(-1, WIDTH * EMBED) @ self.p["filter"]).reshape(*x.shape[:2], FILTERS)
            out[part] = y.max(axis=1)
            if where:
                at[part] = y.argmax(axis=1)
        return np.maximum(out + self.p["shift"], 0), at

    def _combined(self, v: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        first = np.cumsum(count) - count
        u = np.hstack([np.maximum.reduceat(v, first), np.add.reduceat(v, first) / count[:, None].astype(np.float32)])
        h = np.tanh(u @ self.p["w1"] + self.p["b1"])
        return u, h, h @ self.p["w2"] + self.p["b2"][0]

    def scores(self, raw: list[bytes]) -> np.ndarray:
        """The probability of label 1 for each text."""
        rows, count = chunks_of(raw)
        logit = self._combined(self.pooled(rows)[0], count)[2].astype(np.float64)
        return 1 / (1 + np.exp(-np.clip(logit, -30, 30)))

    def gradients(self, raw: list[bytes], labels: np.ndarray) -> dict[str, np.ndarray]:
        """Of the mean log loss, for each parameter."""
        rows, count = chunks_of(raw)
        v, at = self.pooled(rows, True)
        u, h, logit = self._combined(v, count)
        d = ((1 / (1 + np.exp(-np.clip(logit, -30, 30))) - labels) / len(raw)).astype(np.float32)
        g = {"w2": h.T @ d, "b2": d.sum(keepdims=True)}
        dh = np.outer(d, self.p["w2"]) * (1 - h * h)
        g["w1"], g["b1"] = u.T @ dh, dh.sum(0)
        du = dh @ self.p["w1"].T
        doc = np.repeat(np.arange(len(raw)), count)
        dv = (du[:, FILTERS:] / count[:, None].astype(np.float32))[doc]
        top = (v == u[doc, :FILTERS]).astype(np.float32)
        top /= np.add.reduceat(top, np.cumsum(count) - count)[doc]
        dv = (dv + top * du[:, :FILTERS][doc]) * (v > 0)
        g["shift"] = dv.sum(0)
        byte = rows[np.arange(len(rows))[:, None, None], (at * STEP)[:, :, None] + np.arange(WIDTH)]
        x = self.p["embed"][byte].reshape(len(rows), FILTERS, WIDTH * EMBED)
        g["filter"] = np.einsum("nf,nfk->kf", dv, x)
        dx = (dv[:, :, None] * self.p["filter"].T).reshape(-1, EMBED)
        g["embed"] = np.zeros_like(self.p["embed"])
        np.add.at(g["embed"], byte.reshape(-1), dx)
        return g


def train(sample: list[tuple[int, str, int]], epochs: int = EPOCHS, seed: int = SEED,
          prior: float | None = None) -> ByteCnn:
    """Fit by Adam on (id, text, label) rows; without rows of both classes every score is near the prior.

    The sample holds the classes in other shares than the corpus: the last bias
    is moved so that scores refer to ``prior``, the share of label 1 there.
    """
    rng = np.random.default_rng(seed)
    net = ByteCnn(rng)
    raw = [t.encode() for _, t, _ in sample]
    y = np.array([label for *_, label in sample], np.float32)
    share = float(y.mean()) if len(y) else 0.5
    if 0 < share < 1:
        moment = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in net.p.items()}
        step, total = 0, epochs * -(-len(raw) // BATCH)
        for _ in range(epochs):
            order = rng.permutation(len(raw))
            for i in range(0, len(raw), BATCH):
                pick = order[i:i + BATCH]
                step += 1
                rate = RATE * (1 - step / (total + 1))
                for k, g in net.gradients([raw[j] for j in pick], y[pick]).items():
                    m, s = moment[k]
                    m += 0.1 * (g - m)
                    s += 0.001 * (g * g - s)
                    net.p[k] -= (rate * (m / (1 - 0.9 ** step))
                                 / (np.sqrt(s / (1 - 0.999 ** step)) + 1e-8)).astype(np.float32)
        if prior is not None:
            p = min(max(prior, 1e-3), 1 - 1e-3)
            net.p["b2"] += np.float32(np.log(p / (1 - p)) - np.log(share / (1 - share)))
    else:
        net.p["w2"][:] = 0
        p = min(max(prior if prior is not None else share, 1e-3), 1 - 1e-3)
        net.p["b2"][:] = np.log(p / (1 - p))
    return net


def fit(docs: DataFrame, labels: DataFrame, learn: Column, target: str = "quality",
        per_class: int = TRAIN_PER_CLASS) -> ByteCnn:
    """Train on at most ``per_class`` labelled rows of each class that satisfy ``learn``, a condition on doc_id."""
    known = labels.where(learn & F.col(target).isin(0, 1)).agg(F.avg(target).alias("p")).first()["p"]
    return train(labelled_sample(docs, labels, target, learn, per_class, SEED), prior=known)


def scored(docs: DataFrame, net: ByteCnn, text_col: str = "text", score_col: str = "score") -> DataFrame:
    """``docs`` with the column ``score_col`` (replaced if there): the probability of the whole text, in input order.

    Rows stay as they are: repeated rows, null ids and extra columns pass
    through. A null text counts as empty and is scored; an empty table stays empty.
    """
    def compute(raw):
        return [pa.array(net.scores(raw), pa.float64())]

    return with_text_columns(docs.drop(score_col), text_col, [StructField(score_col, DoubleType())], compute, 1 << 20)
