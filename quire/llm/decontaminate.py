"""Benchmark decontamination by the q-gram lemma on diagonal bands.

A benchmark item is cut into overlapping windows, long ones that allow more
edits and short ones that find parts of an item. If a stretch of a document
is within ``e`` edits of a window of m characters, the two share at least
m - q + 1 - e * q q-grams, and all of these lie on diagonals (document position
minus window position) at most e apart. Shared q-grams are counted in
diagonal bands that overlap by e; bands that meet the bound are verified by
banded alignment. The bound never loses a window within the budget. So every
verbatim part of an item of PART_WINDOW + PART_STRIDE - 1 = 99 characters or
more is found, and an item shorter than PART_WINDOW if it is there whole, within
the edits; shorter parts are found only where they hold a window.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import Broadcast, cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from quire.llm.common import map_batches, slices, stored, texts, where_text

#: Characters of a q-gram, of a window, and between the starts of two windows.
Q, WINDOW, STRIDE = 9, 120, 60
#: Characters of a short window, and between the starts of two.
PART_WINDOW, PART_STRIDE = 80, 20
#: Edits allowed for each character of a window.
EDIT_RATE = 0.08
#: Characters of benchmark text that one pass over the documents carries; a larger benchmark takes several passes.
BLOCK_CHARS = 1_500_000
#: Hash bits of the filter that q-grams pass before they are searched.
FILTER_BITS = 22
#: Pairs of a document's q-grams and places in windows that are held at a time.
HITS = 1 << 20
MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)


def normal(text: str) -> str:
    """Lower case, with each run of white space as one space."""
    return " ".join(text.lower().split())


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def gram_hashes(codes: np.ndarray, q: int = Q) -> np.ndarray:
    """A 64-bit hash of the q-gram at each position, by doubling."""
    n = len(codes) - q + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    power, width, total, done = codes.astype(np.uint64) + np.uint64(1), 1, None, 0
    factor = MULTIPLIER
    with np.errstate(over="ignore"):
        rest = q
        while rest:
            if rest & 1:
                part = power[done:done + n]
                total = part.copy() if total is None else total * factor + part
                done += width
            rest >>= 1
            if rest:
                power = power[:-width] * factor + power[width:]
                width, factor = width * 2, factor * factor
        total ^= total >> np.uint64(29)
        return total * MULTIPLIER


def edit_budget(length: int, rate: float, q: int) -> int:
    """Edits allowed in a window, at most so many that one shared q-gram is still required."""
    return min(int(rate * length), (length - q) // q)


@dataclass
class Block:
    """Windows of benchmark items (places in ``codes``), and their q-grams in the order of their hashes."""
    items: list
    codes: np.ndarray
    first: np.ndarray
    owner: list[int]
    length: np.ndarray
    budget: np.ndarray
    whole: dict[str, list[int]]
    grams: np.ndarray
    starts: np.ndarray
    window_of: np.ndarray
    position: np.ndarray
    likely: np.ndarray

    def window(self, w: int) -> np.ndarray:
        return self.codes[self.first[w]:self.first[w] + self.length[w]]

    @property
    def windows(self) -> list[np.ndarray]:
        return [self.window(w) for w in range(len(self.owner))]

    def required(self, q: int) -> np.ndarray:
        """Shared q-grams that each window asks for."""
        return self.length - q + 1 - self.budget * q


def build_block(rows: list[tuple], q: int, window: int, stride: int, rate: float,
                part: tuple[int, int] | None = None) -> Block:
    """Index (item_id, text) rows by windows, and by the short windows of ``part`` (their length and stride) too. An item too short for a bound is kept for comparison with whole documents."""
    items, texts_of, first, length, owner, whole, at = [], [], [], [], [], {}, 0
    for item_id, text in rows:
        t = normal(text or "")
        if 0 < len(t) < 2 * q:
            whole.setdefault(t, []).append(len(items))
        elif t:
            spans = set()
            for size, step in ((window, stride), part or (window, stride)):
                last = max(len(t) - size, 0)
                spans |= {(s, min(s + size, len(t))) for s in (*range(0, last + 1, step), last)}
            for start, end in sorted(spans):
                first.append(at + start)
                length.append(end - start)
                owner.append(len(items))
            texts_of.append(t)
            at += len(t)
        items.append(item_id)
    codes, first, length = code_points("".join(texts_of)), np.array(first, np.int64), np.array(length, np.int64)
    hashes, size = gram_hashes(codes, q), np.maximum(length - q + 1, 0)
    total = int(size.sum())
    kind = np.int32 if max(total, len(codes)) < 1 << 31 else np.int64
    # windows overlap: each place of the texts is hashed and ranked once, and windows hold places
    place = np.arange(total, dtype=kind) + np.repeat((first - (np.cumsum(size) - size)).astype(kind), size)
    used = np.zeros(len(hashes), bool)
    used[place] = True
    grams, number = np.unique(hashes[used], return_inverse=True)
    rank = np.zeros(len(hashes), kind)
    rank[used] = number
    key = rank[place]
    starts = np.append(0, np.cumsum(np.bincount(key, minlength=len(grams))))
    order = np.argsort(key, kind="stable").astype(kind)
    del hashes, used, number, rank, key
    position = (place - np.repeat(first.astype(kind), size)).astype(np.min_scalar_type(int(size.max(initial=0))))[order]
    del place
    likely = np.zeros(1 << FILTER_BITS, bool)
    likely[_slot(grams)] = True
    return Block(items, codes, first, owner, length, np.array([edit_budget(n, rate, q) for n in length.tolist()], np.int64),
                 whole, grams, starts, np.repeat(np.arange(len(size), dtype=kind), size)[order], position, likely)


class Unpickled:
    """An object that comes out of its pickle as what a call gives."""

    def __init__(self, call, *args):
        self.call, self.args = call, args

    def __reduce__(self):
        return self.call, self.args


def sent(spark: SparkSession, rows: list[tuple], *how) -> Broadcast:
    """A broadcast of benchmark rows whose value is their block in the tasks. The texts alone are sent, and each Python
    worker indexes them once: an index is some forty times as large, more than the driver should build, pickle and keep."""
    return spark.sparkContext.broadcast(Unpickled(pickle.loads, cloudpickle.dumps(Unpickled(build_block, rows, *how))))


def _slot(hashes: np.ndarray) -> np.ndarray:
    return (hashes >> np.uint64(64 - FILTER_BITS)).astype(np.int64)


def align(window: np.ndarray, stretch: np.ndarray, low: int, high: int, budget: int) -> tuple[int, int, int] | None:
    """Least edits that turn the window into a part of the stretch, over diagonals low to high.

    Returns (edits, start, end) in the stretch, or None beyond the budget."""
    m, n, far = len(window), len(stretch), budget + 1
    diagonal = np.arange(low, high + 1)
    lane = np.arange(len(diagonal))
    cost = np.where((diagonal >= 0) & (diagonal <= n), 0, far)
    begin = np.clip(diagonal, 0, n)
    padded = np.append(stretch, np.uint32(0xFFFFFFFF))
    for i in range(1, m + 1):
        j = diagonal + i
        inside = (j >= 1) & (j <= n)
        new = cost + (padded[np.where(inside, j - 1, n)] != window[i - 1])
        missing = np.append(cost[1:], far) + 1
        shorter = missing < new
        begin = np.where(shorter, np.append(begin[1:], n), begin)
        new = np.where((j >= 0) & (j <= n), np.minimum(new, missing), far)
        least = np.minimum.accumulate(new - lane)
        begin = begin[np.maximum.accumulate(np.where(new - lane == least, lane, 0))]
        cost = np.where((j >= 0) & (j <= n), np.minimum(least + lane, far), far)
        if cost.min() > budget:
            return None
    best = int(cost.argmin())
    return int(cost[best]), int(begin[best]), int(diagonal[best] + m)


def _verify(window: np.ndarray, codes: np.ndarray, low: int, high: int, budget: int) -> tuple[int, int, int] | None:
    """Alignment of a window over the document's diagonals low to high; a verbatim copy needs no table."""
    a, b = max(low, 0), min(high + len(window), len(codes))
    stretch = codes[a:b]
    at = stretch.tobytes().find(window.tobytes())
    if at >= 0 and at % 4 == 0:
        return 0, a + at // 4, a + at // 4 + len(window)
    got = align(window, stretch, low - a, high - a, budget)
    return got and (got[0], a + got[1], a + got[2])


def _dense(at: np.ndarray, key: np.ndarray, block: Block, q: int) -> tuple[np.ndarray, np.ndarray]:
    """The hits (positions, keys) that lie among as many others as any window asks for, within its reach."""
    least, reach = int(block.required(q).min()), int((block.length + block.budget).max())
    if len(at) < least:
        return at[:0], key[:0]
    first = np.flatnonzero(at[least - 1:] - at[:len(at) - least + 1] <= reach)
    edge = np.zeros(len(at) + 1, np.int64)
    edge[first] += 1
    edge[first + least] -= 1
    kept = np.cumsum(edge[:-1]) > 0
    return at[kept], key[kept]


def _bands(at: np.ndarray, key: np.ndarray, block: Block, offset: int, span: int) -> tuple[np.ndarray, np.ndarray]:
    """(window * span + cell + offset, shared q-grams) of the bands that hits (positions, keys) fall in.

    Cells hold budget + 1 diagonals; a band is a cell and the next, so any budget + 1 diagonals lie in one band. A hit
    meets each place of its q-gram in the windows. Texts that repeat a few letters make very many such pairs, so they are
    made and counted HITS at a time."""
    count = block.starts[key + 1] - block.starts[key]
    ends = np.cumsum(count)

    def pairs(start: int, stop: int) -> tuple[np.ndarray, np.ndarray]:
        n = count[start:stop]
        before = ends[start:stop] - n - (ends[start - 1] if start else 0)
        slot = np.repeat(block.starts[key[start:stop]] - before, n) + np.arange(n.sum())
        window = block.window_of[slot].astype(np.int64)
        return window, (np.repeat(at[start:stop], n) - block.position[slot]) // (block.budget[window] + 1) + offset

    if not len(ends) or ends[-1] <= HITS:
        window, cell = pairs(0, len(at))
        cells = window * span + cell
        return np.unique(np.concatenate([cells, cells - 1]), return_counts=True)
    parts: list[tuple[np.ndarray, np.ndarray]] = []
    cuts = [0, *(np.flatnonzero(np.diff(ends // HITS)) + 1).tolist(), len(at)]
    for start, stop in zip(cuts, cuts[1:]):
        if start == stop:
            continue
        window, cell = pairs(start, stop)
        there = np.flatnonzero(np.bincount(window))  # few windows, and hits side by side reach few cells of each
        low, width = cell.min() - 1, int(cell.max() - cell.min()) + 2
        if len(there) * width <= 4 * HITS:
            n = np.bincount(np.searchsorted(there, window) * width + (cell - low), minlength=len(there) * width)
            n = n + np.append(n[1:], 0)  # a band has its own cell and the next; the first cell of a window is always empty
            own = np.flatnonzero(n)
            parts.append((there[own // width] * span + own % width + low, n[own]))
        else:
            cells = window * span + cell
            parts.append(np.unique(np.concatenate([cells, cells - 1]), return_counts=True))
        if sum(len(p[0]) for p in parts) > 4 * HITS:
            parts = [_added(parts)]
    return _added(parts)


def _added(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Counts by band, of all parts together."""
    band, place = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
    return band, np.bincount(place, np.concatenate([p[1] for p in parts]), len(band)).astype(np.int64)


def scan(text: str, block: Block, q: int) -> list[tuple[int, int, int, int]]:
    """(item number, start, end, edits) in the normalised text; overlapping stretches of an item are joined."""
    found = [(i, 0, len(text), 0) for i in block.whole.get(text, ())]
    codes = code_points(text)
    hashes = gram_hashes(codes, q)
    at = np.flatnonzero(block.likely[_slot(hashes)])
    if not len(at) or not len(block.grams):
        return found
    key = np.minimum(np.searchsorted(block.grams, hashes[at]), len(block.grams) - 1)
    equal = block.grams[key] == hashes[at]
    at, key = _dense(at[equal], key[equal], block, q)
    if not len(at):
        return found
    offset = int(block.length.max()) + 1
    span = len(codes) + 2 * offset
    band, shared = _bands(at, key, block, offset, span)
    need = block.required(q)
    band = band[shared >= need[band // span]]
    stretches: dict[int, list] = {}
    for run in np.split(band, np.flatnonzero(np.diff(band) > 1) + 1) if len(band) else ():
        w = int(run[0]) // span
        budget, size = int(block.budget[w]), int(block.budget[w]) + 1
        low = (int(run[0]) % span - offset) * size - budget
        high = (int(run[-1]) % span - offset + 2) * size - 1 + budget
        if got := _verify(block.window(w), codes, low, high, budget):
            stretches.setdefault(block.owner[w], []).append((got[1], got[2], got[0]))
    for item, parts in sorted(stretches.items()):
        start, end, edits = None, -1, 0
        for a, b, e in sorted(parts):
            if start is not None and a <= end:
                end, edits = max(end, b), min(edits, e)
                continue
            if start is not None:
                found.append((item, start, end, edits))
            start, end, edits = a, b, e
        found.append((item, start, end, edits))
    return found


def blocks(benchmark: DataFrame, q: int, window: int, stride: int, rate: float, block_chars: int,
           part: tuple[int, int] | None) -> Iterator[tuple[Broadcast, bool]]:
    """The benchmark (item_id, text) as blocks of about ``block_chars`` characters, each small enough to send along, one
    at a time, and whether it is the only one."""
    rows = benchmark.select("item_id", F.col("text").cast("string").alias("text")).distinct()
    total = rows.agg(F.sum(F.length("text")).alias("n")).first()["n"] or 0
    n = -(-total // block_chars)
    place = F.pmod(F.xxhash64("item_id", "text"), F.lit(max(n, 1)))
    for i in range(n):
        yield sent(rows.sparkSession, [(r["item_id"], r["text"]) for r in rows.where(place == i).collect()],
                   q, window, stride, rate, part), n == 1


def matches(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", q: int = Q,
            window: int = WINDOW, stride: int = STRIDE, rate: float = EDIT_RATE,
            block_chars: int = BLOCK_CHARS, part: tuple[int, int] | None = (PART_WINDOW, PART_STRIDE)) -> DataFrame:
    """(doc_id, item_id, start, end, edits) for each stretch of a document that repeats a benchmark item.

    Texts are compared in lower case with white space as single spaces, and
    positions count characters of that form. Items are searched by windows, so
    a part of an item is found too, surely one of 99 characters or more that is
    copied verbatim. Items shorter than two q-grams only
    match a document that equals them. Empty and null texts match nothing;
    repeated documents are reported each, repeated items once; an empty
    benchmark or empty documents give no rows. ``end`` is exclusive and
    ``edits`` is the least of the windows in the stretch.
    """
    src = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    kinds = src.schema["doc_id"].dataType, benchmark.schema["item_id"].dataType
    schema = f"doc_id {kinds[0].simpleString()}, item_id {kinds[1].simpleString()}, start long, end long, edits long"
    out = docs.sparkSession.createDataFrame([], schema)
    for block_sent, only in blocks(benchmark, q, window, stride, rate, block_chars, part):
        def run(batches, block_sent=block_sent):
            for batch in slices(batches, "text"):
                block = block_sent.value
                rows = []
                for doc_id, text in zip(batch.column("doc_id").to_pylist(), texts(batch, "text")):
                    rows += [(doc_id, block.items[i], a, b, e) for i, a, b, e in scan(normal(text), block, q)]
                columns = list(zip(*rows)) or [()] * 5
                kind = [to_arrow_type(kinds[0]), to_arrow_type(kinds[1])] + [pa.int64()] * 3
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kind)],
                                                 names=["doc_id", "item_id", "start", "end", "edits"])
        found = map_batches(src, run, schema)
        out = out.unionByName(found if only else stored(found, "matches"))  # so that the next block can take its place
    return out


def clean(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", q: int = Q, window: int = WINDOW,
          stride: int = STRIDE, rate: float = EDIT_RATE, block_chars: int = BLOCK_CHARS,
          part: tuple[int, int] | None = (PART_WINDOW, PART_STRIDE)) -> DataFrame:
    """The rows of ``docs``, all columns, whose text repeats no benchmark item; see ``matches``."""
    for block_sent, only in blocks(benchmark, q, window, stride, rate, block_chars, part):
        docs = where_text(docs, text_col, lambda t, block_sent=block_sent: not scan(normal(t), block_sent.value, q))
        if not only:
            names = docs.columns  # written by place, as names may be odd
            docs = stored(docs.toDF(*[f"c{i}" for i in range(len(names))]), "clean").toDF(*names)
    return docs
