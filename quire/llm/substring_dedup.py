"""Removal of passages that repeat across documents, by level-wise doubling.

Windows of words are compared level by level. The first length is the window
length halved as often as it stays even and above FIRST words; only windows
repeated in several documents at one length are extended to twice that length,
until none survives or the window length itself is reached, where the answer
is read: longer windows cover no other words.

The first level need not look at every window. Among all first-level windows
inside one whole window the one of least hash is its anchor; equal windows have
equal anchors, so a window can repeat only if its anchor does. Anchors are some
2 / (window - first + 2) of all positions.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from numpy.lib.stride_tricks import sliding_window_view
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quire.llm.common import map_batches, raw_texts, slices, stored
from quire.llm.sieve import bits_of, found

WINDOW = 50
#: Words that a window of the first level has at least.
FIRST = 20
#: An anchor or window with more rows than this share of an even partition is hot: it is counted by partial sums and its
#: one answer is sent to its rows, so that no task gets them all. There are at most partitions / HOT such keys.
HOT = 0.25
#: Odd multipliers of the two independent window hashes, and one that mixes hashes before they are compared.
BASES, MIX = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)), np.uint64(0xD6E8FEB86659FD93)


def ladder(window: int, first: int = FIRST) -> list[int]:
    """The lengths compared, each twice the one before, up to ``window``."""
    rungs = [window]
    while rungs[0] % 2 == 0 and rungs[0] // 2 >= first:
        rungs.insert(0, rungs[0] // 2)
    return rungs


def _power(base: np.uint64, n: int) -> np.uint64:
    return np.uint64(pow(int(base), n, 1 << 64))


def _extended(left: np.ndarray, right: np.ndarray, shift: int, length: int, base: np.uint64) -> np.ndarray:
    """Hashes of the windows made of one of ``shift`` words and one of ``length`` words right behind it."""
    n = max(len(right) - shift, 0)
    return left[:n] * _power(base, length) + right[shift:shift + n]


def _hashes(words: np.ndarray, length: int, base: np.uint64) -> np.ndarray:
    """The hash of the window of ``length`` words at each start, put together by doubling."""
    whole, size, part, have = None, 0, words, 1
    while True:
        if length & have:
            whole = part if whole is None else _extended(whole, part, size, have, base)
            size += have
        if 2 * have > length:
            return whole
        part, have = _extended(part, part, have, have, base), 2 * have


def _words(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Two independent hashes of each word."""
    digest = xxhash.xxh3_128_digest
    both = np.frombuffer(b"".join([digest(w) for w in text.split()]), "<u8").reshape(-1, 2)
    return np.ascontiguousarray(both[:, 0]), np.ascontiguousarray(both[:, 1])


def _anchors(first: np.ndarray, span: int) -> tuple[np.ndarray, np.ndarray]:
    """Mixed first-level hashes, and for each whole window the place of its anchor."""
    mixed = (first ^ (first >> np.uint64(31))) * MIX
    if len(mixed) < span:
        return mixed, np.zeros(0, np.int64)
    return mixed, np.arange(len(mixed) - span + 1) + sliding_window_view(mixed, span).argmin(axis=1)


def _lists(values: list[np.ndarray], kind) -> pa.Array:
    ends = np.concatenate([[0], np.cumsum([len(v) for v in values])]).astype(np.int32)
    flat = np.concatenate(values) if values else np.zeros(0)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(flat.astype(kind)))


def _sources(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = F.col(text_col).cast("string")
    return docs.select(F.col(id_col).alias("id"), F.coalesce(F.xxhash64(F.lit(1), text), F.lit(0)).alias("text_key"),
                       text.alias("text")).withColumn("row_key", F.xxhash64("id", "text_key"))


def _sifted(src: DataFrame, table, inside: bool) -> DataFrame:
    """The rows of ``src`` whose row_key may be in the bit table, or those whose row_key is surely not."""

    def run(batches):
        for batch in batches:
            held = found(table.value, batch.column("row_key").to_numpy(zero_copy_only=False))
            yield batch.filter(pa.array(held if inside else ~held))

    return map_batches(src, run, src.schema)


def _same_row(a: str, b: str):
    return F.col(f"{a}.id").eqNullSafe(F.col(f"{b}.id")) & (F.col(f"{a}.text_key") == F.col(f"{b}.text_key"))


def _shared(rows: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, least, n) of the keys that occur in documents of different ids; ids that are null come last."""
    return (rows.groupBy(*keys).agg(F.min("id").alias("least"), F.max("id").alias("most"), F.count("*").alias("n"),
                                    F.max(F.col("id").isNull()).alias("no_id"))
            .where((F.col("least") < F.col("most")) | (F.col("least").isNotNull() & F.col("no_id")))
            .select(*keys, "least", "n"))


def _hot_size(rows: DataFrame) -> float:
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return HOT * (rows.agg(F.sum("n")).first()[0] or 0) / parts


def _joined(rows: DataFrame, shared: DataFrame, keys: list[str], hot_size: float) -> DataFrame:
    """``rows`` with the columns of ``shared``: hot keys, few by their definition, are sent to the rows."""
    hot = F.broadcast(shared.where(F.col("n") > hot_size))
    cold = shared.where(F.col("n") <= hot_size)
    return (rows.join(hot, keys).unionByName(rows.join(hot.select(*keys), keys, "left_anti").join(cold, keys)))


def repeated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW,
             first: int = FIRST) -> DataFrame:
    """(id, text_key, starts) of the documents with windows whose words also start a window in a document of a smaller
    id: the word positions, from 0, at which these windows start. text_key tells texts of one id apart.

    Ids that are null count as greater than all others, and not as smaller than each other.
    """
    spark, rungs = docs.sparkSession, ladder(window, first)
    src, base, span = _sources(docs, id_col, text_col), rungs[0], window - rungs[0] + 1

    def anchored(batches):
        for batch in slices(batches, "text"):
            at, keys = [], []
            for text in raw_texts(batch, "text"):
                mixed, place = _anchors(_hashes(_words(text)[0], base, BASES[0]), span)
                at.append(np.unique(place))
                keys.append(mixed[at[-1]].view(np.int64))
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("text_key"), _lists(at, np.int32),
                                              _lists(keys, np.int64)], names=["id", "text_key", "at", "key"])

    kind = src.schema["id"].dataType.simpleString()
    picks = stored(map_batches(src.drop("row_key"), anchored, f"id {kind}, text_key long, at array<int>, key array<long>")
                   .where(F.size("at") > 0), "anchors")
    shared = stored(_shared(picks.select("id", F.explode("key").alias("key")), ["key"]), "anchors-shared")
    sieve = spark.sparkContext.broadcast(bits_of(shared, "key"))

    def maybe(batches):
        for batch in batches:
            keys = batch.column("key")
            flat = keys.flatten().to_numpy()
            keep = found(sieve.value, flat)
            of = np.repeat(np.arange(len(keys)), keys.value_lengths().to_numpy())[keep]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c).take(pa.array(of)) for c in ("id", "text_key")),
                 batch.column("at").flatten().filter(pa.array(keep)), pa.array(flat[keep])],
                names=["id", "text_key", "at", "key"])

    asked = map_batches(picks, maybe, f"id {kind}, text_key long, at int, key long")
    survivors = _survivors(asked, shared, ["key"])
    for k in range(1, len(rungs)):
        if survivors.isEmpty():
            break
        windows = _extended_windows(src, survivors, rungs[:k + 1], window)
        if k < len(rungs) - 1:
            windows = stored(windows, f"windows-{rungs[k]}")
            survivors = _survivors(windows, _shared(windows, ["low", "high"]), ["low", "high"])
    else:
        return _answers(windows if len(rungs) > 1 else _extended_windows(src, survivors, rungs, window))
    return survivors.select("id", "text_key", F.array().cast("array<int>").alias("starts"))


def _survivors(rows: DataFrame, shared: DataFrame, keys: list[str]) -> DataFrame:
    """(id, text_key, places) of the documents with keys that several documents share: where, and whether hot."""
    shared = stored(shared, "shared")
    limit = _hot_size(shared)
    place = F.struct("at", (F.col("n") > limit).alias("hot"))
    return stored(_joined(rows, shared, keys, limit).groupBy("id", "text_key")
                  .agg(F.collect_set(place).alias("places")), "survivors")


def _extended_windows(src: DataFrame, survivors: DataFrame, rungs: list[int], window: int) -> DataFrame:
    """(id, text_key, at, low, high, hot): the windows of the last length in ``rungs`` whose parts survived.

    After the first level these are the windows around a surviving anchor;
    later both halves must have survived. Two hashes, of 64 and 32 bits, name the words.
    """
    base, length, before = rungs[0], rungs[-1], rungs[-2] if len(rungs) > 1 else rungs[-1]
    span = window - base + 1
    sieve = src.sparkSession.sparkContext.broadcast(
        bits_of(survivors.select(F.xxhash64("id", "text_key").alias("k")), "k"))
    # a repeated row gives the same windows again, which changes no answer
    near = (_sifted(src, sieve, True).drop("row_key").alias("a")
            .join(survivors.alias("b"), _same_row("a", "b")).select("a.*", "b.places"))

    def extended(batches):
        for batch in slices(batches, "text"):
            own, at, low, high, hot = [], [], [], [], []
            places = batch.column("places")
            starts = places.value_lengths().to_numpy().cumsum()
            flat = places.flatten()
            where, heat = flat.field("at").to_numpy(), flat.field("hot").to_numpy(zero_copy_only=False)
            for i, text in enumerate(raw_texts(batch, "text")):
                words = _words(text)
                mine = slice(starts[i - 1] if i else 0, starts[i])
                state = np.zeros(len(words[0]), np.int8)
                state[where[mine]] = 1 + heat[mine]
                hashes = [_hashes(w, length, m) for w, m in zip(words, BASES)]
                n = len(hashes[0])
                if len(rungs) <= 2:
                    anchor = _anchors(_hashes(words[0], base, BASES[0]), span)[1]
                    state = _of_whole(state[anchor], n, window - length)
                else:
                    state = np.minimum(state[:n], state[before:before + n])
                live = np.flatnonzero(state)
                own.append(np.full(len(live), i))
                at.append(live.astype(np.int32))
                low.append(hashes[0][live].view(np.int64))
                high.append((hashes[1][live] >> np.uint64(32)).astype(np.uint32).view(np.int32))
                hot.append(state[live] == 2)
            own = pa.array(np.concatenate(own))
            rest = [pa.array(np.concatenate(c)) for c in (at, low, high, hot)]
            yield pa.RecordBatch.from_arrays([*(batch.column(c).take(own) for c in ("id", "text_key")), *rest],
                                             names=["id", "text_key", "at", "low", "high", "hot"])

    kind = src.schema["id"].dataType.simpleString()
    return map_batches(near, extended, f"id {kind}, text_key long, at int, low long, high int, hot boolean")


def _of_whole(state: np.ndarray, n: int, more: int) -> np.ndarray:
    """The state of each shorter window, of n, from those of the whole windows it lies in: the greatest."""
    if not more or not len(state):
        return state
    padded = np.concatenate([np.zeros(more, state.dtype), state, np.zeros(more, state.dtype)])
    return sliding_window_view(padded, more + 1).max(axis=1)[:n]


def _answers(windows: DataFrame) -> DataFrame:
    """(id, text_key, starts) of the windows that also start in a document of a smaller id.

    Windows that are not hot meet in one partition by their words. Hot ones are reduced before they are shuffled.
    """
    least = F.min("id").over(Window.partitionBy("low", "high"))
    plain = windows.where(~F.col("hot")).select("id", "text_key", "at", least.alias("least"))
    often = stored(windows.where("hot").select("id", "text_key", "at", "low", "high"), "hot-windows")
    often_shared = stored(_shared(often, ["low", "high"]), "hot-windows-shared")
    hot = _joined(often, often_shared, ["low", "high"], _hot_size(often_shared)).select("id", "text_key", "at", "least")
    smaller = (F.col("least") < F.col("id")) | (F.col("id").isNull() & F.col("least").isNotNull())
    return stored(plain.unionByName(hot).where(smaller).groupBy("id", "text_key")
                  .agg(F.collect_set("at").alias("starts")), "repeats")


def without_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW,
                    first: int = FIRST) -> DataFrame:
    """(id, n_words, spans, kept) for every row: the removed stretches of words (start, end exclusive), and the words
    that are kept, joined by one space.

    Words are runs of anything but ASCII white space. A word goes if it lies in a
    window of ``window`` words of its document whose words also start a window in
    a document of a smaller id. Windows are judged on the input. Repetition within
    one document, or between rows of one id, removes nothing. A null id is
    greater than all others; rows without an id remove nothing from each other.
    A null, empty or shorter text has no window. Repeated rows come back as often
    as they came, an empty table gives an empty result, other columns are ignored.
    """
    src = _sources(docs, id_col, text_col)
    starts = repeated(docs, id_col, text_col, window, first)
    sieve = docs.sparkSession.sparkContext.broadcast(
        bits_of(starts.select(F.xxhash64("id", "text_key").alias("k")), "k"))
    kind = src.schema["id"].dataType.simpleString()
    span_type = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))

    def run(batches):
        for batch in slices(batches, "text"):
            n, spans, kept = [], [], []
            for text, at in zip(raw_texts(batch, "text"), batch.column("starts").to_pylist()):
                words, gone, last = text.split(), [], 0
                for s in sorted(at or ()):
                    if gone and s <= gone[-1]["end"]:
                        gone[-1]["end"] = s + window
                    else:
                        gone.append({"start": s, "end": s + window})
                left = []
                for g in gone:
                    left += words[last:g["start"]]
                    last = g["end"]
                n.append(len(words))
                spans.append(gone)
                kept.append(b" ".join(left + words[last:]))
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), pa.array(n, pa.int64()), pa.array(spans, span_type),
                 pa.array(kept, pa.binary()).cast(pa.string())], names=["id", "n_words", "spans", "kept"])

    nothing = F.lit(None).cast("array<int>").alias("starts")
    whole = _sifted(src, sieve, False).select("id", "text", nothing)
    some = (_sifted(src, sieve, True).alias("a").join(starts.alias("b"), _same_row("a", "b"), "left")
            .select("a.id", "a.text", "b.starts"))
    return map_batches(whole.unionByName(some), run,
                       f"id {kind}, n_words long, spans array<struct<start:int,end:int>>, kept string")
