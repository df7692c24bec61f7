"""Collocations mined by dynamic itemset counting.

The documents are dealt into shards that are scanned in a cycle. Words are
counted from the first shard on. At the end of each shard a phrase whose two
subphrases (without its last, and without its first word) have both reached the
threshold becomes active, and is counted from the next shard on for one full
cycle. So phrases of several lengths are counted in the same scan, and mining
ends when every active phrase has been counted over all shards.

Which phrases have reached the threshold is kept as a table of bits of fixed
size, one state per shard end. A phrase is counted in shard t if its
subphrases are in the state of t and were not yet, both, in that of one cycle
before. States only grow, so every phrase is counted over exactly one cycle,
also one that is active by a false bit: that only costs work. Counts are exact.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quire.llm.common import MIX, map_batches, raw_texts, slices, word_keys
from quire.llm.sieve import bits_of, found
from quire.session import shared_folder

#: Shards of a cycle. More of them activate phrases sooner, and cost as many more scans and jobs.
SHARDS = 2
#: Bits of the states (8 MB each; a scan is sent two), and words that a phrase has at most.
STATE_BITS, LONGEST = 1 << 26, 3
#: A subphrase that holds more than this share of an even partition's requests is sent to them instead of met.
HOT = 0.25
#: Phrases that a task remembers to have named.
MENTIONED = 4_000_000
#: Documents are dealt into slots; phrases are named from the slots below the first number, then from those below the next.
SLOTS = (2, 16)
#: Text bytes whose phrases are counted at once; the more, the fewer rows.
SCAN_BYTES = 4 << 20
SEED = 42
#: Letters are lower-cased, piece ends become line feeds and tabs spaces.
PLAIN = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ.,;:!?\x0b\x0c\r\t", b"abcdefghijklmnopqrstuvwxyz\n\n\n\n\n\n\n\n\n ")


def language_key(name: str) -> int:
    return xxhash.xxh64_intdigest(name.encode(), SEED)


class Words:
    """The words of some documents: their keys, languages and pieces, and their letters, one space after each word."""

    def __init__(self, texts: list[bytes], languages: list[str]):
        plain = b"\n".join(texts).translate(PLAIN) + b"\n"
        letters = np.frombuffer(plain, np.uint8)
        line_end = letters == 10
        gap = line_end | (letters == 32)
        after_gap = np.concatenate([[True], gap[:-1]])
        start, end = np.flatnonzero(~gap & after_gap), np.flatnonzero(gap & ~after_gap)
        self.piece = np.cumsum(line_end, dtype=np.int32)[start]
        self.names = sorted(set(languages))
        number = {name: i for i, name in enumerate(self.names)}
        ends = np.cumsum([len(t) + 1 for t in texts])
        words = np.diff(np.searchsorted(start, ends), prepend=0)
        self.language = np.repeat(np.array([number[name] for name in languages], np.int64), words)
        seeds = np.array([language_key(name) for name in self.names], np.uint64)
        self.keys = word_keys(letters, start, end, seeds[self.language])
        self._letters, self._gap, self._after_gap = letters, gap, after_gap
        self._places = np.concatenate([[0], np.cumsum(end - start + 1)])

    def spelled(self, start: np.ndarray, size: int) -> list[bytes]:
        """The phrases of ``size`` words that start at these words, their words joined by one space."""
        kept = self._letters[~self._gap | ~self._after_gap]
        spaced = np.where(kept == 10, np.uint8(32), kept).tobytes()
        return [spaced[a:b] for a, b in zip(self._places[start].tolist(), (self._places[start + size] - 1).tolist())]

    def phrases(self, size: int) -> np.ndarray:
        """Where phrases of ``size`` words start."""
        n = len(self.piece) - size + 1
        if n <= 0:
            return np.zeros(0, np.int64)
        return np.flatnonzero(self.piece[:n] == self.piece[size - 1:])

    def phrase_keys(self, start: np.ndarray, size: int) -> np.ndarray:
        return phrase_keys([self.keys[start + i] for i in range(size)])


def phrase_keys(words: list[np.ndarray]) -> np.ndarray:
    """64-bit keys of phrases from the keys of their words; a word's key is its own. Languages are part of word keys."""
    key = words[0]
    if len(words) == 1:
        return key.view(np.int64)
    key = key + np.uint64(len(words))
    for word in words[1:]:
        key = (key ^ (key >> np.uint64(31))) * MIX[0] + word
    key = (key ^ (key >> np.uint64(33))) * MIX[1]
    return (key ^ (key >> np.uint64(33))).view(np.int64)


def scan(shard: DataFrame, sizes: list[int], now, before) -> DataFrame:
    """(key, n): counts of the phrases of these sizes that are in their cycle; ``now`` and ``before`` are states."""

    def run(batches):
        for batch in slices(batches, "text", SCAN_BYTES):
            words = Words(raw_texts(batch, "text"), batch.column("lang").to_pylist())
            out = []
            for size in sizes:
                start = words.phrases(size)
                if size > 1:
                    first, second = (words.phrase_keys(start + i, size - 1) for i in (0, 1))
                    live = found(now.value, first) & found(now.value, second)
                    if before is not None:
                        live &= ~(found(before.value, first) & found(before.value, second))
                    start = start[live]
                out.append(np.unique(words.phrase_keys(start, size), return_counts=True))
            keys, n = (np.concatenate(c) for c in zip(*out))
            yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(n.astype(np.int64))], names=["key", "n"])

    return map_batches(shard, run, "key long, n long")


@contextmanager
def reached(logs: list[DataFrame], least: int) -> Iterator[DataFrame]:
    """(key, n) of the keys that the logs count ``least`` times or more, all together; to be used inside the context.

    Such a key has at least its even share in one of the logs, so only rows of keys that do are added up.
    """
    if len(logs) == 1:
        yield logs[0].where(F.col("n") >= least)
        return
    share = math.ceil(least / len(logs))
    everything = logs[0]
    for log in logs[1:]:
        everything = everything.unionByName(log)
    sieve = everything.sparkSession.sparkContext.broadcast(bits_of(everything.where(F.col("n") >= share), "key"))

    def run(batches):
        for batch in batches:
            yield batch.filter(pa.array(found(sieve.value, batch.column("key").to_numpy())))

    yield (map_batches(everything, run, everything.schema).groupBy("key").agg(F.sum("n").alias("n"))
           .where(F.col("n") >= least))
    sieve.destroy()


def _written(df: DataFrame, name: str) -> DataFrame:
    """As ``stored``, but read again by its known schema, which takes no job."""
    path = shared_folder(df.sparkSession, f"llm-{name}")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def counted(docs: DataFrame, least: int, shards: int = SHARDS, longest: int = LONGEST) -> DataFrame:
    """(key, n) of every phrase of 1 to ``longest`` words that occurs ``least`` times or more, by dynamic itemset
    counting; docs has lang, text and shard."""
    spark = docs.sparkSession
    states, logs = {0: np.zeros(STATE_BITS // 8, np.uint8)}, []
    for t in range(longest * shards):
        back = t - shards
        states.pop(back - 1, None)
        if back >= 0 and np.array_equal(states[t], states[back]):
            break  # nothing has become active for a whole cycle
        sizes = [k for k in range(1, longest + 1) if (k > 1 or t < shards) and t >= k - 1]
        part = docs.where(F.col("shard") == t % shards).select("lang", "text")
        now, before = (spark.sparkContext.broadcast(states[x]) if x >= 0 else None for x in (t, back))
        log = scan(part, sizes, now, before)
        logs.append(_written(log.groupBy("key").agg(F.sum("n").alias("n")), f"shard-{t}"))
        for sent in (now, before):
            if sent is not None:
                sent.destroy()  # the log is written
        # whatever was counted in this shard has all its counts in the last cycle
        with reached(logs[-shards:], least) as found_:
            states[t + 1] = states[t] | bits_of(found_, "key", STATE_BITS)
    del states
    with reached(logs, least) as found_:
        return _written(found_, "reached")


def _mentions(docs: DataFrame, often: DataFrame, longest: int) -> DataFrame:
    """(lang, phrase, size, key) of the phrases of 2 or more words whose keys may be among ``often``, and per batch one
    row without a phrase that has the number of words of a language in ``size``."""
    sieve = docs.sparkSession.sparkContext.broadcast(bits_of(often, "key", STATE_BITS))

    def rows(lang: list[str], phrases: pa.Array, size, keys: pa.Array) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(lang, pa.string()), phrases, pa.array(size, pa.int64()), keys],
                                          names=["lang", "phrase", "size", "key"])

    def run(batches):
        # one mention by each task, or a few, is enough
        seen = np.zeros(0, np.int64)
        for batch in slices(batches, "text", SCAN_BYTES):
            words = Words(raw_texts(batch, "text"), batch.column("lang").to_pylist())
            yield rows(words.names, pa.nulls(len(words.names), pa.string()),
                       np.bincount(words.language, minlength=len(words.names)), pa.nulls(len(words.names), pa.int64()))
            fresh = []
            for size in range(2, longest + 1):
                start = words.phrases(size)
                keys = words.phrase_keys(start, size)
                likely = found(sieve.value, keys)
                keys, first = np.unique(keys[likely], return_index=True)
                if len(seen):
                    new = seen[np.minimum(np.searchsorted(seen, keys), len(seen) - 1)] != keys
                    keys, first = keys[new], first[new]
                start = start[likely][first]
                fresh.append(keys)
                lang = [words.names[i] for i in words.language[start].tolist()]
                yield rows(lang, pa.array(words.spelled(start, size), pa.binary()).cast(pa.string()),
                           np.full(len(start), size), pa.array(keys))
            seen = np.sort(np.concatenate([seen if len(seen) < MENTIONED else seen[:0], *fresh]))

    return map_batches(docs.select("lang", "text"), run, "lang string, phrase string, size long, key long")


def _named(docs: DataFrame, often: DataFrame, longest: int) -> DataFrame:
    """(lang, phrase, size, times): once each the phrases whose keys may be among ``often``, and rows without a phrase
    whose sizes, as often as they came, add up to the words of a language; docs has lang, text and slot.

    A first part of the documents names nearly all phrases; the others are asked only for those that it lacks. So the
    mentions of a phrase do not grow with the number of tasks."""
    left, parts, low = often, [], 0
    for high in SLOTS:
        part = docs.where((F.col("slot") >= low) & (F.col("slot") < high))
        parts.append(_written(_mentions(part, left, longest).groupBy("lang", "phrase", "size", "key")
                              .agg(F.count("*").alias("times")), "named"))
        left, low = left.join(parts[-1].select("key"), "key", "left_anti"), high
    both = parts[0]
    for part in parts[1:]:
        both = both.unionByName(part)
    # a false bit may name a phrase in several parts
    return both.groupBy("lang", "phrase", "size").agg(F.sum("times").alias("times"))


def _keys_of_words(phrases: list[bytes], lang: list[str], size: int) -> list[np.ndarray]:
    """The keys of the first, second, ... words of phrases of ``size`` words."""
    letters = np.frombuffer(b" ".join(phrases) + b" ", np.uint8) if phrases else np.zeros(0, np.uint8)
    end = np.flatnonzero(letters == 32)
    start = np.concatenate([[0], end + 1])[:len(end)]
    seeds = {name: language_key(name) for name in set(lang)}
    keys = word_keys(letters, start, end, np.repeat(np.array([seeds[name] for name in lang], np.uint64), size))
    return [keys[i::size] for i in range(size)]


def _with_keys(phrases: DataFrame, longest: int) -> DataFrame:
    """(lang, phrase, size, key, parts): the phrase's key, and those of its first 1, 2, ... and of its other words."""

    def run(batches):
        for batch in batches:
            size = batch.column("size").to_numpy()
            lang = batch.column("lang").to_pylist()
            text = raw_texts(batch, "phrase")
            keys, parts = np.zeros(len(size), np.int64), [None] * len(size)
            for k in range(2, longest + 1):
                at = np.flatnonzero(size == k)
                words = _keys_of_words([text[i] for i in at], [lang[i] for i in at], k)
                keys[at] = phrase_keys(words)
                cuts = [phrase_keys(words[:c]) for c in range(1, k)] + [phrase_keys(words[c:]) for c in range(1, k)]
                for i, row in zip(at, np.stack(cuts, axis=1).tolist()):
                    parts[i] = row
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(keys), pa.array(parts, pa.list_(pa.int64()))],
                names=["lang", "phrase", "size", "key", "parts"])

    return map_batches(phrases, run, "lang string, phrase string, size long, key long, parts array<long>")


def candidates(docs: DataFrame, least: int = 10, shards: int = SHARDS, longest: int = LONGEST, text_col: str = "text",
               lang_col: str = "lang", spread_by: tuple[str, ...] = ()) -> tuple[DataFrame, DataFrame]:
    """(lang, phrase, size, a, l, r, n, score, dropped) of all phrases of 2 to ``longest`` words that occur ``least``
    times or more, and (lang, n), the words of each language."""
    spark = docs.sparkSession
    text = F.col(text_col).cast("string")
    dealt = F.xxhash64(*spread_by, text)
    src = docs.select(F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).alias("lang"), text.alias("text"),
                      F.pmod(dealt, F.lit(shards)).alias("shard"),
                      F.pmod(F.shiftright(dealt, 32), F.lit(SLOTS[-1])).alias("slot")).where(text.isNotNull())
    often = counted(src, least, shards, longest)
    named = _named(src, often, longest)
    totals = (named.where(F.col("phrase").isNull())
              .groupBy("lang").agg(F.sum(F.col("size") * F.col("times")).alias("n")))
    found_ = _written(_with_keys(named.where(F.col("phrase").isNotNull()).drop("times"), longest)
                    .join(often.withColumnRenamed("n", "a"), "key"), "candidates")
    # requests for the counts of parts; words that very many candidates hold are not met in one partition
    asked = found_.select("key", F.posexplode("parts").alias("cut", "part"))
    wanted = asked.groupBy("part").agg(F.count("*").alias("asked"))
    known = _written(often.select(F.col("key").alias("part"), F.col("n").alias("f")).join(wanted, "part"), "parts")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    limit = HOT * (known.agg(F.sum("asked")).first()[0] or 0) / parts
    hot, cold = F.broadcast(known.where(F.col("asked") > limit)), known.where(F.col("asked") <= limit)
    met = asked.join(hot, "part").unionByName(asked.join(hot.select("part"), "part", "left_anti").join(cold, "part"))
    counts = [F.max(F.when(F.col("cut") == i, F.col("f"))).alias(f"f{i}") for i in range(2 * longest - 2)]
    scored = found_.join(met.groupBy("key").agg(*counts), "key")
    best = F.lit(None).cast("struct<score:long,k:int,l:long,r:long>")
    for size in range(2, longest + 1):
        cuts = []
        for k in range(1, size):
            left, right = F.col(f"f{k - 1}"), F.col(f"f{size - 2 + k}")
            exact = "cast(1000000 as decimal(7,0)) * cast(a as decimal(15,0)) * cast(a as decimal(15,0))"
            under = f"(cast(f{k - 1} as decimal(15,0)) * cast(f{size - 2 + k} as decimal(15,0)))"
            cuts.append(F.struct(F.expr(f"({exact}) div {under}").alias("score"), F.lit(k).alias("k"), left.alias("l"),
                                 right.alias("r")))
        best = F.when(F.col("size") == size, F.array_min(F.array(*cuts))).otherwise(best)
    # the phrases inside a longer one, all lengths: of size s those of 2 to s - 1 words
    inside = _inside(found_, longest)
    longer = inside.groupBy("part").agg(F.max("a").alias("longer"))
    out = (scored.withColumn("best", best).join(longer, scored["key"] == longer["part"], "left")
           .join(totals, "lang")
           .select("lang", "phrase", "size", "a", "best.l", "best.r", "n", "best.score",
                   (F.coalesce(F.col("longer"), F.lit(0)) * 100 >= F.col("a") * 50).alias("dropped")))
    return out, totals


def _inside(found_: DataFrame, longest: int) -> DataFrame:
    """(part, a): for each candidate the keys of the shorter phrases of 2 or more words that lie inside it."""
    kind = "part long, a long"

    def run(batches):
        for batch in batches:
            size, a = batch.column("size").to_numpy(), batch.column("a").to_numpy()
            lang, text = batch.column("lang").to_pylist(), raw_texts(batch, "phrase")
            keys, counts = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
            for k in range(3, longest + 1):
                at = np.flatnonzero(size == k)
                words = _keys_of_words([text[i] for i in at], [lang[i] for i in at], k)
                for m in range(2, k):
                    for s in range(k - m + 1):
                        keys.append(phrase_keys(words[s:s + m]))
                        counts.append(a[at])
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys)), pa.array(np.concatenate(counts))],
                                             names=["part", "a"])

    return map_batches(found_.where(F.col("size") > 2).select("lang", "phrase", "size", "a"), run, kind)


def collocations(docs: DataFrame, top: int = 2000, least: int = 10, shards: int = SHARDS, longest: int = LONGEST,
                 text_col: str = "text", lang_col: str = "lang", spread_by: tuple[str, ...] = ()) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): the first ``top`` phrases of each language.

    Texts, A-Z lower-cased, are cut at . , ; : ! ? and line ends into pieces, and
    these at spaces and tabs into words. A phrase of 2 to ``longest`` words of one
    piece that occurs a >= ``least`` times is cut in two parts that occur l and r
    times; its score is the whole part of 1000000 a a / (l r) for the cut where
    that is least, the first of equal ones. A phrase inside a longer one with at
    least half its count is dropped. Ranks go by score, then a, both descending,
    then the phrase's bytes; n counts the words of the language.

    A null text has no words, a null language is `und`. Repeated rows count as
    often as they come; a table without words gives no rows. ``spread_by`` names
    more columns by which equal texts are dealt into shards.
    """
    found_, _ = candidates(docs, least, shards, longest, text_col, lang_col, spread_by)
    order = [F.col("score").desc(), F.col("a").desc(), F.col("phrase")]
    kept = found_.where(~F.col("dropped")).drop("dropped", "size")
    # first in each of many parts of a language, so that one task orders few of its phrases
    spread = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    some = F.pmod(F.hash("phrase"), F.lit(spread)).alias("part")
    few = (kept.select("*", some)
           .withColumn("rank", F.row_number().over(Window.partitionBy("lang", "part").orderBy(*order)))
           .where(F.col("rank") <= top).drop("part", "rank"))
    return (few.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long"))
            .where(F.col("rank") <= top).select("lang", "rank", "phrase", "a", "l", "r", "n", "score"))
