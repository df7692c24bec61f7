"""Stupid-backoff scores of documents, computed relationally.

For each order, the n-grams of a text become 64-bit hashes with their count in
the document. Counts and the documents' requests are dealt by that hash into
parts of bounded size, one row with the n-grams of many documents at a time;
in its part every request reads the n-gram's total, and the logarithms are
summed per document. A request whose n-gram the reference lacks
goes on to the next lower order with the backoff penalty.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from quire.llm.common import map_batches, raw_texts, slices, stored, word_keys

ORDER, BACKOFF, SEED = 3, 0.4, 42
#: Share of the documents that is read to find n-grams too frequent for one partition, and how many rows make one so,
#: in shares of a partition. Such n-grams are counted apart and their few totals sent along: only the way differs.
PROBE, HOT = 0.01, 0.5
#: One of the 64-bit multipliers that mix word hashes (an odd constant).
MIX = np.uint64(0x9E3779B97F4A7C15)
#: Bytes of text whose n-grams one part holds; a text of b bytes has at most b / 2 + 1 n-grams of an order.
PART_BYTES = 8 << 20
#: What a document counts beside its text.
DOC_BYTES = 64
#: N-grams dealt to one part: of gram[i] in docs[at[i]] (none if -1) n counts, and how often the total multiplies and
#: divides the score. Arrays of numbers are bytes. A row with words, singles and known has one of each for its docs.
#: A document's sums come back together in its home.
DEALT = ("part long, docs array<{}>, homes array<long>, gram binary, at binary, n binary, pos binary, neg binary, "
         "words binary, singles binary, known binary")
HOME = ("home long, docs array<{}>, part binary, n_words binary, lost binary, singles binary, n_missing binary, "
        "missing binary")
LEVEL = "doc {}, part double, n_words long, lost long, singles long, missing array<long>"
UPPER, LOWER = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ\t\x0b\x0c\r\n", b"abcdefghijklmnopqrstuvwxyz     "
PLAIN = bytes.maketrans(UPPER, LOWER)


def word_hashes(texts: list[bytes]) -> list[np.ndarray]:
    """A hash of each word of each text; words are parted by ASCII white space, with A-Z lower-cased."""
    letters = np.frombuffer(b" ".join(texts).translate(PLAIN) + b" ", np.uint8)
    gap = letters == 32
    after_gap = np.concatenate([[True], gap[:-1]])
    start, end = np.flatnonzero(~gap & after_gap), np.flatnonzero(gap & ~after_gap)
    hashes = word_keys(letters, start, end, np.uint64(SEED))
    return np.split(hashes, np.searchsorted(start, np.cumsum([len(t) + 1 for t in texts])[:-1]))


def grams(words: np.ndarray, order: int) -> np.ndarray:
    """The hash of the n-gram at each start."""
    n = len(words) - order + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    with np.errstate(over="ignore"):
        g = words[:n] + np.uint64(order)
        for i in range(1, order):
            g = (g ^ (g >> np.uint64(31))) * MIX + words[i:i + n]
        g = (g ^ (g >> np.uint64(29))) * MIX
    return g.view(np.int64)


def requests(words: np.ndarray, order: int, top: int, missing: set | None) -> tuple[np.ndarray, ...]:
    """Per distinct n-gram of this order: its hash, its count, how often that count multiplies the score, and divides.

    Position i is scored by the longest n-gram that ends there: of the top
    order, or of all words before. If that one is in ``missing`` (hashes of
    the n-grams of higher orders that the reference lacks), by the next shorter.
    """
    own = grams(words, order)
    if not missing:
        keys, n = np.unique(own, return_counts=True)
        pos, neg = np.zeros(len(keys), np.int64), np.zeros(len(keys), np.int64)
        if order == top:
            pos = n
        elif len(own):
            first = np.searchsorted(keys, own[0])
            pos[first] = 1
            if order == top - 1:  # each but the last is the context of a longer one
                neg = n.copy()
                neg[np.searchsorted(keys, own[-1])] -= 1
            elif len(own) > 1:
                neg[first] = 1
        return keys, n, pos, neg
    lost = np.fromiter(missing, np.int64, len(missing))

    def reached(k: int) -> np.ndarray:
        """Whether the n-gram of order k at each start is asked for."""
        g = grams(words, k)
        if k == top:
            return np.ones(len(g), bool)
        first = np.arange(len(g)) == 0
        first[1:] |= reached(k + 1) & np.isin(grams(words, k + 1), lost)
        return first

    pos, neg = reached(order).astype(np.int64), np.zeros(len(own), np.int64)
    if order < top and len(own):
        longer = reached(order + 1) & ~np.isin(grams(words, order + 1), lost)
        neg[:len(longer)] += longer
    keys, at = np.unique(own, return_inverse=True)
    total = lambda v: np.bincount(at, v, len(keys)).astype(np.int64)
    return keys, total(None), total(pos), total(neg)


def names_of(fields: str) -> list[str]:
    return [f.split()[0] for f in fields.split(", ")]


def numbers(table: pa.Table, column: str, kind) -> np.ndarray:
    """The numbers of all rows' bytes."""
    return np.frombuffer(b"".join(v.as_py() or b"" for v in table.column(column)), kind)


def ids_of(table: pa.Table) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """The distinct documents of all rows' docs, which of them each is, and how many a row has."""
    lists = table.column("docs").combine_chunks()
    ids = pc.dictionary_encode(lists.flatten(), null_encoding="encode")
    sizes = pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
    return ids.dictionary, ids.indices.to_numpy(zero_copy_only=False).astype(np.int64), sizes


def in_lists(values: pa.Array, sizes) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.cumsum([0, *sizes]).astype(np.int32)), values)


def entries(batches: Iterator[pa.RecordBatch], order: int, top: int, counts: bool, asks: bool, hot: dict[int, int],
            only: set[int] | None = None) -> Iterator[tuple]:
    """Per slice of the documents: the slice, the n-grams of one order (at, gram, n, pos, neg), and per document its
    number of words, of words scored on their own, and the part of its score that ``hot`` totals give.

    With ``counts`` the n-grams are counted (n), with ``asks`` the documents
    request them (pos, neg). Counts that no request of the same document goes
    with are summed over the slice, and of no document (at -1). ``only`` keeps
    just these n-grams, to count them. A column ``missing`` lists what a
    document's higher orders lack.
    """
    often = np.array(sorted(only if only is not None else hot), np.int64)
    logs = np.log(np.array([hot.get(int(g), 1) for g in often], float))
    none = np.zeros(0, np.int64)
    for batch in slices(batches, "text"):
        gone = (batch.column("missing").to_pylist() if "missing" in batch.schema.names
                else [None] * batch.num_rows)
        asked, loose, own, size = [[none] * 4], [[none] * 2], [], []
        for i, words in enumerate(word_hashes(raw_texts(batch, "text"))):
            gram, n, pos, neg = requests(words, order, top, set(gone[i]) if gone[i] else None)
            known, singles = 0.0, int(pos.sum()) if order == 1 else 0
            if len(often) and len(gram):
                place = np.minimum(np.searchsorted(often, gram), len(often) - 1)
                is_hot = often[place] == gram
                if only is None:
                    known = float(((pos - neg)[is_hot] * logs[place[is_hot]]).sum())
                keep = is_hot if only is not None else ~is_hot
                gram, n, pos, neg = gram[keep], n[keep], pos[keep], neg[keep]
            wanted = pos + neg > 0 if asks else np.zeros(len(gram), bool)
            own.append((len(words) if order == 1 else 0, singles, known))
            size.append(int(wanted.sum()))
            asked.append([gram[wanted], n[wanted] if counts else np.zeros(size[i], np.int64), pos[wanted], neg[wanted]])
            if counts:
                loose.append([gram[~wanted], n[~wanted]])
        asked = [np.concatenate(c) for c in zip(*asked)]
        loose = [np.concatenate(c) for c in zip(*loose)]
        keys, at = np.unique(loose[0], return_inverse=True)
        times, nought = np.bincount(at, loose[1], len(keys)).astype(np.int64), np.zeros(len(keys), np.int64)
        found = [np.concatenate(c) for c in zip(
            (np.repeat(np.arange(len(size)), size), *asked), (nought - 1, keys, times, nought, nought))]
        yield batch, found, own


def dealt(docs: DataFrame, order: int, top: int, counts: bool, asks: bool, hot: dict[int, int], parts: list[int]) -> DataFrame:
    """The n-grams of one order (see ``entries``), dealt into parts by their hash: rows as in DEALT."""
    kind, names, many = docs.schema["doc"].dataType, names_of(DEALT), len(parts)

    def run(batches):
        for batch, (at, gram, n, pos, neg), own in entries(batches, order, top, counts, asks, hot):
            part = ((gram.view(np.uint64) >> np.uint64(40)) % np.uint64(many)).astype(np.int64)
            by = np.argsort(part, kind="stable")  # in a part by document
            edges = np.append(np.flatnonzero(np.diff(part[by], prepend=-1)), len(by))
            columns = [[] for _ in names]
            for start, end in zip(edges[:-1], edges[1:]):
                here = by[start:end]
                owner, place = np.unique(at[here], return_inverse=True)
                if len(owner) and owner[0] < 0:
                    owner, place = owner[1:], place - 1
                arrays = (place, n[here], pos[here], neg[here])
                row = (parts[part[here[0]]], owner, None, gram[here].tobytes(), *(c.astype(np.int32).tobytes() for c in arrays),
                       None, None, None)
                for column, value in zip(columns, row):
                    column.append(value)
            if asks:
                row = (parts[int(gram[0] % many) if len(gram) else 0], np.arange(len(own)), *[None] * 6,
                       *(np.array(c, t).tobytes() for c, t in zip(zip(*own), (np.int64, np.int64, np.float64))))
                for column, value in zip(columns, row):
                    column.append(value)
            owners = columns[1]
            if not owners:
                continue
            take, sizes = pa.array(np.concatenate(owners).astype(np.int64)), [len(o) for o in owners]
            yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int64()),
                                              *(in_lists(batch.column(c).take(take), sizes) for c in ("doc", "home")),
                                              *(pa.array(c, pa.binary()) for c in columns[3:])], names=names)

    homed = docs.withColumn("home", F.pmod(F.xxhash64("doc"), F.lit(many)))
    return map_batches(homed, run, DEALT.format(kind.simpleString()))


def even_keys(spark: SparkSession, parts: int) -> list[int]:
    """For each of so many shuffle partitions a number that Spark's hash puts there, so that each gets one part."""
    keys = spark.range(24 * parts).groupBy(F.pmod(F.hash("id"), F.lit(parts)).alias("at")).agg(F.min("id").alias("key"))
    found = {r["at"]: r["key"] for r in keys.collect()}
    return [found.get(i, 24 * parts + i) for i in range(parts)]


def level_of(found: DataFrame, kind, parts: list[int], list_missing: bool) -> DataFrame:
    """What the documents' requests of one order give: rows as in LEVEL, one for each document."""
    back, names, arrow = names_of(HOME), names_of(LEVEL), to_arrow_type(kind)

    def totals(table: pa.Table) -> pa.Table:
        """Each request reads its n-gram's total; a document's sums go home."""
        gram = numbers(table, "gram", np.int64)
        at, n, pos, neg = (numbers(table, c, np.int32) for c in ("at", "n", "pos", "neg"))
        ids, code, sizes = ids_of(table)
        size, base = len(ids), np.cumsum(sizes) - sizes
        by = np.argsort(gram)
        ordered = gram[by]
        new = np.append(True, ordered[1:] != ordered[:-1])[:len(gram)]
        total = np.add.reduceat(n[by].astype(np.int64), np.flatnonzero(new)) if len(gram) else np.zeros(0, np.int64)
        times = np.empty(len(gram), np.int64)
        times[by] = np.repeat(total, np.diff(np.append(np.flatnonzero(new), len(gram))))
        del by, ordered, new, total, n
        asked = at >= 0
        held = pc.fill_null(pc.binary_length(table.column("gram")), 0).to_numpy(zero_copy_only=False) // 8
        owner = code[(at + np.repeat(base, held))[asked]]
        times, gram, pos, neg = times[asked], gram[asked], pos[asked], neg[asked]
        seen = times > 0
        is_own = pc.is_valid(table.column("words")).to_numpy(zero_copy_only=False)
        of_own = code[np.repeat(is_own, sizes)]
        words, singles, known = (np.bincount(of_own, numbers(table, c, t), size) for c, t in (
            ("words", np.int64), ("singles", np.int64), ("known", np.float64)))
        part = known + np.bincount(owner, (pos - neg) * np.log(np.where(seen, times, 1)), size)
        lost = np.bincount(owner[~seen], pos[~seen], size)
        home = np.zeros(size, np.int64)
        home[code] = table.column("homes").combine_chunks().flatten().to_numpy(zero_copy_only=False)
        order = np.argsort(home, kind="stable")
        rank = np.empty(size, np.int64)
        rank[order] = np.arange(size)
        absent = ~seen & (pos > 0) if list_missing else np.zeros(len(seen), bool)
        lost_at = rank[owner[absent]]
        missing = gram[absent][np.argsort(lost_at, kind="stable")]
        n_missing = np.bincount(lost_at, minlength=size)
        ends = np.cumsum(np.append(0, n_missing))
        edges = np.append(np.flatnonzero(np.diff(home[order], prepend=-1)), size)
        sums = [part[order].astype(float), *(c[order].astype(np.int64) for c in (words, lost, singles)), n_missing]
        spans = list(zip(edges[:-1], edges[1:]))
        return pa.Table.from_arrays(
            [pa.array(np.array(parts, np.int64)[home[order][edges[:-1]]]),
             in_lists(ids.take(pa.array(order)).cast(arrow), np.diff(edges)),
             *(pa.array([c[a:b].tobytes() for a, b in spans], pa.binary()) for c in sums),
             pa.array([missing[ends[a]:ends[b]].tobytes() for a, b in spans], pa.binary())], names=back)

    def at_home(table: pa.Table) -> pa.Table:
        """A document's sums of all parts."""
        ids, code, _ = ids_of(table)
        sums = [np.bincount(code, numbers(table, c, t), len(ids)).astype(t) for c, t in (
            ("part", np.float64), ("n_words", np.int64), ("lost", np.int64), ("singles", np.int64))]
        owner = np.repeat(code, numbers(table, "n_missing", np.int64))
        missing = numbers(table, "missing", np.int64)[np.argsort(owner, kind="stable")]
        return pa.Table.from_arrays(
            [ids.cast(arrow), *(pa.array(c) for c in sums),
             in_lists(pa.array(missing), np.bincount(owner, minlength=len(ids)))], names=names)

    def at_once(run):
        def of_part(batches):
            whole = [b for b in batches if b.num_rows]
            if whole:
                yield from run(pa.Table.from_batches(whole)).to_batches()
        return of_part

    sent = map_batches(found.repartition(len(parts), "part"), at_once(totals), HOME.format(kind.simpleString()))
    return map_batches(sent.repartition(len(parts), "home"), at_once(at_home), LEVEL.format(kind.simpleString()))


def gram_counts(docs: DataFrame, order: int, top: int, asks: bool, only: set[int] | None = None) -> DataFrame:
    """Rows (gram, n), as they are dealt, for n-grams that a few documents have or for a few n-grams."""
    def run(batches):
        for _, (_, gram, n, _, _), _ in entries(batches, order, top, True, asks, {}, only):
            yield pa.RecordBatch.from_arrays([pa.array(gram), pa.array(n)], names=["gram", "n"])

    return map_batches(docs, run, "gram long, n long")


def hot_counts(reference: DataFrame, probe: DataFrame, order: int, top: int, parts: int | None = None) -> dict[int, int]:
    """Exact totals of the n-grams that a probe of the documents shows to hold a large share of a part's entries."""
    share = HOT / (parts or int(reference.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    by_gram = stored(gram_counts(probe, order, top, True).groupBy("gram").agg(F.count("*").alias("n")), "probe")
    total = by_gram.agg(F.sum("n").alias("n")).first()["n"] or 0
    found = by_gram.where((F.col("n") > share * total) & (F.col("n") > 20)).collect()
    often = {r["gram"] for r in found}
    if not often:
        return {}
    exact = gram_counts(reference, order, top, False, often).groupBy("gram").agg(F.sum("n").alias("n")).collect()
    return {r["gram"]: r["n"] for r in exact}


def score(docs: DataFrame, reference: DataFrame | None = None, id_col: str = "doc_id", text_col: str = "text",
          order: int = ORDER, backoff: float = BACKOFF) -> DataFrame:
    """(doc_id, n_words, log_score, per_word) for every document.

    log_score sums log S(word | up to order - 1 words before), where S is the
    n-gram's count over its context's count in the reference, or ``backoff``
    times the S of a context shorter by one word if the reference lacks the
    n-gram; a word that it lacks counts as half a time. The reference is
    ``docs`` itself if none is given. All documents are counted, whole.

    Without a reference scores are in-sample: a document's own n-grams are
    among the counts, so none is missing and nothing backs off. A text of words
    found nowhere else then has S = 1 from its second word on, the best there
    is; per_word tells such texts from good ones only with another reference.

    A null or empty text has no words and scores 0. Rows of one doc_id, null
    included, are one document: their sums are added. Empty tables give no
    rows; an empty reference backs off everywhere.
    """
    src = docs.select(F.col(id_col).alias("doc"), F.col(text_col).cast("string").alias("text"))
    base = src if reference is None else reference.select(F.col(id_col).alias("doc"),
                                                          F.col(text_col).cast("string").alias("text"))
    parts, asking, kind = None, src, src.schema["doc"].dataType
    probe = stored(base.sample(PROBE, SEED), "probe-docs")
    spent = F.coalesce(F.octet_length("text"), F.lit(0)).cast("long") + DOC_BYTES
    size = sum(df.agg(F.sum(spent).alias("n")).first()["n"] or 0
               for df in ([src] if reference is None else [src, base]))
    many = max(math.ceil(size / PART_BYTES), 2 * src.sparkSession.sparkContext.defaultParallelism)
    dealt_to = even_keys(src.sparkSession, many)
    for k in range(order, 0, -1):
        hot = hot_counts(base, probe, k, order, many)
        found = dealt(asking, k, order, reference is None, True, hot, dealt_to)
        if reference is not None:
            counted = dealt(base.select(F.lit(None).cast(kind).alias("doc"), "text"), k, order, True, False, hot, dealt_to)
            found = found.unionByName(counted)
        lists = reference is not None and k > 1
        level = stored(level_of(found, kind, dealt_to, lists), f"order-{k}")
        extra = F.lit(math.log(backoff)) if k > 1 else F.lit(math.log(0.5))
        one = level.select("doc", "n_words", "singles", (F.col("part") + F.col("lost") * extra).alias("part"))
        parts = one if parts is None else parts.unionByName(one)
        if reference is not None and k > 1:
            now = level.select("doc", F.col("missing").alias("more"))
            none = F.array().cast("array<long>")
            before = F.col("a.missing") if "missing" in asking.columns else none
            asking = (asking.alias("a").join(now.alias("b"), F.col("a.doc").eqNullSafe(F.col("b.doc")), "left")
                      .select("a.doc", "a.text", F.concat(before, F.coalesce("b.more", none)).alias("missing")))
    if reference is None:
        words = parts.agg(F.sum("n_words").alias("n")).first()["n"] or 0
    else:
        size = F.size(F.filter(F.split("text", r"[\x20\x09-\x0D]+"), lambda w: w != ""))
        words = base.where("text is not null").agg(F.sum(size.cast("long")).alias("n")).first()["n"] or 0
    whole = parts.groupBy("doc").agg(F.sum("n_words").alias("n_words"), F.sum("singles").alias("singles"),
                                     F.sum("part").alias("part"))
    total = F.col("part") - F.col("singles") * math.log(max(words, 1))
    return whole.select(F.col("doc").alias("doc_id"), "n_words", total.alias("log_score"),
                        F.when(F.col("n_words") > 0, total / F.col("n_words")).alias("per_word"))
