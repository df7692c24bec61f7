"""Alignment of two tokenizers over a corpus, with corpus-wide counts of the token pairs that overlap.

The first pass aligns each document and counts, per task, in how many
documents a pair of ids overlaps. The distinct pairs get a minimal perfect
hash; each task's counts become dense vectors indexed by it, which are added
up in a tree. The second pass aligns the documents again and looks the
counts of their pairs up, each checked by the key that is stored with it.

Where both tokenizers always cut before a lone space, a text is aligned chunk
by chunk, and a chunk that was seen before is read from a cache.
"""

from __future__ import annotations

import json
import re
import sys
import types
import uuid
import zlib
from itertools import chain, islice

import numpy as np
import pandas as pd
import public_tokenizers
import pyarrow as pa
import sentencepiece
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from quire.llm.common import map_batches, raw_texts, slices, stored
from quire.llm.perfect_hash import PerfectHash, build, segment_of

#: Segments of the perfect hash. With two vocabularies of some 50,000 ids one holds at most a few million pairs.
SEGMENTS = 256
#: Vectors that one task adds up at a time.
FAN = 16
#: Pairs that one second pass looks up (some 20 bytes each are sent to every task); more pairs take more passes.
BLOCK_PAIRS = 4_000_000
#: Distinct chunks in a cache, and their bytes, before it is emptied; distinct pairs that a task holds before it emits.
CACHE_CHUNKS, CACHE_BYTES, HELD_PAIRS = 400_000, 32 << 20, 1_000_000
#: A space after anything but a space, before a byte that starts no white space.
LONE_SPACE = re.compile(rb"(?<=[^ ]) (?=[!-\xc1\xc3-\xe0\xe4-\xff])")
#: A chunk that starts or ends with white space, or with bytes that could be.
ODD_CHUNK = re.compile(rb"^[\x00-\x20\xc2\xe1-\xe3]|[\x00-\x20]$|\xc2[\x80-\xbf]$|[\xe1-\xe3][\x80-\xbf]{2}$|^$")
#: Chunks that are encoded as one text.
TOGETHER = 100
#: How byte-level vocabularies cut a text (fixed value).
BYTE_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
META_SPACE = "▁"


def _byte_letters() -> dict[str, int]:
    """The letters that byte-level vocabularies write for bytes: printable ones stand for themselves, the others
    follow from U+0100."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(0x100 + i): b for i, b in enumerate(rest)}


def bytes_of_a(spec: str) -> list[bytes]:
    """The bytes of each id of a byte-level vocabulary."""
    letters, tokenizer = _byte_letters(), Tokenizer.from_str(spec)
    special = {i for i, t in tokenizer.get_added_tokens_decoder().items() if t.special}
    out = [b""] * tokenizer.get_vocab_size(with_added_tokens=True)
    for token, i in tokenizer.get_vocab(with_added_tokens=True).items():
        out[i] = token.encode() if i in special else bytes(letters[c] for c in token)
    return out


def bytes_of_b(model: sentencepiece.SentencePieceProcessor) -> list[bytes]:
    """The bytes of each piece: U+2581 is a space, byte pieces are their byte."""
    return [bytes([int(model.id_to_piece(i)[3:5], 16)]) if model.is_byte(i)
            else model.id_to_piece(i).replace(META_SPACE, " ").encode() for i in range(model.get_piece_size())]


def cuts_bytes(spec: str) -> bool:
    """Whether a tokenizer cuts plain text by BYTE_PATTERN, as byte-level vocabularies do."""
    rules = json.loads(spec)
    cutter = rules.get("pre_tokenizer") or {}
    return (cutter.get("type"), cutter.get("use_regex"), cutter.get("add_prefix_space"), rules.get("normalizer")) == (
        "ByteLevel", True, False, None)


def _quick_encoder(spec: str, spelling: list[bytes]) -> tiktoken.Encoding | None:
    """The same byte-pair encoding by ranks, which takes a fifth of the time; None unless ids are in order of merges."""
    model = json.loads(spec)["model"]
    merges = [m if isinstance(m, list) else m.split(" ") for m in model.get("merges", [])]
    made = [model["vocab"].get("".join(m), -1) for m in merges]
    special = {i for i, t in Tokenizer.from_str(spec).get_added_tokens_decoder().items()}
    if model.get("type") != "BPE" or model.get("dropout") or made != sorted(made) or -1 in made:
        return None
    ranks = {t: i for i, t in enumerate(spelling) if t and i not in special}
    return tiktoken.Encoding("by_ranks", pat_str=BYTE_PATTERN, mergeable_ranks=ranks, special_tokens={})


def _sorted_once(values: np.ndarray) -> np.ndarray:
    values = np.sort(values)
    return values[np.concatenate([[True], values[1:] != values[:-1]])] if len(values) else values


class _Numbers(dict):
    """Numbers chunks as they are first asked for."""

    def __missing__(self, chunk: bytes) -> int:
        self[chunk] = n = len(self)
        return n


class Aligner:
    """Aligns texts by two tokenizers and remembers the chunks it has seen."""

    def __init__(self, spec: str, model: bytes):
        self.a = Tokenizer.from_str(spec)
        self.a.no_truncation()
        self.a.no_padding()
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_proto=model)
        self.bytes_a, self.bytes_b = bytes_of_a(spec), bytes_of_b(self.b)
        self.length_a = np.array([len(t) for t in self.bytes_a], np.int64)
        self.length_b = np.array([len(t) for t in self.bytes_b], np.int64)
        cuts_a = cuts_bytes(spec)
        self.quick = _quick_encoder(spec, self.bytes_a) if cuts_a else None
        cuts_b = not any(b" " in t.lstrip(b" ") for t in self.bytes_b)
        self.by_chunk = cuts_a and cuts_b
        self.key = self.counted = None
        self.clear()

    def clear(self):
        self.number = _Numbers()
        self.held = 0
        self.groups: list[str] = []
        self.flat = np.zeros(0, np.int64)
        #: per chunk: 1 if both tokenizers give back its bytes, tokens of A, of B, groups, links, first link
        self.facts = np.zeros((0, 6), np.int64)
        #: per chunk: links of the best count, sum of the counts
        self.worth = np.zeros((0, 2), np.int64)

    def chunks(self, batch: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(text, chunk): the numbers of the chunks of all texts, in order; new ones are aligned first. An empty text
        has none."""
        if len(self.number) > CACHE_CHUNKS or self.held > CACHE_BYTES:
            self.clear()
        known = len(self.number)
        parts = [(LONE_SPACE.split(t) if self.by_chunk else [t]) if t else [] for t in batch]
        chunk = np.array(list(map(self.number.__getitem__, chain.from_iterable(parts))), np.int64)
        if len(self.number) > known:
            self._learn(list(islice(self.number, known, None)))
        return np.repeat(np.arange(len(parts)), list(map(len, parts))), chunk

    def sound(self, text: np.ndarray, chunk: np.ndarray, n: int) -> np.ndarray:
        """Which of ``n`` texts have chunks, all of them spelled by both tokenizers."""
        return (np.bincount(text, minlength=n) > 0) & (np.bincount(text, self.facts[chunk, 0] == 0, n) == 0)

    def _learn(self, new: list[bytes]):
        self.held += sum(map(len, new))
        facts, worth, groups = np.zeros((len(new), 6), np.int64), np.zeros((len(new), 2), np.int64), [""] * len(new)
        odd = [i for i, p in enumerate(new) if ODD_CHUNK.search(p)] if self.by_chunk else list(range(len(new)))
        plain = np.setdiff1d(np.arange(len(new)), odd, assume_unique=True)
        if len(plain):  # neither tokenizer joins plain chunks, so many are encoded as one text
            parts = [new[i] for i in plain.tolist()]
            some = [b" ".join(parts[i:i + TOGETHER]).decode("utf-8", "replace") for i in range(0, len(parts), TOGETHER)]
            a, b = (list(chain.from_iterable(ids)) for ids in (self._encoded_a(some), self.b.encode(some, num_threads=1)))
            if self._spelled(a, b, b" " + b" ".join(parts)):
                self._align(plain, new, a, b, facts, worth, groups)
            else:
                odd = list(range(len(new)))
        texts = [new[i].decode("utf-8", "replace") for i in odd]
        ids_a, ids_b = self._encoded_a(texts), self.b.encode(texts, num_threads=1) if texts else []
        sound = [k for k, i in enumerate(odd) if self._spelled(ids_a[k], ids_b[k], b" " + new[i])]
        if sound:
            self._align(np.array([odd[k] for k in sound]), new, list(chain.from_iterable(ids_a[k] for k in sound)),
                        list(chain.from_iterable(ids_b[k] for k in sound)), facts, worth, groups)
        self.facts, self.worth = np.concatenate([self.facts, facts]), np.concatenate([self.worth, worth])
        self.groups += groups

    def _encoded_a(self, texts: list[str]) -> list[list[int]]:
        if self.quick is not None:
            return [self.quick.encode_ordinary(" " + t) for t in texts]
        return [e.ids for e in self.a.encode_batch_fast([" " + t for t in texts], add_special_tokens=False)]

    def _spelled(self, a: list[int], b: list[int], text: bytes) -> bool:
        return b"".join([self.bytes_a[t] for t in a]) == text and b"".join([self.bytes_b[t] for t in b]) == text

    def _align(self, index: np.ndarray, new: list[bytes], a: list[int], b: list[int], facts: np.ndarray,
               worth: np.ndarray, groups: list[str]):
        """Fills in what is known of the chunks at ``index``, whose tokens are ``a`` and ``b``, chunk after chunk."""
        a, b = np.array(a, np.int64), np.array(b, np.int64)
        end_a, end_b = np.cumsum(self.length_a[a]), np.cumsum(self.length_b[b])
        every, both = _sorted_once(np.concatenate([end_a, end_b])), np.intersect1d(end_a, end_b, assume_unique=True)
        stop = np.cumsum([1 + len(new[i]) for i in index.tolist()])
        upto = [np.searchsorted(ends, stop, "right") for ends in (end_a, end_b, both, every)]
        n_a, n_b, n_groups, n_links = (np.diff(n, prepend=0) for n in upto)
        links = a[np.searchsorted(end_a, every)] * len(self.bytes_b) + b[np.searchsorted(end_b, every)]
        facts[index] = np.stack([np.ones_like(n_a), n_a, n_b, n_groups, n_links, len(self.flat) + upto[3] - n_links], axis=1)
        self.flat = np.concatenate([self.flat, links])
        if self.counted is None:  # the first pass needs no more
            return
        side = np.concatenate([2 * np.searchsorted(both, end_a), 2 * np.searchsorted(both, end_b) + 1])
        order = np.argsort(side, kind="stable")
        ids, side = np.concatenate([a, b])[order], side[order]
        after = np.where(np.diff(side, append=-1) == 0, ",", np.where(side % 2 == 0, "|", ";"))
        parts = [f"{i}{c}" for i, c in zip(ids.tolist(), after.tolist())]
        start = 0
        for i, n in zip(index.tolist(), (n_a + n_b).tolist()):
            groups[i] = "".join(parts[start:start + n])[:-1]
            start += n
        table, counts, best = self.counted
        at = table.find(links)
        n = np.where(at >= 0, counts[at] if len(counts) else 0, 0)
        is_best = (at >= 0) & (n == best[links // len(self.bytes_b)])
        sums = [np.concatenate([[0], np.cumsum(v)]) for v in (is_best, n)]
        worth[index] = np.stack([v[upto[3]] - v[upto[3] - n_links] for v in sums], axis=1)

    def use(self, key, counted: tuple | None):
        """From now on look links up in ``counted``, named by ``key``: a PerfectHash, the counts by index, and the best
        count per id of A."""
        if self.key != key:
            self.clear()
            self.key, self.counted = key, counted


def worker_aligner(spec: str, model: bytes) -> Aligner:
    """The aligner of this Python worker, which keeps its cache from task to task."""
    held = sys.modules.setdefault("_token_aligners", types.ModuleType("_token_aligners"))
    key = (zlib.crc32(spec.encode()), zlib.crc32(model))
    if held.__dict__.get("key") != key:
        held.key, held.aligner = key, Aligner(spec, model)
    return held.aligner


def _pairs_of(aligner: Aligner, batch: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(pair, documents that hold it) of some documents."""
    text, chunk = aligner.chunks(batch)
    keep = aligner.sound(text, chunk, len(batch))[text]
    # each chunk of a document once, then each pair of a document once
    held = _sorted_once(text[keep] << 32 | chunk[keep])
    if not len(held):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    text, chunk = held >> 32, held & 0xFFFFFFFF
    n, first = aligner.facts[chunk, 4], aligner.facts[chunk, 5]
    ends = np.cumsum(n)
    links = aligner.flat[np.repeat(first - ends + n, n) + np.arange(ends[-1])]
    of = np.repeat(text, n)
    # ordered by pair, then text: a pair stays below 2 ** 32, a slice has fewer than 2 ** 31 texts
    once = _sorted_once(links << 31 | of) >> 31
    start = np.flatnonzero(np.concatenate([[True], once[1:] != once[:-1]]))
    return once[start], np.diff(np.append(start, len(once)))


def _merged(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    keys, at = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
    return keys, np.bincount(at, np.concatenate([p[1] for p in parts]), len(keys)).astype(np.int64)


def task_counts(src: DataFrame, spec: str, model: bytes) -> DataFrame:
    """(segment, leaf, pairs, counts): per task and segment, in how many documents each pair overlaps."""

    def rows(parts, leaf):
        keys, n = _merged(parts)
        segment = segment_of(keys, SEGMENTS)
        order = np.argsort(segment, kind="stable")
        keys, n, segment = keys[order], n[order], segment[order]
        which, start = np.unique(segment, return_index=True)
        ends = pa.array(np.append(start, len(keys)).astype(np.int32))
        yield pa.RecordBatch.from_arrays(
            [pa.array(which.astype(np.int32)), pa.array(np.full(len(which), leaf, np.int32)),
             pa.ListArray.from_arrays(ends, pa.array(keys)), pa.ListArray.from_arrays(ends, pa.array(n))],
            names=["segment", "leaf", "pairs", "counts"])

    def run(batches):
        aligner, held = worker_aligner(spec, model), []
        aligner.use(None, None)
        leaf = TaskContext.get().partitionId()
        for batch in slices(batches, "text"):
            held.append(_pairs_of(aligner, raw_texts(batch, "text")))
            if sum(len(k) for k, _ in held) > HELD_PAIRS:
                held = [_merged(held)]
                if len(held[0][0]) > HELD_PAIRS // 2:
                    yield from rows(held, leaf)
                    held = []
        if held:
            yield from rows(held, leaf)

    return map_batches(src.select("text"), run, "segment int, leaf int, pairs array<long>, counts array<long>")


def _hashed(counts: DataFrame) -> DataFrame:
    """(segment, sizes, bits, keys): the minimal perfect hash of the distinct pairs of each segment."""

    def run(batches):
        for batch in batches:
            for segment, keys in zip(batch.column("segment").to_pylist(), batch.column("keys")):
                sizes, bits, by_index = build(keys.values.to_numpy())
                yield pa.RecordBatch.from_pydict(
                    {"segment": pa.array([segment], pa.int32()), "sizes": pa.array([sizes], pa.list_(pa.int32())),
                     "bits": pa.array([bits], pa.binary()), "keys": pa.array([by_index], pa.list_(pa.int64()))})

    distinct = counts.select("segment", F.explode("pairs").alias("pair")).distinct()
    return map_batches(distinct.groupBy("segment").agg(F.collect_list("pair").alias("keys")), run,
                       "segment int, sizes array<int>, bits binary, keys array<long>")


def _summed(counts: DataFrame, hashed: DataFrame) -> DataFrame:
    """(segment, total): the dense vectors of all tasks, indexed by the perfect hash, added up in a tree."""
    kind = "segment int, leaf int, total array<long>"
    branch = (F.col("leaf") / FAN).cast("int").alias("leaf")

    def dense(pdf: pd.DataFrame) -> pd.DataFrame:
        row = pdf.iloc[0]
        table = PerfectHash(SEGMENTS, [(row["segment"], row["sizes"], row["bits"], row["keys"])])
        total = np.zeros(len(table.keys), np.int64)
        for pairs, n in zip(pdf["pairs"], pdf["counts"]):
            total[table.find(pairs)] += n  # pairs are distinct within a row
        return pd.DataFrame({"segment": [row["segment"]], "leaf": [row["leaf"]], "total": [total]})

    def added(pdf: pd.DataFrame) -> pd.DataFrame:
        total = pdf["total"].iloc[0].copy()
        for more in pdf["total"].iloc[1:]:
            total += more
        return pd.DataFrame({"segment": [pdf["segment"].iloc[0]], "leaf": [pdf["leaf"].iloc[0]], "total": [total]})

    leaves = counts.agg(F.max("leaf")).first()[0] or 0
    level = (counts.join(hashed, "segment").select("segment", branch, "pairs", "counts", "sizes", "bits", "keys")
             .groupBy("segment", "leaf").applyInPandas(dense, kind))
    while leaves >= FAN:
        leaves //= FAN
        level = level.select("segment", branch, "total").groupBy("segment", "leaf").applyInPandas(added, kind)
    return level.select("segment", "total")


def pair_counts(docs: DataFrame, spec: str, model: bytes, text_col: str = "text") -> DataFrame:
    """(segment, sizes, bits, keys, total): per segment of the perfect hash its pairs and in how many documents each
    pair of overlapping tokens occurs. A pair is the id of A times the size of B's vocabulary, plus the id of B."""
    counts = stored(task_counts(docs.select(F.col(text_col).cast("string").alias("text")), spec, model), "pair-counts")
    hashed = stored(_hashed(counts), "pair-hashes")
    return stored(hashed.join(_summed(counts, hashed), "segment"), "pair-totals")


def _blocks(sizes: list[tuple[int, int]], limit: int):
    """Segments, in order, in blocks of at most ``limit`` pairs, one segment at least."""
    block, held = [], 0
    for segment, n in sizes:
        if block and held + n > limit:
            yield block
            block, held = [], 0
        block.append(segment)
        held += n
    if block:
        yield block


def align(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", spec_path: str | None = None,
          model_path: str | None = None, block_pairs: int = BLOCK_PAIRS) -> DataFrame:
    """(id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups) for every row.

    A encodes a space and the text, B the text, to which it adds the space; strings
    of special tokens are plain text. Offsets where tokens of both end part them
    into ``groups``, written `a,a|b;a|b`. A link is a pair of tokens that share
    bytes; its count is the number of rows that hold the link's pair of ids.
    n_best is the number of links whose count is the highest of their id of A,
    count_sum the sum over links.

    A null or empty text, and one that A or B does not spell byte by byte, has no
    tokens: zeros, and empty groups. Repeated rows count as often as they come;
    ids play no part. An empty table gives an empty result.
    """
    with open(spec_path or public_tokenizers.path("byte_bpe_50k.json"), encoding="utf-8") as f:
        spec = f.read()
    with open(model_path or public_tokenizers.path("piece_bpe_32k.model"), "rb") as f:
        model = f.read()
    size_b = sentencepiece.SentencePieceProcessor(model_proto=model).get_piece_size()
    totals = pair_counts(docs, spec, model, text_col)
    spark = docs.sparkSession
    best = np.zeros(len(bytes_of_a(spec)), np.int64)
    pairs = totals.select(F.explode(F.arrays_zip("keys", "total")).alias("p")).select("p.keys", "p.total")
    # one row per id of A, so bounded by the vocabulary
    highest = (pairs.groupBy((F.col("keys") / size_b).cast("long").alias("a")).agg(F.max("total").alias("n")).toPandas())
    best[highest["a"].to_numpy(np.int64)] = highest["n"].to_numpy(np.int64)
    sizes = sorted((r["segment"], r["n"]) for r in totals.select("segment", F.size("keys").alias("n")).collect())
    kind = docs.schema[id_col].dataType.simpleString()
    zero = F.lit(0).cast("long")
    out = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"), zero.alias("n_best"),
                      zero.alias("count_sum"))
    blocks = list(_blocks(sizes, block_pairs)) or [[]]
    for number, block in enumerate(blocks):
        got = totals.where(F.col("segment").isin(block)).toPandas() if block else None
        rows = [] if got is None else list(zip(got["segment"], got["sizes"], got["bits"], got["keys"]))
        counts = np.concatenate(list(got["total"])) if rows else np.zeros(0, np.int64)
        sent = spark.sparkContext.broadcast((rows, counts, best))
        out = _second_pass(out, spec, model, sent, last=number == len(blocks) - 1)
    return out


def _second_pass(rows: DataFrame, spec: str, model: bytes, sent, last: bool) -> DataFrame:
    """Aligns again, and adds what the pairs of one block are worth; the texts go on unless this is the last block."""
    key = uuid.uuid4().hex
    names = ["id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups"]

    def run(batches):
        aligner = worker_aligner(spec, model)
        for batch in slices(batches, "text"):
            if aligner.key != key:
                held, counts, best = sent.value
                aligner.use(key, (PerfectHash(SEGMENTS, held), counts, best))
            size = batch.num_rows
            text, chunk = aligner.chunks(raw_texts(batch, "text"))
            sound = aligner.sound(text, chunk, size)
            found = np.concatenate([aligner.facts[chunk, 1:5], aligner.worth[chunk]], axis=1)
            sums = np.concatenate([np.zeros((1, 6), np.int64), np.cumsum(found, axis=0)])
            stop = np.searchsorted(text, np.arange(size), "right")
            start = np.concatenate([[0], stop[:-1]])
            each = np.where(sound[:, None], sums[stop] - sums[start], 0)
            facts, worth = each[:, :4], each[:, 4:] + np.stack(
                [batch.column(c).to_numpy() for c in ("n_best", "count_sum")], axis=1)
            groups = []
            if last:
                spelled = list(map(aligner.groups.__getitem__, chunk.tolist()))
                groups = [";".join(spelled[s:e]) if ok else "" for s, e, ok in zip(
                    start.tolist(), stop.tolist(), sound.tolist())]
            more = pa.array(groups, pa.string()) if last else batch.column("text")
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), *(pa.array(c) for c in facts.T.copy()), *(pa.array(c) for c in worth.T.copy()), more],
                names=names if last else [*names[:-1], "text"])

    kind = rows.schema["id"].dataType.simpleString()
    return map_batches(rows.select("id", "text", "n_best", "count_sum"), run,
                       f"id {kind}, {' long, '.join(names[1:-1])} long, {'groups' if last else 'text'} string")
