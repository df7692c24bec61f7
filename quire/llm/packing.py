"""Packing of token streams into windows by order-preserving dynamic programming.

Documents stay in input order, end to end. Windows are cut at document or
sentence ends (inside very long sentences at fixed steps) so that padding plus
truncation penalties is least. The cost of a window ending at cut j is
best(i) + window - (pos j - pos i) + penalty j, so a queue of cuts with rising
best(i) + pos i gives each transition in constant time.
"""

from __future__ import annotations

import json
import string
import sys
import types
import zlib
from collections import deque
from itertools import chain, islice

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from tokenizers import Tokenizer, pre_tokenizers

from quire.llm.common import map_batches, raw_texts, slices

WINDOW = 2048
END_ID = 1
#: Tokens of padding that a cut inside a document is worth: at a sentence end, and elsewhere.
SENTENCE_PENALTY, HARD_PENALTY = 16, 64
#: Inside a sentence, cuts are possible at every so many tokens.
HARD_STEP = 64
#: Tokens that are packed at once; the last window of a block moves on into the next.
BLOCK = 1 << 20
#: Words, and words without punctuation, in the caches; with more, a cache is emptied before the next batch.
CACHE_WORDS, CACHE_STEMS = 600_000, 100_000
SENTENCE_ENDS = (".", "!", "?")


#: The pattern by which the word tokenizer cuts a text (fixed value of the vocabulary file).
WORD_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
#: Letters below this one are lower-cased alike by Python and the tokenizer, and are their own normal form.
PLAIN_BELOW = "\u0130"


class _Numbers(dict):
    """Numbers words as they are first asked for."""

    def __missing__(self, word):
        self[word] = n = len(self)
        return n


class Encoder:
    """Encodes texts, word by word through a cache where the tokenizer allows it.

    A tokenizer that drops white space and cuts words by WORD_PATTERN never
    joins two words, so a text's ids are its words' ids end to end. Any other
    tokenizer encodes whole texts.
    """

    def __init__(self, spec: str):
        self.tokenizer = Tokenizer.from_str(spec)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.by_word = WORD_PATTERN in str(json.loads(spec).get("pre_tokenizer")).replace("\\\\", "\\")
        self.bytes_as_text = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=True)
        self.ends = np.zeros(max([END_ID, *vocabulary.values()]) + 1, bool)
        for token, i in vocabulary.items():
            self.ends[i] = token.removesuffix("</w>").endswith(SENTENCE_ENDS)
        self._clear()

    def _clear(self):
        self.number = _Numbers()
        self.stems: dict[str, list[int]] = {}
        self.flat = np.zeros(0, np.int32)
        self.start = np.zeros(0, np.int64)
        self.length = np.zeros(0, np.int64)

    def _stem(self, stem: str) -> list[int]:
        """The ids of lower-case letters, or of a run of ASCII punctuation."""
        if (ids := self.stems.get(stem)) is None:
            plain = stem if stem.isascii() else self.bytes_as_text.pre_tokenize_str(stem)[0][0]
            ids = self.stems[stem] = [t.id for t in self.tokenizer.model.tokenize(plain)]
        return ids

    def _encoded(self, words: list[bytes]) -> list[list[int]]:
        """Letters with punctuation behind them take the model alone; any other word takes the whole tokenizer."""
        out: list = []
        other = []
        for word in words:
            text = word.decode("utf-8", "replace")
            stem = text.rstrip(string.punctuation)
            if stem and not (stem.isalpha() and max(stem) < PLAIN_BELOW):
                other.append((len(out), text))
                out.append(None)
                continue
            ids = self._stem(stem.lower()) if stem else []
            out.append(ids + self._stem(text[len(stem):]) if len(stem) < len(text) else ids)
        encoded = self.tokenizer.encode_batch_fast([t for _, t in other], add_special_tokens=False)
        for (i, _), e in zip(other, encoded):
            out[i] = e.ids
        return out

    def _learn(self, words: list[bytes]):
        encoded = self._encoded(words)
        length = np.fromiter(map(len, encoded), np.int64, len(encoded))
        self.start = np.concatenate([self.start, len(self.flat) + np.cumsum(length) - length])
        self.length = np.concatenate([self.length, length])
        self.flat = np.concatenate([self.flat, np.fromiter(chain.from_iterable(encoded), np.int32)])

    def encode(self, batch: list[bytes]) -> list[np.ndarray]:
        """The ids of each UTF-8 text."""
        if not self.by_word:
            whole = self.tokenizer.encode_batch_fast([t.decode("utf-8", "replace") for t in batch],
                                                     add_special_tokens=False)
            return [np.array(e.ids, np.int32) for e in whole]
        if len(self.number) > CACHE_WORDS:
            self._clear()
        if len(self.stems) > CACHE_STEMS:
            self.stems.clear()
        known = len(self.number)
        at = [np.array(list(map(self.number.__getitem__, t.split())), np.int64) for t in batch]
        if len(self.number) > known:
            self._learn(list(islice(self.number, known, None)))
        out = []
        for words in at:
            length = self.length[words]
            ends = np.cumsum(length)
            total = int(ends[-1]) if len(ends) else 0
            out.append(self.flat[np.repeat(self.start[words] - ends + length, length) + np.arange(total)])
        return out


def worker_encoder(spec: str) -> Encoder:
    """The encoder of this Python worker, which keeps its cache from task to task."""
    held = sys.modules.setdefault("_packing_encoders", types.ModuleType("_packing_encoders"))
    key = zlib.crc32(spec.encode())
    if held.__dict__.get("key") != key:
        held.key, held.encoder = key, Encoder(spec)
    return held.encoder


def cut_points(ends: np.ndarray, penalty: np.ndarray, step: int = HARD_STEP) -> tuple[np.ndarray, np.ndarray]:
    """Fill the gaps between rising cut positions with hard cuts at every ``step`` tokens."""
    gaps = np.diff(ends, prepend=0)
    more = np.maximum(gaps - 1, 0) // step
    if more.any():
        before = np.repeat(ends - gaps, more)
        rank = np.arange(more.sum()) - np.repeat(np.cumsum(more) - more, more)
        hard = before + (rank + 1) * step
        ends, penalty = np.concatenate([ends, hard]), np.concatenate([penalty, np.full(len(hard), HARD_PENALTY)])
        order = np.argsort(ends, kind="stable")
        ends, penalty = ends[order], penalty[order]
    return ends, penalty


def best_cuts(ends: np.ndarray, penalty: np.ndarray, window: int) -> list[int]:
    """The window ends of least total cost; the last of ``ends`` is always one. No gap may exceed the window."""
    position, fine = [0, *ends.tolist()], [0, *penalty.tolist()]
    value, back = [0] * len(position), [0] * len(position)  # value: least cost up to a cut, plus its position
    queue = deque([0])
    for j in range(1, len(position)):
        here = position[j]
        while position[queue[0]] < here - window:
            queue.popleft()
        back[j] = i = queue[0]
        value[j] = v = value[i] + window + fine[j]
        while queue and value[queue[-1]] >= v:
            queue.pop()
        queue.append(j)
    cuts, j = [], len(position) - 1
    while j:
        cuts.append(position[j])
        j = back[j]
    return cuts[::-1]


class Packer:
    """Packs one ordered stream of (id, token ids) block by block."""

    def __init__(self, ends: np.ndarray, window: int, first_sequence: int):
        self.ends, self.window, self.sequence = ends, window, first_sequence
        self.docs: list[tuple] = []  # id, tokens before what is left, all tokens
        self.parts: list[np.ndarray] = []
        self.held = 0

    def add(self, doc_id, ids: np.ndarray):
        self.docs.append((doc_id, 0, len(ids)))
        self.parts.append(ids)
        self.held += len(ids)

    def _cuts(self, tokens: np.ndarray, doc_ends: np.ndarray) -> list[int]:
        stops = np.flatnonzero(self.ends[tokens]) + 1
        where = np.union1d(stops, doc_ends)
        fine = np.where(np.isin(where, doc_ends), 0, SENTENCE_PENALTY)
        return best_cuts(*cut_points(where, fine, min(HARD_STEP, self.window)), self.window)

    def flush(self, last: bool) -> dict | None:
        """The pieces of all windows but the last, which waits for what follows; of all if ``last``."""
        if not self.held:
            return None
        tokens = np.concatenate(self.parts).astype("<i4")
        sizes = np.fromiter(map(len, self.parts), np.int64, len(self.parts))
        doc_ends = np.cumsum(sizes)
        doc_starts = doc_ends - sizes
        cuts = self._cuts(tokens, doc_ends)
        windows = np.array([0] + (cuts if last else cuts[:-1]), np.int64)
        done = int(windows[-1])
        bounds = np.union1d(windows, doc_starts[doc_starts < done])
        begin, length = bounds[:-1], np.diff(bounds)
        if not done:
            begin = length = np.zeros(0, np.int64)
        of = np.searchsorted(doc_starts, begin, side="right") - 1
        window = np.searchsorted(windows, begin, side="right") - 1
        out = {
            "doc": [self.docs[i][0] for i in of],
            "start": begin - doc_starts[of] + np.array([d[1] for d in self.docs], np.int64)[of],
            "length": length, "tokens": tokens, "begin": begin,
            "doc_tokens": np.array([d[2] for d in self.docs], np.int64)[of],
            "sequence": self.sequence + window, "offset": begin - windows[window],
        }
        self.sequence += len(windows) - 1
        keep = int(np.searchsorted(doc_ends, done, side="right"))
        left = self.docs[keep:]
        if left:
            used = max(0, done - int(doc_starts[keep]))
            left[0] = (left[0][0], left[0][1] + used, left[0][2])
            self.parts = [tokens[int(doc_starts[keep]) + used:int(doc_ends[keep])], *self.parts[keep + 1:]]
        else:
            self.parts = []
        self.docs, self.held = left, len(tokens) - done
        return out


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer_path: str | None = None,
         window: int = WINDOW, block: int = BLOCK) -> DataFrame:
    """One row per piece of a document: doc_id, start, length, doc_tokens, sequence_id, offset, ids.

    ``ids`` holds the piece's tokens as little-endian unsigned 32-bit numbers.
    Every partition of the input is packed on its own, in its order and without
    a shuffle, so copies or hot sources move nothing; its last window is the
    only one that may be short of more than a sentence. sequence_id starts with
    the partition's number. A null or empty text is the end token alone; null
    ids and repeated rows are packed like any other; an empty table gives no
    rows. A sentence longer than a window is cut inside.
    """
    with open(tokenizer_path or public_tokenizers.path("word_bpe_49k.json"), encoding="utf-8") as f:
        spec = f.read()
    src = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    kind = src.schema["doc_id"].dataType

    def rows(p: dict | None):
        if p is None or not len(p["begin"]):
            return
        stops = np.append(p["begin"], p["begin"][-1] + p["length"][-1]).astype(np.int32) * 4
        ids = pa.Array.from_buffers(pa.binary(), len(p["begin"]),
                                    [None, pa.py_buffer(stops.tobytes()), pa.py_buffer(p["tokens"].tobytes())])
        yield pa.RecordBatch.from_arrays(
            [pa.array(p["doc"], to_arrow_type(kind))] + [pa.array(p[k], pa.int64()) for k in (
                "start", "length", "doc_tokens", "sequence", "offset")] + [ids],
            names=["doc_id", "start", "length", "doc_tokens", "sequence_id", "offset", "ids"])

    def run(batches):
        encoder = worker_encoder(spec)
        packer = Packer(encoder.ends, window, TaskContext.get().partitionId() << 40)
        end = np.array([END_ID], np.int32)
        for batch in slices(batches, "text"):
            for doc_id, ids in zip(batch.column("doc_id").to_pylist(), encoder.encode(raw_texts(batch, "text"))):
                packer.add(doc_id, np.concatenate([ids, end]))
            if packer.held >= block:
                yield from rows(packer.flush(False))
        yield from rows(packer.flush(True))

    return map_batches(src, run, f"doc_id {kind.simpleString()}, start long, length long, doc_tokens long, sequence_id long, "
                               "offset long, ids binary")
