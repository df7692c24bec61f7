import hashlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from quire.llm import perfect_hash, token_alignment
from quire.llm.queries import op12_token_alignment

SF = "/root/testdata/sf0.001"
ODD = [
    "two  spaces and   three", " leading", "trailing ", "a\nb \n c\td", "no\u00a0break \u3000wide", "\u2581 marked",
    "<|endoftext|> and <s> </s> <0x41>", "x" * 5000, "emoji \U0001f600 ok", "\x00 nul", "caf\u00e9 na\u00efve 'tis don't",
    "\u4f60\u597d \u4e16\u754c", "   ", "\n", "a \u2003b", "e\u0301 combined",
]


@pytest.fixture(scope="module")
def models():
    with open(public_tokenizers.path("byte_bpe_50k.json"), encoding="utf-8") as f:
        spec = f.read()
    with open(public_tokenizers.path("piece_bpe_32k.model"), "rb") as f:
        return spec, f.read()


class Plain:
    """Whole texts, token by token, without chunks or hashes."""

    def __init__(self, spec, model):
        self.a = Tokenizer.from_str(spec)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_proto=model)
        self.bytes_a, self.bytes_b = token_alignment.bytes_of_a(spec), token_alignment.bytes_of_b(self.b)

    def links(self, text):
        if not text:
            return [], [], [], []
        a = self.a.encode(" " + text, add_special_tokens=False).ids
        b = self.b.encode(text)
        spelled = (" " + text).encode()
        if b"".join(self.bytes_a[i] for i in a) != spelled or b"".join(self.bytes_b[i] for i in b) != spelled:
            return [], [], [], []

        def ranges(ids, size):
            at = 0
            for i in ids:
                yield at, at + len(size[i]), i
                at += len(size[i])
        ra, rb = list(ranges(a, self.bytes_a)), list(ranges(b, self.bytes_b))
        ends = {e for _, e, _ in ra} & {e for _, e, _ in rb}
        groups, links = [], []
        j = 0
        for s, e, i in ra:
            while j and rb[j - 1][1] > s:
                j -= 1
            k = j
            while k < len(rb) and rb[k][0] < e:
                if rb[k][1] > s:
                    links.append((i, rb[k][2]))
                k += 1
            j = k
        start = 0
        for end in sorted(ends):
            groups.append((",".join(str(i) for s, e, i in ra if start <= s and e <= end),
                           ",".join(str(i) for s, e, i in rb if start <= s and e <= end)))
            start = end
        return a, b, groups, links


def brute(rows, models):
    plain = Plain(*models)
    found = [(i, *plain.links(t)) for i, t in rows]
    counts = Counter(p for *_, links in found for p in set(links))
    best = Counter()
    for (a, _), n in counts.items():
        best[a] = max(best[a], n)
    return sorted(((i, len(a), len(b), len(groups), len(links), sum(counts[p] == best[p[0]] for p in links),
                    sum(counts[p] for p in links), ";".join(f"{x}|{y}" for x, y in groups))
                   for i, a, b, groups, links in found), key=str)


def test_query_matches_brute_force(spark, models):
    rows = [(r["doc_id"], (r["text"] or "")) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    want = [(*r[:-1], hashlib.sha256(r[-1].encode()).hexdigest() if r[-1] else "") for r in brute(rows, models)]
    assert sorted((tuple(r) for r in op12_token_alignment(spark, SF).collect()), key=str) == sorted(want, key=str)


def test_odd_texts_and_many_blocks(spark, models, monkeypatch):
    """Chunks never change what whole texts give; counts that need several passes add up."""
    rows = list(enumerate(ODD * 2)) + [(None, None), (None, "id"), (7, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    want = brute(rows, models)
    for pairs in (10**6, 40):
        assert sorted((tuple(r) for r in token_alignment.align(df, block_pairs=pairs).collect()), key=str) == want


def test_vectors_are_added_in_a_tree(spark, models):
    rows = [(i, f"word{i % 7} and the other {i}") for i in range(400)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(40)  # more leaves than one task adds
    assert sorted((tuple(r) for r in token_alignment.align(df).collect()), key=str) == brute(rows, models)


def test_awkward_rows(awkward, no_docs, models):
    rows = [(r["doc_id"], r["text"]) for r in awkward.collect()]
    assert sorted((tuple(r) for r in token_alignment.align(awkward).collect()), key=str) == brute(rows, models)
    assert token_alignment.align(no_docs).collect() == []


def test_perfect_hash_is_minimal_and_verified():
    rng = np.random.default_rng(3)
    keys = np.unique(rng.integers(0, 2**40, 20_000))
    segment = perfect_hash.segment_of(keys, 8)
    rows = [(s, *perfect_hash.build(keys[segment == s])) for s in range(8)]
    table = perfect_hash.PerfectHash(8, rows)
    assert sorted(table.find(keys)) == list(range(len(keys)))
    assert (table.keys[table.find(keys)] == keys).all()
    foreign = np.setdiff1d(rng.integers(0, 2**40, 5_000), keys)
    assert (table.find(foreign) == -1).all()
    assert (perfect_hash.PerfectHash(8, rows[:3]).find(keys[segment > 2]) == -1).all()
    assert (perfect_hash.PerfectHash(8, []).find(keys) == -1).all()
