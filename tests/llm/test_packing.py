import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from quire.llm import packing
from quire.llm.queries import op2_packing

SF = "/root/testdata/sf0.001"
PATH = public_tokenizers.path("word_bpe_49k.json")


def check_pieces(rows, texts, window=2048):
    """Every id lies in one piece, sequences have no gaps and are short enough."""
    tokenizer = Tokenizer.from_file(PATH)
    ids = {i: tokenizer.encode(t or "", add_special_tokens=False).ids + [1] for i, t in texts.items()}
    covered, filled = defaultdict(list), defaultdict(list)
    for r in rows:
        covered[r["doc_id"]].append((r["start"], r["length"]))
        filled[r["sequence_id"]].append((r["offset"], r["length"]))
        part = np.array(ids[r["doc_id"]][r["start"]:r["start"] + r["length"]], "<u4").tobytes()
        assert zlib.crc32(part) == r["ids_crc32"] and r["doc_tokens"] == len(ids[r["doc_id"]])
    for parts, total in [(sorted(covered[i]), len(ids[i])) for i in ids] + [(sorted(p), None) for p in filled.values()]:
        at = 0
        for start, length in parts:
            assert start == at and length > 0
            at += length
        assert at == total if total is not None else at <= window
    return sum(map(len, ids.values())), len(filled)


def test_query_round_trip(spark):
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    tokens, sequences = check_pieces(op2_packing(spark, SF).collect(), texts)
    assert sequences <= -(-tokens // 2048) * 1.05 + 1


def test_awkward_rows(spark, awkward, no_docs):
    from pyspark.sql import functions as F
    one = awkward.dropDuplicates(["doc_id", "text"]).where("doc_id is not null").coalesce(1)
    rows = packing.pack(one, window=64, block=100).withColumn("ids_crc32", F.crc32("ids")).collect()
    check_pieces(rows, {r["doc_id"]: r["text"] for r in one.collect()}, 64)
    assert packing.pack(awkward).where("start = 0").count() == awkward.count()
    assert packing.pack(no_docs).count() == 0


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_encoder_equals_tokenizer(name):
    with open(public_tokenizers.path(name), encoding="utf-8") as f:
        encoder = packing.Encoder(f.read())
    texts = ["", " ", "\n\n", "A b  c", "<|endoftext|> x<|startoftext|>y,", "don't I'LL x' 's 't ,'s", "ΣΑΣ İ ß ªº µm é é",
             "x\ty\r\nz\x0b\x0c", "a b\xa0c", "it.### 12ab_ __ ,.!", "".join(map(chr, range(1, 600)))]
    whole = encoder.tokenizer.encode_batch(texts, add_special_tokens=False)
    assert [a.tolist() for a in encoder.encode([t.encode() for t in texts])] == [e.ids for e in whole]


def test_cuts_are_optimal():
    for seed in range(150):
        rng = random.Random(seed)
        ends = np.array(sorted(rng.sample(range(1, 60), rng.randint(1, 15))))
        ends, fine = packing.cut_points(ends, np.array([rng.choice([0, 3, 9]) for _ in ends]), 4)
        position, window = [0, *ends.tolist()], 10
        cost = dict(zip(ends.tolist(), fine.tolist()))
        best = [0]
        for j in range(1, len(position)):
            best.append(min(best[i] + window - position[j] + position[i] + cost[position[j]]
                            for i in range(j) if position[j] - position[i] <= window))
        cuts = packing.best_cuts(ends, fine, window)
        spans = [b - a for a, b in zip([0, *cuts], cuts)]
        assert max(spans) <= window and cuts[-1] == position[-1]
        assert sum(window - s + cost[c] for s, c in zip(spans, cuts)) == best[-1]
