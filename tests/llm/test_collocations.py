import random
import re
from collections import Counter

import pytest

from quire.llm import collocations
from quire.llm.queries import op13_collocations

SF = "/root/testdata/sf0.001"


def brute(rows, top=2000, least=10, longest=3):
    """Every phrase of every piece in a dictionary."""
    counts, words = {}, Counter()
    upper = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    for lang, text in rows:
        lang = "und" if lang is None else lang
        f = counts.setdefault(lang, Counter())
        for piece in re.split("[.,;:!?\n-\r]", (text or "").translate(upper)):
            w = re.findall("[^ \t]+", piece)
            words[lang] += len(w)
            for k in range(1, longest + 1):
                f.update(tuple(w[i:i + k]) for i in range(len(w) - k + 1))
    out = []
    for lang, f in counts.items():
        found = [p for p, n in f.items() if len(p) > 1 and n >= least]
        gone = set()
        for p in found:
            for k in range(2, len(p)):
                for i in range(len(p) - k + 1):
                    if 100 * f[p] >= 50 * f[p[i:i + k]]:
                        gone.add(p[i:i + k])
        ranked = []
        for p in found:
            if p not in gone:
                a = f[p]
                score, k = min((1000000 * a * a // (f[p[:k]] * f[p[k:]]), k) for k in range(1, len(p)))
                ranked.append((-score, -a, " ".join(p).encode(), f[p[:k]], f[p[k:]]))
        for rank, (s, a, p, left, right) in enumerate(sorted(ranked)[:top], 1):
            out.append((lang, rank, p.decode(), -a, left, right, words[lang], -s))
    return sorted(out)


def test_query_matches_brute_force(spark):
    rows = [(r["lang"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    got = sorted(tuple(r) for r in op13_collocations(spark, SF).collect())
    assert got == brute(rows) and len(got) > 150


@pytest.mark.parametrize("shards, longest, least", [(1, 3, 3), (3, 4, 2)])
def test_any_number_of_shards_and_lengths(spark, shards, longest, least):
    rng = random.Random(shards)
    vocabulary = ["the", "New", "new", "york", "a", "of", "z", "\u00e9t\u00e9", "x\u2581y"]
    seps = [" ", " ", " ", "  ", "\t", ". ", ",", "\n", "!?"]
    rows = [(rng.choice(["en", "fr", None]), "".join(rng.choice(vocabulary) + rng.choice(seps)
                                                     for _ in range(rng.randint(0, 40)))) for _ in range(60)]
    df = spark.createDataFrame(rows, "lang string, text string").repartition(3)
    got = collocations.collocations(df, top=25, least=least, shards=shards, longest=longest)
    assert sorted(tuple(r) for r in got.collect()) == brute(rows, 25, least, longest)


def test_false_bits_change_nothing(spark, monkeypatch):
    """With states of 64 bits nearly every phrase is active from the first shard on."""
    monkeypatch.setattr(collocations, "STATE_BITS", 64)
    rng = random.Random(9)
    rows = [("en", " ".join(rng.choice("abcdefghijklmnop") for _ in range(30))) for _ in range(40)]
    df = spark.createDataFrame(rows, "lang string, text string").repartition(3)
    got = collocations.collocations(df, least=4)
    assert sorted(tuple(r) for r in got.collect()) == brute(rows, least=4)


def test_products_beyond_64_bits(spark):
    """The score's terms pass 64 bits; its value stays exact."""
    from pyspark.sql import functions as F
    a, left, right = 9_007_199_254_741, 9_007_199_254_999, 9_007_199_255_003
    exact = spark.range(1).select(F.expr(
        f"(cast(1000000 as decimal(7,0)) * cast({a}L as decimal(15,0)) * cast({a}L as decimal(15,0))) div "
        f"(cast({left}L as decimal(15,0)) * cast({right}L as decimal(15,0)))").alias("s")).first()["s"]
    assert exact == 1000000 * a * a // (left * right)


def test_awkward_rows(awkward, no_docs):
    rows = [(r["lang"], r["text"]) for r in awkward.collect()]
    got = collocations.collocations(awkward, least=2)
    assert sorted(tuple(r) for r in got.collect()) == brute(rows, least=2)
    assert collocations.collocations(no_docs).collect() == []


def test_mentions_do_not_grow_with_the_number_of_tasks(spark, monkeypatch):
    """Many tasks that hold the same phrases: a phrase is named by few of them."""
    rng = random.Random(4)
    rows = [("en", " ".join(rng.choice("abcdefghij") for _ in range(20))) for _ in range(400)]
    written, write = [], collocations._written

    def noted(df, name):
        out = write(df, name)
        if name == "named":
            written.append(out.where("phrase is not null").selectExpr("sum(times)").first()[0] or 0)
        return out

    monkeypatch.setattr(collocations, "_written", noted)
    got = collocations.collocations(spark.createDataFrame(rows, "lang string, text string").repartition(40), longest=2)
    assert sorted(tuple(r) for r in got.collect()) == brute(rows, longest=2)
    assert sum(written) < 40 * 100 / 2


def test_word_keys_tell_words_apart():
    """Words of any length, next to anything, have the same key; all others, another one."""
    import numpy as np

    from quire.llm.common import word_keys
    rng = random.Random(5)
    words = [bytes(rng.choice(b"ab\x00\xff") for _ in range(n)) for n in range(30) for _ in range(20)]
    for fill in (b" ", b"\xff\xff"):
        letters = np.frombuffer(fill.join(words), np.uint8)
        end = np.cumsum([len(w) + len(fill) for w in words]) - len(fill)
        keys = word_keys(letters, end - np.array([len(w) for w in words]), end, np.uint64(7))
        same_again = dict(zip(words, keys.tolist()))
        assert [same_again[w] for w in words] == keys.tolist() and len(set(keys.tolist())) == len(set(words))
    other = word_keys(np.frombuffer(words[-1], np.uint8), np.array([0]), np.array([29]), np.uint64(8))
    assert other[0] != same_again[words[-1]]
