import hashlib
import random

import pytest

from quire.llm import substring_dedup
from quire.llm.queries import op11_substring_dedup

SF = "/root/testdata/sf0.001"


def brute(rows, window):
    """id, text -> (words, removed places, kept text) by a dictionary of every window."""
    first = {}
    parsed = [(i, (t or "").encode().split()) for i, t in rows]
    order = lambda i: (i is None, i or 0)
    for i, words in parsed:
        for p in range(len(words) - window + 1):
            key = tuple(words[p:p + window])
            first[key] = min(first.get(key, (True, 0)), order(i))
    out = []
    for i, words in parsed:
        gone = set()
        for p in range(len(words) - window + 1):
            if first[tuple(words[p:p + window])] < order(i):
                gone.update(range(p, p + window))
        kept = b" ".join(w for n, w in enumerate(words) if n not in gone).decode()
        out.append((i, len(words), len(gone), kept))
    return sorted(out, key=str)


def measured(df):
    return sorted(((r["id"], r["n_words"], sum(s["end"] - s["start"] for s in r["spans"]), r["kept"])
                   for r in df.collect()), key=str)


def test_query_matches_brute_force(spark):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    want = [(i, n, gone, hashlib.sha256(kept.encode()).hexdigest()) for i, n, gone, kept in brute(rows, 50)]
    got = [tuple(r) for r in op11_substring_dedup(spark, SF).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)
    assert any(r[2] for r in got)


@pytest.mark.parametrize("window, first, rungs", [(8, 1, 4), (8, 4, 2), (5, 1, 1), (12, 2, 3)])
def test_every_ladder_finds_the_same(spark, window, first, rungs):
    """Small alphabets give repeats of every length, within documents and across them, with ties and null ids."""
    assert len(substring_dedup.ladder(window, first)) == rungs
    rng = random.Random(window)
    passages = [[rng.choice("abc") for _ in range(rng.randint(3, 30))] for _ in range(12)]
    rows = [(rng.choice([None, *range(30)]), " ".join(w for _ in range(rng.randint(0, 4)) for w in rng.choice(passages)))
            for _ in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = measured(substring_dedup.without_repeats(df, window=window, first=first))
    assert got == brute(rows, window)


def test_hot_passages(spark):
    """A passage in every document is hot: its windows take the other way, with the same result."""
    rng = random.Random(1)
    hot = [f"h{i}" for i in range(30)]
    rows = [(i, " ".join([f"u{i}_{j}" for j in range(rng.randint(0, 9))] + hot + [f"v{i}"])) for i in range(300)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    assert measured(substring_dedup.without_repeats(df, window=10, first=5)) == brute(rows, 10)


def test_awkward_rows(awkward, no_docs):
    rows = [(r["doc_id"], r["text"]) for r in awkward.collect()]
    assert measured(substring_dedup.without_repeats(awkward, window=4, first=2)) == brute(rows, 4)
    assert substring_dedup.without_repeats(no_docs).collect() == []


def test_no_repeats_at_all(spark):
    df = spark.createDataFrame([(1, "a b c d e f"), (2, "g h i j k l")], "doc_id long, text string")
    assert [r["spans"] for r in substring_dedup.without_repeats(df, window=4, first=2).collect()] == [[], []]
