import math
from collections import Counter

import pytest

from quire.llm import lm_backoff as L
from quire.llm.queries import op7_lm_backoff

SF = "/root/testdata/sf0.001"
SMALL = [(1, "a b c d a b"), (2, ""), (3, None), (None, "a b"), (4, "zz"), (4, "a zz b c d"), (5, "A B C q"),
         (6, "a b c d a b"), (6, "a b c d a b"), (7, "a " * 4000)]


def brute(docs, reference, order=3, backoff=0.4):
    words = lambda t: (t or "").encode().lower().split()
    count, total = Counter(), 0
    for t in reference:
        w = words(t)
        total += len(w)
        for k in range(1, order + 1):
            count.update(tuple(w[i:i + k]) for i in range(len(w) - k + 1))
    out = {}
    for doc_id, t in docs:
        w, score = words(t), 0.0
        for p in range(len(w)):
            for k in range(min(order, p + 1), 0, -1):
                gram = tuple(w[p - k + 1:p + 1])
                if count[gram]:
                    score += math.log(count[gram] / (count[gram[:-1]] if k > 1 else total))
                    break
                score += math.log(backoff if k > 1 else 0.5 / max(total, 1))
        old = out.get(doc_id, (0, 0.0))
        out[doc_id] = (old[0] + len(w), old[1] + score)
    return out


def same(df, want):
    got = {r["doc_id"]: r for r in df.collect()}
    assert got.keys() == want.keys()
    for doc_id, (n, score) in want.items():
        assert got[doc_id]["n_words"] == n and got[doc_id]["log_score"] == pytest.approx(score, rel=1e-9, abs=1e-9)
        assert got[doc_id]["per_word"] == (pytest.approx(score / n) if n else None)


def test_query_matches_brute_force(spark):
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    same(op7_lm_backoff(spark, SF), brute(docs, [t for _, t in docs]))


@pytest.mark.parametrize("order", [1, 2, 3])
def test_backoff_to_another_corpus(spark, order):
    docs = spark.createDataFrame(SMALL, "doc_id long, text string").selectExpr("*", "1 as gram", "2 as doc", "3 as n")
    texts = ["a b c a b d", "b c d d", "zz a a", None, ""]
    reference = spark.createDataFrame([(9, t) for t in texts], "doc_id long, text string")
    same(L.score(docs, reference, order=order), brute(SMALL, texts, order))
    same(L.score(docs, order=order), brute(SMALL, [t for _, t in SMALL], order))
    if order == 3:
        same(L.score(docs, reference.where("false")), brute(SMALL, []))
        assert L.score(docs.where("false")).count() == 0


def test_frequent_ngrams_take_another_way(spark, monkeypatch):
    monkeypatch.setattr(L, "HOT", 0.004)
    monkeypatch.setattr(L, "PROBE", 0.5)
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    base = docs.selectExpr("doc_id as doc", "text")
    assert any(L.hot_counts(base, base, k, 3) for k in (2, 3))
    same(L.score(docs), brute(rows, [t for _, t in rows]))


def test_words_of_many_texts_at_once():
    """The words of each text, however parted: equal ones alike, and none for empty texts."""
    texts = [b"", b"The cat\x0b\x0cthe\r\nCAT ", b" \t ", b"a-word-of-more-than-eight-bytes a-Word-of-more-than-eight-bytes", b"the"]
    hashes = L.word_hashes(texts)
    assert [len(h) for h in hashes] == [len(t.split()) for t in texts]
    of = {}
    for text, found in zip(texts, hashes):
        for word, h in zip(text.lower().split(), found.tolist()):
            assert of.setdefault(word, h) == h
    assert len(set(of.values())) == len(of) == 3


def test_ngrams_are_dealt_many_to_a_row(spark, monkeypatch):
    """A shuffle has a row per slice and part, not one per n-gram, and a document's sums go home in rows of many."""
    rows, sent = [(i, " ".join(f"w{i * j % 97}" for j in range(300))) for i in range(40)], []
    write = L.stored

    def counted(df, name):
        plan = df._jdf.queryExecution().optimizedPlan().toString()
        sent.append((name, "MapInArrow" in plan, "Window" in plan))
        return write(df, name)

    monkeypatch.setattr(L, "stored", counted)
    monkeypatch.setattr(L, "PART_BYTES", 2000)  # more parts than there are cores
    docs = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    same(L.score(docs), brute(rows, [t for _, t in rows]))
    orders = [s for s in sent if s[0].startswith("order-")]
    assert len(orders) == 3 and all(packed and not window for _, packed, window in orders)
    base = docs.selectExpr("doc_id as doc", "text")
    assert L.dealt(base, 3, 3, True, True, {}, list(range(8))).count() <= 8 + 1 < 40 * 90
