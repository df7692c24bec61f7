import random
import tracemalloc

from quire.llm import decontaminate as D
from quire.llm.queries import op3_decontamination

SF = "/root/testdata/sf0.001"


def least_edits(window, text):
    """Least edits that turn the window into some part of the text."""
    row = [0] * (len(text) + 1)
    for a in window:
        new = [row[0] + 1]
        for j, b in enumerate(text):
            new.append(min(row[j] + (a != b), row[j + 1] + 1, new[j] + 1))
        row = new
    return min(row)


def edited(rng, text, edits):
    out = list(text)
    for _ in range(edits):
        p, kind = rng.randrange(len(out)), rng.random()
        if kind < 0.4:
            out[p] = rng.choice("abcdefgh ")
        elif kind < 0.7:
            del out[p]
        else:
            out.insert(p, rng.choice("abcdefgh "))
    return "".join(out)


def test_query_finds_every_whole_item(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").collect()
    items = spark.read.parquet(f"{SF}/benchmark.parquet").collect()
    got = {(r["doc_id"], r["item_id"]) for r in op3_decontamination(spark, SF).collect()}
    want = {(d["doc_id"], b["item_id"]) for d in docs for b in items if D.normal(b["text"]) in D.normal(d["text"])}
    assert want and want <= got
    for doc_id, item_id in got - want:
        text = D.normal(next(d["text"] for d in docs if d["doc_id"] == doc_id))
        item = D.normal(next(b["text"] for b in items if b["item_id"] == item_id))
        assert any(least_edits(item[s:s + D.WINDOW], text) <= D.EDIT_RATE * D.WINDOW
                   for s in range(0, max(1, len(item) - D.WINDOW + 1)))


def test_scan_equals_brute_force_within_the_budget():
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcde") for _ in range(rng.randint(2, 7)))
    items = [(i, " ".join(word() for _ in range(n))) for i, n in enumerate((12, 25, 40, 5))]
    block = D.build_block(items, 5, 60, 30, 0.1)
    outcomes = set()
    for _ in range(40):
        i = rng.randrange(4)
        text = D.normal(word() + " " + edited(rng, items[i][1], rng.randint(0, 14)) + " " + word())
        want = {block.owner[w] for w, codes in enumerate(block.windows)
                if least_edits("".join(map(chr, codes)), text) <= block.budget[w]}
        got = {j for j, *_ in D.scan(text, block, 5)}
        assert got == want
        outcomes.add(i in got)
    assert outcomes == {True, False}


def test_awkward_rows_and_blocks(spark, awkward, no_docs):
    item = "The quick brown fox jumps over the lazy dog again and again, says the old book of rhymes."
    benchmark = spark.createDataFrame([(1, item), (1, item), (2, None), (3, ""), (4, "tiny"), (None, "another " * 9)],
                                      "item_id long, text string")
    from pyspark.sql import functions as F
    docs = awkward.unionByName(awkward.limit(3).withColumn("doc_id", F.lit(99).cast("long"))
                               .withColumn("text", F.lit("so\n" + item.upper() + " yes")))
    docs = docs.unionByName(awkward.limit(1).withColumn("doc_id", F.lit(98).cast("long")).withColumn("text", F.lit("Tiny")))
    for size in (D.BLOCK_CHARS, 60):
        rows = D.matches(docs, benchmark, block_chars=size).collect()
        assert sorted((r["doc_id"], r["item_id"]) for r in rows) == [(98, 4), (99, 1), (99, 1), (99, 1)]
        kept = D.clean(docs, benchmark, block_chars=size)
        assert kept.columns == docs.columns and kept.count() == awkward.count()
    assert D.matches(no_docs, benchmark).count() == 0
    assert D.matches(docs, benchmark.where("false")).count() == 0
    assert D.clean(docs, benchmark.where("false")).count() == docs.count()


def test_every_part_of_99_characters_is_found(spark):
    rng = random.Random(7)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 7)))
    item = D.normal(" ".join(word() for _ in range(90)))[:397].strip()
    docs = [(s, "X" + item[s:s + 99] + "Y") for s in range(len(item) - 98)]
    # many edits in the middle of a long window, more than a short one allows
    centre = item[:56] + "".join("#" if i % 2 else c for i, c in enumerate(item[56:74])) + item[74:120]
    docs.append((-1, centre))
    got = {r["doc_id"] for r in D.matches(spark.createDataFrame(docs, "doc_id long, text string"),
                                          spark.createDataFrame([(1, item)], "item_id long, text string")).collect()}
    assert got == {i for i, _ in docs}


def test_pairs_are_counted_in_pieces(monkeypatch):
    """Long runs of a few letters give the same bands however few pairs are held at a time, in bounded memory."""
    rows = [("run", "a" * 400), ("text", "the quick brown fox jumps over the lazy dog and runs away from it all " * 3)]
    block = D.build_block(rows, D.Q, D.WINDOW, D.STRIDE, D.EDIT_RATE, (D.PART_WINDOW, D.PART_STRIDE))
    texts = ["a" * 3000, "ab" * 900 + "a" * 500, "x" * 300 + "a" * 450 + rows[1][1], "aab" * 800]
    whole = [D.scan(t, block, D.Q) for t in texts]
    for held in (500, 20_000):
        monkeypatch.setattr(D, "HITS", held)
        assert [D.scan(t, block, D.Q) for t in texts] == whole
    assert whole[0] and whole[2] and not whole[3]
    monkeypatch.undo()
    tracemalloc.start()
    assert D.scan("a" * 100_000, block, D.Q)  # some 10 ** 8 pairs
    assert tracemalloc.get_traced_memory()[1] < 500 << 20
    tracemalloc.stop()


def test_a_block_is_indexed_by_the_tasks_not_by_the_driver(spark, monkeypatch):
    rng = random.Random(11)
    rows = [(i, " ".join("".join(rng.choices("abcdefgh", k=6)) for _ in range(40))) for i in range(400)]
    docs = spark.createDataFrame([(i, f"so {text} yes" if i % 2 else "nothing of it") for i, text in rows[:40]],
                                 "doc_id long, text string")
    benchmark = spark.createDataFrame(rows, "item_id long, text string")
    calls, build = [], D.build_block
    monkeypatch.setattr(D, "build_block", lambda *how: (calls.append(how), build(*how))[1])  # tasks have a list of their own
    for size in (D.BLOCK_CHARS, 40_000):
        assert sorted(r["doc_id"] for r in D.clean(docs, benchmark, block_chars=size).collect()) == list(range(0, 40, 2))
        found = D.matches(docs, benchmark, block_chars=size).collect()
        assert sorted((r["doc_id"], r["item_id"]) for r in found) == [(i, i) for i in range(1, 40, 2)]
    assert not calls
    monkeypatch.undo()
    chars = sum(len(text) for _, text in rows)
    tracemalloc.start()
    block = D.build_block(rows, D.Q, D.WINDOW, D.STRIDE, D.EDIT_RATE, (D.PART_WINDOW, D.PART_STRIDE))
    peak = tracemalloc.get_traced_memory()[1] - (1 << D.FILTER_BITS)
    tracemalloc.stop()
    assert peak < 180 * chars and len(block.owner) > 400
