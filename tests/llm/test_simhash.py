import random

import xxhash

from quire.llm import simhash
from quire.llm.components import connected_components
from quire.llm.queries import op10_simhash

SF = "/root/testdata/sf0.001"


def brute_fingerprint(text, size=3):
    words = (text or "").encode().lower().split()
    shingles = [b" ".join(words[i:i + size]) for i in range(max(1, len(words) - size + 1))] if words else []
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(prints, bits):
    parent = {i: i for i in prints}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x
    ids = sorted(prints)
    for i in ids:
        for j in ids:
            if j < i and (prints[i] ^ prints[j]).bit_count() <= bits:
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


def test_query_matches_brute_force(spark):
    rows = {r["doc_id"]: r for r in op10_simhash(spark, SF).collect()}
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    prints = {i: brute_fingerprint(t) for i, t in texts.items()}
    assert {i: r["fingerprint"] for i, r in rows.items()} == {i: f"{p:016x}" for i, p in prints.items()}
    assert {i: r["component_id"] for i, r in rows.items()} == brute_components(prints, 2)


def test_links_are_complete_whatever_the_variant_size(spark):
    rng = random.Random(3)
    prints = set()
    for _ in range(4):
        base = rng.getrandbits(64)
        prints |= {base} | {base ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)) for _ in range(40)}
    prints |= {0, (1 << 64) - 1, 1 << 63}
    signed = [p - (1 << 64) if p >> 63 else p for p in prints]
    fps = spark.createDataFrame([(p,) for p in signed], "fp long")
    for bits in (0, 1, 2, 3):
        want = {tuple(sorted((a, b))) for a in signed for b in signed
                if a < b and ((a ^ b) & ((1 << 64) - 1)).bit_count() <= bits}
        for direct in (64, 2) if bits < 3 else (64,):
            got = {tuple(sorted((r["a"], r["b"]))) for r in simhash.links(fps, bits, direct).collect()}
            assert got == want, (bits, direct)


def test_awkward_rows(spark, awkward, no_docs):
    rows = simhash.near_duplicates(awkward).collect()
    assert len(rows) == awkward.count()
    by_id = {r["id"]: r for r in rows}
    assert by_id[2]["fp"] == by_id[3]["fp"] == by_id[4]["fp"] == 0
    assert by_id[2]["component_id"] == by_id[4]["component_id"] == 2
    assert by_id[7]["component_id"] == 1
    assert simhash.near_duplicates(no_docs).count() == 0
    kept = simhash.one_of_each(awkward)
    assert kept.columns == awkward.columns
    ids = [r["doc_id"] for r in kept.select("doc_id").collect()]
    assert sorted(i for i in ids if i is not None) == [1, 2, 5, 6, 8] and ids.count(None) == 2
    assert simhash.one_of_each(no_docs).count() == 0


def test_components(spark):
    chain = [(i, i + 1) for i in range(40)] + [(100, 101), (101, 100), (7, 7), (200, 100), (None, 3)]
    edges = spark.createDataFrame(chain, "a long, b long")
    got = {r["node"]: r["component"] for r in connected_components(edges).collect()}
    assert got == {**{i: 0 for i in range(41)}, 100: 100, 101: 100, 200: 100}
    assert connected_components(edges.where("false")).count() == 0


def test_one_row_of_each_component_stays(spark):
    rng = random.Random(9)
    a, b, c = (" ".join(f"w{rng.getrandbits(30)}" for _ in range(200)) for _ in range(3))
    rows = [(None, a), (None, a), (None, a.upper()), (1, b), (1, c), (1, b), (2, c), (2, c.upper()), (3, b.title())]
    kept = simhash.one_of_each(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r["doc_id"] or 0, r["text"].lower()) for r in kept) == sorted([(0, a), (1, b), (1, c)])
    repeated = [(4, a), (4, a.upper()), (5, a)]  # an id with two near copies of one text
    [row] = simhash.one_of_each(spark.createDataFrame(repeated, "doc_id long, text string")).collect()
    assert row["doc_id"] == 4
