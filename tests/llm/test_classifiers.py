import zlib

import numpy as np
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from quire.llm import quality_cnn, toxicity
from quire.llm.common import labelled_sample
from quire.llm.queries import op5_toxicity, op6_quality_cnn

SF, LARGER = "/root/testdata/sf0.01", "/root/testdata/sf0.1"


def labelled(target, modulus, held):
    """Training rows and held-out rows, by the crc32 of the id."""
    text = dict(zip(*(pq.read_table(f"{LARGER}/documents.parquet")[c].to_pylist() for c in ("doc_id", "text"))))
    labels = pq.read_table(f"{LARGER}/labels.parquet").to_pylist()
    rows = [(r["doc_id"], text[r["doc_id"]], r[target]) for r in labels if r["doc_id"] in text]
    out = [zlib.crc32(str(r[0]).encode()) % modulus == held for r in rows]
    return [r for r, o in zip(rows, out) if not o], [r for r, o in zip(rows, out) if o]


def test_quality_network_on_held_out_rows():
    train, test = labelled("quality", 3, 1)
    few = [r for r in train if not r[2]] + [r for r in train if r[2]][:1200]
    net = quality_cnn.train(few, prior=sum(r[2] for r in train) / len(train))
    score = net.scores([r[1].encode() for r in test])
    y = np.array([r[2] for r in test])
    assert ((score >= 0.5) == y).mean() > 0.96
    assert (score >= 0.5)[y == 1].mean() > 0.97 and (score < 0.5)[y == 0].mean() > 0.8


def test_toxicity_machine_on_held_out_rows():
    train, test = labelled("toxic", 4, 2)
    few = [r for r in train if r[2]] + [r for r in train if not r[2]][:1200]
    machine = toxicity.train(few, prior=sum(r[2] for r in train) / len(train))
    score = np.array([machine.score(r[1]) for r in test])
    y = np.array([r[2] for r in test])
    rank = score.argsort().argsort()
    auc = (rank[y == 1].mean() - (y.sum() - 1) / 2) / (y == 0).sum()
    assert auc > 0.9 and (score >= 0.3)[y == 1].mean() > 0.7 and (score >= 0.3)[y == 0].mean() < 0.05
    for form in ("idiot", "idioot", "id-iot", "idxiot", "i.d.i.o.t", "stupxid", "pathektic"):
        assert machine.word_margins(toxicity.prepared(form)).max() > 0, form
    assert toxicity.prepared("you i d i o t now") == " you idiot now "


def test_network_gradients():
    rng = np.random.default_rng(0)
    net = quality_cnn.ByteCnn(rng)
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    raw = [rng.integers(32, 120, n).astype(np.uint8).tobytes() for n in (700, 0, 1500)]
    y = np.array([1.0, 0.0, 1.0])

    def loss():
        rows, count = quality_cnn.chunks_of(raw)
        z = net._combined(net.pooled(rows)[0], count)[2]
        return np.mean(np.log1p(np.exp(-z)) * y + np.log1p(np.exp(z)) * (1 - y))

    for name, g in net.gradients(raw, y).items():
        at = np.unravel_index(np.abs(g).argmax(), g.shape)
        net.p[name][at] += 1e-3
        up = loss()
        net.p[name][at] -= 2e-3
        assert (up - loss()) / 2e-3 == pytest.approx(g[at], rel=0.1, abs=2e-4)
        net.p[name][at] += 1e-3


def test_chunks_cover_every_byte():
    raw = [bytes([1 + i % 250]) * n for i, n in enumerate((0, 1, 512, 513, 960, 5000))]
    rows, count = quality_cnn.chunks_of(raw)
    at = 0
    for text, n in zip(raw, count):
        step = quality_cnn.CHUNK - quality_cnn.OVERLAP
        whole = np.zeros(step * (n - 1) + quality_cnn.CHUNK, np.uint8)
        for i in range(n):
            whole[i * step:i * step + quality_cnn.CHUNK] = rows[at + i]
        assert whole.tobytes().rstrip(b"\0") == text
        at += n


@pytest.mark.parametrize("query,modulus,held,cut", [(op5_toxicity, 4, 2, 0.3), (op6_quality_cnn, 3, 1, 0.5)])
def test_queries(spark, query, modulus, held, cut):
    rows = query(spark, SF).collect()
    assert len(rows) == spark.read.parquet(f"{SF}/documents.parquet").count()
    for r in rows:
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % modulus == held)
        assert 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= cut)


def test_labels_and_awkward_rows(spark, awkward, no_docs):
    labels = spark.createDataFrame([(1, 1, 0), (3, 0, 1), (5, 0, 1), (6, None, None), (None, 1, 0), (6, 1, 0), (9, 0, 1)],
                                   "doc_id long, quality int, toxic int")
    sample = labelled_sample(awkward, labels, "quality", F.lit(True), 10, 1)
    assert [(i, y) for i, _, y in sample] == [(1, 1), (3, 0), (5, 0), (6, 1)]
    assert len(labelled_sample(awkward, labels, "quality", F.lit(True), 1, 1)) == 2
    for module in (quality_cnn, toxicity):
        target = {"quality_cnn": "quality", "toxicity": "toxic"}[module.__name__.rpartition(".")[2]]
        for known in (labels, labels.where("false"), labels.where("doc_id = 1")):
            model = module.fit(awkward, known, F.lit(True), target)
            rows = module.scored(awkward, model).collect()
            assert len(rows) == awkward.count() and all(0 <= r["score"] <= 1 for r in rows)
            assert len({r["score"] for r in rows if r["doc_id"] in (2, 3)}) == 1
        out = module.scored(awkward, model)
        assert out.columns == [c for c in awkward.columns if c != "score"] + ["score"]
        assert module.scored(no_docs, model).count() == 0


def test_forward_pass_equals_plain_loops():
    """Every chunk, window and filter one after another, for texts around the chunk's length and an empty one."""
    q, rng = quality_cnn, np.random.default_rng(3)
    net = q.ByteCnn(rng)
    net.p = {k: (v + rng.normal(0, 0.1, v.shape)).astype(np.float32) for k, v in net.p.items()}
    p = {k: v.astype(np.float64) for k, v in net.p.items()}
    sizes = (0, 1, q.CHUNK - 1, q.CHUNK, q.CHUNK + 1, 2 * q.CHUNK - q.OVERLAP, 3 * q.CHUNK)
    raw = [rng.integers(0, 256, n).astype(np.uint8).tobytes() for n in sizes]
    for text, got in zip(raw, net.scores(raw)):
        starts = [0]
        while starts[-1] + q.CHUNK < len(text):
            starts.append(starts[-1] + q.CHUNK - q.OVERLAP)
        pooled = []
        for s in starts:
            chunk = p["embed"][np.frombuffer(text[s:s + q.CHUNK].ljust(q.CHUNK, b"\0"), np.uint8)]
            best = np.full(q.FILTERS, -np.inf)
            for at in range(0, q.CHUNK - q.WIDTH + 1, q.STEP):
                best = np.maximum(best, chunk[at:at + q.WIDTH].reshape(-1) @ p["filter"])
            pooled.append(np.maximum(best + p["shift"], 0))
        u = np.concatenate([np.max(pooled, axis=0), np.mean(pooled, axis=0)])
        logit = np.tanh(u @ p["w1"] + p["b1"]) @ p["w2"] + p["b2"][0]
        assert abs(1 / (1 + np.exp(-logit)) - got) < 1e-4, len(text)


def test_kernel_equals_plain_loops():
    """The gap-weighted triples of each word, one after another; margins, kernels with landmarks, and norms."""
    t, rng = toxicity, np.random.default_rng(4)
    machine = t.StringSvm(rng.normal(0, 1, t.TRIPLES), 0.25)
    text = t.prepared("a an idiot i-d i.o.t Straße x2y  longerwordwithmanyletters 你好 é")

    def triples(word):
        c = [0, *machine.triples.codes(word).tolist(), 0]
        for i in range(len(c) - 2):
            for k in range(i + 2, min(i + t.SPAN, len(c))):
                for j in range(i + 1, k):
                    yield (c[i] * t.CODES + c[j]) * t.CODES + c[k], t.DECAY ** (k - i - 2)

    words = text.split()
    length = {w: np.sqrt(1e-3 + sum(x * x for _, x in triples(w))) for w in words}
    want = [sum(machine.weights[n] * x for n, x in triples(w)) / length[w] + 0.25 for w in words]
    assert np.allclose(machine.word_margins(text), want, atol=1e-4)
    landmarks = ["idiot", "letters", "an"]
    number, table = t._triple_table(landmarks, machine.triples)
    got = t._features(words, machine.triples, number, table)
    for i, w in enumerate(words):
        for j, mark in enumerate(landmarks):
            other = {}
            for n, x in triples(mark):
                other[n] = other.get(n, 0) + x
            assert abs(got[i, j] - sum(x * other.get(n, 0) for n, x in triples(w)) / length[w]) < 1e-4
