import zlib

import corpus_pipeline as P
from pyspark.sql import functions as F

import __spark_entry__ as entry
from quire.llm import decontaminate as D
from quire.llm import quality_rules as R
from quire.llm.common import labelled_sample, table
from quire.llm.quality_cnn import SEED, TRAIN_PER_CLASS, train
from test_packing import check_pieces
from test_simhash import brute_components, brute_fingerprint

SF = "/root/testdata/sf0.001"


def test_stages_match_brute_force(spark):
    """The rules calibrate on too few labels here to reject more than the base rules do."""
    docs = {r["doc_id"]: r["text"] for r in table(spark, SF, "documents").collect()}
    measures = {i: dict(zip(R.MEASURES, R.measures_of((t or "").encode()))) for i, t in docs.items()}
    left = {i: t for i, t in docs.items()
            if measures[i]["n_words"] >= 50 and 2 * measures[i]["n_repeat_words"] <= measures[i]["n_words"]}
    labels = table(spark, SF, "labels")
    learn = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 != 1
    known = [r["quality"] for r in labels.collect() if zlib.crc32(str(r["doc_id"]).encode()) % 3 != 1]
    sample = labelled_sample(table(spark, SF, "documents"), labels, "quality", learn, TRAIN_PER_CLASS, SEED)
    net = train(sample, prior=sum(known) / len(known))
    left = {i: t for i, t in left.items() if net.scores([t.encode()])[0] >= 0.5}
    component = brute_components({i: brute_fingerprint(t) for i, t in left.items()}, 2)
    left = {i: t for i, t in left.items() if component[i] == i}
    block = D.build_block([(r["item_id"], r["text"]) for r in table(spark, SF, "benchmark").collect()], D.Q, D.WINDOW,
                          D.STRIDE, D.EDIT_RATE, (D.PART_WINDOW, D.PART_STRIDE))
    left = {i: t for i, t in left.items() if not D.scan(D.normal(t), block, D.Q)}
    pieces = P.run(spark, SF).withColumn("ids_crc32", F.crc32("ids")).collect()
    assert {r["doc_id"] for r in pieces} == set(left)
    check_pieces(pieces, left)


def test_awkward_rows(spark, awkward):
    docs = awkward
    for _, stage in P.STAGES[:-1]:
        docs = stage(spark, docs, SF)
        assert docs.columns == awkward.columns
    assert P.STAGES[-1][1](spark, docs, SF).count() == docs.count() == 0
    for _, stage in P.STAGES:
        assert stage(spark, awkward.where("false"), SF).count() == 0


def test_all_are_registered():
    names = entry.queries()
    assert {n.split("_")[0] for n in names if n.startswith("op")} == {f"op{i}" for i in range(1, 14)}
    assert "pipeline" in names
