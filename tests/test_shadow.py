"""Shadow model: trains, scores in [0, 1], survives save / load unchanged."""

import tempfile

import pytest

from quire.operators import shadow as SH
from quire.operators.features.assemble import compute_features
from quire.session import write_table
from quire.sources.adapters import FIXTURE_AS_OF, fixture

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def frames(spark):
    fx = fixture(spark, SF)
    feats = write_table(compute_features(fx.sources(), FIXTURE_AS_OF), "test-features")
    return feats, write_table(SH.training_frame(feats, fx.merchants), "test-training")


def test_train_score_save_load(spark, frames):
    feats, frame = frames
    model = SH.train_shadow(frame, n_trees=5)
    s1 = model.score(feats.select("application_id", *SH.ML_FEATURES))
    a = {r.application_id: r.shadow_ml_score for r in s1.collect()}
    assert a and all(0.0 <= v <= 1.0 for v in a.values())
    path = tempfile.mkdtemp(prefix="quire-model-", dir="/tmp")
    model.save(spark, path)
    again = SH.ShadowModel.load(spark, path)
    b = {r.application_id: r.shadow_ml_score
         for r in again.score(feats.select("application_id", *SH.ML_FEATURES)).collect()}
    assert a.keys() == b.keys() and all(abs(a[k] - b[k]) < 1e-12 for k in a)
    assert len(model.importances) == len(SH.ML_FEATURES)


def test_logistic_variant(spark, frames):
    _, frame = frames
    m = SH.train_shadow(frame, model_type="logistic", max_iter=50)
    assert m.metrics["model_type"] == "logistic" and len(m.trees) == 5


@pytest.mark.parametrize("model_type", ["gbm", "logistic"])
def test_training_starts_few_tasks(spark, frames, model_type):
    """A small training frame is one part: no task per shuffle partition in each of the trainers' jobs."""
    sc, group = spark.sparkContext, f"shadow-{model_type}"
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "64")
    sc.setJobGroup(group, "training")
    try:
        SH.train_shadow(frames[1], n_trees=1, depth=1, model_type=model_type, max_iter=3)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
        sc.setLocalProperty("spark.jobGroup.id", None)
    track = sc.statusTracker()
    jobs = [track.getJobInfo(j) for j in track.getJobIdsForGroup(group)]
    tasks = [s.numTasks for j in jobs for s in map(track.getStageInfo, j.stageIds) if s is not None]
    assert jobs and sum(tasks) < 6 * len(jobs)
