"""Plan-shape checks for scale: one scan per source in the feature plan, no
Cartesian products, no Python UDFs, bounded broadcasts only."""

from collections import Counter

from quire.operators.features.assemble import compute_features
from quire.sources.adapters import FIXTURE_AS_OF, fixture

SF = "/root/testdata/sf0.001"


def leaves(node):
    """The scans of an executed plan, through adaptive stages; a reused exchange reads nothing again."""
    name = node.getClass().getSimpleName()
    if name == "AdaptiveSparkPlanExec":
        return leaves(node.executedPlan())
    if name.endswith("QueryStageExec"):
        return leaves(node.plan())
    if name == "ReusedExchangeExec":
        return []
    children = node.children()
    if not children.size():
        return [node]
    return [x for i in range(children.size()) for x in leaves(children.apply(i))]


def scanned(df):
    """How often the final plan reads each table (by the name of its folder)."""
    df.collect()
    plan = df._jdf.queryExecution().executedPlan()
    folders = [x.relation().location().rootPaths().apply(0).getName() for x in leaves(plan)
               if x.getClass().getSimpleName() == "FileSourceScanExec"]
    assert folders, plan.toString()
    return Counter(f.rpartition("-")[0] for f in folders), plan.toString()


def test_feature_plan_scans_each_source_once(spark):
    src = fixture(spark, SF).sources()
    scans, plan = scanned(compute_features(src, FIXTURE_AS_OF))
    for name in ("bank", "psp", "webshop", "marketplace", "accounting", "kyc"):
        assert scans[name] == 1, (name, scans)
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
    assert "BatchEvalPython" not in plan and "ArrowEvalPython" not in plan


def test_decisions_are_column_expressions(spark):
    import __spark_entry__ as E
    _, plan = scanned(E.queries()["decisions"](spark, SF))
    assert "Python" not in plan
