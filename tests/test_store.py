"""The monthly store: merged history equals a full pass, old months are not read, joins of statistics move nothing."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from quire.operators.features.assemble import compute_features
from quire.plans.queries import stored_by_month
from quire.sources import store as ST
from quire.sources.adapters import FIXTURE_AS_OF, fixture

SF = "/root/testdata/sf0.001"


def rounded(df):
    return sorted(tuple(round(x, 9) if isinstance(x, float) else x for x in r) for r in df.collect())


@pytest.fixture(scope="module")
def stored(spark):
    return stored_by_month(spark, SF)


@pytest.mark.parametrize("as_of", [FIXTURE_AS_OF, dt.date(1997, 2, 17)])
def test_merged_history_equals_a_full_pass(spark, stored, as_of):
    full = dict(fixture(spark, SF).sources())
    recent = full | {name: ST.read_facts(spark, name, stored + "/facts", as_of) for name in ("bank", "psp", "webshop")}
    history = ST.read_history(spark, stored + "/history")
    assert set(history) == {"bank", "psp", "webshop"}
    assert rounded(compute_features(recent, as_of, history=history)) == rounded(compute_features(full, as_of))


def test_only_the_months_of_the_windows_are_read(spark, stored):
    for name in ("bank", "psp"):
        rows = ST.read_facts(spark, name, stored + "/facts", dt.date(1998, 12, 31))
        months = {f.split("_month=")[1][:7] for f in rows.inputFiles()}
        assert len(months) > 13  # what is listed
        got = rows.select(F.col("_metadata.file_path").alias("f")).distinct().collect()
        assert {r["f"].split("_month=")[1][:7] for r in got} <= {f"1998-{m:02d}" for m in range(1, 13)} | {"1997-12"}
        plan = rows._jdf.queryExecution().executedPlan().toString()
        assert "PartitionFilters: [" in plan and "PartitionFilters: []" not in plan


def test_a_month_written_again_is_replaced(spark, tmp_path):
    psp = fixture(spark, SF).sources()["psp"]
    months = [r[0] for r in psp.select(F.trunc("order_date", "MM").alias("m")).distinct().orderBy("m").limit(3).collect()]
    some = psp.filter(F.trunc("order_date", "MM").isin(months))
    for batch in (months, months[1:2], months[2:]):
        ST.write_facts(some, "psp", str(tmp_path), batch)
    assert ST.read_facts(spark, "psp", str(tmp_path), FIXTURE_AS_OF, None).count() == some.count()


def test_joins_of_stored_statistics_move_nothing(spark, tmp_path):
    sources = fixture(spark, SF).sources()
    tables = ST.write_statistics(sources, FIXTURE_AS_OF, str(tmp_path), "stats_test", 4)
    try:
        df = ST.features_of(tables, FIXTURE_AS_OF)
        assert rounded(df) == rounded(compute_features(sources, FIXTURE_AS_OF))
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" in plan and "Exchange" not in plan
    finally:
        for name in tables:
            spark.sql(f"drop table if exists stats_test_{name}")


def test_reconciliation_from_history(spark, stored):
    from quire.operators.reconcile import reconcile_bank_psp
    f = fixture(spark, SF)
    history = ST.read_history(spark, stored + "/history")
    for as_of in (FIXTURE_AS_OF, dt.date(1998, 12, 31)):
        now = [ST.read_facts(spark, n, stored + "/facts", as_of, as_of.day - 1) for n in ("bank", "psp")]
        got = rounded(reconcile_bank_psp(f.merchants, *now, as_of, history))
        assert got == rounded(reconcile_bank_psp(f.merchants, f.bank, f.psp, as_of)) and len(got) > 2


def test_each_fact_source_is_stored_once(spark, tmp_path, monkeypatch):
    """What the facts are made from is not kept beside them: PSP, bank and webshop rows, postings, balances."""
    import os

    from quire import session
    from quire.plans import queries
    from quire.sources import adapters
    named, name_folder = [], session.shared_folder
    monkeypatch.setattr(queries, "_STORES", {})
    for module in (session, adapters, queries):
        monkeypatch.setattr(module, "shared_folder", lambda s, n: named.append((n, name_folder(s, n))) or named[-1][1],
                            raising=False)
    os.symlink(SF, tmp_path / "sf")
    store = stored_by_month(spark, str(tmp_path / "sf"))
    left = {n for n, path in named if os.path.isdir(path.removeprefix("file:"))}
    assert "store" in left and left <= {"store", "merchants"} and "postings" in {n for n, _ in named}
    for name in ("bank", "psp", "webshop", "marketplace", "accounting"):
        whole = getattr(fixture(spark, SF), name)
        rows = ST.read_facts(spark, name, store + "/facts", FIXTURE_AS_OF, None)
        assert rows.count() == whole.count() and rows.select(whole.columns).exceptAll(whole).isEmpty()


def test_written_tables_leave_no_shuffle_files(spark, tmp_path):
    import time

    from quire.session import SHUFFLES_REMOVED, write_table

    def files():
        found = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
        return {n for i in range(found.size()) if (n := found.apply(i).getName()).startswith("shuffle_")}

    psp = fixture(spark, SF).sources()["psp"]
    psp.count()
    before = files()
    for written in (lambda: write_table(psp.groupBy("buyer_id").count(), "test-shuffles"),
                    lambda: ST.write_facts(psp, "psp", str(tmp_path / "facts")),
                    lambda: ST.merge_history({"psp": psp}, str(tmp_path / "history"))):
        written()
        until = time.time() + 10
        while (left := files() - before) and time.time() < until:
            time.sleep(0.2)
        assert not left and spark.conf.get(SHUFFLES_REMOVED, None) is None
