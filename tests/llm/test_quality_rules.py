import math
import re

import numpy as np

from quire.llm import quality_rules as R
from quire.llm.queries import op9_quality_rules

SF = "/root/testdata/sf0.001"


def brute(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    where = {}
    for i in range(len(words) - 2):
        where.setdefault(tuple(words[i:i + 3]), []).append(i)
    repeat = {i + d for v in where.values() if len(v) > 1 for i in v for d in range(3)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)),
            len(repeat), len(lines), len(re.findall("[A-Z]", text)))


def test_query_matches_brute_force(spark):
    rows = {r["doc_id"]: r for r in op9_quality_rules(spark, SF).collect()}
    docs = spark.read.parquet(f"{SF}/documents.parquet").collect()
    assert len(rows) == len(docs)
    for d in docs:
        r, want = rows[d["doc_id"]], brute(d["text"])
        assert tuple(r[c] for c in R.MEASURES[:5]) == want[:5]
        failed = want[0] < 50 or 100 * want[4] > 50 * want[0]
        assert r["base_failed"] == failed and not (failed and r["kept"])


def test_measures_of_odd_texts():
    for t in ["", " \n", "a b c a b c", "a b a b a b", "x\x85y\xa0z w", "l\n l\nl \nl\n\n\n", "é|é <é>", "A\x0bB\x0cC\rD",
              " ".join(str(i % 700) for i in range(3000))]:
        assert R.measures_of(t.encode()) == brute(t)


def test_bound_is_exact():
    for n, k, p in [(30, 0, 0.1), (50, 3, 0.05), (200, 200, 0.3), (1000, 4, 0.01)]:
        exact = sum(math.comb(n, i) * p ** i * (1 - p) ** (n - i) for i in range(k + 1))
        assert abs(R.binomial_tail(k, n, p) - exact) < 1e-9


def test_cutoffs_keep_their_guarantee(spark):
    rule = R.Rule("share", "n_symbols", "n_words", (0.1, 0.2, 0.3, 0.4))
    # of 2,000 good texts, 30 have a share over 0.2 and 2 one over 0.3
    rows = [(100, 25 if i < 28 else 35 if i < 30 else 5, 500, 0, 0, 10, 0) for i in range(2000)]
    rows += [(60, 3, 300, 0, 0, 10, 0)] * 40 + [(10, 9, 50, 0, 0, 1, 0)] * 500
    good = spark.createDataFrame(rows, "n_words long, n_symbols long, word_chars long, n_dup_lines long, "
                                       "n_repeat_words long, n_lines long, n_upper long")
    cutoffs = R.calibrate(good, (rule,), 0.01, 0.05)
    want = [c for c, k in zip(rule.grid, (30, 30, 2, 0)) if R.binomial_tail(k, 2040, 0.01) <= 0.05][0]
    assert cutoffs == {(s, "share"): want for s in range(len(R.STRATA))} and want == 0.3  # one group: texts are few
    kept = good.withColumn("kept", R.verdict(cutoffs, (rule,)))
    assert kept.where("kept").count() == 2038  # texts that fail the base rules do not count


def test_strata_are_joined_until_they_can_be_tested():
    need = lambda parts: math.log(0.05 / parts) / math.log(0.99)
    for sizes, want in [([0] * 6, []), ([297, 0, 0, 0, 0, 0], []), ([0, 0, 299, 0, 0, 0], [[0, 1, 2, 3, 4, 5]]),
                        ([500] * 6, [[0], [1], [2], [3], [4], [5]]), ([370, 5, 400, 2, 0, 10], [[0], [1, 2, 3, 4, 5]])]:
        got = R.merged_strata(sizes, 0.01, 0.05)
        assert got == want, (sizes, got)
        assert all(sum(sizes[s] for s in g) >= need(len(got)) for g in got)
        assert not got or sum(got, []) == list(range(6))


def test_joint_false_rejection_stays_within_the_risk():
    """In 300 draws of labelled texts, where rules reject different texts, the true share that all rules together reject
    is over the risk about as seldom as promised, and the rules do act."""
    rng = np.random.default_rng(11)
    steps = R.path(R.RULES)
    share = np.linspace(0.0002, 0.0012, len(steps))  # of good texts that each step rejects first
    failed = acted = 0
    for _ in range(300):
        hits = rng.multinomial(3000, [*share, 1 - share.sum()])
        counts = {(2, i): int(n) for i, n in enumerate(hits[:-1])} | {(2, None): int(hits[-1])}
        cutoffs = R.chosen_cutoffs(counts, R.RULES, R.RISK, R.DELTA)
        taken = sum((2, r.name) in cutoffs and c >= cutoffs[2, r.name] for r, c in steps)
        failed += share[:taken].sum() > R.RISK
        acted += taken > 5
    assert failed <= 300 * R.DELTA + 3 * (300 * R.DELTA) ** 0.5 and acted > 250


def test_verdict_and_accepted_with_active_cutoffs(spark):
    """A thousand good texts calibrate; then texts full of symbols or capitals go, in both forms of the operator."""
    good = [(i, " ".join(f"word{i}x{j}" for j in range(60 + i % 300))) for i in range(1000)]
    bad = [(5000 + i, " ".join("#$%" if j % 2 else f"w{i}{j}" for j in range(80))) for i in range(20)]
    bad += [(6000 + i, " ".join(f"SHOUT{i}X{j}" for j in range(80))) for i in range(20)]
    docs = spark.createDataFrame(good + bad, "doc_id long, text string")
    labels = spark.createDataFrame([(i, 1) for i, _ in good], "doc_id long, quality int")
    kept = {r["doc_id"] for r in R.judge(docs, labels).where("kept").collect()}
    assert kept == {i for i, _ in good}
    assert {r["doc_id"] for r in R.accepted(docs, labels).collect()} == kept


def test_awkward_rows(spark, awkward, no_docs):
    labels = spark.createDataFrame([(1, 1), (1, 0), (None, 1), (5, None), (2, 1)], "doc_id long, quality int")
    rows = R.judge(awkward, labels).collect()
    assert len(rows) == awkward.count() and not any(r["kept"] for r in rows)  # all are short, or repeat words
    kept = R.accepted(awkward, labels)
    assert kept.columns == awkward.columns and kept.count() == 0
    from pyspark.sql import functions as F
    fine = awkward.withColumn("text", F.lit(" ".join(f"w{i}" for i in range(60))))
    assert R.accepted(fine, labels).count() == awkward.count()
    assert R.judge(no_docs, labels).count() == 0 and R.accepted(no_docs, labels.where("false")).count() == 0


def test_copies_of_a_good_text_are_one_trial(spark):
    from pyspark.sql import functions as F

    # of 300 good texts, 15 hold a symbol in every fifth word
    def text(i):
        return " ".join(f"w{i}x{j}" + "#" * (i < 15 and j % 5 == 0) for j in range(100))

    docs = spark.createDataFrame([(i, text(i)) for i in range(300)], "doc_id long, text string")
    copies = spark.range(5000).select((F.col("id") + 1000).alias("doc_id"), F.lit(text(299)).alias("text"))
    rows = docs.unionByName(copies)
    labels = rows.select("doc_id", F.lit(1).alias("quality"))
    plain = R.calibrate(R.good_texts(R.measure_table(docs), labels))
    assert R.calibrate(R.good_texts(R.measure_table(rows), labels)) == plain
    assert R.judge(rows, labels).where("kept").count() == rows.count()
    assert R.accepted(rows, labels).count() == rows.count()
