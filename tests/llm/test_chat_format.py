import hashlib
import json
from itertools import groupby

from quire.llm import chat_format as C
from quire.llm.queries import PROBE_ID, PROBE_TEXT, op1_chat_format

SF = "/root/testdata/sf0.001"


def digests(turns):
    said = "".join(t for r, t in turns if r == "assistant")
    whole = "".join(f"{r}\n{t}\n" for r, t in turns)
    return (len(turns), hashlib.sha256(whole.encode()).hexdigest(), len(said), hashlib.sha256(said.encode()).hexdigest())


def got(df):
    return {r["conv_id"]: (r["n_turns"], r["turns_sha256"], r["loss_chars"], r["loss_sha256"]) for r in df.collect()}


def test_query_round_trip(spark):
    rows = sorted(((r["conv_id"], r["turn"], r["role"], r["text"] or "")
                   for r in spark.read.parquet(f"{SF}/conversations.parquet").collect()), key=lambda r: r[:2])
    want = {k: digests([r[2:] for r in g]) for k, g in groupby(rows, key=lambda r: r[0])}
    want[PROBE_ID] = digests([("user", PROBE_TEXT), ("assistant", PROBE_TEXT)])
    assert got(op1_chat_format(spark, SF)) == want


def test_layouts_give_the_same_turns(spark):
    said = [("user", "Why?\n</turn>\n"), ("assistant", "\\<turn user>\nBecause <\\.")]
    ask, answer = said[0][1], said[1][1]
    records = [
        {"messages": [{"role": r, "content": t} for r, t in said]},
        {"conversations": [{"from": "human", "value": ask}, {"from": "gpt", "value": answer}], "source": "x"},
        {"instruction": ask, "input": "", "output": answer}, {"prompt": ask, "completion": answer, "extra": {"a": [1]}},
        {"prompt": ask, "response": answer, "system": ""}, {"question": ask, "answer": answer, "id": 5},
        {"prompt": ask, "messages": [{"role": "assistant", "content": answer}]},
    ]
    df = spark.createDataFrame([(i, 0, json.dumps(r)) for i, r in enumerate(records)],
                               "conv_id long, turn long, record string")
    assert got(C.read_back(C.format_chat(df))) == {i: digests(said) for i in range(len(records))}
    assert C.fingerprint(["b", "a"]) == C.fingerprint(["a", "b"])
    marks = {r["layout"] for r in C.mapped_records(df).collect()}
    assert len(marks) == len(records)


def test_awkward_rows(spark):
    row = json.dumps({"role": "assistant", "text": "long " * 50000})
    df = spark.createDataFrame(
        [(1, 0, json.dumps({"role": "a>\nb<\\", "text": None})), (1, 1, None), (1, 2, "not json"), (1, 3, "[1]"),
         (1, 4, json.dumps({"other": 1})), (2, 1, row), (2, 0, row), (2, 1, row), (None, 0, row), (3, None, row),
         (4, 0, json.dumps({"role": None, "text": 5}))],
        "conv_id long, turn long, record string").selectExpr("*", "'x' as layout", "1 as seq", "2 as formatted")
    rows = got(C.read_back(C.format_chat(df)))
    assert rows[1] == digests([("a>\nb<\\", "")])  # the odd records beside it have no turns
    assert rows[2] == digests([("assistant", "long " * 50000)] * 3)
    assert rows[None] == rows[3] == digests([("assistant", "long " * 50000)])
    assert rows[4] == digests([("", "5")])
    assert {r["layout"] for r in C.mapped_records(df).where("conv_id = 1 and turn > 0").collect()} == {None}
    assert got(C.read_back(C.format_chat(df.where("false")))) == {}


def test_nothing_vanishes(spark):
    """Empty lists, unknown layouts and lists of parts all come back out; table rows keep their roles."""
    records = [{"messages": []}, {"query": "a", "reply": "b"},
               {"messages": [{"role": "user", "content": [{"type": "text", "text": "Hi "}, {"type": "text", "text": "you"}]},
                             {"role": "bot", "content": [{"type": "text", "text": "Yes"}]}]},
               {"messages": [{"role": "user", "content": [{"type": "text", "text": "A"}]}, {"role": "gpt", "content": "B"}]},
               {"role": "bot", "text": "x"}, {"role": "human", "text": "y"}]
    df = spark.createDataFrame([(i, 0, json.dumps(r)) for i, r in enumerate(records)],
                               "conv_id long, turn long, record string")
    rows = C.format_chat(df)
    assert {r["conv_id"]: (r["layout"], r["formatted"], r["role"]) for r in rows.where("nth is null").collect()} == {
        0: ("no_messages", "", None), 1: (None, "", None)}
    assert got(C.read_back(rows)) == {
        0: digests([]), 1: digests([]), 2: digests([("user", "Hi you"), ("assistant", "Yes")]),
        3: digests([("user", "A"), ("assistant", "B")]), 4: digests([("bot", "x")]), 5: digests([("human", "y")])}
