"""Chat formatting through schema fingerprints.

A record is one JSON object. The sorted set of its nested field paths (such as
``messages[].role``) is hashed, and the hash selects a declarative layout that
says where the record's turns are. Canonical turns are then written in one
template whose marks cannot occur inside a text, with a loss span for each
turn that a model is trained to say.
"""

from __future__ import annotations

import hashlib
import json
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.llm.common import BATCH_BYTES

TURNS = "array<struct<role:string,text:string>>"


@dataclass(frozen=True)
class Layout:
    """Where the turns of a record are.

    ``paths`` are the field paths that name the layout. With ``each``, the
    turns are the objects of that list with a ``role`` and a ``text`` field.
    Otherwise ``turns`` gives (role, fields): a role that starts with ``$`` is
    read from that field, and several fields are joined by a blank line,
    leaving out empty ones. A turn named ``system`` is left out when empty.
    Names of speakers are made canonical (ROLES) unless ``as_is``.
    """
    name: str
    paths: tuple[str, ...]
    turns: tuple[tuple[str, tuple[str, ...]], ...] = ()
    each: str | None = None
    role: str = "role"
    text: str = "content"
    as_is: bool = False


LAYOUTS = (
    Layout("turn_row", ("role", "text"), (("$role", ("text",)),), as_is=True),
    Layout("message_row", ("role", "content"), (("$role", ("content",)),)),
    Layout("messages", ("messages[].content", "messages[].role"), each="messages"),
    Layout("no_messages", ("messages",), each="messages"),
    Layout("message_parts", ("messages[].content[].text", "messages[].content[].type", "messages[].role"), each="messages"),
    Layout("some_message_parts", ("messages[].content", "messages[].content[].text", "messages[].content[].type",
                                  "messages[].role"), each="messages"),
    Layout("message_texts", ("messages[].role", "messages[].text"), each="messages", text="text"),
    Layout("from_value", ("conversations[].from", "conversations[].value"), each="conversations", role="from",
           text="value"),
    Layout("instruction_input", ("input", "instruction", "output"),
           (("user", ("instruction", "input")), ("assistant", ("output",)))),
    Layout("instruction", ("instruction", "output"), (("user", ("instruction",)), ("assistant", ("output",)))),
    Layout("instruction_response", ("instruction", "response"),
           (("user", ("instruction",)), ("assistant", ("response",)))),
    Layout("prompt_completion", ("completion", "prompt"), (("user", ("prompt",)), ("assistant", ("completion",)))),
    Layout("prompt_response", ("prompt", "response"), (("user", ("prompt",)), ("assistant", ("response",)))),
    Layout("system_prompt_response", ("prompt", "response", "system"),
           (("system", ("system",)), ("user", ("prompt",)), ("assistant", ("response",)))),
    Layout("question_answer", ("answer", "question"), (("user", ("question",)), ("assistant", ("answer",)))),
    Layout("prompt_messages", ("messages[].content", "messages[].role", "prompt"), (("user", ("prompt",)),),
           each="messages"),
)
#: Names of speakers that mean the same (fixed values); others stay as they are.
ROLES = {"human": "user", "gpt": "assistant", "bot": "assistant", "model": "assistant", "ai": "assistant"}
LOSS_ROLE = "assistant"


def field_paths(value, prefix: str = "") -> set[str]:
    """Paths of the scalar fields in a parsed JSON value; an empty list or object is a field."""
    if isinstance(value, dict) and value:
        return set().union(*(field_paths(v, f"{prefix}.{k}" if prefix else k) for k, v in value.items()))
    if isinstance(value, list) and value:
        return set().union(*(field_paths(v, prefix + "[]") for v in value))
    return {prefix}


def fingerprint(paths) -> str:
    """A short hash of a set of field paths; their order does not matter."""
    return hashlib.sha256("\n".join(sorted(paths)).encode()).hexdigest()[:16]


def _text(value) -> str:
    """A value as text; a list of parts is the text of its parts, end to end."""
    if isinstance(value, list) and value and all(isinstance(p, dict) and isinstance(p.get("text"), str) for p in value):
        return "".join(p["text"] for p in value)
    return "" if value is None else value if isinstance(value, str) else json.dumps(value, ensure_ascii=False)


def _role(value) -> str:
    name = _text(value)
    return ROLES.get(name, name)


def canonical_turns(layout: Layout, record: dict) -> list[dict]:
    out, named = [], _text if layout.as_is else _role
    for role, fields in layout.turns:
        parts = [_text(record.get(f)) for f in fields]
        text = parts[0] if len(parts) == 1 else "\n\n".join(p for p in parts if p)
        if role != "system" or text:
            out.append({"role": named(record.get(role[1:])) if role.startswith("$") else role, "text": text})
    if layout.each:
        out += [{"role": named(m.get(layout.role)), "text": _text(m.get(layout.text))} for m in record[layout.each]]
    return out


def mapped_records(records: DataFrame, record_col: str = "record", layouts: tuple[Layout, ...] = LAYOUTS) -> DataFrame:
    """``records`` with the columns fingerprint, layout and turns added.

    Fields that no layout knows are left out of the fingerprint, so extra
    fields do no harm. A record of no known layout has layout null and no
    turns; so has one that is null or not a JSON object. Columns that have one
    of the three names already give way. An empty table gives an empty one.
    """
    known = {p for x in layouts for p in x.paths}
    by_print = {fingerprint(x.paths): x for x in layouts}

    @F.pandas_udf(f"fingerprint string, layout string, turns {TURNS}")
    def mapped(col: pd.Series) -> pd.DataFrame:
        rows = []
        for raw in col:
            try:
                record = json.loads(raw) if isinstance(raw, str) else None
            except ValueError:
                record = None
            if not isinstance(record, dict):
                rows.append((None, None, []))
                continue
            mark = fingerprint(field_paths(record) & known)
            layout = by_print.get(mark)
            rows.append((mark, layout and layout.name, canonical_turns(layout, record) if layout else []))
        return pd.DataFrame(rows, columns=["fingerprint", "layout", "turns"])

    cols = [c for c in records.columns if c not in ("fingerprint", "layout", "turns")]
    return (records.select(*[F.col(f"`{c}`") for c in cols], mapped(F.col(record_col)).alias("__mapped"))
            .select(*[F.col(f"`{c}`") for c in cols], "__mapped.*"))


def escaped(text: Column, more: str = "") -> Column:
    """Put a backslash before each backslash, ``<`` and character of ``more``."""
    return F.regexp_replace(text, r"([\\<" + more + "])", r"\\$1")


def unescaped(text: str) -> str:
    """Undo ``escaped`` on a whole text."""
    out, i = [], 0
    while (at := text.find("\\", i)) >= 0:
        out.append(text[i:at] + text[at + 1:at + 2])
        i = at + 2
    return "".join(out) + text[i:]


def format_chat(records: DataFrame, id_col: str = "conv_id", order_col: str = "turn", record_col: str = "record",
                layouts: tuple[Layout, ...] = LAYOUTS, loss_role: str = LOSS_ROLE) -> DataFrame:
    """One row per turn: conv_id, seq, nth, layout, role, formatted, loss_start, loss_end.

    A conversation's text is ``formatted`` of its rows end to end, in the order
    of (seq, nth): seq is the record's place, nth the turn's place in it. A
    turn reads ``<turn ROLE>`` newline TEXT newline ``</turn>`` newline, where a
    backslash goes before each backslash and ``<`` of the text, and before
    ``>`` and newlines of the role too; so no text can hold a mark. The loss
    mask covers [loss_start, loss_end) of the row's code points, which is the
    text of a ``loss_role`` turn; both are null elsewhere. A null text is
    empty. Records of equal seq are ordered by a hash, equal records come as
    often as they are there. Rows stay one per turn, so no conversation is ever
    gathered here; other columns are ignored.

    Nothing vanishes: a record without a turn, as its layout is unknown (layout
    is null then) or its list of turns is empty, is one row whose nth, role and
    spans are null and whose ``formatted`` is empty. An empty table gives no rows.
    """
    turns = mapped_records(records.select(F.col(id_col).alias("conv_id"), F.col(order_col).alias("seq"),
                                          F.col(record_col).alias("record")), "record", layouts)
    is_turn = F.col("nth").isNotNull()
    turns = (turns.select("conv_id", "seq", F.xxhash64("record").alias("tie"), "layout",
                          F.posexplode_outer("turns").alias("nth", "t"))
             .select("conv_id", "seq", "tie", "nth", "layout", F.when(is_turn, F.coalesce("t.role", F.lit(""))).alias("role"),
                     F.coalesce("t.text", F.lit("")).alias("text")))
    head = F.concat(F.lit("<turn "), escaped(F.col("role"), r">\n"), F.lit(">\n"))
    body = escaped(F.col("text"))
    masked = F.col("role") == loss_role
    return turns.select("conv_id", "seq", "tie", "nth", "layout", "role",
                        F.when(is_turn, F.concat(head, body, F.lit("\n</turn>\n"))).otherwise("").alias("formatted"),
                        F.when(masked, F.length(head)).cast("long").alias("loss_start"),
                        F.when(masked, F.length(head) + F.length(body)).cast("long").alias("loss_end"))


TURN_END = "\n</turn>\n"


def parse_turn(piece: str) -> tuple[str, str]:
    """(role, text) of one formatted turn."""
    head = 0
    while (head := piece.index(">", head)) and (len(piece[:head]) - len(piece[:head].rstrip("\\"))) % 2:
        head += 1
    return unescaped(piece[len("<turn "):head]), unescaped(piece[head + 2:len(piece) - len(TURN_END)])


def read_back(formatted: DataFrame) -> DataFrame:
    """Digests per conversation, read from formatted text and loss spans alone.

    Returns conv_id, n_turns, turns_sha256, loss_chars, loss_sha256 and
    formatted_chars. A SHA-256 needs its bytes in order, so the rows of a
    conversation meet in one sorted partition; they stream through it and only
    the hash states and one unfinished turn are held, however long the
    conversation is. A null conv_id is a conversation too, and one whose records
    have no turns has none here either: it comes back with n_turns 0.
    """
    formatted.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    kind = formatted.schema["conv_id"].dataType.simpleString()
    ordered = (formatted.select("conv_id", "seq", "tie", "nth", "formatted", "loss_start", "loss_end")
               .repartition("conv_id").sortWithinPartitions("conv_id", "seq", "tie", "nth")
               .select(F.col("conv_id").cast("string").alias("conv_id"), "formatted", "loss_start", "loss_end"))
    columns = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]

    def run(frames):
        state = None

        def result():
            assert not state["rest"], "a formatted text ends inside a turn"
            return (state["id"], state["n"], state["turns"].hexdigest(), state["loss_chars"],
                    state["loss"].hexdigest(), state["chars"])

        for frame in frames:
            done = []
            for conv_id, piece, start, end in zip(*(frame[c] for c in frame.columns)):
                if state is None or conv_id != state["id"]:
                    if state is not None:
                        done.append(result())
                    state = {"id": conv_id, "n": 0, "turns": hashlib.sha256(), "loss_chars": 0,
                             "loss": hashlib.sha256(), "chars": 0, "rest": ""}
                state["chars"] += len(piece)
                if not pd.isna(start):
                    text = unescaped(piece[int(start):int(end)])
                    state["loss_chars"] += len(text)
                    state["loss"].update(text.encode())
                *turns, state["rest"] = (state["rest"] + piece).split(TURN_END)
                for t in turns:
                    role, text = parse_turn(t + TURN_END)
                    state["n"] += 1
                    state["turns"].update(f"{role}\n{text}\n".encode())
            yield pd.DataFrame(done, columns=columns)
        if state is not None:
            yield pd.DataFrame([result()], columns=columns)

    found = ordered.mapInPandas(run, "conv_id string, n_turns long, turns_sha256 string, loss_chars long, "
                                     "loss_sha256 string, formatted_chars long")
    return found.withColumn("conv_id", F.col("conv_id").cast(kind))
