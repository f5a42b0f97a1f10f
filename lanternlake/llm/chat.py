"""Chat formatting: records of many layouts become turns of a few roles, and these one marked text with a mask for the loss.

A record is a JSON object. The nested paths of its fields, in order and hashed, are the fingerprint of its schema. Layouts
are declared as paths; a fingerprint that a layout foresees selects it at once, any other one selects the layout whose paths it
holds, once a task. So what a record needs is one look-up, however many layouts there are, and a schema that no layout fits
is reported by its fingerprint, its records kept without turns.

The template marks each turn's begin, role and end. Control strings inside roles and texts get a backslash, and so do
backslashes, so that a reader gets back exactly what was written. A formatted text is its turns one after the other: a long conversation
may be formatted in parts, which put together are the whole.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import combinations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

# ------------------------------------------------------------------ layouts


@dataclass(frozen=True)
class Layout:
    """turns: (role, path) in order, a path that is missing or null gives no turn. each: (list, path of the role, path of the text) of one turn an element.

    needed: paths that a record must hold; optional: those that it may hold besides. roles: names of roles in the record and what they become. after: a
    path whose text, if not empty, follows another one's after an empty line.
    """

    name: str
    needed: tuple[str, ...]
    optional: tuple[str, ...] = ()
    turns: tuple[tuple[str, str], ...] = ()
    each: tuple[str, str, str] | None = None
    after: dict[str, str] = field(default_factory=dict)
    roles: dict[str, str] = field(default_factory=dict)


#: Names of fields in common layouts (fixed values).
LAYOUTS = (
    Layout("prompt", ("prompt", "completion"), ("system",), (("system", "system"), ("user", "prompt"), ("assistant", "completion"))),
    Layout("prompt-response", ("prompt", "response"), ("system",), (("system", "system"), ("user", "prompt"), ("assistant", "response"))),
    Layout("question", ("question", "answer"), (), (("user", "question"), ("assistant", "answer"))),
    Layout("instruction", ("instruction", "output"), ("system", "input"), (("system", "system"), ("user", "instruction"), ("assistant", "output")), after={"instruction": "input"}),
    Layout("messages", ("messages[].role", "messages[].content"), ("messages[].name",), each=("messages", "role", "content")),
    Layout("message-parts", ("messages[].role", "messages[].content[].text"), ("messages[].content[].type",), each=("messages", "role", "content[].text")),
    Layout("from-value", ("conversations[].from", "conversations[].value"), (), each=("conversations", "from", "value"), roles={"human": "user", "gpt": "assistant"}),
)


def paths(value: object, at: str = "") -> set[str]:
    """The nested paths of a JSON value's leaves; [] stands for all elements of a list, and for an empty list itself."""
    if isinstance(value, dict) and value:
        return set().union(*(paths(v, (at + "." if at else "") + re.sub(r"([.\[\\])", r"\\\1", k)) for k, v in value.items()))
    if isinstance(value, list):
        return set().union(*(paths(v, at + "[]") for v in value)) if value else {at + "[]"}
    return {at}


def fingerprint(found: set[str]) -> str:
    return hashlib.sha256("\n".join(sorted(found)).encode()).hexdigest()[:32]


def _foreseen(layouts: tuple[Layout, ...]) -> dict[str, Layout]:
    """The fingerprints that layouts foresee: what they need with any of what is optional, and an empty list."""
    out: dict[str, Layout] = {}
    for layout in layouts:
        for n in range(len(layout.optional) + 1):
            for more in combinations(layout.optional, n):
                out.setdefault(fingerprint({*layout.needed, *more}), layout)
        if layout.each:
            out.setdefault(fingerprint({layout.each[0] + "[]"}), layout)
    return out


class Mapper:
    """Finds a record's layout by its fingerprint and reads its turns."""

    def __init__(self, layouts: tuple[Layout, ...] = LAYOUTS):
        self.layouts, self.known = layouts, _foreseen(layouts)

    def layout(self, mark: str, found: set[str]) -> Layout | None:
        """The layout of a fingerprint: as foreseen, or the one with most of its paths among those found, the first of equal ones; None if no layout fits."""
        if mark not in self.known:
            fits = [x for x in self.layouts if found.issuperset(x.needed)]
            self.known[mark] = max(fits, key=lambda x: len(found & {*x.needed, *x.optional}), default=None)
        return self.known[mark]

    def turns(self, record: str | None) -> tuple[str | None, str | None, list[tuple[str, str]]]:
        """(fingerprint, layout's name, turns as (role, text)) of a record; a text that is null is empty, one that is no string is its JSON."""
        try:
            value = json.loads(record) if record is not None else None
        except ValueError:
            value = None
        if not isinstance(value, dict):
            return None, None, []
        found = paths(value)
        mark = fingerprint(found)
        layout = self.layout(mark, found)
        if layout is None:
            return mark, None, []
        if layout.each:
            name, role, text = layout.each
            turns = [(_text(x, role), _text(x, text)) for x in value[name] or () if isinstance(x, dict)]
            return mark, layout.name, [(layout.roles.get(r, r), t) for r, t in turns]
        out = []
        for role, path in layout.turns:
            if path in found and (path in layout.needed or value.get(path) is not None):
                more = _text(value, layout.after[path]) if path in layout.after else ""
                out.append((role, _text(value, path) + ("\n\n" + more if more else "")))
        return mark, layout.name, out


def _text(value: object, path: str) -> str:
    """What stands at a path, texts of a list's elements joined."""
    name, more, rest = path.partition("[].")
    value = value.get(name) if isinstance(value, dict) else None
    if more:
        return "".join(_text(x, rest) for x in value or () if isinstance(x, dict)) if isinstance(value, list) else _plain(value)
    return _plain(value)


def _plain(value: object) -> str:
    return "" if value is None else value if isinstance(value, str) else json.dumps(value, ensure_ascii=False)


# ------------------------------------------------------------------ template

BEGIN, AFTER_ROLE, END = "### ", ": ", "</turn>\n"
#: Strings that get a backslash inside texts; inside roles the colon does too.
CONTROL = ("\\", "###", "</turn>")
_UNESCAPE = re.compile(r"\\(\\|###|</turn>|:)")
_TURN = re.compile(r"### ((?:[^\\:]++|\\.)*+): ((?:[^\\<]++|\\.|<(?!/turn>))*+)</turn>\n", re.DOTALL)


def escaped(text: str, more: tuple[str, ...] = ()) -> str:
    for x in (*CONTROL, *more):
        if x in text:
            text = text.replace(x, "\\" + x)
    return text


def unescaped(text: str) -> str:
    return _UNESCAPE.sub(r"\1", text) if "\\" in text else text


def formatted(turns: list[tuple[str, str]], learned: str = "assistant") -> tuple[str, list[tuple[int, int]]]:
    """The marked text, and the loss mask: where the texts of the learned role stand, by code point."""
    parts, at, spans = [], 0, []
    for role, text in turns:
        head, body = BEGIN + escaped(role, (":",)) + AFTER_ROLE, escaped(text)
        if role == learned:
            spans.append((at + len(head), at + len(head) + len(body)))
        parts += [head, body, END]
        at += len(head) + len(body) + len(END)
    return "".join(parts), spans


def read_turns(text: str) -> list[tuple[str, str]]:
    """The turns of a marked text; an error if it is none."""
    out, at = [], 0
    while at < len(text):
        found = _TURN.match(text, at)
        if not found:
            raise ValueError(f"no turn at character {at}")
        out.append((unescaped(found[1]), unescaped(found[2])))
        at = found.end()
    return out


# ------------------------------------------------------------------ tables

SPANS = "array<struct<start: bigint, end: bigint>>"
_SPANS = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))


def format_records(records: DataFrame, id_col: str = "conv_id", order_col: str | None = None, record_col: str = "record", layouts: tuple[Layout, ...] = LAYOUTS, learned: str = "assistant") -> DataFrame:
    """(id[, order], fingerprint, layout, n_turns, formatted, loss) of each record, a JSON object or a struct.

    loss: spans of code points of formatted with the texts of the learned role. A record that is null or no JSON object has neither
    fingerprint nor layout, one of a schema that no layout fits no layout; both have no turns and an empty text. Repeated rows
    and null ids stay rows of their own; no rows give none. Other columns are not read.
    """
    kept = [id_col] + ([order_col] if order_col else [])
    record = F.col(record_col)
    if isinstance(records.schema[record_col].dataType, StructType):
        record = F.to_json(record)
    names = [*kept, "fingerprint", "layout", "n_turns", "formatted", "loss"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mapper = Mapper(layouts)
        for batch in batches:
            begin, size, rows = 0, 0, []
            for i, text in enumerate(batch.column(len(kept))):
                mark, layout, turns = mapper.turns(text.as_py())
                out, spans = formatted(turns, learned)
                rows.append((mark, layout, len(turns), out, [{"start": a, "end": b} for a, b in spans]))
                size += len(out)
                # Long texts leave the task a few at a time.
                if size > 4 << 20 or i == batch.num_rows - 1:
                    columns = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), [pa.string(), pa.string(), pa.int64(), pa.string(), _SPANS], strict=True)]
                    yield pa.RecordBatch.from_arrays([batch.column(k).slice(begin, len(rows)) for k in range(len(kept))] + columns, names)
                    begin, size, rows = i + 1, 0, []

    types = [f"`{c}` {records.schema[c].dataType.simpleString()}" for c in kept]
    schema = ", ".join([*types, "fingerprint string", "layout string", "n_turns bigint", "formatted string", f"loss {SPANS}"])
    return records.select(*kept, record.alias("record")).mapInArrow(run, schema)


def read_back(texts: DataFrame, id_col: str = "conv_id", order_col: str = "at") -> DataFrame:
    """(id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars) of each conversation, from rows (id, order, formatted, loss) of format_records() alone.

    A conversation's parts follow one another in order of order_col. turns_sha256: of role, line end, text, line end of each turn. loss_chars and
    loss_sha256: of the unescaped text under the loss mask. A task reads its conversations part by part and keeps digests only, so the longest one needs
    no more memory than its longest part. Parts of a null id are one conversation.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, state = None, None

        def closed() -> tuple:
            return state[0], state[1], state[2].hexdigest(), state[3], state[4].hexdigest(), state[5]

        for batch in batches:
            done = []
            for row in range(batch.num_rows):
                key, text, loss = (batch.column(k)[row].as_py() for k in (0, 2, 3))
                if state is None or key != now:
                    done += [closed()] if state else []
                    now, state = key, [key, 0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                for role, turn in read_turns(text):
                    state[1] += 1
                    state[2].update(f"{role}\n{turn}\n".encode())
                for span in loss:
                    learned = unescaped(text[span["start"] : span["end"]])
                    state[3] += len(learned)
                    state[4].update(learned.encode())
                state[5] += len(text)
            yield _ended(done, batch.schema.field(0).type)
        if state:
            yield _ended([closed()], batch.schema.field(0).type)

    def _ended(rows: list[tuple], key: pa.DataType) -> pa.RecordBatch:
        columns = list(zip(*rows, strict=True)) or [[]] * 6
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, [key, pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()], strict=True)], [id_col, "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])

    ordered = texts.select(id_col, order_col, "formatted", "loss").repartition(id_col).sortWithinPartitions(id_col, order_col)
    return ordered.mapInArrow(run, f"`{id_col}` {texts.schema[id_col].dataType.simpleString()}, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint")


#: Turns and characters after which a conversation goes on in a new record.
RECORD_TURNS, RECORD_CHARS = 64, 1 << 20


def records_of(turns: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(id, at, record): the rows of a table of turns as JSON records in the layout that their roles allow, in order of at.

    A user's and an assistant's turn become a prompt with completion, these after a system's turn an instruction with output; anything else
    becomes messages, or from and value where the id is odd and the roles are the usual three. Null roles and texts are
    empty. Rows are put in order of id, turn, role and text, null first, over all tasks alike, so a conversation of any length is no task's alone: it goes on
    in another record after RECORD_TURNS turns or RECORD_CHARS characters, and where one task's rows end.
    """
    names = {"user": "human", "assistant": "gpt", "system": "system"}

    def layout(key: object, rows: list[tuple[str, str]]) -> dict:
        roles, texts = [r for r, _ in rows], [t for _, t in rows]
        if roles == ["user", "assistant"]:
            return {"prompt": texts[0], "completion": texts[1]}
        if roles == ["system", "user", "assistant"]:
            return {"system": texts[0], "instruction": texts[1], "output": texts[2]}
        if isinstance(key, int) and key % 2 and names.keys() >= set(roles):
            return {"conversations": [{"from": names[r], "value": t} for r, t in rows]}
        return {"messages": [{"role": r, "content": t} for r, t in rows]}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, key, first, size, kind = [], None, 0, 0, None
        for batch in batches:
            kind, out, held_out = batch.schema.field(0).type, [], 0
            for now, at, role, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if held and (now != key or len(held) == RECORD_TURNS or size > RECORD_CHARS):
                    out.append((key, first, json.dumps(layout(key, held), ensure_ascii=False)))
                    held, size, held_out = [], 0, held_out + size
                    if held_out > 4 << 20:
                        yield _packed(out, kind)
                        out, held_out = [], 0
                if not held:
                    key, first = now, at
                held.append((role, text))
                size += len(text)
            yield _packed(out, kind)
        if held:
            yield _packed([(key, first, json.dumps(layout(key, held), ensure_ascii=False))], kind)

    def _packed(rows: list[tuple], kind: pa.DataType) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(list(zip(*rows, strict=True)) or [[]] * 3, [kind, pa.int64(), pa.string()], strict=True)], [id_col, "at", "record"])

    empty = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    ordered = turns.select(F.col(id_col), F.col(turn_col).alias("turn"), empty(role_col).alias("role"), empty(text_col).alias("text")).orderBy(id_col, "turn", "role", "text")
    placed = ordered.select(id_col, F.monotonically_increasing_id().alias("at"), "role", "text")
    return placed.mapInArrow(run, f"`{id_col}` {turns.schema[id_col].dataType.simpleString()}, at bigint, record string")
