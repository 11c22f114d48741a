"""Chat formatting with schema fingerprints.

The nested field paths of a frame's schema (or of a JSON record) that any
mapping knows are hashed; the hash selects a declarative mapping, which turns
prompt, instruction and message layouts into canonical turns
``(conv_id, turn, role, text)``.  The formatter marks turns, escapes control
characters inside texts reversibly and states which spans bear loss; the
reader gets the turns back from the formatted text.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from itertools import combinations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, StructType

ASSISTANT = "assistant"


@dataclass(frozen=True)
class Layout:
    """A mapping: either ``each`` (array path, role field, text field), or
    ``row`` (turn, role and text fields of one turn per row), or ``fields``
    (role, path) in order; optional fields may be missing from a schema."""

    name: str
    each: tuple[str, str, str] | None = None
    row: tuple[str, str, str] | None = None
    fields: tuple[tuple[str, str], ...] = ()
    optional: tuple[tuple[str, str], ...] = ()
    roles: dict[str, str] = field(default_factory=dict, hash=False)

    def paths(self) -> set[str]:
        if self.each:
            return {f"{self.each[0]}[].{self.each[1]}", f"{self.each[0]}[].{self.each[2]}"}
        return set(self.row or ()) | {p for _, p in self.fields}


# The layouts and their field names.
LAYOUTS = (
    Layout("turn rows", row=("turn", "role", "text")),
    Layout("messages", each=("messages", "role", "content")),
    Layout("from and value", each=("conversations", "from", "value"),
           roles={"human": "user", "gpt": "assistant"}),
    Layout("prompt and response", fields=(("user", "prompt"), ("assistant", "response")), optional=(("system", "system"),)),
    Layout("prompt and completion", fields=(("user", "prompt"), ("assistant", "completion")), optional=(("system", "system"),)),
    Layout("instruction", fields=(("user", "instruction"), ("assistant", "output")),
           optional=(("system", "system"), ("user", "input"))),
    Layout("question and answer", fields=(("user", "question"), ("assistant", "answer")), optional=(("system", "system"),)),
)


def schema_paths(kind: DataType, prefix: str = "") -> set[str]:
    """Nested field paths of a schema; ``[]`` stands for array elements."""
    if isinstance(kind, ArrayType):
        return schema_paths(kind.elementType, prefix + "[]")
    if isinstance(kind, StructType):
        return set().union(*(schema_paths(f.dataType, f"{prefix}.{f.name}" if prefix else f.name) for f in kind.fields))
    return {prefix}


def record_paths(value, prefix: str = "") -> set[str]:
    """Nested field paths of a JSON value."""
    if isinstance(value, list):
        return set().union(*(record_paths(v, prefix + "[]") for v in value)) if value else {prefix + "[]"}
    if isinstance(value, dict):
        return set().union(*(record_paths(v, f"{prefix}.{k}" if prefix else k) for k, v in value.items()))
    return {prefix}


def fingerprint(paths: Iterable[str]) -> str:
    """Hash of the paths that matter: those of layouts whose required paths
    are all there.  Others are ignored; two layouts at once match none."""
    have = set(paths)
    known = {p for lay in LAYOUTS if lay.paths() <= have for p in lay.paths() | {p for _, p in lay.optional}}
    return hashlib.sha256("\n".join(sorted(known & have)).encode()).hexdigest()[:16]


def mappings() -> dict[str, Layout]:
    """Fingerprint -> layout, with and without each optional field."""
    out = {}
    for lay in LAYOUTS:
        for n in range(len(lay.optional) + 1):
            for extra in combinations(lay.optional, n):
                out[fingerprint(lay.paths() | {p for _, p in extra})] = Layout(
                    lay.name, lay.each, lay.row, _ordered(lay.fields, extra), (), lay.roles)
    return out


def _ordered(fields, extra):
    """Optional fields in place: system first, others before the answer."""
    system = tuple(e for e in extra if e[0] == "system")
    return system + fields[:1] + tuple(e for e in extra if e[0] != "system") + fields[1:]


def _turns(lay: Layout, at) -> Column:
    """array<struct<role, text>> of a record; ``at`` gives a field's column."""
    if lay.each:
        path, role, text = lay.each
        turns = F.transform(at(path), lambda m: F.struct(m[role].cast("string").alias("role"), m[text].cast("string").alias("text")))
    else:
        said = [F.struct(F.lit(role).alias("role"), at(path).cast("string").alias("text")) for role, path in lay.fields]
        optional = {"system", "input"}
        none = F.array().cast("array<struct<role:string,text:string>>")
        turns = F.concat(*[   # empty optional fields are no turn
            F.when(F.coalesce(at(p), F.lit("")) == "", none).otherwise(F.array(s)) if p in optional else F.array(s)
            for (_, p), s in zip(lay.fields, said, strict=True)])
    for old, new in lay.roles.items():
        turns = F.transform(turns, lambda t: F.struct(F.when(t["role"] == old, F.lit(new)).otherwise(t["role"]).alias("role"), t["text"].alias("text")))
    return turns


def canonical_turns(frame: DataFrame, id_col: str = "conv_id") -> DataFrame:
    """``(conv_id, turn, role, text)`` of a frame whose schema fits a layout.

    A schema that fits none is an error that names its paths.  Null arrays
    give no turns, null texts stay null, further columns are ignored, empty
    frames give no rows.
    """
    paths = schema_paths(frame.schema)
    lay = mappings().get(fingerprint(paths))
    if lay is None:
        raise ValueError(f"no layout for the field paths {sorted(paths)}")
    if lay.row:
        turn, role, text = lay.row
        return frame.select(F.col(id_col).alias("conv_id"), F.col(turn).cast("long").alias("turn"),
                            F.col(role).cast("string").alias("role"), F.col(text).cast("string").alias("text"))
    return frame.select(F.col(id_col).alias("conv_id"), F.posexplode(_turns(lay, F.col)).alias("turn", "t")).select(
        "conv_id", F.col("turn").cast("long").alias("turn"), "t.role", "t.text")


def canonical_json_turns(frame: DataFrame, json_col: str = "record", id_col: str = "conv_id") -> DataFrame:
    """The same for JSON records of mixed layouts, one record per row: each
    record's own fingerprint selects its mapping.  Further column ``layout``;
    records that fit no layout (also null and broken JSON) give one row with a
    null layout and no turn."""
    @F.udf("string")
    def of_record(text):
        try:
            return fingerprint(record_paths(json.loads(text)))
        except (TypeError, ValueError, RecursionError):
            return None

    known = {fp: lay for fp, lay in mappings().items() if not lay.row}
    turns, name = None, None
    for fp, lay in known.items():
        if lay.each:
            kind = f"{lay.each[0]} array<struct<`{lay.each[1]}` string, `{lay.each[2]}` string>>"
        else:
            kind = ", ".join(f"`{p}` string" for _, p in lay.fields)
        parsed = F.from_json(F.col("__json"), kind)
        here, said = F.col("__fp") == fp, _turns(lay, lambda p, parsed=parsed: parsed[p])
        turns = F.when(here, said) if turns is None else turns.when(here, said)
        name = F.when(here, F.lit(lay.name)) if name is None else name.when(here, F.lit(lay.name))
    marked = frame.select(F.col(id_col).alias("conv_id"), F.col(json_col).cast("string").alias("__json")).withColumn("__fp", of_record("__json"))
    return marked.select("conv_id", name.alias("layout"), F.posexplode_outer(turns).alias("turn", "t")).select(
        "conv_id", F.col("turn").cast("long").alias("turn"), "t.role", "t.text", "layout")


def escaped(text: Column) -> Column:
    """``\\``, ``<`` and ``>`` each behind a backslash: no control string can
    stand in a text, whatever it holds."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"([\\<>])", r"\\$1")


_TURN = re.compile(r"<turn ((?:[^<>\\]++|\\.)*+)>\n((?:[^<>\\]++|\\.)*+)</turn>\n", re.S)


def unescaped(text: str) -> str:
    return re.sub(r"\\(.)", r"\1", text, flags=re.S)


def read_turns(formatted: str) -> list[tuple[str, str]]:
    """(role, text) of each turn of a formatted conversation."""
    out, at = [], 0
    while at < len(formatted):
        m = _TURN.match(formatted, at)
        if m is None:
            raise ValueError(f"no turn at character {at}")
        out.append((unescaped(m[1]), unescaped(m[2])))
        at = m.end()
    return out


def _assemble(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pieces sorted by conversation -> one row per conversation."""
    now: tuple = ()
    parts: list[str] = []
    spans: list[dict] = []
    length = turns = 0
    done: list[tuple] = []

    def close() -> None:
        nonlocal parts, spans, length, turns
        if now:
            done.append((now[0], turns, "".join(parts), spans))
        parts, spans, length, turns = [], [], 0, 0

    def flush(kind) -> pa.RecordBatch:
        nonlocal done
        cols = list(zip(*done, strict=True)) if done else [[], [], [], []]
        done = []
        return pa.RecordBatch.from_arrays(
            [pa.array(cols[0], kind), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.string()),
             pa.array(cols[3], pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))],
            names=["conv_id", "n_turns", "formatted", "loss_spans"])

    kind = None
    for batch in batches:
        kind = batch.schema.field("conv_id").type
        for conv, head, body, tail, loss in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "head", "body", "tail", "loss")), strict=True):
            if (conv,) != now:
                close()
                now = (conv,)
            if loss:
                spans.append({"start": length + len(head), "end": length + len(head) + len(body)})
            parts += (head, body, tail)
            length += len(head) + len(body) + len(tail)
            turns += 1
        yield flush(kind)
    close()
    if kind is not None:
        yield flush(kind)


def format_conversations(turns: DataFrame) -> DataFrame:
    """``(conv_id, n_turns, formatted, loss_spans)``: one row per conversation.

    Turns stand by ``turn`` (null last; ties by role, then text), repeated
    rows each.  Null roles and texts are empty.  A null ``conv_id`` is a
    conversation of its own.  ``loss_spans`` are the assistant texts, in code
    points of ``formatted``.  Conversations are read as sorted streams; only
    the one being written is held.  An empty table gives no rows.
    """
    role = F.coalesce("role", F.lit(""))
    pieces = turns.select(
        "conv_id", "turn", "role", "text",
        F.concat(F.lit("<turn "), escaped(F.col("role")), F.lit(">\n")).alias("head"),
        escaped(F.col("text")).alias("body"), F.lit("</turn>\n").alias("tail"), (role == ASSISTANT).alias("loss"))
    ordered = pieces.repartition("conv_id").sortWithinPartitions(
        "conv_id", F.col("turn").asc_nulls_last(), "role", "text")
    kind = turns.schema["conv_id"].dataType.simpleString()
    return ordered.select("conv_id", "head", "body", "tail", "loss").mapInArrow(
        _assemble, f"conv_id {kind}, n_turns long, formatted string, loss_spans array<struct<start:long,end:long>>")


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for text, spans in zip(batch.column("formatted").to_pylist(), batch.column("loss_spans").to_pylist(), strict=True):
            every = read_turns(text)
            loss = "".join(unescaped(text[s["start"]:s["end"]]) for s in spans)
            said = "".join(f"{role}\n{words}\n" for role, words in every)
            rows.append((len(every), hashlib.sha256(said.encode()).hexdigest(), len(loss),
                         hashlib.sha256(loss.encode()).hexdigest(), len(text)))
        cols = list(zip(*rows, strict=True)) if rows else [[]] * 5
        kinds = (pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64())
        yield pa.RecordBatch.from_arrays(
            [batch.column("conv_id"), *(pa.array(c, k) for c, k in zip(cols, kinds, strict=True))],
            names=["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])


def digests(formatted: DataFrame) -> DataFrame:
    """Figures read back from formatted conversations."""
    kind = formatted.schema["conv_id"].dataType.simpleString()
    return formatted.select("conv_id", "formatted", "loss_spans").mapInArrow(
        _digests, f"conv_id {kind}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
