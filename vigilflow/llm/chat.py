"""Chat formatting: layouts found by fingerprints of nested field paths.

A record is a JSON text of any layout.  The set of its nested field paths is hashed; the
fingerprint selects a declared layout, which says where the turns lie.  Records
become canonical turns (role, text) and then one marked-up text with a loss mask.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations
from urllib.parse import quote, unquote

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T
from pyspark.sql.pandas.types import to_arrow_schema

START, END = "<|im_start|>", "<|im_end|>\n"


@dataclass(frozen=True)
class Layout:
    """Where a layout keeps its turns.

    A list layout names the ``list`` field with the ``role`` and ``text`` fields of its
    items and maps role names by ``roles``.  A flat layout lists ``turns`` as (role,
    fields); several fields of a turn are joined by an empty line, absent ones left out.
    """

    name: str
    list: str = ""
    role: str = ""
    text: str = ""
    roles: tuple[tuple[str, str], ...] = ()
    turns: tuple[tuple[str, tuple[str, ...]], ...] = ()
    optional: tuple[str, ...] = ()

    def path_sets(self) -> list[set[str]]:
        """Sets of field paths that this layout covers, every choice of optional fields included."""
        if self.list:
            return [{f"{self.list}[].{self.role}", f"{self.list}[].{self.text}"}, {f"{self.list}[.]"}]
        fixed = {f for _, fields in self.turns for f in fields if f not in self.optional}
        choices = (c for n in range(len(self.optional) + 1) for c in combinations(self.optional, n))
        return [fixed | set(c) for c in choices]

    def read(self, record: dict) -> list[dict]:
        """The turns of a record of this layout."""
        if self.list:
            names = dict(self.roles)
            roles = [_text(item.get(self.role)) for item in record[self.list]]
            texts = [_text(item.get(self.text)) for item in record[self.list]]
            return [{"role": names.get(role, role), "text": text} for role, text in zip(roles, texts)]
        out = []
        for role, fields in self.turns:
            parts = [_text(record[f]) for f in fields if f in record]
            if parts:
                out.append({"role": role, "text": "\n\n".join(parts)})
        return out


LAYOUTS = (
    Layout("messages", list="messages", role="role", text="content"),
    Layout("shared", list="conversations", role="from", text="value", roles=(("human", "user"), ("gpt", "assistant"))),
    Layout("prompt", turns=(("user", ("prompt",)), ("assistant", ("response",)))),
    Layout("completion", turns=(("user", ("prompt",)), ("assistant", ("completion",)))),
    Layout(
        "instruction",
        turns=(("system", ("system",)), ("user", ("instruction", "input")), ("assistant", ("output",))),
        optional=("system", "input"),
    ),
)


def _text(value) -> str:
    return {None: "", True: "true", False: "false"}.get(value, value) if not isinstance(value, str) else value


def field_paths(value, at: str = "") -> set[str]:
    """Paths of all fields of a JSON value; list positions do not count, empty lists and objects end a path.

    An empty list has a path that no other value has; dots and brackets in names are escaped.
    """
    if isinstance(value, dict):
        name = lambda key: re.sub(r"([\\.\[{])", r"\\\1", key)
        parts = [field_paths(v, f"{at}.{name(k)}" if at else name(k)) for k, v in value.items()]
        return set().union(*parts) or {f"{at}{{}}"}
    if isinstance(value, list):
        return set().union(*(field_paths(v, f"{at}[]") for v in value)) or {f"{at}[.]"}
    return {at}


def fingerprint(paths: set[str]) -> str:
    return hashlib.sha256("\n".join(sorted(paths)).encode()).hexdigest()[:16]


def canonical(records: DataFrame, record: str = "record", layouts: tuple[Layout, ...] = LAYOUTS) -> DataFrame:
    """Adds ``fingerprint``, ``layout`` and ``turns`` (array of role, text); columns of these names are replaced.

    The fingerprint is the hash of the record's set of field paths.  Unknown layouts get a null layout and no turns; broken
    records (null, empty, no JSON, nested beyond Python's depth) a null fingerprint, too; nothing is dropped.  Counts by fingerprint tell
    which layouts to declare next.  Records may have any length.
    """
    known = {fingerprint(paths): layout for layout in layouts for paths in layout.path_sets()}
    added = T.StructType().add("fingerprint", "string").add("layout", "string")
    added = added.add("turns", T.ArrayType(T.StructType().add("role", "string").add("text", "string")))
    kept = [c for c in records.columns if c not in added.names]

    def read(text: str | None) -> tuple[str | None, str | None, list[dict]]:
        try:
            value = json.loads(text, parse_int=str, parse_float=str, parse_constant=str)
            mark = fingerprint(field_paths(value))
        except (TypeError, ValueError, RecursionError):
            return None, None, []
        layout = known.get(mark)
        return mark, layout and layout.name, layout.read(value) if layout else []

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = to_arrow_schema(added)
        for batch in batches:
            found = [read(text) for text in batch.column(record).to_pylist()]
            columns = list(zip(*found)) if found else [()] * 3
            arrays = [pa.array(c, field.type) for c, field in zip(columns, types)]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), *arrays], [*kept, *added.names])

    schema = T.StructType([*(records.schema[c] for c in kept), *added.fields])
    return records.mapInArrow(run, schema)


def escape(text: str) -> str:
    """No control string is left in the result: every ``<``, backslashes, ``|`` gets a backslash more."""
    return re.sub(r"<(\\*)\|", r"<\\\1|", text)


def unescape(text: str) -> str:
    return re.sub(r"<\\(\\*)\|", r"<\1|", text)


def render(turns: list[dict]) -> tuple[str, list[tuple[int, int]]]:
    """The marked-up text and the spans (code points) that count for the loss: assistant texts."""
    parts, spans, at = [], [], 0
    for turn in turns:
        head, body = f"{START}{quote(turn['role'] or '', safe='')}\n", escape(turn["text"] or "")
        parts += [head, body, END]
        if turn["role"] == "assistant":
            spans.append((at + len(head), at + len(head) + len(body)))
        at += len(head) + len(body) + len(END)
    return "".join(parts), spans


def parse(formatted: str) -> list[tuple[str, str]]:
    """The turns of a marked-up text; the inverse of ``render``."""
    out = []
    for piece in formatted.split(END)[:-1]:
        role, _, body = piece.removeprefix(START).partition("\n")
        out.append((unquote(role), unescape(body)))
    return out


def formatted(canonical_turns: DataFrame, key: str) -> DataFrame:
    """(key, formatted, loss) of frames with a ``turns`` column; ``loss`` holds code-point spans.

    No turns give an empty text.  Null roles and texts count as empty.
    """
    kind = canonical_turns.schema[key].dataType.simpleString()

    def convert(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            done = [render(turns or []) for turns in batch.column("turns").to_pylist()]
            loss = [[{"start": a, "stop": b} for a, b in spans] for _, spans in done]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(key), pa.array([text for text, _ in done], pa.string()),
                    pa.array(loss, pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))),
                ],
                [key, "formatted", "loss"],
            )

    return canonical_turns.select(key, "turns").mapInArrow(
        convert, f"`{key}` {kind}, formatted string, loss array<struct<start:long,stop:long>>"
    )


def read_back(chats: DataFrame, key: str) -> DataFrame:
    """Per formatted chat: turns and loss text as read from the output, as counts and digests."""
    kind = chats.schema[key].dataType.simpleString()

    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for text, loss in zip(batch.column("formatted").to_pylist(), batch.column("loss").to_pylist()):
                turns = parse(text)
                whole = "".join(f"{role}\n{said}\n" for role, said in turns)
                learned = "".join(unescape(text[s["start"] : s["stop"]]) for s in loss)
                rows.append((len(turns), _sha(whole), len(learned), _sha(learned), len(text)))
            columns = list(zip(*rows)) if rows else [[]] * 5
            kinds = (pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column(key), *(pa.array(c, k) for c, k in zip(columns, kinds))],
                [key, "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"],
            )

    return chats.mapInArrow(
        digests,
        f"`{key}` {kind}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long",
    )


def _sha(text: str) -> str:
    return hashlib.sha256(text.encode("utf-8", "surrogatepass")).hexdigest()


def as_records(rows: DataFrame) -> DataFrame:
    """One JSON record per conversation from (conv_id, turn, role, text) rows, in the layout its shape allows.

    Turns are ordered by turn, then role, then text (nulls first), so ties have one order.
    Two-turn exchanges become prompt records, system-user-assistant ones instruction records,
    other conversations message lists, every second one with the names of shared chats.
    """
    turns = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "role", "text"))).alias("t"))
    role = lambda t: F.coalesce(t["role"], F.lit(""))
    text = lambda t: F.coalesce(t["text"], F.lit(""))
    at = lambda i: text(F.get("t", F.lit(i)))
    roles = F.concat_ws(",", F.transform("t", role))
    known = F.forall("t", lambda t: role(t).isin("system", "user", "assistant"))
    shared_name = lambda t: F.when(role(t) == "user", "human").when(role(t) == "assistant", "gpt").otherwise(role(t))
    record = (
        F.when((F.size("t") == 2) & (roles == "user,assistant"), F.to_json(F.struct(at(0).alias("prompt"), at(1).alias("response"))))
        .when(
            (F.size("t") == 3) & (roles == "system,user,assistant"),
            F.to_json(F.struct(at(0).alias("system"), at(1).alias("instruction"), at(2).alias("output"))),
        )
        .when(
            known & (F.pmod(F.xxhash64("conv_id"), F.lit(2)) == 1),
            F.to_json(F.struct(F.transform("t", lambda t: F.struct(shared_name(t).alias("from"), text(t).alias("value"))).alias("conversations"))),
        )
        .otherwise(F.to_json(F.struct(F.transform("t", lambda t: F.struct(role(t).alias("role"), text(t).alias("content"))).alias("messages"))))
    )
    return turns.select("conv_id", record.alias("record"))
