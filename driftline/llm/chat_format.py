"""Chat formatting: a finite-state machine over roles, and a reader that undoes it.

A template declares, per role, the text before and after a turn, whether its text counts for the loss, and which roles may
follow. Turns become text segments with a loss flag. Inside texts, every character that starts a control string
is followed by a backslash and backslashes are doubled, so that no control string can stand there and the text can
be restored. Turns are streamed in order, so that a conversation of any length needs the memory of one turn.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Turn:
    before: str
    after: str
    loss: bool
    next: tuple[str, ...]


@dataclass(frozen=True)
class Template:
    """``roles`` by name; any other role is written with ``other``, whose {role} is filled in, and is never valid."""

    roles: dict[str, Turn] = field(default_factory=dict)
    first: tuple[str, ...] = ()
    other: Turn = Turn("<<ROLE {role}>>", "<</ROLE>>", False, ())

    def controls(self) -> str:
        """The characters that start control strings: the first that is not blank, or the first blank of a blank string."""
        parts = [p for t in (*self.roles.values(), self.other) for p in (t.before, t.after)]
        return "".join(sorted({p.strip()[0] if p.strip() else p[0] for p in parts if p}))


DEFAULT = Template(
    roles={
        "system": Turn("<<SYS>>", "<</SYS>>", False, ("user",)),
        "user": Turn("[INST] ", " [/INST]", False, ("assistant",)),
        "assistant": Turn("<s>", "</s>", True, ("user",)),
    },
    first=("system", "user"),
)


def escape(text: str, template: Template = DEFAULT) -> str:
    starts = re.escape(template.controls())
    return re.sub(rf"[{starts}\\]", lambda m: m[0] + "\\", text)


def unescape(text: str, template: Template = DEFAULT) -> str:
    starts = re.escape(template.controls())
    return re.sub(rf"([{starts}\\])\\", r"\1", text)


def _format(template: Template):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, allowed, seq = object(), (), 0
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                role, text = row["role"] or "", row["text"] or ""
                if row["conv_id"] != conv:
                    conv, allowed, seq = row["conv_id"], template.first, 0
                turn = template.roles.get(role)
                valid = role in allowed
                if turn is None:
                    turn = Turn(template.other.before.format(role=escape(role, template)), template.other.after, False, allowed)
                allowed = turn.next
                for part, loss in ((turn.before, False), (escape(text, template), turn.loss), (turn.after, False)):
                    out.append({"conv_id": conv, "seq": seq, "turn": row["turn"], "segment": part, "loss": loss, "valid": valid})
                    seq += 1
            yield pa.RecordBatch.from_pylist(out, schema=pa.schema([("conv_id", batch.schema.field("conv_id").type), ("seq", pa.int64()), ("turn", batch.schema.field("turn").type), ("segment", pa.string()), ("loss", pa.bool_()), ("valid", pa.bool_())]))

    return run


def format_chat(conversations: DataFrame, template: Template = DEFAULT) -> DataFrame:
    """(conv_id, seq, turn, segment, loss, valid): three segments a turn, in order of ``seq``.

    ``valid`` tells whether the role may stand at this place; turns out of order are formatted all the same. Null texts and
    roles are empty. Turns with equal numbers are ordered by role and text; null turns come first; a null conversation id is
    one conversation. Repeated rows are turns of their own, texts of any length are read whole, other columns are ignored. An empty
    table gives an empty table.
    """
    own = conversations.select("conv_id", "turn", "role", "text")
    types = {f.name: f.dataType.simpleString() for f in own.schema}
    ordered = own.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    return ordered.mapInArrow(_format(template), f"conv_id {types['conv_id']}, seq long, turn {types['turn']}, segment string, loss boolean, valid boolean")


class _Reader:
    """Reads one conversation's segments, in order, back into turns, and digests them."""

    def __init__(self, template: Template):
        self.all, self.loss, self.held = hashlib.sha256(), hashlib.sha256(), ""
        self.template = template
        self.turns = self.loss_chars = self.chars = 0
        known = [(t.before, t.after, role) for role, t in template.roles.items()]
        lead, end = template.other.before.split("{role}")
        self.patterns = [(re.compile(re.escape(b) + r"(.*?)" + re.escape(a), re.S), role) for b, a, role in known]
        self.other = re.compile(re.escape(lead) + r"(.*?)" + re.escape(end) + r"(.*?)" + re.escape(template.other.after), re.S)

    def add(self, segment: str, loss: bool) -> None:
        self.chars += len(segment)
        if loss:
            text = unescape(segment, self.template)
            self.loss_chars += len(text)
            self.loss.update(text.encode())
        self.held += segment
        while self.held and self.read():
            pass

    def read(self) -> bool:
        """Take one whole turn off the text held; control strings cannot stand inside texts, so the first end is its end."""
        for pattern, role in self.patterns:
            if m := pattern.match(self.held):
                break
        else:
            if not (m := self.other.match(self.held)):
                return False
            role = unescape(m[1], self.template)
        self.held = self.held[m.end() :]
        self.turns += 1
        self.all.update(f"{role}\n{unescape(m[m.lastindex], self.template)}\n".encode())
        return True


def _digest(template: Template):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, reader, kind = None, None, None

        def row() -> pa.RecordBatch:
            if reader.held:
                raise ValueError(f"conversation {conv}: the formatted text cannot be read back")
            cols = ("conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars")
            values = (conv, reader.turns, reader.all.hexdigest(), reader.loss_chars, reader.loss.hexdigest(), reader.chars)
            types = (kind, pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64())
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(values, types)], names=cols)

        for batch in batches:
            kind = batch.schema.field("conv_id").type
            done = []
            for r in batch.to_pylist():
                if reader is None or r["conv_id"] != conv:
                    if reader is not None:
                        done.append(row())
                    conv, reader = r["conv_id"], _Reader(template)
                reader.add(r["segment"], r["loss"])
            if done:
                yield pa.Table.from_batches(done).combine_chunks().to_batches()[0]
        if reader is not None:
            yield row()

    return run


def read_chat(segments: DataFrame, template: Template = DEFAULT) -> DataFrame:
    """Per conversation, from the segments alone: turns read back, their digest, and the text under the loss mask.

    Takes what ``format_chat`` gives: segments are never null, a null conversation id is one conversation. Segments that cannot
    be read back raise an error. An empty table gives an empty table.
    """
    kind = segments.schema["conv_id"].dataType.simpleString()
    ordered = segments.select("conv_id", "seq", "segment", "loss").repartition("conv_id").sortWithinPartitions("conv_id", "seq")
    return ordered.mapInArrow(_digest(template), f"conv_id {kind}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
