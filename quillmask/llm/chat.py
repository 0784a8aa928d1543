"""Chat formatting: turns of typed content parts become marked text with a loss mask, and can be read back from it.

A turn is written as START + role + newline + content + END + newline. A visitor flattens the parts of a turn in their
order: text is escaped, images, audio and documents leave a placeholder and are recorded with their place and the number
of tokens they expand to. Formatting needs no shuffle: each turn is a piece of its conversation's text, and pieces in turn
order make up the whole. Reading back sorts the pieces of a conversation within a partition and streams over them, so a
conversation of any length takes bounded memory.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .stream import tidy

START, END = "<|im_start|>", "<|im_end|>"
PARTS = "array<struct<kind:string,text:string,ref:string,width:int,height:int,seconds:double,pages:int>>"
_OPEN = re.compile(r"<(\\*)\|")
_SHUT = re.compile(r"<\\(\\*)\|")


def escape(text: str) -> str:
    """A backslash more between every "<" and "|" that only backslashes part, so that no control string is left."""
    return _OPEN.sub(r"<\\\1|", text)


def unescape(text: str) -> str:
    return _SHUT.sub(r"<\1|", text)


def escape_role(role: str) -> str:
    return escape(role.replace("\\", "\\\\").replace("\n", "\\n"))


def unescape_role(role: str) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], unescape(role))


class Flattener:
    """Visits the parts of one turn; text, attachments (kind, ref, place in code points, tokens) and tokens build up."""

    def __init__(self, patch: int = 28, audio_rate: float = 25.0, page_tokens: int = 512):
        self.patch, self.audio_rate, self.page_tokens = patch, audio_rate, page_tokens
        self.out: list[str] = []
        self.at = 0
        self.attachments: list[dict] = []

    def visit(self, part: dict | None) -> None:
        if part is None:
            return
        getattr(self, f"visit_{part.get('kind')}", self.visit_other)(part)

    def _put(self, text: str) -> None:
        self.out.append(text)
        self.at += len(text)

    def _attach(self, kind: str, part: dict, tokens: int) -> None:
        self.attachments.append({"kind": kind, "ref": part.get("ref"), "place": self.at, "n_tokens": max(1, tokens)})
        self._put(f"<|{kind}|>")

    def visit_text(self, part: dict) -> None:
        self._put(escape(part.get("text") or ""))

    def visit_image(self, part: dict) -> None:
        self._attach("image", part, -(-(part.get("width") or 0) // self.patch) * -(-(part.get("height") or 0) // self.patch))

    def visit_audio(self, part: dict) -> None:
        self._attach("audio", part, round((part.get("seconds") or 0) * self.audio_rate))

    def visit_document(self, part: dict) -> None:
        self._attach("document", part, (part.get("pages") or 0) * self.page_tokens)

    def visit_other(self, part: dict) -> None:
        raise ValueError(f"unknown kind of content part: {part.get('kind')!r}")


def format_turn(role: str | None, content: str | list[dict] | None, learn: frozenset[str]) -> dict:
    """One turn as marked text; places and the loss span count code points of it."""
    head = f"{START}{escape_role(role or '')}\n"
    visitor = Flattener()
    visitor.at = len(head)
    for part in [{"kind": "text", "text": content}] if content is None or isinstance(content, str) else content:
        visitor.visit(part)
    body = "".join(visitor.out)
    return {"formatted": f"{head}{body}{END}\n", "loss_start": len(head), "loss_chars": len(body) if role in learn else 0,
            "attachments": visitor.attachments, "expanded_tokens": sum(x["n_tokens"] for x in visitor.attachments)}


_ATTACHMENT = T.StructType([T.StructField(n, t) for n, t in (("kind", T.StringType()), ("ref", T.StringType()), ("place", T.IntegerType()), ("n_tokens", T.IntegerType()))])
_ADDED = [("formatted", T.StringType()), ("loss_start", T.IntegerType()), ("loss_chars", T.IntegerType()), ("attachments", T.ArrayType(_ATTACHMENT)), ("expanded_tokens", T.IntegerType())]
_ARROW = [pa.string(), pa.int32(), pa.int32(), pa.list_(pa.struct([("kind", pa.string()), ("ref", pa.string()), ("place", pa.int32()), ("n_tokens", pa.int32())])), pa.int32()]


def _format(batches: Iterator[pa.RecordBatch], role_at: int, content_at: int, learn: frozenset[str], names: list[str]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = [format_turn(r, c, learn) for r, c in zip(batch.column(role_at).to_pylist(), batch.column(content_at).to_pylist(), strict=True)]
        added = [pa.array([r[n] for r in rows], t) for (n, _), t in zip(_ADDED, _ARROW, strict=True)]
        yield pa.RecordBatch.from_arrays([*batch.columns, *added], names)


def format_chats(turns: DataFrame, role_col: str = "role", content_col: str = "text", learn: tuple[str, ...] = ("assistant",)) -> DataFrame:
    """turns with formatted (the turn's piece of its conversation's text), loss_start and loss_chars (the span of it that is
    learned: the content of turns whose role is in learn), attachments and expanded_tokens.

    content_col is a string or an array of parts (PARTS; kinds text, image, audio, document). Null content, null parts and null
    texts are empty, a null role is the empty role, an unknown kind raises an error. Rows are independent of each other; an empty
    table gives an empty one. A column that has the name of a result is refused with a ValueError."""
    clash = {n for n, _ in _ADDED} & set(turns.columns)
    if clash:
        raise ValueError(f"columns {sorted(clash)} would be overwritten")
    schema = T.StructType([*turns.schema.fields, *(T.StructField(n, t) for n, t in _ADDED)])
    at = turns.columns.index
    return turns.mapInArrow(tidy(_format, role_at=at(role_col), content_at=at(content_col), learn=frozenset(learn), names=schema.names), schema)


def read_turns(formatted: str) -> Iterator[tuple[str, str]]:
    """(role, content) of the turns in marked text; placeholders of attachments stay in the content."""
    at = 0
    while at < len(formatted):
        if not formatted.startswith(START, at):
            raise ValueError(f"no turn begins at {at}")
        line = formatted.index("\n", at)
        end = formatted.index(END, line)
        if formatted[end + len(END)] != "\n":
            raise ValueError(f"no line ends at {end}")
        yield unescape_role(formatted[at + len(START) : line]), unescape(formatted[line + 1 : end])
        at = end + len(END) + 1


class _Digest:
    def __init__(self):
        self.turns = self.loss = self.size = 0
        self.all, self.learned = hashlib.sha256(), hashlib.sha256()

    def add(self, formatted: str, start: int, count: int) -> None:
        self.size += len(formatted)
        learned = unescape(formatted[start : start + count])
        self.loss += len(learned)
        self.learned.update(learned.encode())
        for role, text in read_turns(formatted):
            self.turns += 1
            self.all.update(f"{role}\n{text}\n".encode())


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Over pieces sorted by conversation: one digest row at the end of each."""
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
    now, state = None, None
    row = lambda: (now, state.turns, state.all.hexdigest(), state.loss, state.learned.hexdigest(), state.size)
    for batch in batches:
        done = []
        for conv, text, start, count in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if state is None or conv != now:
                if state is not None:
                    done.append(row())
                now, state = conv, _Digest()
            state.add(text, start, count)
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in done], t) for i, t in enumerate(kinds)], names)
    if state is not None:
        yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(row(), kinds, strict=True)], names)


def chat_digests(pieces: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn") -> DataFrame:
    """One row per conversation, read back from the pieces that format_chats made: conv_id, n_turns, turns_sha256 (role,
    newline, text, newline per turn), loss_chars and loss_sha256 (all text under the loss mask, unescaped), formatted_chars.

    Turns that share a number are ordered by their piece; null turns come first; a null conversation is one of its own."""
    rows = pieces.select(F.col(conv_col).cast("long").alias("conv_id"), F.col(turn_col).alias("turn"), "formatted", "loss_start", "loss_chars")
    rows = rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "formatted").drop("turn")
    return rows.mapInArrow(tidy(_digests), "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
