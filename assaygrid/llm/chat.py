"""Chat formatting of typed content parts.

A turn's content is a list of typed parts. A visitor flattens them in order: text is escaped, and an
image, audio or document part becomes a numbered placeholder, with its reference and the tokens it will
expand to kept. The template is

    ### role:
    content
    </turn>

where content never holds a bare control string: a backslash stands before each backslash, "#" and "<"
of a text, so that texts read back as they were. The loss mask covers the content of the roles that are
trained on. A row is a turn: conversations of any length need not fit a task, and their pieces joined in
order are the formatted conversation.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from assaygrid.llm.tables import arrow_batches

# The template.
OPEN, AFTER_ROLE, CLOSE = "### ", ":\n", "\n</turn>\n"
_ESCAPE = re.compile(r"[\\#<]")
_ROLE_ESCAPE = re.compile(r"[\\#<:\n]")
_UNESCAPE = re.compile(r"\\(.)", re.S)
_PLACEHOLDER = r"<(?:image|audio|document):\d+>"
_HEAD = re.compile(r"### ((?:[^\\:\n]|\\.)*+):\n", re.S)
_CONTENT = re.compile(rf"(?:[^\\#<]++|\\.|{_PLACEHOLDER})*+", re.S)


def escape(text: str) -> str:
    return _ESCAPE.sub(r"\\\g<0>", text)


def unescape(text: str) -> str:
    return _UNESCAPE.sub(r"\1", text)


def escape_role(role: str) -> str:
    return _ROLE_ESCAPE.sub(lambda m: "\\n" if m[0] == "\n" else "\\" + m[0], role)


def unescape_role(role: str) -> str:
    return _UNESCAPE.sub(lambda m: "\n" if m[1] == "n" else m[1], role)


@dataclass
class Expansion:
    """Tokens that parts expand to: an image's patches, audio by the second, a document by the page, text by characters."""

    patch: int = 28
    audio_rate: float = 12.5
    page_tokens: int = 512
    chars_per_token: float = 4.0


@dataclass
class Flatten:
    """Visits the parts of a turn in order."""

    rule: Expansion
    content: list[str] = field(default_factory=list)
    attachments: list[dict] = field(default_factory=list)
    tokens: int = 0

    def visit(self, part: dict) -> None:
        kind = part.get("type") or "text"
        getattr(self, f"visit_{kind}", self.visit_other)(part)

    def visit_text(self, part: dict) -> None:
        text = part.get("text") or ""
        self.content.append(escape(text))
        self.tokens += math.ceil(len(text) / self.rule.chars_per_token)

    def visit_image(self, part: dict) -> None:
        patches = math.ceil((part.get("width") or 0) / self.rule.patch) * math.ceil((part.get("height") or 0) / self.rule.patch)
        self._attach("image", part, max(1, patches))

    def visit_audio(self, part: dict) -> None:
        self._attach("audio", part, max(1, math.ceil((part.get("seconds") or 0) * self.rule.audio_rate)))

    def visit_document(self, part: dict) -> None:
        self._attach("document", part, max(1, part.get("pages") or 1) * self.rule.page_tokens)

    def visit_other(self, part: dict) -> None:
        raise ValueError(f"no such part type: {part.get('type')}")

    def _attach(self, kind: str, part: dict, tokens: int) -> None:
        self.attachments.append({"kind": kind, "uri": part.get("uri"), "tokens": tokens})
        self.content.append(f"<{kind}:{len(self.attachments)}>")
        self.tokens += tokens


def format_turn(role: str, parts: list[dict], trained: frozenset[str], rule: Expansion) -> dict:
    flat = Flatten(rule)
    for part in parts:
        flat.visit(part)
    content = "".join(flat.content)
    head = OPEN + escape_role(role) + AFTER_ROLE
    start = len(head)
    end = start + len(content) if role in trained else start
    return {"formatted": head + content + CLOSE, "loss_start": start, "loss_end": end, "attachments": flat.attachments, "n_tokens": flat.tokens}


def read_turn(formatted: str) -> tuple[str, str]:
    """Role and text (placeholders left in it) of a formatted turn."""
    head = _HEAD.match(formatted)
    if head is None or not formatted.endswith(CLOSE) or not _CONTENT.fullmatch(content := formatted[head.end() : len(formatted) - len(CLOSE)]):
        raise ValueError("not a formatted turn")
    return unescape_role(head[1]), unescape(content)


ATTACHMENTS = "array<struct<kind:string,uri:string,tokens:long>>"


def format_turns(rows: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", content: str = "text", trained: tuple[str, ...] = ("assistant",), rule: Expansion | None = None) -> DataFrame:
    """conv_id, turn, formatted, loss_start, loss_end, attachments and n_tokens of each row.

    content: a string (one text part), or array<struct<type, text, uri, width, height, seconds, pages>>
    (fields that a part does not need may be missing; a type other than text, image, audio or document
    fails). loss_start and loss_end are code points of formatted, equal where nothing is trained on.
    Null content, parts and roles: empty. Null conv_ids and turns are kept. Repeated rows are each
    formatted; other columns are dropped. An empty table gives an empty result.
    """
    arrow_batches(rows.sparkSession)
    rule, roles = rule or Expansion(), frozenset(trained)
    base = rows.select(F.col(conv_id).alias("conv_id"), F.col(turn).alias("turn"), F.col(role).cast("string").alias("role"), F.col(content).alias("content"))
    plain = isinstance(base.schema["content"].dataType, T.StringType)
    kinds = T._parse_datatype_string(f"formatted string, loss_start int, loss_end int, attachments {ATTACHMENTS}, n_tokens long")
    schema = T.StructType([base.schema["conv_id"], base.schema["turn"], *kinds])
    attached = pa.list_(pa.struct([("kind", pa.string()), ("uri", pa.string()), ("tokens", pa.int64())]))

    def formatted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            contents = batch.column(3).to_pylist()
            parts = [[{"type": "text", "text": c}] for c in contents] if plain else [[p for p in c or [] if p is not None] for c in contents]
            done = [format_turn(r or "", p, roles, rule) for r, p in zip(batch.column(2).to_pylist(), parts, strict=True)]
            made = [pa.array([d[n] for d in done], t) for n, t in (("formatted", pa.string()), ("loss_start", pa.int32()), ("loss_end", pa.int32()), ("attachments", attached), ("n_tokens", pa.int64()))]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *made], schema.names)

    return base.mapInArrow(formatted, schema)


def read_back(turns: DataFrame) -> DataFrame:
    """Of rows of format_turns, read from their formatted text: conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars.

    turns_sha256: of role, line end, text, line end for each turn in order; loss_sha256: of all text
    under the mask, unescaped. Turns are in order of turn (null first), equal ones of their formatted text. A
    conversation is read in one pass in a task, with two running digests (SHA-256 has no other way), holding
    one batch at a time. Null conv_ids are one conversation.
    """
    arrow_batches(turns.sparkSession)
    kind = turns.schema["conv_id"]
    schema = T.StructType([kind, *T._parse_datatype_string("n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")])
    ordered = turns.select("conv_id", "turn", "formatted", "loss_start", "loss_end").repartition("conv_id").sortWithinPartitions("conv_id", "turn", "formatted")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_id, state, kind = None, None, None
        done: list[tuple] = []
        for batch in batches:
            kind = batch.column(0).type
            for conv, formatted, a, b in zip(*(batch.column(i).to_pylist() for i in (0, 2, 3, 4)), strict=True):
                if state is None or conv != open_id:
                    if state is not None:
                        done.append((open_id, *state.close()))
                    open_id, state = conv, Digests()
                state.add(formatted, a, b)
            if len(done) > 1000:
                yield table(done, kind)
                done = []
        if state is not None:
            done.append((open_id, *state.close()))
        if done:
            yield table(done, kind)

    def table(done: list[tuple], kind: pa.DataType) -> pa.RecordBatch:
        kinds = [kind, pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*done, strict=True), kinds, strict=True)], schema.names)

    return ordered.mapInArrow(read, schema)


class Digests:
    def __init__(self):
        self.turns, self.loss = hashlib.sha256(), hashlib.sha256()
        self.n, self.loss_chars, self.chars = 0, 0, 0

    def add(self, formatted: str, start: int, end: int) -> None:
        role, text = read_turn(formatted)
        self.turns.update(f"{role}\n{text}\n".encode())
        masked = unescape(formatted[start:end])
        self.loss.update(masked.encode())
        self.n, self.loss_chars, self.chars = self.n + 1, self.loss_chars + len(masked), self.chars + len(formatted)

    def close(self) -> tuple:
        return self.n, self.turns.hexdigest(), self.loss_chars, self.loss.hexdigest(), self.chars
