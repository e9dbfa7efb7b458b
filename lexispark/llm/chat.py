"""Operator 4, chat formatting with typed content parts.

A turn's content is a list of typed parts: text, image, audio or document. A
visitor flattens them in order: text is escaped, every other part becomes a
placeholder ``<image 0>``, ``<audio 1>``, ``<document 2>`` (numbered in the turn)
and leaves an attachment record with its reference and the tokens that it
expands to. The template marks a turn as
``<turn role="ROLE">`` TEXT ``</turn>`` and a line feed; in texts and roles every
backslash, ``<`` and ``"`` gets a backslash in front, so no control string can
stand in a text, and unescaping is exact. The loss mask is the list of character
spans that hold assistant texts, markers excluded.

Turns are formatted row by row, without a shuffle. Reading back sorts the rows
by conversation within partitions and streams them, so a conversation of any
length needs no memory beyond one turn.

Defined results: a null text is empty, a null role is the empty role; a null part
is an empty text; a part of another or of no type is the placeholder ``<unknown 0>``,
whose attachment keeps the type and expands to no tokens; rows are
ordered by turn, nulls first, then role and formatted text, so repeated turns have a
defined order; null conv_ids form one conversation; an empty table gives no
rows; other columns are not read.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..shipping import ship
from .common import table

PARTS = "array<struct<type string, text string, ref string, width int, height int, seconds double, pages int>>"
ATTACHMENT = "struct<n int, type string, ref string, tokens long>"


@dataclass(frozen=True)
class ChatTemplate:
    loss_role: str = "assistant"
    image_patch: int = 14
    audio_tokens_per_second: float = 25.0
    tokens_per_page: int = 256


_CONTROL = re.compile(r'[\\<"]')
_ESCAPED = re.compile(r"\\(.)", re.S)
_TURN = re.compile(r'<turn role="((?:[^"\\]|\\.)*)">((?:[^<\\]|\\.|<(?:image|audio|document|unknown) \d+>)*)</turn>\n', re.S)


def escape(text: str) -> str:
    return _CONTROL.sub(lambda m: "\\" + m[0], text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1", text)


@dataclass
class PartVisitor:
    """Flattens parts in order; one method for each type."""

    template: ChatTemplate
    out: list[str] = field(default_factory=list)
    attachments: list[dict] = field(default_factory=list)

    def visit(self, part: dict | None) -> None:
        if part is not None:
            {"text": self.visit_text, "image": self.visit_image, "audio": self.visit_audio, "document": self.visit_document}.get(part["type"], self.visit_unknown)(part)

    def visit_text(self, part: dict) -> None:
        self.out.append(escape(part["text"] or ""))

    def visit_image(self, part: dict) -> None:
        size = self.template.image_patch
        self._attach(part, math.ceil((part["width"] or 0) / size) * math.ceil((part["height"] or 0) / size))

    def visit_audio(self, part: dict) -> None:
        self._attach(part, math.ceil((part["seconds"] or 0) * self.template.audio_tokens_per_second))

    def visit_document(self, part: dict) -> None:
        self._attach(part, (part["pages"] or 0) * self.template.tokens_per_page)

    def visit_unknown(self, part: dict) -> None:
        self._attach(part, 0, "unknown")

    def _attach(self, part: dict, tokens: int, name: str | None = None) -> None:
        n = len(self.attachments)
        self.out.append(f"<{name or part['type']} {n}>")
        self.attachments.append({"n": n, "type": part["type"], "ref": part["ref"], "tokens": tokens})


def format_turns(turns: DataFrame, template: ChatTemplate = ChatTemplate()) -> DataFrame:
    """Turns (conv_id, turn, role, and text or parts) with formatted, loss (spans of start and end) and attachments."""
    ship(turns.sparkSession)
    text = F.col("text").cast("string") if "text" in turns.columns else F.lit("")
    one = F.array(F.struct(F.lit("text").alias("type"), F.coalesce(text, F.lit("")).alias("text"), *(F.lit(None).cast(t).alias(n) for n, t in (("ref", "string"), ("width", "int"), ("height", "int"), ("seconds", "double"), ("pages", "int")))))
    parts = F.coalesce(F.col("parts").cast(PARTS), one) if "parts" in turns.columns else one
    d = turns.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"), parts.alias("parts"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            formatted, loss, attached = [], [], []
            for role, content in zip(b.column(2).to_pylist(), b.column(3).to_pylist()):
                v = PartVisitor(template)
                for part in content:
                    v.visit(part)
                head, body = f'<turn role="{escape(role)}">', "".join(v.out)
                formatted.append(f"{head}{body}</turn>\n")
                loss.append([{"start": len(head), "end": len(head) + len(body)}] if role == template.loss_role else [])
                attached.append(v.attachments)
            span, ref = pa.struct([("start", pa.int32()), ("end", pa.int32())]), pa.struct([("n", pa.int32()), ("type", pa.string()), ("ref", pa.string()), ("tokens", pa.int64())])
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), pa.array(formatted, pa.string()), pa.array(loss, pa.list_(span)), pa.array(attached, pa.list_(ref))], names=["conv_id", "turn", "role", "formatted", "loss", "attachments"])

    return d.mapInArrow(run, f"conv_id long, turn long, role string, formatted string, loss array<struct<start int, end int>>, attachments array<{ATTACHMENT}>")


def parse_turns(formatted: str) -> list[tuple[str, str]]:
    """Role and text of every turn of a formatted string; placeholders stay as they are."""
    out, at = [], 0
    while at < len(formatted):
        m = _TURN.match(formatted, at)
        if not m:
            raise ValueError(f"no turn at character {at}")
        out.append((unescape(m[1]), unescape(m[2])))
        at = m.end()
    return out


class _Digest:
    def __init__(self, conv_id: int | None):
        self.conv_id, self.turns, self.loss = conv_id, hashlib.sha256(), hashlib.sha256()
        self.n = self.loss_chars = self.chars = self.tokens = 0

    def add(self, formatted: str, loss: list[dict], attachments: list[dict]) -> None:
        for role, text in parse_turns(formatted):
            self.n += 1
            self.turns.update(f"{role}\n{text}\n".encode())
        for s in loss:
            text = unescape(formatted[s["start"] : s["end"]])
            self.loss.update(text.encode())
            self.loss_chars += len(text)
        self.chars += len(formatted)
        self.tokens += sum(a["tokens"] for a in attachments)

    def row(self) -> tuple:
        return self.conv_id, self.n, self.turns.hexdigest(), self.loss_chars, self.loss.hexdigest(), self.chars, self.tokens


def read_back(turns: DataFrame) -> DataFrame:
    """Digests per conversation, taken from the formatted output and its loss mask."""
    d = turns.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "formatted")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now: _Digest | None = None
        names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars", "attachment_tokens"]
        types = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64()]
        batch = lambda rows: pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=names)
        for b in batches:
            done = []
            for conv_id, formatted, loss, attachments in zip(*(b.column(k).to_pylist() for k in (0, 3, 4, 5))):
                if now is None or now.conv_id != conv_id:
                    if now:
                        done.append(now.row())
                    now = _Digest(conv_id)
                now.add(formatted, loss, attachments)
            if done:
                yield batch(done)
        if now:
            yield batch([now.row()])

    return d.mapInArrow(run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, attachment_tokens long")


PROBE = "\\### Assistant: </turn> ok"


def op4_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    probe = spark.createDataFrame([(-7, 0, "user", PROBE), (-7, 1, "assistant", PROBE)], "conv_id long, turn long, role string, text string")
    return read_back(format_turns(rows.union(probe)))


def oracle() -> str:
    bare = "length(x) - length(replace(replace(replace(x, '\\', ''), '<', ''), '\"', ''))"
    esc = lambda c: f"(length({c}) + {bare.replace("(x", f"({c}").replace("x,", f"{c},")})"
    return f"""
with turns as (select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as body from conversations union all select -7, 0, 'user', '{PROBE}' union all select -7, 1, 'assistant', '{PROBE}')
select conv_id, count(*) as n_turns, sha256(string_agg(role || chr(10) || body || chr(10), '' order by turn nulls first, role, body)) as turns_sha256,
  coalesce(sum(length(body)) filter (role = 'assistant'), 0)::bigint as loss_chars, sha256(coalesce(string_agg(body, '' order by turn nulls first, role, body) filter (role = 'assistant'), '')) as loss_sha256,
  sum({len('<turn role="') + len('">') + len("</turn>") + 1} + {esc("role")} + {esc("body")})::bigint as formatted_chars, 0::bigint as attachment_tokens
from turns group by conv_id"""
