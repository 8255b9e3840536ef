"""Chat formatting: typed content parts, a reversible template, a loss mask.

A turn's content is a list of typed parts. A visitor flattens them in order: text is escaped
and written out, an image, audio or document part becomes a placeholder ``<|kind:k|>`` (k: its
place among the turn's attachments) and leaves an attachment reference with the number of
tokens that the placeholder expands to. A turn is written

    ### role: content</turn>

with a line feed. Inside contents a backslash goes before each backslash, ``</turn>``, ``### ``
and ``<|``, inside roles before each backslash, colon, line feed, ``<`` and ``#``; so a turn
can be read back exactly, whatever its text says.

Turns are formatted row by row; a conversation of any length streams through its task, which
keeps digests and no texts.

Edge cases: null text or content -> empty; null role -> empty role; null conv_id -> one
conversation of its own; equal turns are ordered by role, then text; repeated rows are turns
of their own; extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import math
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerline.llm.common import on_workers

TURN_END = "</turn>"
LOSS_ROLE = "assistant"
#: Tokens that attachments expand to.
TILE, TOKENS_A_TILE, TOKENS_AN_IMAGE = 512, 170, 85
TOKENS_A_SECOND, TOKENS_A_PAGE = 25, 256

_ESCAPE = re.compile(r"\\|</turn>|### |<\|")
_ESCAPE_ROLE = re.compile(r"[\\:\n<#]")
_UNESCAPE = re.compile(r"\\(.)", re.S)
_READ = re.compile(r"### ((?:[^\\:]|\\.)*): ((?:[^\\<]|\\.|<(?!/turn>))*)</turn>\n", re.S)
_PLACEHOLDER = re.compile(r"<\|[a-z]+:[0-9]+\|>|\\(.)", re.S)

PART = "struct<type:string,text:string,uri:string,width:int,height:int,seconds:double,pages:int>"


def escape(text: str) -> str:
    return _ESCAPE.sub(lambda m: "\\" + m.group(), text)


class Flatten:
    """Visitor over a turn's parts: ``written`` text, ``attachments`` in order."""

    def __init__(self):
        self.written: list[str] = []
        self.attachments: list[dict] = []

    def visit(self, part: dict) -> None:
        getattr(self, f"visit_{part.get('type') or 'text'}", self.visit_other)(part)

    def visit_text(self, part: dict) -> None:
        self.written.append(escape(part.get("text") or ""))

    def visit_image(self, part: dict) -> None:
        tiles = math.ceil((part.get("width") or TILE) / TILE) * math.ceil((part.get("height") or TILE) / TILE)
        self._attach("image", part, TOKENS_AN_IMAGE + TOKENS_A_TILE * tiles)

    def visit_audio(self, part: dict) -> None:
        self._attach("audio", part, math.ceil((part.get("seconds") or 0.0) * TOKENS_A_SECOND))

    def visit_document(self, part: dict) -> None:
        self._attach("document", part, (part.get("pages") or 0) * TOKENS_A_PAGE)

    def visit_other(self, part: dict) -> None:
        """A part of an unknown kind keeps its place; it expands to no tokens."""
        self._attach("other", part, 0)

    def _attach(self, kind: str, part: dict, tokens: int) -> None:
        self.written.append(f"<|{kind}:{len(self.attachments)}|>")
        self.attachments.append({"kind": kind, "uri": part.get("uri"), "n_tokens": tokens})


def write_turn(role: str | None, parts: list[dict]) -> tuple[str, int, int, list[dict]]:
    """(formatted turn, start and end of its content, attachments)."""
    seen = Flatten()
    for part in parts:
        seen.visit(part)
    head = "### " + _ESCAPE_ROLE.sub(lambda m: "\\" + m.group(), role or "") + ": "
    body = "".join(seen.written)
    return f"{head}{body}{TURN_END}\n", len(head), len(head) + len(body), seen.attachments


def read_turns(formatted: str) -> list[tuple[str, str]]:
    """(role, text) of each turn; placeholders are no text."""
    out, at = [], 0
    while at < len(formatted):
        m = _READ.match(formatted, at)
        if not m:
            raise ValueError(f"no turn at {at}")
        out.append((_UNESCAPE.sub(r"\1", m.group(1)), _PLACEHOLDER.sub(lambda x: x.group(1) or "", m.group(2))))
        at = m.end()
    return out


_ATTACHED = pa.list_(pa.struct([("kind", pa.string()), ("uri", pa.string()), ("n_tokens", pa.int64())]))


def format_turns(turns: DataFrame) -> DataFrame:
    """One row per turn: conv_id, turn, formatted, content_start, content_end, in_loss,
    attachments, n_attached (expanded tokens), and role_key, text_key that order equal turns.

    Contents come from ``parts`` (array of ``PART``) where that column is not null, else from
    ``text``."""
    on_workers(turns.sparkSession)
    parts = F.col("parts").cast(f"array<{PART}>") if "parts" in turns.columns else F.lit(None).cast(f"array<{PART}>")
    d = turns.select(F.col("conv_id").cast("bigint").alias("conv_id"), F.col("turn").cast("bigint").alias("turn"),
                     F.col("role").cast("string").alias("role"), F.col("text").cast("string").alias("text"),
                     parts.alias("parts"))

    def run(batches):
        for batch in batches:
            made, start, end, loss, att, tokens = [], [], [], [], [], []
            for role, text, own in zip(*(batch.column(i).to_pylist() for i in (2, 3, 4))):
                t, x, y, a = write_turn(role, [{"type": "text", "text": text}] if own is None else own)
                made.append(t)
                start.append(x)
                end.append(y)
                loss.append(role == LOSS_ROLE)
                att.append(a)
                tokens.append(sum(k["n_tokens"] for k in a))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(made, pa.string()), pa.array(start, pa.int64()),
                 pa.array(end, pa.int64()), pa.array(loss, pa.bool_()), pa.array(att, _ATTACHED),
                 pa.array(tokens, pa.int64()), batch.column(2), batch.column(3)],
                ["conv_id", "turn", "formatted", "content_start", "content_end", "in_loss", "attachments",
                 "n_attached", "role_key", "text_key"])

    return d.mapInArrow(
        run, "conv_id bigint, turn bigint, formatted string, content_start bigint, content_end bigint, in_loss boolean, "
             "attachments array<struct<kind:string,uri:string,n_tokens:bigint>>, n_attached bigint, role_key string, "
             "text_key string")


def read_back(formatted: DataFrame) -> DataFrame:
    """Digests of each conversation, read from its formatted turns in order."""
    cols = ["conv_id", "turn", "role_key", "text_key"]
    ordered = formatted.select(*cols, "formatted", "content_start", "content_end", "in_loss", "n_attached").repartition(
        "conv_id").sortWithinPartitions(*cols)

    def run(batches):
        now, out = None, []

        def done():
            out.append((now["id"], now["n"], now["turns"].hexdigest(), now["loss"], now["mask"].hexdigest(),
                        now["chars"], now["attached"]))

        for batch in batches:
            for conv, text, a, b, loss, attached in zip(*(batch.column(i).to_pylist() for i in (0, 4, 5, 6, 7, 8))):
                if now is None or now["id"] != conv:
                    if now is not None:
                        done()
                    now = {"id": conv, "n": 0, "turns": hashlib.sha256(), "loss": 0, "mask": hashlib.sha256(),
                           "chars": 0, "attached": 0}
                for role, said in read_turns(text):
                    now["n"] += 1
                    now["turns"].update(f"{role}\n{said}\n".encode())
                if loss:
                    masked = _PLACEHOLDER.sub(lambda x: x.group(1) or "", text[a:b])
                    now["loss"] += len(masked)
                    now["mask"].update(masked.encode())
                now["chars"] += len(text)
                now["attached"] += attached
            if out:
                yield _rows(out)
                out = []
        if now is not None:
            done()
        yield _rows(out)

    return ordered.mapInArrow(run, "conv_id bigint, n_turns bigint, turns_sha256 string, loss_chars bigint, "
                                   "loss_sha256 string, formatted_chars bigint, n_attached bigint")


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars", "n_attached"]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64()]
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names)
