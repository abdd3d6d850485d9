"""Chat formatting: typed content parts, flattened by a visitor, in a template that can be read back.

A turn's content is a string (one text part) or an array of parts
``struct<kind:string, text:string, ref:string, units:int>``. A visitor flattens the parts in order: text is escaped, an
image, audio or document part becomes an ordered placeholder ``<|image 0|>`` and leaves an attachment
``struct<ordinal, kind, ref, tokens>``; its tokens are what ``units`` (image tiles, audio seconds, document pages)
expand to. Parts of other kinds are read as text.

Template: ``<|role|>\\n`` + content + ``<|end|>\\n`` for every turn. Every control string starts with ``<|``; in texts
and roles ``<`` becomes ``\\l`` and ``\\`` becomes ``\\\\``, so no text can hold a control string and unescaping gives
it back exactly. Texts of assistant turns are under the loss mask; roles, marks and placeholders aren't.

Turns come in order of turn, role, then content; the rows of a conversation are sorted by the shuffle and streamed, so
a conversation isn't held whole. It is one task's all the same, as its order and its digests want it: a table with one
conversation is formatted by one task, in bounded memory. Conversation ids may be of any type that can be sorted. Defined results: a null text or role is empty; a null turn comes first; a null
conversation id is a conversation; repeated rows are turns of their own; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Tokens that a unit of an attachment expands to, and those that each attachment costs besides.
EXPANSION = {"image": (256, 2), "audio": (25, 2), "document": (512, 4)}
PART = "struct<kind:string,text:string,ref:string,units:int>"
_TURN = re.compile(r"<\|([^|]*)\|>\n([^<]*(?:<\|(?:image|audio|document) \d+\|>[^<]*)*)<\|end\|>\n")
_PLACE = re.compile(r"<\|(?:image|audio|document) \d+\|>")


def escape(text: str) -> str:
    return text.replace("\\", "\\\\").replace("<", "\\l")


def escape_role(role: str) -> str:
    return escape(role).replace("|", "\\p")


_BACK = {"\\\\": "\\", "\\l": "<", "\\p": "|"}


def unescape(text: str) -> str:
    return re.sub(r"\\[\\lp]", lambda m: _BACK[m[0]], text)


class Flattener:
    """Visits the parts of one conversation's turns in order."""

    def __init__(self):
        self.attachments: list[dict] = []

    def visit(self, part: dict) -> str:
        return getattr(self, f"visit_{part['kind']}", self.visit_text)(part)

    def visit_text(self, part: dict) -> str:
        return escape(part["text"] or "")

    def _attach(self, part: dict) -> str:
        a_unit, fixed = EXPANSION[part["kind"]]
        n = len(self.attachments)
        self.attachments.append({"ordinal": n, "kind": part["kind"], "ref": part["ref"], "tokens": a_unit * max(part["units"] or 1, 1) + fixed})
        return f"<|{part['kind']} {n}|>"

    visit_image = visit_audio = visit_document = _attach

    def turn(self, role: str | None, content: str | list | None) -> str:
        parts = content if isinstance(content, list) else [{"kind": "text", "text": content}]
        return f"<|{escape_role(role or '')}|>\n{''.join(self.visit(p) for p in parts if p)}<|end|>\n"


def read_turns(formatted: str) -> Iterator[tuple[str, list[tuple[int, int]], str]]:
    """From the output alone: role, the spans of the turn's text in it, and the text unescaped, placeholders left out."""
    at = 0
    for m in _TURN.finditer(formatted):
        if m.start() != at:
            raise ValueError(f"no turn at {at}")
        at, spans, lo = m.end(), [], m.start(2)
        for p in _PLACE.finditer(formatted, m.start(2), m.end(2)):
            spans.append((lo, p.start()))
            lo = p.end()
        spans.append((lo, m.end(2)))
        yield unescape(m[1]), [s for s in spans if s[0] < s[1]], "".join(unescape(formatted[a:b]) for a, b in spans)
    if at != len(formatted):
        raise ValueError(f"no turn at {at}")


def format_turns(turns: DataFrame, content: str = "text") -> DataFrame:
    """A row per turn of ``turns`` (``conv_id, turn, role`` and the content), in order within a conversation and
    task: ``conv_id, ordinal, formatted, loss_spans`` (code points in ``formatted``) and ``attachments``."""
    key = turns.schema["conv_id"].dataType.simpleString()
    out = T.StructType.fromDDL(f"conv_id {key}, ordinal long, formatted string, loss_spans array<struct<start:int,end:int>>, attachments array<struct<ordinal:int,kind:string,ref:string,tokens:int>>")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = None
        now, n, flattener = object(), 0, Flattener()
        for batch in batches:
            from pyspark.sql.pandas.types import to_arrow_schema

            schema = schema or to_arrow_schema(out)
            rows = []
            for row in batch.to_pylist():
                if row["conv_id"] != now:
                    now, n, flattener = row["conv_id"], 0, Flattener()
                before = len(flattener.attachments)
                said = flattener.turn(row["role"], row["content"])
                ((role, spans, _),) = read_turns(said)
                loss = [{"start": a, "end": b} for a, b in spans] if role == "assistant" else []
                rows.append({"conv_id": now, "ordinal": n, "formatted": said, "loss_spans": loss, "attachments": flattener.attachments[before:]})
                n += 1
            yield pa.RecordBatch.from_pylist(rows, schema=schema)

    return sorted_turns(turns, content).mapInArrow(run, out)


def sorted_turns(turns: DataFrame, content: str = "text") -> DataFrame:
    rows = turns.select("conv_id", "turn", "role", F.col(content).alias("content"))
    order = [F.col(c).asc_nulls_first() for c in ("conv_id", "turn", "role")]
    return rows.repartition("conv_id").sortWithinPartitions(*order, F.col("content").asc_nulls_first())


def read_back(formatted: DataFrame) -> DataFrame:
    """Digests per conversation, read from the formatted text and its loss mask alone: ``conv_id, n_turns,
    turns_sha256, loss_chars, loss_sha256, formatted_chars``. ``formatted`` comes straight from :func:`format_turns`."""
    key = formatted.schema["conv_id"].dataType.simpleString()
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]

    from pyspark.sql.pandas.types import to_arrow_type

    kind = to_arrow_type(formatted.schema["conv_id"].dataType)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, open_ = None, None

        def row(x) -> list:
            return [now, x[0], x[1].hexdigest(), x[2], x[3].hexdigest(), x[4]]

        for batch in batches:
            done = []
            for conv, said, mask in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "formatted", "loss_spans")), strict=True):
                if open_ is None or conv != now:
                    done += [row(open_)] if open_ else []
                    now, open_ = conv, [0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                for role, _, text in read_turns(said):
                    open_[0] += 1
                    open_[1].update(f"{role}\n{text}\n".encode("utf-8", "surrogatepass"))
                for span in mask:
                    loss = unescape(said[span["start"] : span["end"]])
                    open_[2] += len(loss)
                    open_[3].update(loss.encode("utf-8", "surrogatepass"))
                open_[4] += len(said)
            if done:
                yield _batch(done)
        if open_:
            yield _batch([row(open_)])

    def _batch(rows: list) -> pa.RecordBatch:
        schema = pa.schema([("conv_id", kind)] + [(n, pa.string() if n.endswith("sha256") else pa.int64()) for n in names[1:]])
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

    return formatted.mapInArrow(run, f"conv_id {key}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
