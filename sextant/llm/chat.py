"""Conversations to training text, by way of typed content parts.

A turn's content is a list of parts: text, image, audio or document, and a document may hold parts of its own. A
visitor flattens them in order. Text is escaped and stands in the output as it is; any other part leaves a
placeholder there and an attachment, which records the part's reference, the place of the placeholder and the
number of tokens that a model's front end will put in its place.

The template, with text as escaped:

    system     <<SYS>>text<</SYS>>
    user       [INST]text[/INST]
    assistant  <|assistant|>text</s>
    any other  <|role|>role<|text|>text<|end|>

A control string in a text gets a backslash before it, as does a backslash, so that markers can be told from text
and the text comes back whole.
"""

from __future__ import annotations

import hashlib
import math
import re
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import BATCH_BYTES, scratch_dir, tidy

LEAF = "kind:string,text:string,uri:string,width:int,height:int,seconds:double,pages:int"
PARTS = f"array<struct<{LEAF},parts:array<struct<{LEAF}>>>>"
KINDS = ("text", "image", "audio", "document")

#: The markers of the template, by role: (before the text, after it).
MARKS = {"system": ("<<SYS>>", "<</SYS>>"), "user": ("[INST]", "[/INST]"), "assistant": ("<|assistant|>", "</s>")}
OTHER = ("<|role|>", "<|text|>", "<|end|>")
_PLACE = r"<\|[a-z_]+(?::[0-9]+)?\|>"
CONTROL = re.compile(rf"</?s>|\[/?INST\]|<</?SYS>>|{_PLACE}")
_ESCAPED = re.compile(rf"\\|{CONTROL.pattern}")
_TOKEN = re.compile(rf"\\(.)|({CONTROL.pattern})", re.DOTALL)


def escape(text: str) -> str:
    return _ESCAPED.sub(lambda m: "\\" + m[0], text)


def unescape(text: str) -> str:
    return re.sub(r"\\(.)", r"\1", text, flags=re.DOTALL)


@dataclass(frozen=True)
class Expansion:
    """How many tokens a part becomes: an image by its patches, audio by time, a document by pages; what is unknown counts once."""

    patch: int = 28
    audio_per_second: float = 25.0
    document_page: int = 512

    def image(self, part: dict) -> int:
        return math.ceil((part.get("width") or 1) / self.patch) * math.ceil((part.get("height") or 1) / self.patch)

    def audio(self, part: dict) -> int:
        return max(1, math.ceil((part.get("seconds") or 0) * self.audio_per_second))

    def document(self, part: dict) -> int:
        return max(1, part.get("pages") or 1) * self.document_page


@dataclass
class Flattener:
    """Visits the parts of one turn in order; ``kind`` picks the method."""

    expansion: Expansion
    at: int = 0
    out: list[str] = field(default_factory=list)
    texts: list[tuple[int, int]] = field(default_factory=list)
    attachments: list[dict] = field(default_factory=list)

    def visit(self, part: dict | None) -> None:
        """A part that is null is skipped; one of an unknown kind is text if it has any, else a document."""
        if part is None:
            return
        kind = part.get("kind") if part.get("kind") in KINDS else "text" if part.get("text") is not None else "document"
        getattr(self, f"visit_{kind}")(part)

    def put(self, text: str) -> None:
        self.out.append(text)
        self.at += len(text)

    def visit_text(self, part: dict) -> None:
        """Text right behind other text starts escaped, so that the two don't make a control string together."""
        began, text = self.at, escape(part.get("text") or "")
        if text and self.texts and self.texts[-1][1] == began and not text.startswith("\\"):
            text = "\\" + text
        self.put(text)
        self.texts.append((began, self.at))

    def visit_image(self, part: dict) -> None:
        self.attach("image", part, self.expansion.image(part))

    def visit_audio(self, part: dict) -> None:
        self.attach("audio", part, self.expansion.audio(part))

    def visit_document(self, part: dict) -> None:
        """A document with parts is its placeholder and then they; their tokens are its tokens, so it has none of its own."""
        inner = part.get("parts") or []
        self.attach("document", part, 0 if inner else self.expansion.document(part))
        for p in inner:
            self.visit(p)

    def attach(self, kind: str, part: dict, tokens: int) -> None:
        self.attachments.append({"kind": kind, "uri": part.get("uri"), "at": self.at, "tokens": tokens})
        self.put(f"<|{kind}:{len(self.attachments) - 1}|>")


def format_turn(role: str, parts: list[dict] | None, expansion: Expansion) -> tuple[str, list[tuple[int, int]], list[dict]]:
    """(formatted turn, spans under the loss, attachments); places are code points of the turn."""
    flat = Flattener(expansion)
    head, tail = MARKS.get(role) or (f"{OTHER[0]}{escape(role)}{OTHER[1]}", OTHER[2])
    flat.put(head)
    for part in parts or []:
        flat.visit(part)
    flat.put(tail)
    return "".join(flat.out), flat.texts if role == "assistant" else [], flat.attachments


SEGMENTS = """conv_id long, task int, place long, first_turn long, n_turns long, formatted string, loss array<struct<lo:long,hi:long>>,
 attachments array<struct<turn:long,number:int,kind:string,uri:string,at:long,tokens:long>>, expanded_tokens long"""
_ARROW = pa.schema([
    ("conv_id", pa.int64()), ("task", pa.int32()), ("place", pa.int64()), ("first_turn", pa.int64()), ("n_turns", pa.int64()), ("formatted", pa.string()), ("loss", pa.list_(pa.struct([("lo", pa.int64()), ("hi", pa.int64())]))),
    ("attachments", pa.list_(pa.struct([("turn", pa.int64()), ("number", pa.int32()), ("kind", pa.string()), ("uri", pa.string()), ("at", pa.int64()), ("tokens", pa.int64())]))), ("expanded_tokens", pa.int64()),
])


def _segments(expansion: Expansion, limit: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, place = TaskContext.get().partitionId(), 0
        now: dict | None = None
        done, size = [], 0

        def close() -> None:
            nonlocal now, size
            if now is not None:
                text = "".join(now.pop("texts"))
                done.append(now | {"formatted": text, "expanded_tokens": sum(a["tokens"] for a in now["attachments"])})
                size += len(text)
                now = None

        for b in batches:
            for lo in range(0, b.num_rows, 256):
                for row in b.slice(lo, 256).to_pylist():
                    if now is not None and (now["conv_id"] != row["conv_id"] or now["at"] >= limit):
                        close()
                    if now is None:
                        now = {"conv_id": row["conv_id"], "task": task, "place": place, "first_turn": row["turn"], "n_turns": 0, "at": 0, "texts": [], "loss": [], "attachments": []}
                        place += 1
                    text, loss, attached = format_turn(row["role"], row["parts"], expansion)
                    began = now["at"]
                    now["texts"].append(text)
                    now["loss"] += [{"lo": began + x, "hi": began + y} for x, y in loss]
                    now["attachments"] += [a | {"turn": row["turn"], "number": i, "at": began + a["at"]} for i, a in enumerate(attached)]
                    now["at"] += len(text)
                    now["n_turns"] += 1
                if size >= limit:
                    yield pa.RecordBatch.from_pylist(done, schema=_ARROW)
                    done, size = [], 0
        close()
        if done:
            yield pa.RecordBatch.from_pylist(done, schema=_ARROW)

    return tidy(run)


def format_chats(turns: DataFrame, *, parts: str | None = None, expansion: Expansion = Expansion(), segment_chars: int = 1 << 20) -> DataFrame:
    """Formatted conversations in segments, one row each, in the columns of SEGMENTS.

    ``turns`` has conv_id, turn, role, and text or a column of typed content named by ``parts`` (PARTS). A conversation is its
    segments by (task, place), put behind each other: whole turns, of about ``segment_chars`` characters unless one turn is longer.
    ``loss`` and ``attachments`` give places in the segment, ``at`` being the placeholder's.

    Turns go by (turn, role, content), nulls first; a null text or list is empty, a null role is ''. Repeated rows are turns of
    their own, a null conv_id is a conversation. An empty table gives no rows; other columns are not read. Turns are dealt by ranges
    of that order, so that a huge conversation is spread over tasks, and no task holds more than a segment and a batch.
    """
    content = F.col(f"`{parts}`").cast(PARTS) if parts else F.array(F.struct(F.lit("text").alias("kind"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")))
    rows = turns.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"), content.alias("parts"))
    order = ["conv_id", "turn", "role", F.to_json("parts") if parts else F.col("parts")[0]["text"]]
    return rows.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(_segments(expansion, segment_chars), SEGMENTS)


def write_chats(turns: DataFrame, path: str, **how) -> None:
    """``format_chats`` as Parquet at ``path``."""
    spark = turns.sparkSession
    before = spark.conf.get(BATCH_BYTES)
    spark.conf.set(BATCH_BYTES, "4m")
    try:
        format_chats(turns, **how).write.parquet(path)
    finally:
        spark.conf.set(BATCH_BYTES, before)


def read_turns(formatted: str) -> Iterator[tuple[str, str]]:
    """(role, text) of each turn of a formatted segment, without its placeholders."""
    role, ends, text = "", None, []
    by_mark = {head: (r, tail) for r, (head, tail) in MARKS.items()}
    at = 0
    for m in _TOKEN.finditer(formatted):
        if ends is not None:
            text.append(formatted[at : m.start()])
        elif m.start() != at:
            raise ValueError(f"text between turns at {at}")
        at = m.end()
        mark = m[2]
        if mark is None and ends is not None:
            text.append(m[1])
        elif mark is None:
            raise ValueError(f"text between turns at {m.start()}")
        elif ends is None and mark in by_mark:
            role, ends = by_mark[mark]
        elif ends is None and mark == OTHER[0]:
            ends = OTHER[1]
        elif ends == mark == OTHER[1]:
            role, ends, text = "".join(text), OTHER[2], []
        elif mark == ends:
            yield role, "".join(text)
            ends, text = None, []
        elif not re.fullmatch(r"<\|(image|audio|document):[0-9]+\|>", mark):
            raise ValueError(f"{mark} at {m.start()} belongs to no turn")
    if ends is not None or at != len(formatted):
        raise ValueError("the last turn does not end")


DIGESTS = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = [x.split()[0] for x in DIGESTS.split(", ")]
    done: list[tuple] = []
    now: list | None = None

    def close() -> None:
        if now is not None:
            done.append((now[0], now[1], now[2].hexdigest(), now[3], now[4].hexdigest(), now[5]))

    def table() -> pa.RecordBatch:
        types = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
        return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*done, strict=True), types, strict=True)], names)

    for b in batches:
        for lo in range(0, b.num_rows, 64):
            for row in b.slice(lo, 64).to_pylist():
                if now is None or now[0] != row["conv_id"]:
                    close()
                    now = [row["conv_id"], 0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                for role, text in read_turns(row["formatted"]):
                    now[1] += 1
                    now[2].update(f"{role}\n{text}\n".encode())
                for s in row["loss"]:
                    text = unescape(row["formatted"][s["lo"] : s["hi"]])
                    now[3] += len(text)
                    now[4].update(text.encode())
                now[5] += len(row["formatted"])
            if len(done) >= 1_000:
                yield table()
                done = []
    close()
    if done:
        yield table()


def digest_chats(spark: SparkSession, path: str) -> DataFrame:
    """A row a conversation from the written segments: its turns and the text under the loss, read back and hashed as they stream by."""
    rows = spark.read.schema(SEGMENTS).parquet(path).select("conv_id", "task", "place", "formatted", "loss")
    return rows.repartition("conv_id").sortWithinPartitions("conv_id", "task", "place").mapInArrow(tidy(_digest), DIGESTS)


def formatted_digests(spark: SparkSession, turns: DataFrame, **how) -> DataFrame:
    """Write ``turns`` as formatted text, read it back, digest it."""
    path = f"{scratch_dir(spark)}/chat-{uuid.uuid4().hex}"
    write_chats(turns, path, **how)
    return digest_chats(spark, path)
