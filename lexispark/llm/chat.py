"""Chat formatting with typed content parts.

A message's content is a list of parts: text, image, audio or document. A
visitor flattens them in order: text as itself, the others as placeholders
``<|kind:n|>`` with an attachment reference and the number of tokens the
placeholder expands to. Turns are marked ``<|im_start|>role\\n ... <|im_end|>\\n``.

Control strings inside texts are escaped: ``<`` followed by any number of
backslashes and ``|`` gets one backslash more, so no ``<|`` of a text survives
and taking one backslash away restores it.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

START, END, NEWLINE = "<|im_start|>", "<|im_end|>", "<|nl|>"
KINDS = ("image", "audio", "document")
#: Tokens that a placeholder expands to: an image by tiles of this many pixels a side, audio and documents by rates.
TILE, TILE_TOKENS, AUDIO_TOKENS_A_SECOND, DOCUMENT_TOKENS_A_PAGE = 512, 170, 25, 600
PART = "struct<type:string,text:string,ref:string,width:int,height:int,seconds:double,pages:int>"


def escaped(text: Column) -> Column:
    return F.regexp_replace(text, r"<(\\*)\|", r"<\\$1|")


def unescape(text: str) -> str:
    return re.sub(r"<\\(\\*)\|", r"<\1|", text)


def text_parts(text: Column) -> Column:
    """A plain text as its only part; null is empty."""
    row = F.struct(F.lit("text").alias("type"), F.coalesce(text.cast("string"), F.lit("")).alias("text"),
                   F.lit(None).cast("string").alias("ref"), F.lit(None).cast("int").alias("width"),
                   F.lit(None).cast("int").alias("height"), F.lit(None).cast("double").alias("seconds"),
                   F.lit(None).cast("int").alias("pages"))
    return F.array(row).cast(f"array<{PART}>")


def _expanded(part: Column) -> Column:
    """Tokens a part's placeholder stands for; missing measures count as the smallest."""
    def tiles(side: str) -> Column:
        return F.ceil(F.greatest(F.coalesce(part[side], F.lit(1)), F.lit(1)) / TILE)

    return (F.when(part["type"] == "image", tiles("width") * tiles("height") * TILE_TOKENS)
            .when(part["type"] == "audio", F.ceil(F.greatest(F.coalesce(part["seconds"], F.lit(0.0)), F.lit(0.0)) * AUDIO_TOKENS_A_SECOND))
            .when(part["type"] == "document", F.greatest(F.coalesce(part["pages"], F.lit(1)), F.lit(1)) * DOCUMENT_TOKENS_A_PAGE)
            .otherwise(0).cast("long"))


def flattened(parts: Column) -> Column:
    """The visitor: struct<content, attachments>. Parts of unknown type become text placeholders of their type.

    Neighbouring text parts are joined before they are escaped, so no control
    string can arise where two parts meet.
    """
    start = F.struct(F.lit("").alias("done"), F.lit("").alias("open"),
                     F.array().cast("array<struct<n:int,kind:string,ref:string,tokens:long>>").alias("attachments"))

    def visit(acc: Column, part: Column) -> Column:
        kind = F.regexp_replace(F.coalesce(part["type"], F.lit("unknown")), "[^a-z]", "_")
        n = F.size(acc["attachments"])
        item = F.struct(n.alias("n"), kind.alias("kind"), part["ref"].alias("ref"), _expanded(part).alias("tokens"))
        mark = F.concat(acc["done"], escaped(acc["open"]), F.lit("<|"), kind, F.lit(":"), n.cast("string"), F.lit("|>"))
        is_text = F.coalesce(part["type"] == "text", F.lit(False))
        return F.struct(F.when(is_text, acc["done"]).otherwise(mark).alias("done"),
                        F.when(is_text, F.concat(acc["open"], F.coalesce(part["text"], F.lit("")))).otherwise("").alias("open"),
                        F.when(is_text, acc["attachments"]).otherwise(F.concat(acc["attachments"], F.array(item))).alias("attachments"))

    return F.aggregate(F.filter(parts, lambda p: p.isNotNull()), start, visit, lambda acc: F.struct(
        F.concat(acc["done"], escaped(acc["open"])).alias("content"), acc["attachments"].alias("attachments")))


def format_turns(df: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role",
                 parts: Column | None = None, loss_roles: tuple[str, ...] = ("assistant",)) -> DataFrame:
    """conv_id, turn, formatted, loss_start, loss_end (code points in ``formatted``), attachments: one row per turn.

    A conversation's formatted text is its turns' joined by (turn, formatted).
    The work is row-local, so a conversation of any length moves nothing here.
    The loss covers the content of ``loss_roles``; other turns have null loss
    bounds. ``parts`` defaults to the ``text`` column as one text part; null
    or empty parts are an empty content, a null role an empty one. Repeated
    rows and ties of a turn number each stay a turn. Extra columns are not read.
    """
    content = flattened(F.coalesce(parts if parts is not None else text_parts(F.col("text")), F.array().cast(f"array<{PART}>")))
    role = F.coalesce(F.col(role_col).cast("string"), F.lit(""))
    head = F.concat(F.lit(START), F.regexp_replace(escaped(role), "\n", NEWLINE), F.lit("\n"))
    rows = df.select(F.col(conv_col).alias("conv_id"), F.col(turn_col).alias("turn"), role.isin(*loss_roles).alias("__loss"),
                     head.alias("__head"), content.alias("__c"))
    start = F.when(F.col("__loss"), F.length("__head"))
    return rows.select("conv_id", "turn", F.concat("__head", F.col("__c.content"), F.lit(END + "\n")).alias("formatted"),
                       start.alias("loss_start"), (start + F.length("__c.content")).alias("loss_end"),
                       F.col("__c.attachments").alias("attachments"))


_TURN = re.compile(re.escape(START) + r"([^\n]*)\n(.*)" + re.escape(END) + r"\n", re.S)


def read_turn(formatted: str) -> tuple[str, str]:
    """(role, text) of one formatted turn."""
    m = _TURN.fullmatch(formatted)
    if m is None:
        raise ValueError("not a formatted turn: " + formatted[:80])
    return unescape(m[1].replace(NEWLINE, "\n")), unescape(m[2])


class _Sums:
    """Running digests of one conversation."""

    def __init__(self, conv):
        self.conv, self.turns, self.loss, self.chars = conv, 0, 0, 0
        self.all, self.learned = hashlib.sha256(), hashlib.sha256()

    def add(self, formatted: str, lo: int | None, hi: int | None) -> None:
        role, text = read_turn(formatted)
        self.turns += 1
        self.chars += len(formatted)
        self.all.update(f"{role}\n{text}\n".encode("utf-8", "replace"))
        if lo is not None:
            under = unescape(formatted[lo:hi])
            self.loss += len(under)
            self.learned.update(under.encode("utf-8", "replace"))


def digests(turns: DataFrame) -> DataFrame:
    """conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars, read from ``format_turns``' output.

    Turns are sorted within their partition and streamed through running
    digests: a conversation of any length needs the memory of one batch.
    """
    kind = dict(turns.dtypes)["conv_id"]
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
    schema = f"conv_id {kind}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def batch(done: list[_Sums], ids: pa.DataType) -> pa.RecordBatch:
            cols = [[s.conv for s in done], [s.turns for s in done], [s.all.hexdigest() for s in done], [s.loss for s in done],
                    [s.learned.hexdigest() for s in done], [s.chars for s in done]]
            types = [ids, pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names)

        now, ids = None, None
        for b in batches:
            ids, done = b.schema.field("conv_id").type, []
            for conv, formatted, lo, hi in zip(*[b.column(c).to_pylist() for c in ("conv_id", "formatted", "loss_start", "loss_end")],
                                               strict=True):
                if now is None or conv != now.conv:
                    if now is not None:
                        done.append(now)
                    now = _Sums(conv)
                now.add(formatted, lo, hi)
            if done:
                yield batch(done, ids)
        if now is not None:
            yield batch([now], ids)

    return (turns.select("conv_id", "turn", "formatted", "loss_start", "loss_end").repartition("conv_id")
            .sortWithinPartitions("conv_id", "turn", "formatted").mapInArrow(run, schema))
