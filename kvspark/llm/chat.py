"""Chat formatting with typed content parts (operator 2). DataFrame functions only.

A turn's content is a list of parts. A visitor takes them in order: text is escaped, and an image, audio or document
becomes a placeholder that names its turn and part; what it refers to, and how many tokens it stands for, is recorded.

The template: ``<|turn ROLE|>`` CONTENT ``<|end|>``, placeholders ``<|KIND turn.part|>``. In texts and roles a backslash
becomes ``\\e``, ``<|`` becomes ``\\l`` and ``|>`` becomes ``\\g``, so that no text contains a control string, and
undoing these three gives every text back. Texts side by side are escaped as one, so that none comes of their seam.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Escapes, in the order in which they are made and, backwards, undone.
ESCAPES = (("\\", "\\e"), ("<|", "\\l"), ("|>", "\\g"))
END = "<|end|>"
PARTS = "array<struct<kind:string,text:string,ref:string,units:double>>"
#: Tokens that one unit stands for: a pixel, a second, a page.
EXPANSION = {"image": 1 / 196, "audio": 25.0, "document": 1024.0}


def escape(text: Column) -> Column:
    for plain, coded in ESCAPES:
        text = F.replace(text, F.lit(plain), F.lit(coded))
    return text


def unescape(text: Column) -> Column:
    for plain, coded in reversed(ESCAPES):
        text = F.replace(text, F.lit(coded), F.lit(plain))
    return text


def _body(parts: Column, placeholder) -> Column:
    """The parts as one escaped text with placeholders. ``placeholder(part, place)`` is what stands between the marks.

    A single text is escaped as it is. Several parts are first put together with one control character on either side
    of a placeholder; the same characters inside texts are escaped before, as ``\\a`` and ``\\b``, and put back behind.
    """
    marks = (("\x01", "\\a"), ("\x02", "\\b"))

    def inner(text: Column) -> Column:
        for plain, coded in (ESCAPES[0], *marks):
            text = F.replace(text, F.lit(plain), F.lit(coded))
        return text

    whole = F.array_join(F.transform(parts, lambda p, j: F.when(p["kind"].isNull(), inner(p["text"])).otherwise(F.concat(F.lit(marks[0][0]), inner(placeholder(p, j)), F.lit(marks[1][0])))), "")
    for plain, coded in ESCAPES[1:]:
        whole = F.replace(whole, F.lit(plain), F.lit(coded))
    for (mark, coded), control in zip(marks, ("<|", "|>")):
        whole = F.replace(F.replace(whole, F.lit(mark), F.lit(control)), F.lit(coded), F.lit(mark))
    return F.when((F.size(parts) == 1) & F.get(parts, F.lit(0))["kind"].isNull(), escape(F.get(parts, F.lit(0))["text"])).otherwise(whole)


def text_part(text: Column) -> Column:
    """A content of one text part."""
    return F.array(F.struct(F.lit("text").alias("kind"), text.alias("text"), F.lit(None).cast("string").alias("ref"), F.lit(None).cast("double").alias("units"))).cast(PARTS)


def _expanded(part: Column, expansion: dict[str, float]) -> Column:
    rate = F.lit(0.0)
    for kind, each in expansion.items():
        rate = F.when(part["kind"] == kind, F.lit(float(each))).otherwise(rate)
    return F.ceil(F.coalesce(part["units"], F.lit(0.0)) * rate).cast("long")


def format_chat(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", parts: str = "parts", loss_roles: tuple[str, ...] = ("assistant",), expansion: dict[str, float] = EXPANSION) -> DataFrame:
    """One row a conversation: ``conv, formatted, loss_spans, attachments, attachment_tokens``.

    parts: a column of type PARTS. loss_spans: ``array<struct<start,stop>>``, the code points of ``formatted`` that are
    content of a turn whose role is in ``loss_roles``. attachments: ``array<struct<turn,part,kind,ref,tokens>>`` in
    order. Turns are ordered by ``turn`` (null first), then by role and content, so repeated turn numbers have a
    defined order. Null roles, contents and texts are empty; a null part is an empty text; a null ``conv`` is a
    conversation of its own. No rows: no rows. Other columns are not read. One shuffle, by ``conv``: its turns have
    to meet, since the formatted conversation is one value.
    """
    content = F.coalesce(F.col(parts), F.array().cast(PARTS))
    is_text = lambda p: F.coalesce(p["kind"], F.lit("text")) == "text"
    rows = turns.select(
        F.col(conv).alias("conv"), F.col(turn).alias("turn"), F.coalesce(F.col(role), F.lit("")).alias("role"),
        F.transform(content, lambda p: F.struct(
            F.when(~is_text(p), p["kind"]).alias("kind"), F.when(is_text(p), F.coalesce(p["text"], F.lit(""))).otherwise(F.lit("")).alias("text"),
            p["ref"].alias("ref"), _expanded(p, expansion).alias("tokens"))).alias("parts"),
    )
    order = Window.partitionBy("conv").orderBy("turn", "role", "parts")
    rows = rows.withColumn("at", F.row_number().over(order) - 1)
    body = _body(F.col("parts"), lambda p, j: F.concat(p["kind"], F.lit(" "), F.col("at").cast("string"), F.lit("."), j.cast("string")))
    rows = rows.select(
        "conv", "at", F.concat(F.lit("<|turn "), escape(F.col("role")), F.lit("|>")).alias("head"), body.alias("body"), F.col("role").isin(*loss_roles).alias("loss"),
        F.filter(F.transform("parts", lambda p, j: F.struct(F.col("at").alias("turn"), j.alias("part"), p["kind"].alias("kind"), p["ref"].alias("ref"), p["tokens"].alias("tokens"))), lambda a: a["kind"].isNotNull()).alias("attached"),
    )
    piece = F.concat("head", "body", F.lit(END))
    upto = F.sum(F.length(piece).cast("long")).over(Window.partitionBy("conv").orderBy("at").rowsBetween(Window.unboundedPreceding, 0))
    start = upto - F.length("body") - len(END)
    rows = rows.select("conv", "at", piece.alias("piece"), "attached", F.when(F.col("loss"), F.struct(start.alias("start"), (start + F.length("body")).alias("stop"))).alias("span"))
    whole = rows.groupBy("conv").agg(F.array_sort(F.collect_list(F.struct("at", "piece", "attached", "span"))).alias("t"))
    attachments = F.flatten(F.transform("t", lambda x: x["attached"]))
    return whole.select(
        F.col("conv").alias(conv), F.array_join(F.transform("t", lambda x: x["piece"]), "").alias("formatted"),
        F.filter(F.transform("t", lambda x: x["span"]), lambda s: s.isNotNull()).alias("loss_spans"), attachments.alias("attachments"),
        F.aggregate(attachments, F.lit(0).cast("long"), lambda n, a: n + a["tokens"]).alias("attachment_tokens"),
    )


def read_turns(formatted: Column) -> Column:
    """The turns of a formatted conversation as ``array<struct<role,text>>``; placeholders stay as they are."""
    head = "<|turn "
    pieces = F.split(formatted, r"<\|end\|>")
    pieces = F.slice(pieces, 1, F.size(pieces) - 1)
    return F.transform(pieces, lambda p: F.struct(
        unescape(F.substring_index(F.substr(p, F.lit(len(head) + 1)), "|>", 1)).alias("role"),
        unescape(F.substr(p, F.locate("|>", p) + 2)).alias("text")))


def read_loss(formatted: Column, spans: Column) -> Column:
    """All text under the loss mask, in order."""
    return F.array_join(F.transform(spans, lambda s: unescape(F.substr(formatted, (s["start"] + 1).cast("int"), (s["stop"] - s["start"]).cast("int")))), "")


def digests(chats: DataFrame, conv: str = "conv_id") -> DataFrame:
    """What the formatted conversations say when read back."""
    turns = read_turns(F.col("formatted"))
    said = F.array_join(F.transform(turns, lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    loss = read_loss(F.col("formatted"), F.col("loss_spans"))
    return chats.select(
        conv, F.size(turns).cast("long").alias("n_turns"), F.sha2(said.cast("binary"), 256).alias("turns_sha256"), F.length(loss).cast("long").alias("loss_chars"),
        F.sha2(loss.cast("binary"), 256).alias("loss_sha256"), F.length("formatted").cast("long").alias("formatted_chars"),
    )
