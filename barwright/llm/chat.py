"""Chat formatting with typed content parts, as DataFrame expressions only.

A turn's content is a text or an array of parts; a text is a text part. A visitor flattens the
parts in order: text stays text, images, audio and documents become one placeholder each, and
a document's own parts follow it; so does the text that another part has. A part of any other
kind becomes ``<attachment>``. Each placeholder leaves an attachment (kind, ref, turn, place among all,
tokens it expands to).

The template wraps a turn as ``<s>role\\ntext</s>\\n``. Control strings inside texts get one
more backslash after their first character, which reading back takes off again, so any text
comes back as it was; in roles backslash and line feed are written ``\\0`` and ``\\1``. Loss
spans are the assistant texts' places (start, length in code points) in the output.

Turns are numbered and placed by a window over their conversation, so a long conversation
costs no more than its sort; its output is one string, which has to fit in one row.

Defined results: null texts, roles and parts are empty; a part without a type is text; null turns come first; turns with the
same number go by role, then text, then parts; repeated rows are repeated turns; a null
conversation id is a conversation; an empty table gives an empty table; other columns aren't
returned.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barwright.llm.arrow import quoted

#: The control strings, as a pattern of first character, backslashes and rest.
CONTROL = r"(<|\[)(\\*)(/?(?:s>|INST\]|image>|audio>|document>|attachment>))"
ESCAPED = r"(<|\[)\\(\\*)(/?(?:s>|INST\]|image>|audio>|document>|attachment>))"
OPEN, CLOSE = "<s>", "</s>\n"

#: A part; ``parts`` of a document are flat ones of the same fields.
FLAT = "type string, text string, ref string, width int, height int, seconds double, pages int"
FLAT_STRUCT = f"struct<{FLAT.replace(' ', ':').replace(',:', ',')}>"
PART = f"{FLAT_STRUCT[:-1]},parts:array<{FLAT_STRUCT}>>"


def escape(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), CONTROL, r"$1\\$2$3")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, ESCAPED, "$1$2$3")


def _escape_role(role: Column) -> Column:
    return escape(F.replace(F.replace(F.coalesce(role, F.lit("")), F.lit("\\"), F.lit("\\0")), F.lit("\n"), F.lit("\\1")))


def _unescape_role(role: Column) -> Column:
    return F.replace(F.replace(unescape(role), F.lit("\\1"), F.lit("\n")), F.lit("\\0"), F.lit("\\"))


def _flattened(parts: Column) -> Column:
    """Parts in reading order, a document's own after it."""
    names = [f.split(" ")[0] for f in FLAT.split(", ")]

    def flat(p: Column) -> Column:
        return F.struct(*[p[n].alias(n) for n in names])

    return F.flatten(F.transform(F.filter(parts, lambda p: p.isNotNull()), lambda p: F.concat(F.array(flat(p)), F.coalesce(F.transform(p["parts"], flat), F.array().cast(f"array<{FLAT_STRUCT}>")))))


def _is_text(p: Column) -> Column:
    return F.coalesce(p["type"], F.lit("text")) == "text"


def _placeholder(p: Column) -> Column:
    """What stands for a part that isn't text; a kind without a placeholder of its own is an attachment."""
    known = p["type"].isin("image", "audio", "document")
    return F.concat(F.lit("<"), F.when(known, p["type"]).otherwise("attachment"), F.lit(">"))


def _tokens(p: Column, patch: int, audio_rate: float, page_tokens: int) -> Column:
    """Tokens that a placeholder expands to: patches of an image, frames of audio, pages of a document; 1 of others."""
    image = F.ceil(F.coalesce(p["width"], F.lit(patch)) / patch) * F.ceil(F.coalesce(p["height"], F.lit(patch)) / patch)
    audio = F.ceil(F.coalesce(p["seconds"], F.lit(0.0)) * audio_rate)
    pages = F.coalesce(p["pages"], F.lit(1)) * page_tokens
    return F.when(p["type"] == "image", image).when(p["type"] == "audio", audio).when(p["type"] == "document", pages).otherwise(1).cast("long")


def text_part(text: Column) -> Column:
    """A content of one text part."""
    return F.array(F.struct(F.lit("text").alias("type"), text.alias("text"))).cast("array<struct<type:string,text:string>>")


def as_parts(content: Column, fields: list[str]) -> Column:
    """A content with the fields of PART; those that ``content`` doesn't have are null."""
    kinds = dict(f.split(" ") for f in FLAT.split(", "))
    whole = lambda p: [(p[n] if n in fields else F.lit(None)).cast(t).alias(n) for n, t in kinds.items()]
    return F.transform(content, lambda p: F.when(p.isNotNull(), F.struct(*whole(p), (p["parts"] if "parts" in fields else F.lit(None)).cast(f"array<{FLAT_STRUCT}>").alias("parts"))))


def format_chats(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str | None = "text", parts: str | None = None, trained: tuple[str, ...] = ("assistant",), patch: int = 14, audio_rate: float = 25.0, page_tokens: int = 256) -> DataFrame:
    """(conv, formatted, loss_spans, attachments, n_turns, expanded_tokens).

    A turn's content is its ``text``, as a text part, then the parts in the column ``parts``,
    array<PART> or of some of its fields.
    """
    content = []
    if text:
        content.append(as_parts(text_part(F.col(quoted(text))), ["type", "text"]))
    if parts:
        fields = turns.schema[parts].dataType.elementType.names
        content.append(F.coalesce(as_parts(F.col(quoted(parts)), fields), F.array().cast(f"array<{PART}>")))
    named = lambda c, n: F.col(quoted(c)).alias(n)
    visited = turns.select(named(conv, "chat_id"), named(turn, "chat_turn"), named(role, "chat_role"), _flattened(F.concat(*content)).alias("chat_flat"))
    pieces = F.transform("chat_flat", lambda p: F.when(_is_text(p), escape(p["text"])).otherwise(F.concat(_placeholder(p), escape(p["text"]))))
    body = F.array_join(pieces, "")
    media = F.transform(F.filter("chat_flat", lambda p: ~_is_text(p)), lambda p: F.struct(p["type"].alias("kind"), p["ref"].alias("ref"), _tokens(p, patch, audio_rate, page_tokens).alias("tokens")))
    kind = "array<struct<kind:string,ref:string,tokens:bigint>>"
    rows = visited.select("chat_id", "chat_turn", "chat_role", body.alias("chat_body"), media.cast(kind).alias("chat_media"))
    head = F.concat(F.lit(OPEN), _escape_role(F.col("chat_role")), F.lit("\n"))
    rows = rows.withColumns({"chat_head": head, "chat_length": (F.length(head) + F.length("chat_body") + len(CLOSE)).cast("long")})
    order = Window.partitionBy("chat_id").orderBy(F.col("chat_turn").asc_nulls_first(), F.col("chat_role").asc_nulls_first(), "chat_body", "chat_media")
    placed = rows.withColumns({"chat_place": F.row_number().over(order), "chat_start": F.sum("chat_length").over(order.rowsBetween(Window.unboundedPreceding, 0)) - F.col("chat_length")})
    loss = F.when(F.col("chat_role").isin(*trained), F.struct((F.col("chat_start") + F.length("chat_head")).alias("start"), F.length("chat_body").cast("long").alias("length")))
    line = F.struct("chat_place", F.concat("chat_head", "chat_body", F.lit(CLOSE)).alias("line"), loss.alias("loss"), "chat_turn", "chat_media")
    lines = placed.groupBy("chat_id").agg(F.sort_array(F.collect_list(line)).alias("chat_lines"))
    found = F.flatten(F.transform("chat_lines", lambda x: F.transform(x["chat_media"], lambda m: F.struct(m["kind"].alias("kind"), m["ref"].alias("ref"), x["chat_turn"].alias("turn"), m["tokens"].alias("tokens")))))
    return lines.select(
        F.col("chat_id").alias(conv),
        F.array_join(F.transform("chat_lines", lambda x: x["line"]), "").alias("formatted"),
        F.filter(F.transform("chat_lines", lambda x: x["loss"]), lambda x: x.isNotNull()).alias("loss_spans"),
        F.transform(found, lambda m, i: F.struct(i.alias("place"), m["kind"].alias("kind"), m["ref"].alias("ref"), m["turn"].alias("turn"), m["tokens"].alias("tokens"))).alias("attachments"),
        F.size("chat_lines").cast("long").alias("n_turns"),
        F.aggregate(found, F.lit(0).cast("long"), lambda a, m: a + m["tokens"]).alias("expanded_tokens"),
    )


def read_turns(formatted: Column) -> Column:
    """array<struct<role, text>> read back from an output; placeholders stay in the texts."""
    lines = F.filter(F.split(formatted, CLOSE), lambda x: x != "")

    def read(line: Column) -> Column:
        inner = F.substring(line, F.lit(len(OPEN) + 1), F.length(line))
        role = F.substring_index(inner, "\n", 1)
        return F.struct(_unescape_role(role).alias("role"), unescape(F.substring(inner, F.length(role) + 2, F.length(inner))).alias("text"))

    return F.transform(lines, read)


def read_loss(formatted: Column, spans: Column) -> Column:
    """The texts under the loss mask, unescaped, in order."""
    return F.transform(spans, lambda s: unescape(F.substring(formatted, (s["start"] + 1).cast("int"), s["length"].cast("int"))))
