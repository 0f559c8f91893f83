"""Chat formatting with typed content parts, in DataFrame functions only (operator 7).

A turn is ``<turn>role<text>body</turn>`` and a line feed. A body is the turn's
parts in order: text parts escaped, others as placeholders ``<kind:n>`` with n the
part's place among the conversation's attachments. ``<`` opens control strings
alone, so texts and roles escape it (``\\l``) and the escape sign (``\\\\``); nothing
else in a text can be taken for the template, and both are undone exactly.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

KINDS = ("image", "audio", "document")
PARTS_TYPE = ("array<struct<kind:string,text:string,ref:string,width:bigint,height:bigint,"
              "seconds:double,pages:bigint>>")
#: What an attachment expands to: a token per image tile, per part of a second, per page.
IMAGE_TILE, AUDIO_TOKENS_A_SECOND, PAGE_TOKENS = 28, 25, 256


def escape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit("<"), F.lit("\\l"))


def unescape(text: Column) -> Column:
    """Undoes ``escape``; ``<`` cannot be in an escaped text and so serves as a mark."""
    marked = F.replace(F.replace(text, F.lit("\\\\"), F.lit("<b")), F.lit("\\l"), F.lit("<l"))
    return F.replace(F.replace(marked, F.lit("<b"), F.lit("\\")), F.lit("<l"), F.lit("<"))


def expanded_tokens(part: Column) -> Column:
    """Tokens that a placeholder stands for; 0 for text, unknown kinds and missing measures."""
    tiles = (F.ceil(part["width"] / IMAGE_TILE) * F.ceil(part["height"] / IMAGE_TILE)).cast("long")
    counts = (F.when(part["kind"] == "image", tiles)
              .when(part["kind"] == "audio", F.ceil(part["seconds"] * AUDIO_TOKENS_A_SECOND).cast("long"))
              .when(part["kind"] == "document", part["pages"] * PAGE_TOKENS))
    return F.greatest(F.coalesce(counts, F.lit(0)), F.lit(0)).cast("long")


def is_attachment(part: Column) -> Column:
    return F.coalesce(part["kind"].isin(*KINDS), F.lit(False))


def text_parts(text: Column) -> Column:
    """A turn that is plain text, as one part."""
    return F.array(F.struct(F.lit("text").alias("kind"), text.alias("text"))).cast(
        "array<struct<kind:string,text:string>>")


def _visit(part: Column, number: Column) -> Column:
    """The rendering of one part; ``number`` counts the attachments before it."""
    return F.when(is_attachment(part), F.concat(F.lit("<"), part["kind"], F.lit(":"),
                                                number.cast("string"), F.lit(">"))
                  ).otherwise(escape(F.coalesce(part["text"], F.lit(""))))


def format_chat(turns: DataFrame, parts: str = "parts", loss_role: str = "assistant") -> DataFrame:
    """(conv_id, turn, role, parts) -> one row per conversation.

    formatted, n_turns, loss_spans (start and length in code points of each body
    of ``loss_role``), attachments (number, turn, kind, ref, tokens) and
    attachment_tokens. Turns are ordered by turn, nulls first, then role and
    parts, so ties and repeated rows have a fixed order and all stay. A null role or
    text is empty; a null or empty list of parts is an empty body; parts of an
    unknown kind are text. A null conv_id is a conversation. One shuffle, on
    conv_id; a conversation's string is what its digest needs whole.
    """
    fields = {f.name: f.dataType for f in turns.select(F.explode_outer(parts).alias("p")).select("p.*").schema}
    wanted = {"kind": "string", "text": "string", "ref": "string", "width": "bigint",
              "height": "bigint", "seconds": "double", "pages": "bigint"}
    typed = F.transform(F.coalesce(F.col(parts), F.array()), lambda p: F.struct(
        *[(p[n].cast(t) if n in fields else F.lit(None).cast(t)).alias(n) for n, t in wanted.items()]))
    rows = turns.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), typed.alias("parts"))
    rows = rows.withColumn("own", F.filter("parts", is_attachment))
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "parts")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("place", F.row_number().over(order)).withColumn(
        "seen", F.coalesce(F.sum(F.size("own")).over(before), F.lit(0)))
    body = F.array_join(F.transform("parts", lambda p, i: _visit(
        p, F.col("seen") + F.size(F.filter(F.slice("parts", F.lit(1), i), is_attachment)))), "")
    rows = rows.withColumn("body", body).withColumn("head", F.concat(
        F.lit("<turn>"), escape(F.col("role")), F.lit("<text>")))
    rows = rows.withColumn("line", F.concat("head", "body", F.lit("</turn>\n")))
    start = F.coalesce(F.sum(F.char_length("line")).over(before), F.lit(0)) + F.char_length("head")
    rows = rows.withColumn("span", F.when(F.col("role") == loss_role, F.struct(
        start.cast("long").alias("start"), F.char_length("body").cast("long").alias("length"))))
    rows = rows.withColumn("refs", F.transform("own", lambda p, i: F.struct(
        (F.col("seen") + i).cast("long").alias("number"), F.col("turn").alias("turn"),
        p["kind"].alias("kind"), p["ref"].alias("ref"), expanded_tokens(p).alias("tokens"))))
    grouped = rows.groupBy("conv_id").agg(
        F.sort_array(F.collect_list(F.struct("place", "line", "span", "refs"))).alias("t"))
    out = grouped.select(
        "conv_id", F.size("t").cast("long").alias("n_turns"),
        F.array_join(F.col("t.line"), "").alias("formatted"),
        F.filter(F.col("t.span"), lambda s: s.isNotNull()).alias("loss_spans"),
        F.flatten(F.col("t.refs")).alias("attachments"))
    return out.withColumn("attachment_tokens", F.aggregate(
        "attachments", F.lit(0).cast("long"), lambda n, a: n + a["tokens"]))


def parse_chat(formatted: Column) -> Column:
    """The formatted string back as array<struct<role, body>>; the body still escaped.

    Linear in the string: it is split where a turn opens and where a tag opens.
    """
    turns = F.slice(F.split(formatted, "<turn>"), 2, 1 << 30)
    return F.transform(turns, lambda t: F.struct(
        F.substring_index(t, "<text>", 1).alias("role"),
        F.substring_index(F.substring(t, F.instr(t, F.lit("<text>")) + 6, F.length(t)), "</turn>", 1).alias("body")))


def chat_digest(chats: DataFrame) -> DataFrame:
    """conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars, read back from ``formatted``.

    The loss text is what the spans mask, unescaped, nothing between. In bodies
    with attachments the placeholders are part of it.
    """
    turns = parse_chat(F.col("formatted"))
    rows = chats.select("conv_id", "formatted", "loss_spans", turns.alias("turns"))
    said = F.array_join(F.transform("turns", lambda t: F.concat(
        unescape(t["role"]), F.lit("\n"), unescape(t["body"]), F.lit("\n"))), "")
    loss = F.array_join(F.transform("loss_spans", lambda s: unescape(F.substr(
        F.col("formatted"), (s["start"] + 1).cast("int"), s["length"].cast("int")))), "")
    return (rows.withColumn("loss", loss)
            .select("conv_id", F.size("turns").cast("long").alias("n_turns"),
                    F.sha2(said, 256).alias("turns_sha256"),
                    F.char_length("loss").cast("long").alias("loss_chars"),
                    F.sha2("loss", 256).alias("loss_sha256"),
                    F.char_length("formatted").cast("long").alias("formatted_chars")))


#: The digests in DuckDB, from the table itself.
CHAT_SQL = r"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
  UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
g AS (
  SELECT conv_id, count(*) AS n_turns,
    string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text) AS said,
    coalesce(string_agg(CASE WHEN role = 'assistant' THEN text END, '' ORDER BY turn NULLS FIRST, role, text), '') AS loss,
    sum(20 + length(replace(replace(role, '\', '\\'), '<', '\l'))
           + length(replace(replace(text, '\', '\\'), '<', '\l'))) AS chars
  FROM t GROUP BY conv_id)
SELECT conv_id, n_turns, sha256(said) AS turns_sha256, CAST(length(loss) AS BIGINT) AS loss_chars,
  sha256(loss) AS loss_sha256, CAST(chars AS BIGINT) AS formatted_chars
FROM g
"""
