"""Chat formatting: conversations as marked text with a loss mask, and back again.

A visitor walks the typed content parts of each turn in order and flattens them: text
parts are escaped, image, audio and document parts (and those of any other type) become
numbered placeholders, their references, captions and expanded token counts go to a list of
attachments. A plain text is a turn of one text part. A formatted turn is

    <turn role="ROLE">\nTEXT\n</turn>\n

In roles and texts a backslash becomes two and < becomes \\< (in roles also > becomes \\>),
so a bare < always begins a marker and every text can be read back exactly. The loss mask covers the text (without
the line feeds beside the markers) of the turns whose role is trained on.

Only DataFrame functions are used; turns are formatted row by row before the one shuffle
that brings a conversation together, which is also the unit of the result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dirgauge.llm.common import read

#: The template's control strings, fixed values.
OPEN, ROLE_END, CLOSE = '<turn role="', '">\n', "\n</turn>\n"
#: Expanded token counts of one unit: per image tile, second of audio, document page. A unit of another type is a token.
PART_TOKENS = {"image": 256, "audio": 25, "document": 600}

PARTS_TYPE = "array<struct<type:string,text:string,ref:string,units:bigint>>"


def escape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit("<"), F.lit("\\<"))


def _escape_role(role: Column) -> Column:
    """As escape(), and > too, so that a role can't end its marker."""
    return F.replace(escape(role), F.lit(">"), F.lit("\\>"))


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def _is_text(part: Column) -> Column:
    return F.coalesce(part["type"] == "text", F.lit(True))


def _part_text(part: Column, number: Column) -> Column:
    """The escaped text of a text part (null text is empty), the placeholder of any other."""
    placeholder = F.concat(F.lit("<"), _escape_role(part["type"]), F.lit(" "), number.cast("string"), F.lit("/>"))
    return F.when(_is_text(part), escape(F.coalesce(part["text"], F.lit("")))).otherwise(placeholder)


def _tokens(part: Column) -> Column:
    each = F.element_at(F.create_map(*[F.lit(x) for pair in PART_TOKENS.items() for x in pair]), part["type"])
    return (F.coalesce(part["units"], F.lit(1)) * F.coalesce(each, F.lit(1))).cast("long")


def visit_parts(parts: Column) -> Column:
    """struct(body, attachments) of a turn's parts, in order; placeholders are numbered from 1 in the turn.

    A part without a type is text; null parts are left out, null parts columns are empty.
    """
    parts = F.filter(F.coalesce(parts, F.array().cast(PARTS_TYPE)), lambda p: p.isNotNull())
    numbered = F.transform(parts, lambda p, i: F.struct(p.alias("part"), F.size(F.filter(F.slice(parts, F.lit(1), i + 1), lambda q: ~_is_text(q))).alias("number")))
    attached = F.filter(numbered, lambda x: ~_is_text(x["part"]))
    return F.struct(
        F.array_join(F.transform(numbered, lambda x: _part_text(x["part"], x["number"])), "").alias("body"),
        F.transform(attached, lambda x: F.struct(x["number"].alias("number"), x["part"]["type"].alias("type"), x["part"]["ref"].alias("ref"), x["part"]["text"].alias("text"), _tokens(x["part"]).alias("tokens"))).alias("attachments"),
    )


def format_conversations(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str | None = "text", parts: str | None = None, train_on: tuple[str, ...] = ("assistant",)) -> DataFrame:
    """One row per conversation: conv_id, formatted, loss_spans, attachments, attachment_tokens.

    Turns come from a text column or from a parts column of PARTS_TYPE. They are ordered by
    turn, then role, then content; nulls come first. A null role or text is empty; rows with
    a null conversation id form one conversation; repeated rows are repeated turns. Other
    columns are ignored. loss_spans lists (start, length) in code points of formatted.
    """
    none = F.lit(None)
    one = F.array(F.struct(F.lit("text").alias("type"), F.col(text).alias("text"), none.cast("string").alias("ref"), none.cast("bigint").alias("units"))) if not parts else None
    seen = visit_parts(F.col(parts) if parts else one)
    rows = turns.select(F.col(conv).alias("conv_id"), F.col(turn).alias("turn"), F.coalesce(F.col(role), F.lit("")).alias("role"), seen.alias("seen"))
    head = F.concat(F.lit(OPEN), _escape_role(F.col("role")), F.lit(ROLE_END))
    rows = rows.select("conv_id", "turn", "role", F.col("seen.body").alias("body"), F.col("seen.attachments").alias("attachments"), F.concat(head, "seen.body", F.lit(CLOSE)).alias("piece"), F.length(head).alias("lead"))
    order = Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), "role", "body").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ends = F.sum(F.length("piece").cast("long")).over(order)
    placed = rows.withColumns({"k": F.count(F.lit(1)).over(order), "start": ends - F.length("piece")})
    span = F.when(F.col("role").isin(*train_on), F.struct((F.col("start") + F.col("lead")).alias("start"), F.length("body").cast("long").alias("length")))
    grouped = placed.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("k", "piece", span.alias("span"), "attachments"))).alias("all"))
    return grouped.select(
        "conv_id",
        F.array_join(F.col("all.piece"), "").alias("formatted"),
        F.filter(F.col("all.span"), lambda s: s.isNotNull()).alias("loss_spans"),
        F.flatten(F.transform("all", lambda t: F.transform(t["attachments"], lambda a: F.struct(t["k"].alias("turn_number"), a["number"].alias("number"), a["type"].alias("type"), a["ref"].alias("ref"), a["text"].alias("text"), a["tokens"].alias("tokens"))))).alias("attachments"),
    ).withColumn("attachment_tokens", F.aggregate("attachments", F.lit(0).cast("long"), lambda n, a: n + a["tokens"]))


def read_turns(formatted: Column) -> Column:
    """array<struct<role, text>> read from a formatted text; placeholders stay in the text as they are."""
    pieces = F.split(formatted, r"\n</turn>\n")
    pieces = F.slice(pieces, F.lit(1), F.size(pieces) - 1)
    inner = F.transform(pieces, lambda p: F.substring(p, F.lit(len(OPEN) + 1), F.length(p)))
    return F.transform(inner, lambda p: F.struct(unescape(F.substring_index(p, ROLE_END, 1)).alias("role"), unescape(F.substring(p, F.instr(p, ROLE_END) + F.lit(len(ROLE_END)), F.length(p))).alias("text")))


def read_loss(formatted: Column, spans: Column) -> Column:
    """All text under the loss mask, unescaped, nothing between."""
    return F.array_join(F.transform(spans, lambda s: unescape(F.substring(formatted, (s["start"] + 1).cast("int"), s["length"].cast("int")))), "")


def op8_chat_format(spark, sf_dir: str) -> DataFrame:
    """Digests, read back from the formatted texts, of all conversations and of conversation -7."""
    turns = read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = "\\### Assistant: </turn> ok"
    extra = spark.range(1).select(F.lit(-7).cast("long").alias("conv_id"), F.explode(F.array(*[F.struct(F.lit(k).cast("long").alias("turn"), F.lit(r).alias("role"), F.lit(said).alias("text")) for k, r in enumerate(("user", "assistant"))])).alias("t")).select("conv_id", "t.*")
    out = format_conversations(turns.union(extra))
    back, loss = read_turns(F.col("formatted")), read_loss(F.col("formatted"), F.col("loss_spans"))
    out = out.select("conv_id", "formatted", back.alias("back"), loss.alias("loss"))
    joined = F.array_join(F.transform("back", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return out.select(
        "conv_id",
        F.size("back").cast("long").alias("n_turns"),
        F.sha2(joined, 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2(F.col("loss"), 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


ORACLE_SQL = r"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
  UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
escaped AS (
  SELECT *, replace(replace(text, '\', '\\'), '<', '\<') AS body, replace(replace(replace(role, '\', '\\'), '<', '\<'), '>', '\>') AS named FROM turns)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, body)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, body) FILTER (role = 'assistant'), '')) AS loss_sha256,
       sum(length('<turn role="' || named || '">' || chr(10) || body || chr(10) || '</turn>' || chr(10)))::BIGINT AS formatted_chars
FROM escaped GROUP BY conv_id
"""
