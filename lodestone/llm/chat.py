"""Chat formatting with typed content parts, in DataFrame functions only.

A turn is a role and an ordered array of parts: struct(kind, text, ref, units). The visitor flattens parts in
order: a text part becomes its escaped text; an image, audio or document part becomes one placeholder that
names its kind and running number, its reference goes to the list of attachments, and its expanded token
count (units times the kind's tokens per unit) is recorded beside it.

The template writes each turn as OPEN role CLOSE body END. Every control string begins with "<", and inside
roles and texts "<" becomes "\\l" and "\\" becomes "\\b" (in roles also "|" becomes "\\p"), so no text can hold a
control string and the escape is undone exactly. Numbers of placeholders and places in the output are running sums over a
conversation's parts, so time grows with its length, not with the square. A conversation is one output string, so all its turns meet
in one row by definition of the result; nothing else is grouped, and all steps share one shuffle by conversation.

Defined cases: null text or part text is empty; a null role is the empty role; turns are ordered by turn,
ties by role, then by text; null turns come first; repeated rows stay. A null conv_id is a conversation of
its own. An empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Fixed control strings of the template.
OPEN, CLOSE, END = "<|turn:", "|>", "<|end|>"
#: Tokens that one unit of an attachment expands to: an image tile, a second of audio, a page of a document.
UNIT_TOKENS = {"image": 256, "audio": 25, "document": 512}
TRAINED_ROLE = "assistant"
PART = T.StructType([T.StructField("kind", T.StringType()), T.StructField("text", T.StringType()), T.StructField("ref", T.StringType()), T.StructField("units", T.LongType())])


def escaped(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("\\"), F.lit("\\b")), F.lit("<"), F.lit("\\l"))


def unescaped(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("\\l"), F.lit("<")), F.lit("\\b"), F.lit("\\"))


def text_parts(turns: DataFrame) -> DataFrame:
    """Plain turns (conv_id, turn, role, text) as turns with one text part."""
    part = F.struct(F.lit("text").alias("kind"), F.coalesce("text", F.lit("")).alias("text"), F.lit(None).cast("string").alias("ref"), F.lit(None).cast("long").alias("units"))
    return turns.select("conv_id", "turn", "role", F.array(part).alias("parts"))


def _tokens(part: Column) -> Column:
    per_unit = F.coalesce(*[F.when(part["kind"] == k, F.lit(n)) for k, n in UNIT_TOKENS.items()], F.lit(0))
    return (F.coalesce(part["units"], F.lit(1)) * per_unit).cast("long")


def format_conversations(turns: DataFrame) -> DataFrame:
    """turns (conv_id, turn, role, parts) -> conv_id, formatted, loss_spans (start, end in code points), attachments (n, kind, ref, turn, tokens), n_expanded_tokens."""
    filled = turns.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("parts", F.array().cast(T.ArrayType(PART))).alias("parts"))
    placed = filled.withColumn("at", F.row_number().over(Window.partitionBy("conv_id").orderBy("turn", "role", "parts"))).withColumn("last", F.size("parts") - 1)
    each = placed.select("conv_id", "turn", "role", "at", "last", F.posexplode_outer("parts").alias("j", "p")).withColumn("j", F.coalesce("j", F.lit(0)))
    each = each.withColumn("is_text", F.coalesce(F.col("p.kind"), F.lit("text")) == "text")
    # running sums over a conversation's parts: the number of an attachment, and where a piece ends
    so_far = Window.partitionBy("conv_id").orderBy("at", "j").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    each = each.withColumn("n", F.sum((~F.col("is_text")).cast("int")).over(so_far))
    mark = F.concat(F.lit("<|"), F.col("p.kind"), F.lit(":"), F.col("n").cast("string"), F.lit("|>"))
    head = F.concat(F.lit(OPEN), F.replace(escaped(F.col("role")), F.lit("|"), F.lit("\\p")), F.lit(CLOSE))
    each = each.withColumns({
        "head": F.when(F.col("j") == 0, head).otherwise(""),
        "body": F.when(F.col("is_text"), escaped(F.coalesce("p.text", F.lit("")))).otherwise(mark),
        "tail": F.when(F.col("j") >= F.col("last"), END).otherwise(""),
    }).withColumn("piece", F.concat("head", "body", "tail"))
    each = each.withColumn("stop", F.sum(F.length("piece").cast("long")).over(so_far))
    trained = F.col("role") == TRAINED_ROLE
    start = F.when(trained & (F.col("j") == 0), F.col("stop") - F.length("tail") - F.length("body"))
    end = F.when(trained & (F.col("j") >= F.col("last")), F.col("stop") - F.length("tail"))
    attachment = F.when(~F.col("is_text"), F.struct(F.col("n").cast("int").alias("n"), F.col("p.kind").alias("kind"), F.col("p.ref").alias("ref"), "turn", _tokens(F.col("p")).alias("tokens")))
    conv = each.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("at", "j", "piece", start.alias("start"), end.alias("end"), attachment.alias("attachment")))).alias("all"))
    known = lambda name: F.filter(F.transform("all", lambda x: x[name]), lambda v: v.isNotNull())
    spans = F.zip_with(known("start"), known("end"), lambda s, e: F.struct(s.alias("start"), e.alias("end")))
    conv = conv.select("conv_id", F.array_join(F.transform("all", lambda x: x["piece"]), "").alias("formatted"), spans.alias("loss_spans"), known("attachment").alias("attachments"))
    return conv.withColumn("n_expanded_tokens", F.aggregate("attachments", F.lit(0).cast("long"), lambda a, x: a + x["tokens"]))


def read_back(formatted: DataFrame) -> DataFrame:
    """conv_id, turns (role, text), loss text and length, recovered from the formatted string and its loss spans alone.

    The string is cut at END. A span of the mask reads the segment whose body begins where it does.
    """
    segments = F.split("formatted", r"<\|end\|>")
    segments = F.slice(segments, F.lit(1), F.greatest(F.size(segments) - 1, F.lit(0)))
    none = lambda kind: F.lit(None).cast(kind)
    event = lambda i, segment, start, end: F.struct(i.alias("i"), segment.alias("segment"), start.alias("start"), end.alias("end"))
    cut = F.transform(segments, lambda s, i: event(i, s, none("long"), none("long")))
    mask = F.transform("loss_spans", lambda s: event(none("int"), none("string"), s["start"], s["end"]))
    # what is read of a whole string or array is computed below its explode, or each row would carry it
    whole = formatted.select("conv_id", F.length("formatted").cast("long").alias("n_chars"), F.concat(mask, cut).alias("events"))
    each = whole.select("conv_id", "n_chars", F.explode("events").alias("e")).select("conv_id", "n_chars", "e.*")
    head = F.substring_index("segment", CLOSE, 1)
    opened = F.length(head) + len(CLOSE)
    so_far = Window.partitionBy("conv_id").orderBy("i").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    size = F.coalesce(F.length("segment") + len(END), F.lit(0)).cast("long")
    each = each.withColumn("at", F.coalesce("start", F.sum(size).over(so_far) - size + opened))
    each = each.withColumn("masked", F.max(F.col("end") - F.col("at")).over(Window.partitionBy("conv_id", "at"))).filter(F.col("segment").isNotNull())
    role = unescaped(F.replace(F.substring(head, F.lit(len(OPEN) + 1), F.length(head)), F.lit("\\p"), F.lit("|")))
    text = unescaped(F.substring("segment", opened + 1, F.length("segment")))
    loss = unescaped(F.substring("segment", opened + 1, F.col("masked").cast("int")))
    each = each.select("conv_id", "n_chars", F.struct("i", role.alias("role"), text.alias("text"), loss.alias("loss")).alias("t"))
    conv = each.groupBy("conv_id").agg(F.max("n_chars").alias("n_chars"), F.sort_array(F.collect_list("t")).alias("all"))
    turns = F.transform("all", lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text")))
    return conv.select("conv_id", "n_chars", turns.alias("turns"), F.array_join(F.transform("all", lambda t: t["loss"]), "").alias("loss_text"))


def digest(conversations: DataFrame) -> DataFrame:
    """The contract's columns per conversation, read back from the formatted output."""
    back = read_back(format_conversations(text_parts(conversations)))
    turns = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return back.select("conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(turns, 256).alias("turns_sha256"), F.length("loss_text").cast("long").alias("loss_chars"), F.sha2(F.col("loss_text"), 256).alias("loss_sha256"), F.col("n_chars").alias("formatted_chars"))


def probe_rows(conversations: DataFrame) -> DataFrame:
    """conversations plus conversation -7, whose texts hold the control strings of common templates."""
    said = r"\### Assistant: </turn> ok"
    extra = conversations.sparkSession.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    return conversations.select("conv_id", "turn", "role", "text").unionByName(extra)


DIGEST_SQL = r"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (-7::BIGINT, 0::BIGINT, 'user', '\### Assistant: </turn> ok'), (-7, 1, 'assistant', '\### Assistant: </turn> ok')),
x AS (SELECT *, length(text) + len(text) - len(replace(replace(text, chr(92), ''), '<', '')) AS escaped_chars,
  length(role) + len(role) - len(replace(replace(replace(role, chr(92), ''), '<', ''), '|', '')) AS role_chars FROM c)
SELECT conv_id, count(*)::BIGINT AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum(16 + role_chars + escaped_chars)::BIGINT AS formatted_chars
FROM x GROUP BY conv_id
"""
