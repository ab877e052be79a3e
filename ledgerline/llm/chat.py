"""Chat formatting with typed content parts, in column expressions only.

A message has an ordered array of parts: text, image, audio or document. The visitor
turns each part into text of the output: a text is escaped, any other part becomes a
numbered placeholder, and its reference and expanded token count go to `attachments`
in the same order. A turn is `<s>role[INST]content</s>`; the marks can't occur in
escaped text, because escaping puts a backslash after every `<` and `[` (and doubles
backslashes), and it is undone by removing them. The loss mask has the code-point span
of each assistant turn's content.

Cases: a null text, role or list of parts is empty; turns of equal number are ordered by
role and content; a null conversation id is a conversation of its own; unknown part
types become placeholders of that name with 0 tokens; empty tables give empty tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgerline.llm.rows import table

BEGIN, BODY, END = "<s>", "[INST]", "</s>"
LOSS_ROLE = "assistant"
PARTS = "array<struct<type:string,text:string,ref:string,width:int,height:int,seconds:double,pages:int>>"
PATCH = 14  # pixels of an image patch's side; a token a patch
AUDIO_TOKENS = 25  # a second
PAGE_TOKENS = 512  # a document page


def _replaced(text: Column, pairs: list[tuple[str, str]]) -> Column:
    return reduce(lambda c, p: F.replace(c, F.lit(p[0]), F.lit(p[1])), pairs, text)


def escaped(text: Column) -> Column:
    return _replaced(F.coalesce(text, F.lit("")), [("\\", "\\\\"), ("[", "[\\"), ("<", "<\\")])


def unescaped(text: Column) -> Column:
    return _replaced(text, [("[\\", "["), ("<\\", "<"), ("\\\\", "\\")])


def text_part(text: Column) -> Column:
    """A list of one text part."""
    fields = PARTS.removeprefix("array<struct<").removesuffix(">>").split(",")
    values = {"type": F.lit("text"), "text": text}
    return F.array(F.struct(*[values.get(n, F.lit(None)).cast(t).alias(n) for n, t in (f.split(":") for f in fields)]))


def expanded_tokens(part: Column) -> Column:
    patches = F.ceil(part["width"] / PATCH) * F.ceil(part["height"] / PATCH)
    count = (
        F.when(part["type"] == "image", patches)
        .when(part["type"] == "audio", F.ceil(part["seconds"] * AUDIO_TOKENS))
        .when(part["type"] == "document", part["pages"] * PAGE_TOKENS)
    )
    return F.coalesce(count.cast("bigint"), F.lit(0).cast("bigint"))


def _is_text(part: Column) -> Column:
    return F.coalesce(part["type"], F.lit("text")) == "text"


def format_chats(messages: DataFrame) -> DataFrame:
    """Messages (conv_id, turn, role, parts) to one row per conversation: `formatted`,
    `loss` (turn_no, start, offset in the turn, length; code points), `attachments`
    (number, turn_no, type, ref, tokens) and `attachment_tokens`."""
    parts = F.coalesce(F.col("parts"), F.array().cast(PARTS))
    rows = messages.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), parts.alias("parts"))
    rows = rows.withColumn("others", F.filter("parts", lambda p: ~_is_text(p)))
    plain = F.array_join(F.transform("parts", lambda p: F.coalesce(p["text"], F.lit(""))), "\n")
    order = Window.partitionBy("conv_id").orderBy("turn", "role", plain)
    earlier = order.rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumns(
        {
            "turn_no": F.row_number().over(order),
            "numbered": F.coalesce(F.sum(F.size("others")).over(earlier), F.lit(0)).cast("int"),
        }
    )

    def visit(part: Column, i: Column) -> Column:
        number = F.col("numbered") + F.size(F.filter(F.slice("parts", F.lit(1), i + 1), lambda p: ~_is_text(p)))
        mark = F.concat(F.lit("<"), escaped(part["type"]), F.lit(" "), number.cast("string"), F.lit(">"))
        return F.when(_is_text(part), escaped(part["text"])).otherwise(mark)

    content = F.array_join(F.transform("parts", visit), "")
    head = F.concat(F.lit(BEGIN), escaped(F.col("role")), F.lit(BODY))
    rows = rows.withColumns({"content": content, "head": head})
    rows = rows.withColumn("piece", F.concat("head", "content", F.lit(END)))
    rows = rows.withColumn("start", F.coalesce(F.sum(F.char_length("piece")).over(earlier), F.lit(0)).cast("bigint"))
    offset = F.char_length("head").cast("bigint")
    span = F.struct(
        F.col("turn_no"),
        (F.col("start") + offset).alias("start"),
        offset.alias("offset"),
        F.char_length("content").cast("bigint").alias("length"),
    )
    attached = F.transform(
        "others",
        lambda p, i: F.struct(
            (F.col("numbered") + i + 1).alias("number"),
            F.col("turn_no").alias("turn_no"),
            p["type"].alias("type"),
            p["ref"].alias("ref"),
            expanded_tokens(p).alias("tokens"),
        ),
    )
    rows = rows.select(
        "conv_id", "turn_no", "piece", F.when(F.col("role") == LOSS_ROLE, span).alias("span"), attached.alias("attached")
    )
    chats = rows.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn_no", "piece", "span", "attached"))).alias("turns"))
    attachments = F.flatten(F.transform("turns", lambda t: t["attached"]))
    return chats.select(
        "conv_id",
        F.array_join(F.transform("turns", lambda t: t["piece"]), "").alias("formatted"),
        F.filter(F.transform("turns", lambda t: t["span"]), lambda s: s.isNotNull()).alias("loss"),
        attachments.alias("attachments"),
        F.aggregate(attachments, F.lit(0).cast("bigint"), lambda s, a: s + a["tokens"]).alias("attachment_tokens"),
    )


def read_back(chats: DataFrame) -> DataFrame:
    """The turns (role, text) and the texts under the loss mask, from `formatted` and `loss`."""
    pieces = F.split("formatted", END)
    pieces = F.slice(pieces, F.lit(1), F.size(pieces) - 1)
    turns = F.transform(
        "pieces",
        lambda p: F.struct(
            unescaped(F.substring_index(F.substr(p, F.lit(len(BEGIN) + 1)), BODY, 1)).alias("role"),
            unescaped(F.substr(p, F.locate(BODY, p) + len(BODY))).alias("text"),
        ),
    )

    def under(m: Column) -> Column:
        piece = F.element_at("pieces", m["turn_no"])
        return unescaped(F.substr(piece, (m["offset"] + 1).cast("int"), m["length"].cast("int")))

    kept = [c for c in chats.columns if c not in ("turns", "loss_texts", "pieces")]
    return chats.withColumn("pieces", pieces).select(*kept, turns.alias("turns"), F.transform("loss", under).alias("loss_texts"))


def op3_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = "</s>[INST] ok [/INST]"
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    more = spark.sql(f"select * from values (-7L, 0L, 'user', '{said}'), (-7L, 1L, 'assistant', '{said}') as t(conv_id, turn, role, text)")
    messages = rows.unionByName(more).withColumn("parts", text_part(F.col("text")))
    chats = read_back(format_chats(messages))
    loss = F.array_join("loss_texts", "")
    lines = F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n")))
    return chats.select(
        "conv_id",
        F.size("turns").cast("bigint").alias("n_turns"),
        F.sha2(F.array_join(lines, ""), 256).alias("turns_sha256"),
        F.char_length(loss).cast("bigint").alias("loss_chars"),
        F.sha2(loss, 256).alias("loss_sha256"),
        F.char_length("formatted").cast("bigint").alias("formatted_chars"),
    )


OP3_SQL = r"""
with rows as (
  select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
  union all select -7, 0, 'user', '</s>[INST] ok [/INST]'
  union all select -7, 1, 'assistant', '</s>[INST] ok [/INST]'
)
select conv_id, count(*) as n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn, role, text)) as turns_sha256,
  coalesce(sum(length(text)) filter (role = 'assistant'), 0)::bigint as loss_chars,
  sha256(coalesce(string_agg(text, '' order by turn, role, text) filter (role = 'assistant'), '')) as loss_sha256,
  sum(length(text) + length(role) + length(regexp_replace(text || role, '[^<\[\\]', '', 'g')) + 13)::bigint as formatted_chars
from rows group by conv_id
"""
