"""Chat formatting by perspective rotation.

Each participant of a conversation gets a rendering of it with that speaker as the assistant and the others as named users.
A rendering is a list of pieces, each with a mask: 1 for what the model learns to say (the assistant's texts and their
end marks), 0 for the rest. System messages belong to no participant and stay what they are.

A rendering is cut into parts of ``PART_MESSAGES`` messages, so a conversation of any length is never gathered in one
task; the parts of a perspective, joined in their order, are its whole rendering. A message's number is found without a window over its conversation: messages are put in order by range, and a
number is the place in the range plus the messages of the conversation in earlier ranges.

What a participant writes cannot pass for the frame: a start or end mark in a text or a name is broken up by a blank behind
its first character, and a line break in a name becomes a blank.

Messages are ordered by turn, speaker and text, nulls first. Rows equal in all four columns are one message that was read
twice. A null speaker is a participant of its own, with a null perspective, and named ``UNKNOWN`` to the others. A null text is
empty, and rows with a null conversation are one conversation. Very long texts stand in their piece whole. A conversation of
system messages alone has no participant and no rendering, an empty table none at all. Other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from concord.llm.base import written

PART_MESSAGES = 64
#: Characters of a text that place it among rows of one turn; range borders are sampled on the driver, so keys stay short.
KEY_CHARS = 16
SYSTEM = "system"
UNKNOWN = "unknown"
START, END = "<|im_start|>", "<|im_end|>"


def numbered(messages: DataFrame) -> DataFrame:
    """Distinct messages (conv_id, turn, speaker, text) with ``number``, 0 for a conversation's first."""
    keys = ["conv_id", "turn", "speaker", "text"]
    text = F.coalesce("text", F.lit(""))
    distinct = messages.select("conv_id", "turn", F.col("role").alias("speaker"), text.alias("text")).distinct()
    ordered = written(
        distinct.repartitionByRange("conv_id", "turn", "speaker", F.left("text", F.lit(KEY_CHARS)))
        .sortWithinPartitions(*keys)
        .select(*keys, F.spark_partition_id().alias("range"), F.monotonically_increasing_id().alias("row")),
        "messages",
    )
    ranges = ordered.groupBy("conv_id", "range").agg(F.min("row").alias("first"), F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy("conv_id").orderBy("range")) - F.col("n")
    starts = ranges.select(F.col("conv_id").alias("conv"), F.col("range").alias("in_range"), "first", before.alias("start"))
    same = F.col("conv_id").eqNullSafe(F.col("conv")) & (F.col("range") == F.col("in_range"))
    return ordered.join(starts, same).select(*keys, (F.col("row") - F.col("first") + F.col("start")).alias("number"))


def _harmless(text: Column) -> Column:
    """A text without marks."""
    for mark in (START, END):
        text = F.replace(text, F.lit(mark), F.lit(f"{mark[0]} {mark[1:]}"))
    return text


def _pieces(message: Column, perspective: Column) -> Column:
    """Head and body of a message as pieces with their masks."""
    own = message["speaker"].eqNullSafe(perspective)
    name = F.translate(F.coalesce(_harmless(message["speaker"]), F.lit(UNKNOWN)), "\r\n", "  ")
    head = (
        F.when(message["speaker"] == SYSTEM, F.lit(f"{START}{SYSTEM}\n"))
        .when(own, F.lit(f"{START}assistant\n"))
        .otherwise(F.concat(F.lit(f"{START}user name="), name, F.lit("\n")))
    )
    body = F.concat(_harmless(message["text"]), F.lit(f"{END}\n"))
    return F.array(
        F.struct(head.alias("piece"), F.lit(0).alias("mask")), F.struct(body.alias("piece"), own.cast("int").alias("mask"))
    )


def rotated(messages: DataFrame, part_messages: int = PART_MESSAGES) -> DataFrame:
    """conv_id, perspective, part, pieces (array of piece and mask): one row per participant and part."""
    parts = (
        numbered(messages)
        .withColumn("part", F.floor(F.col("number") / part_messages))
        .groupBy("conv_id", "part")
        .agg(F.array_sort(F.collect_list(F.struct("number", "speaker", "text"))).alias("messages"))
    )
    # participants from the rows themselves: a part need not hold all of them
    people = messages.select(F.col("conv_id").alias("conv"), F.col("role").alias("perspective"))
    people = people.where(~F.col("perspective").eqNullSafe(F.lit(SYSTEM)))
    return parts.join(people.distinct(), F.col("conv_id").eqNullSafe(F.col("conv"))).select(
        "conv_id",
        "perspective",
        "part",
        F.flatten(F.transform("messages", lambda m: _pieces(m, F.col("perspective")))).alias("pieces"),
    )


def rendered(messages: DataFrame, part_messages: int = PART_MESSAGES) -> DataFrame:
    """conv_id, perspective, part, n_messages, text, masks (``length:mask`` of each piece, in code points)."""
    masks = F.transform("pieces", lambda p: F.concat_ws(":", F.length(p["piece"]), p["mask"]))
    return rotated(messages, part_messages).select(
        "conv_id",
        "perspective",
        "part",
        (F.size("pieces") / 2).cast("bigint").alias("n_messages"),
        F.array_join("pieces.piece", "").alias("text"),
        F.array_join(masks, " ").alias("masks"),
    )


def _harmless_sql(text: str) -> str:
    for mark in (START, END):
        text = f"replace({text}, '{mark}', '{mark[0]} {mark[1:]}')"
    return text


#: The same in DuckDB, over ``conversations``.
SQL = f"""
WITH m AS (
  SELECT DISTINCT conv_id, turn, role AS speaker, coalesce(text, '') AS text FROM conversations
), n AS (
  SELECT *, (row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, speaker NULLS FIRST, text) - 1) AS number FROM m
), p AS (
  SELECT DISTINCT conv_id, speaker AS perspective FROM m WHERE speaker IS DISTINCT FROM '{SYSTEM}'
), r AS (
  SELECT n.conv_id, p.perspective, number, number // {PART_MESSAGES} AS part,
    CASE WHEN n.speaker = '{SYSTEM}' THEN '{START}{SYSTEM}' || chr(10)
         WHEN n.speaker IS NOT DISTINCT FROM p.perspective THEN '{START}assistant' || chr(10)
         ELSE '{START}user name=' || translate(coalesce({_harmless_sql("n.speaker")}, '{UNKNOWN}'), chr(13) || chr(10), '  ') || chr(10) END AS head,
    {_harmless_sql("n.text")} || '{END}' || chr(10) AS body,
    CASE WHEN n.speaker IS NOT DISTINCT FROM p.perspective THEN 1 ELSE 0 END AS own
  FROM n JOIN p ON n.conv_id IS NOT DISTINCT FROM p.conv_id
)
SELECT conv_id, perspective, part, count(*) AS n_messages,
  string_agg(head || body, '' ORDER BY number) AS text,
  string_agg(length(head) || ':0 ' || length(body) || ':' || own, ' ' ORDER BY number) AS masks
FROM r GROUP BY conv_id, perspective, part
"""
