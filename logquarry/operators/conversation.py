"""Chat messages: alternating roles, the system part, sizes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from logquarry.functions.arrays import unfold
from logquarry.functions.text import is_blank, strip_left, strip_right
from logquarry.operators.ordered import BLOCK_BITS, islands
from logquarry.staging import stage

GAP = "\n\n"


def joined_texts(parts: Column) -> Column:
    """Texts joined by an empty line; white space next to a join is dropped."""
    last = F.size(parts) - 1
    return F.array_join(F.transform(parts, lambda text, i: F.when(
        i == 0, F.when(last == 0, text).otherwise(strip_right(text))
    ).when(i == last, strip_left(text)).otherwise(strip_left(strip_right(text)))), GAP)


def alternate(messages: DataFrame, conversation: str = "conv_id", turn: str = "turn", bits: int = BLOCK_BITS) -> DataFrame:
    """Strictly alternating messages per conversation, ordered by `first_turn` (-1 for an opening that was added).

    Blank texts are dropped and unknown roles count as user. Neighbours of one role are merged. System texts open the
    first user message. A conversation that starts with the assistant has that message turned into the user's.
    """
    role = F.lower(F.trim(F.coalesce("role", F.lit(""))))
    kept = messages.where(~is_blank(F.col("text"))).select(
        conversation, F.col(turn).alias("first_turn"),
        F.when(role.isin("system", "assistant"), role).otherwise("user").alias("role"), "text")
    spoken = islands(kept.where("role <> 'system'"), [conversation], "first_turn", "role", "island", bits)
    merged = spoken.groupBy(conversation, "island").agg(
        F.min("first_turn").alias("first_turn"), F.first("role").alias("role"),
        F.array_sort(F.collect_list(F.struct("first_turn", "text"))).alias("parts"))
    merged = merged.select(
        conversation, "island", "first_turn", "role", joined_texts(F.col("parts.text")).alias("content"))
    # The head and the rest are read apart below; writing the merged messages once is cheaper than merging twice.
    merged = stage(merged, "messages")
    system = kept.where("role = 'system'").groupBy(conversation).agg(
        F.array_sort(F.collect_list(F.struct("first_turn", "text"))).alias("parts"))
    system = system.select(conversation, F.array_join("parts.text", GAP).alias("system"))

    # Only the first two merged messages can change, so the head of a conversation is at most three rows.
    head = merged.where("island <= 2").unionByName(system, allowMissingColumns=True).groupBy(conversation).agg(
        F.max("system").alias("system"),
        F.max(F.when(F.col("island") == 1, F.struct("first_turn", "role", "content"))).alias("one"),
        F.max(F.when(F.col("island") == 2, F.struct("first_turn", "role", "content"))).alias("two"))
    one, two, block = F.col("one"), F.col("two"), F.col("system")

    def message(at: Column, who: str | Column, content: Column) -> Column:
        return F.struct(at.cast("long").alias("first_turn"), (F.lit(who) if isinstance(who, str) else who).alias("role"),
                        content.alias("content"))

    added = message(F.lit(-1), "user", block)
    opening = (
        F.when(one.isNull(), F.array(added))
        .when(block.isNotNull() & (one["role"] == "user"),
              F.array(message(one["first_turn"], "user", F.concat(block, F.lit(GAP), one["content"])), two))
        .when(block.isNotNull(), F.array(added, one, two))
        .when((one["role"] == "assistant") & two.isNotNull(),
              F.array(message(one["first_turn"], "user", F.concat(
                  strip_right(one["content"]), F.lit(GAP), strip_left(two["content"])))))
        .when(one["role"] == "assistant", F.array(message(one["first_turn"], "user", one["content"])))
        .otherwise(F.array(one, two))
    )
    opened = unfold(head, [conversation], F.array_compact(opening), "m").select(conversation, "m.*")
    rest = merged.where("island > 2").select(conversation, "first_turn", "role", "content")
    return opened.unionByName(rest)


def split_system(messages: DataFrame, conversation: str = "conv_id", turn: str = "turn") -> DataFrame:
    """The last system text of each conversation as one row of role `system`, and all other messages as they are."""
    role = F.col("role")
    last = messages.where(role == "system").groupBy(conversation).agg(
        F.max(turn).alias(turn), F.max_by("text", turn).alias("text"))
    kept = last.where(F.length("text") > 0).select(conversation, turn, F.lit("system").alias("role"), "text")
    others = messages.where(role.isNull() | (role != "system")).select(conversation, turn, "role", "text")
    return others.unionByName(kept)


def conversation_tokens(messages: DataFrame, max_tokens: int, conversation: str = "conv_id") -> DataFrame:
    """Estimated tokens of a call per conversation: characters divided by four plus the allowed output."""
    return messages.groupBy(conversation).agg(
        (F.floor(F.sum(F.length("text")) / 4) + max_tokens).cast("long").alias("estimated_tokens"))
