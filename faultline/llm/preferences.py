"""Preference pairs of conversations: the shared turns once as a prompt, then two masked completions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from faultline.llm.shared import running_sum
from faultline.session import cut

TRAINED = "assistant"


def conversations_of(turns: DataFrame) -> DataFrame:
    """conv_id and turns, an array of (role, text) by turn number; null roles and texts are empty.

    Turns of one number stand by role and text, repeated rows as often as they are there. A row without
    an id is a conversation of its own: nothing tells which belong together. An empty table gives no rows.
    """
    row = F.struct(
        "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")
    )
    named = turns.where("conv_id is not null").groupBy("conv_id")
    single = turns.where("conv_id is null").select("conv_id", F.array(row).alias("turns"))
    grouped = named.agg(F.sort_array(F.collect_list(row)).alias("turns")).union(single)
    return grouped.select(
        "conv_id",
        F.transform("turns", lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text"))).alias("turns"),
    )


def _header(turn: Column) -> Column:
    return F.concat(F.lit("<|"), turn["role"], F.lit("|>\n"))


def _rendered(turns: Column) -> Column:
    return F.array_join(F.transform(turns, lambda t: F.concat(_header(t), t["text"], F.lit("\n"))), "")


def _mask(turns: Column) -> Column:
    """Run lengths in characters: of each turn its header, then its text with the line end."""
    runs = F.transform(
        turns,
        lambda t: F.array(
            F.struct(F.length(_header(t)).alias("length"), F.lit(False).alias("train")),
            F.struct((F.length(t["text"]) + 1).alias("length"), (t["role"] == TRAINED).alias("train")),
        ),
    )
    return F.flatten(runs)


def format_preferences(pairs: DataFrame) -> DataFrame:
    """``pairs`` with n_common, prompt, both completions and their masks.

    ``chosen`` and ``rejected`` are arrays of (role, text), null counting as empty. The prompt is
    the longest common prefix of whole turns; completions are the turns behind it. A mask
    gives runs of characters and whether they are trained on: texts of assistant
    turns are. Equal conversations have empty completions. Conversations are rows, so nothing
    is shuffled here.
    """
    none = F.array().cast("array<struct<role:string,text:string>>")
    both = pairs.withColumns({c: F.coalesce(F.col(c), none) for c in ("chosen", "rejected")})
    first = F.array_position(F.zip_with("chosen", "rejected", lambda a, b: a.eqNullSafe(b)), False)
    common = F.when(first > 0, first - 1).otherwise(F.size("chosen")).cast("int")
    both = both.withColumn("n_common", common)
    rest = {c: F.slice(F.col(c), F.col("n_common") + 1, F.greatest(F.size(c), F.lit(1))) for c in ("chosen", "rejected")}
    return both.select(
        *[c for c in pairs.columns if c not in ("chosen", "rejected")],
        "n_common",
        _rendered(F.slice("chosen", F.lit(1), F.col("n_common"))).alias("prompt"),
        _rendered(rest["chosen"]).alias("chosen"),
        _rendered(rest["rejected"]).alias("rejected"),
        _mask(rest["chosen"]).alias("chosen_mask"),
        _mask(rest["rejected"]).alias("rejected_mask"),
    )


def with_foreign_replies(conversations: DataFrame) -> DataFrame:
    """conv_id, chosen and rejected: each conversation, and it with another's last reply.

    The other is the next conversation in the order of the ids' digests, the first after
    the last. Where either has no assistant turn the two are the same, and so they are for a
    conversation without an id, which has no place in that order.
    """
    # Read for the replies and for the pairs.
    conversations = cut(conversations)
    replied = F.filter("turns", lambda t: t["role"] == TRAINED)
    last = F.when(F.size(replied) > 0, F.element_at(replied, -1)["text"])
    key = F.md5(F.col("conv_id").cast("string"))
    replies = conversations.where("conv_id is not null").select("conv_id", last.alias("reply"))
    keyed = replies.withColumns({"key": key, "_bucket": F.substring(key, 1, 3), "_one": F.lit(1)})
    placed = cut(running_sum(keyed, [], "_bucket", ["key", "conv_id"], "_one", "place"))
    total = placed.count()
    own = placed.select("conv_id", F.when(F.col("place") == total, 1).otherwise(F.col("place") + 1).alias("_next"))
    other = placed.select(F.col("place").alias("_next"), F.col("reply").alias("_reply"))
    foreign = own.join(other, "_next").select(F.col("conv_id").alias("_conv"), "_reply")
    # Left, so that conversations without an id stay; null keys match nothing and don't meet in one task.
    joined = conversations.join(foreign, F.col("conv_id") == F.col("_conv"), "left")
    at = F.size("turns") - F.array_position(
        F.reverse(F.transform("turns", lambda t: t["role"] == TRAINED)), True
    )
    joined = joined.withColumn("_at", at)
    replaced = F.transform(
        "turns",
        lambda t, i: F.struct(
            t["role"].alias("role"),
            F.when((i == F.col("_at")) & (t["role"] == TRAINED), F.coalesce(F.col("_reply"), t["text"]))
            .otherwise(t["text"]).alias("text"),
        ),
    )
    return joined.select("conv_id", F.col("turns").alias("chosen"), replaced.alias("rejected"))
