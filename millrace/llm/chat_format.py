"""Preference formatting: prompt once, then the chosen and the rejected completion, each with a training mask.

Two conversations make a pair. Their longest common turn prefix (same roles and texts, turn by turn) is rendered once as
the prompt; the turns after it are the two completions. The result has one row a rendered turn, so no task holds a whole
conversation: segment (prompt, chosen or rejected), turn, rendered text, and the span of characters to train on, which
covers the assistant's text and end mark in completions and is empty elsewhere. `joined` puts the segments of a pair
into one row each.

Defined cases: a null text is empty, a null role is "user", a null turn comes first as turn -1. Rows without conv_id
belong to no pair and are left out. Rows that repeat a turn form it together; they are rendered each, and the turn is
common if both sides have equally many rows with the same contents. A conversation without partner has an empty prompt,
and all its turns are its completion. Extra columns aren't carried. An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm.common import lookup, materialize, table

CLOSE = "<|end|>\n"


def header(role: Column) -> Column:
    return F.concat(F.lit("<|"), role, F.lit("|>\n"))


def preference_segments(turns: DataFrame) -> DataFrame:
    """turns: pair_id, side (chosen or rejected), turn, role, text. One row a rendered turn; the prompt is taken from the chosen side."""
    rows = turns.select(
        "pair_id", "side", F.coalesce("turn", F.lit(-1)).cast("long").alias("turn"), F.coalesce("role", F.lit("user")).alias("role"), F.coalesce("text", F.lit("")).alias("text")
    ).where(F.col("pair_id").isNotNull())
    content = F.xxhash64("role", "text")
    chosen = F.col("side") == "chosen"
    count = lambda mine: F.count(F.when(mine, 1))
    digest = lambda mine: F.array(F.sum(F.when(mine, F.shiftrightunsigned(content, 24))), F.bit_xor(F.when(mine, content)))
    same = (count(chosen) == count(~chosen)) & digest(chosen).eqNullSafe(digest(~chosen))
    each = rows.groupBy("pair_id", "turn").agg(same.alias("same"), F.count(F.lit(1)).alias("n"))
    first = each.groupBy("pair_id").agg(F.min(F.when(~F.col("same"), F.col("turn"))).alias("first_different"), F.sum("n").alias("members"))
    first = materialize(first, "prefixes")
    total = first.agg(F.coalesce(F.sum("members"), F.lit(0))).first()[0]
    met = lookup(rows, "pair_id", first, total)
    common = F.col("first_different").isNull() | (F.col("turn") < F.col("first_different"))
    met = met.where(~common | chosen).withColumn("segment", F.when(common, "prompt").otherwise(F.col("side")))
    train = (F.col("segment") != "prompt") & (F.col("role") == "assistant")
    rendered = F.concat(header(F.col("role")), F.col("text"), F.lit("\n" + CLOSE))
    return met.select(
        "pair_id", "segment", "turn", "role", rendered.alias("rendered"),
        F.when(train, F.char_length(header(F.col("role")))).otherwise(0).cast("long").alias("train_start"),
        F.when(train, F.char_length(rendered)).otherwise(0).cast("long").alias("train_stop"),
    )


def joined(segments: DataFrame) -> DataFrame:
    """One row a pair: prompt, chosen and rejected texts, and the spans to train on in either completion.

    For conversations that fit a training row; a longer one stays as segments."""
    parts = lambda name: F.array_sort(F.collect_list(F.when(F.col("segment") == name, F.struct("turn", "rendered", "train_start", "train_stop"))))
    df = segments.groupBy("pair_id").agg(*(parts(n).alias(n) for n in ("prompt", "chosen", "rejected")))
    text = lambda c: F.array_join(F.transform(c, lambda t: t["rendered"]), "")

    def spans(c: str) -> Column:
        zero = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<struct<start:bigint,stop:bigint>>").alias("spans"))
        step = lambda s, t: F.struct(
            (s["at"] + F.char_length(t["rendered"])).alias("at"),
            F.when(t["train_stop"] > 0, F.concat(s["spans"], F.array(F.struct((s["at"] + t["train_start"]).alias("start"), (s["at"] + t["train_stop"]).alias("stop"))))).otherwise(s["spans"]).alias("spans"),
        )
        return F.aggregate(c, zero, step, lambda s: s["spans"])

    return df.select("pair_id", text(F.col("prompt")).alias("prompt"), *(text(F.col(n)).alias(n) for n in ("chosen", "rejected")), *(spans(n).alias(f"{n}_train") for n in ("chosen", "rejected")))


def answered_twice(turns: DataFrame) -> DataFrame:
    """Preference pairs from plain conversations (conv_id, turn, role, text): each is chosen; rejected is the same conversation up to its last assistant turn, answered as its neighbour (conv_id with the last bit turned) last answered. pair_id is conv_id.

    Both sides share all turns before that answer. A conversation without an assistant turn is common to both sides; one whose neighbour has no answer has an empty rejected completion."""
    rows = turns.where("conv_id is not null").select("conv_id", F.coalesce("turn", F.lit(-1)).cast("long").alias("turn"), F.coalesce("role", F.lit("user")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    last = F.max(F.when(F.col("role") == "assistant", F.struct("turn", "text")))
    lasts = materialize(rows.groupBy("conv_id").agg(last.alias("last"), F.count(F.lit(1)).alias("members")), "lasts")
    other = lasts.select(F.col("conv_id").bitwiseXOR(F.lit(1)).alias("conv_id"), F.col("last.text").alias("other"))
    lasts = materialize(lasts.join(other, "conv_id", "left").select("conv_id", "members", F.col("last.turn").alias("last_turn"), "other"), "answers")
    total = lasts.agg(F.coalesce(F.sum("members"), F.lit(0))).first()[0]
    before = lookup(rows, "conv_id", lasts, total).where("last_turn is null or turn < last_turn")
    answer = lasts.where("last_turn is not null and other is not null").select("conv_id", F.col("last_turn").alias("turn"), F.lit("assistant").alias("role"), F.col("other").alias("text"))
    side = lambda df, name: df.select(F.col("conv_id").alias("pair_id"), F.lit(name).alias("side"), "turn", "role", "text")
    return side(rows, "chosen").unionByName(side(before, "rejected")).unionByName(side(answer, "rejected"))


def op7_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The table names no preferences, so pairs are made of its conversations by `answered_twice`."""
    return preference_segments(answered_twice(table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")))
