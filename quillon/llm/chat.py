"""Operator 3: chat formatting by multi-party perspective rotation.

For every participant of a conversation the dialogue is rendered once with that
speaker as the assistant and all others as named users. A row is one turn of one
perspective: its rendered text, where it stands in the rendered dialogue (code
points, from 0, end exclusive), and the part of it to train on: content and end
mark of the assistant's turns, nothing of the others'. System turns are not a
participant's; they are rendered as such in every perspective and never trained on.

Positions are prefix sums. All turns are sorted into ranges, in which equal ones are
told apart by a number of their own, so that neither a long conversation nor any
number of turns alike is one task's. Turns are then numbered in that order and
summed in chunks of ``CHUNK`` numbers before the chunks are. No dialogue is ever
gathered into one value. Texts are left out of all but the first and the last
shuffle.

Null text counts as empty; a null role is the participant ``unknown``. Turns
are ordered by turn (nulls first), then role, then text; repeated rows are turns
of their own. Rows with a null conversation form one conversation. A
conversation of system turns alone has no perspective. An empty table gives an
empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from .common import materialize

CHUNK = 1_024
#: The template.
SYSTEM, ASSISTANT, USER = "<|system|>\n", "<|assistant|>\n", "<|user name={}|>\n"
END = "<|end|>\n"


def _user(role: Column) -> Column:
    head, tail = USER.split("{}")
    return F.concat(F.lit(head), role, F.lit(tail))


def rotate(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", system: str = "system") -> DataFrame:
    """Returns conv, perspective, position, role_label, name, rendered, start, end, train_start, train_end (null: not trained on)."""
    rows = turns.select(F.col(conv).alias("conv"), F.col(turn).alias("turn"), F.coalesce(F.col(role), F.lit("unknown")).alias("role"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    rows = rows.withColumn("is_system", F.col("role") == system)
    rows = rows.withColumn("size", F.char_length(F.when(F.col("is_system"), F.lit(SYSTEM)).otherwise(_user(F.col("role")))) + F.char_length("text") + len(END))
    rows = rows.withColumn("less", F.when(F.col("is_system"), 0).otherwise(F.char_length(_user(F.col("role"))) - len(ASSISTANT)))

    order = ["conv", F.col("turn").asc_nulls_first(), "role", "text", "tie"]
    rows = rows.withColumn("tie", F.monotonically_increasing_id()).repartitionByRange(*order).sortWithinPartitions(*order)
    whole = materialize(rows.withColumn("row", F.monotonically_increasing_id()).drop("tie"), "turns")
    # Ranges are in order, and so are the numbers. Texts stay behind until all positions are known.
    rows = whole.drop("text", "turn").withColumn("chunk", F.floor(F.col("row") / CHUNK))
    inside = Window.partitionBy("conv", "chunk").orderBy("row").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("before", F.coalesce(F.sum("size").over(inside), F.lit(0))).withColumn("position", F.count("*").over(inside))

    # A row for each chunk, and for each speaker of a chunk.
    chunks = rows.groupBy("conv", "chunk").agg(F.sum("size").alias("size"), F.count("*").alias("n"))
    earlier = Window.partitionBy("conv").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    chunks = chunks.select("conv", "chunk", F.coalesce(F.sum("size").over(earlier), F.lit(0)).alias("chunk_start"), F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("chunk_position"))
    speakers = rows.where(~F.col("is_system")).select("conv", F.col("role").alias("perspective")).distinct()
    mine = rows.where(~F.col("is_system")).groupBy("conv", F.col("role").alias("perspective"), "chunk").agg(F.sum("less").alias("less"))

    placed = rows.join(chunks, [rows["conv"].eqNullSafe(chunks["conv"]), rows["chunk"] == chunks["chunk"]]).select(rows["*"], "chunk_start", "chunk_position")
    seen = placed.join(speakers, placed["conv"].eqNullSafe(speakers["conv"])).select(placed["*"], "perspective")
    # The assistant's own turns are shorter or longer than they would be as a named user's.
    by_chunk = speakers.join(chunks, speakers["conv"].eqNullSafe(chunks["conv"])).select(speakers["conv"], "perspective", "chunk")
    by_chunk = by_chunk.join(mine, [by_chunk["conv"].eqNullSafe(mine["conv"]), by_chunk["perspective"] == mine["perspective"], by_chunk["chunk"] == mine["chunk"]], "left").select(by_chunk["*"], F.coalesce("less", F.lit(0)).alias("less"))
    by_chunk = by_chunk.withColumn("chunk_less", F.coalesce(F.sum("less").over(Window.partitionBy("conv", "perspective").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("less")
    own = F.col("role") == F.col("perspective")
    within = Window.partitionBy("conv", "perspective", "chunk").orderBy("position").rowsBetween(Window.unboundedPreceding, -1)
    seen = seen.join(by_chunk, [seen["conv"].eqNullSafe(by_chunk["conv"]), seen["perspective"] == by_chunk["perspective"], seen["chunk"] == by_chunk["chunk"]]).select(seen["*"], "chunk_less")
    seen = seen.withColumn("own", own).withColumn("my_less", F.coalesce(F.sum(F.when(F.col("own"), F.col("less")).otherwise(0)).over(within), F.lit(0)))

    label = F.when(F.col("is_system"), "system").when(F.col("own"), "assistant").otherwise("user")
    head = F.when(F.col("is_system"), F.lit(SYSTEM)).when(F.col("own"), F.lit(ASSISTANT)).otherwise(_user(F.col("role")))
    seen = seen.join(whole.select("row", "text"), "row")
    start = F.col("chunk_start") + F.col("before") - F.col("chunk_less") - F.col("my_less")
    end = start + F.col("size") - F.when(F.col("own"), F.col("less")).otherwise(0)
    return seen.select(
        F.col("conv").alias(conv),
        "perspective",
        (F.col("chunk_position") + F.col("position")).alias("position"),
        label.alias("role_label"),
        F.when(label == "user", F.col("role")).alias("name"),
        F.concat(head, F.col("text"), F.lit(END)).alias("rendered"),
        start.cast("long").alias("start"),
        end.cast("long").alias("end"),
        F.when(F.col("own"), start + len(ASSISTANT)).cast("long").alias("train_start"),
        F.when(F.col("own"), end).cast("long").alias("train_end"),
    )
