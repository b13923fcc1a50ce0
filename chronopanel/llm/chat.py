"""Chat formatting of logged conversations, of which only the longest snapshots are kept.

Logs hold a conversation again and again while it grows. Each turn gets the hash of its place, role and
text; the exclusive or of the hashes up to a turn stands for the conversation until there. A conversation
is dropped if its whole hash is that of another one's turns before some turn (an anti-join), and of equal
conversations the least id stays. What remains is rendered, with a start and an end mark around each turn.

Turns are taken in order of turn, role and text; exactly repeated rows count once. A turn's place is its rank in
the conversation, so gaps in the numbers and the number of the first turn do not matter. Long conversations are
dealt into blocks of `block_turns` turn numbers: ranks and running hashes are made within blocks and carried
from block to block by the blocks' totals. A rendered conversation has a row for each `block_turns` of its turns
(`part`), so no row holds more, however turns are numbered; turns that share one number are ranked in one task,
which may spill.

Rows without a conversation id belong to no conversation and are left out. Null turns stand before all
others in a block of their own; null roles render as `unknown`, null texts as empty, and they hash unlike
those words. Other columns are not passed on. Marks that stand in a text are rendered as they are, so a reader
of the rendered string alone can take them for turns; escape them before where that matters.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from chronopanel.llm.common import stored

START, END = "<|im_start|>", "<|im_end|>"
BLOCK_TURNS = 1024


def prefixes(turns: DataFrame, block_turns: int = BLOCK_TURNS) -> DataFrame:
    """conv, role, text and of each turn: n, a, b (turns and hashes up to it), own_a, own_b."""
    rows = turns.select(F.col("conv_id").alias("conv"), F.col("turn").cast("bigint").alias("turn"), "role", "text").where("conv is not null").distinct()
    rows = rows.withColumn("block", F.coalesce(F.floor(F.col("turn") / block_turns), F.lit(-(1 << 62))))
    order = Window.partitionBy("conv", "block").orderBy("turn", "role", "text")
    upto = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    before = Window.partitionBy("conv").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    carried = lambda c: F.coalesce(c.over(before), F.lit(0))
    sizes = rows.groupBy("conv", "block").agg(F.count("*").alias("size")).select("conv", "block", carried(F.sum("size")).alias("n0"))
    placed = rows.withColumn("at", F.row_number().over(order)).join(sizes, ["conv", "block"]).withColumn("n", F.col("at") + F.col("n0"))
    nulls = F.isnull("role"), F.isnull("text")
    own = {f"own_{x}": F.xxhash64(F.lit(seed), "n", "role", "text", *nulls) for x, seed in (("a", 1), ("b", 2))}
    hashed = placed.withColumns(own)
    totals = hashed.groupBy("conv", "block").agg(*[F.bit_xor(f"own_{x}").alias(x) for x in "ab"])
    totals = totals.select("conv", "block", *[carried(F.bit_xor(x)).alias(f"{x}0") for x in "ab"])
    run = hashed.withColumns({x: F.bit_xor(f"own_{x}").over(upto) for x in "ab"}).join(totals, ["conv", "block"])
    return run.select("conv", "role", "text", "n", *[F.col(x).bitwiseXOR(F.col(f"{x}0")).alias(x) for x in "ab"], "own_a", "own_b")


def maximal(states: DataFrame) -> DataFrame:
    """conv, n_turns and n_copies (equal conversations, itself included) of those that no longer one continues."""
    whole = states.groupBy("conv").agg(F.max(F.struct("n", "a", "b")).alias("last")).select("conv", "last.*")
    distinct = whole.groupBy("n", "a", "b").agg(F.min("conv").alias("conv"), F.count("*").alias("n_copies"))
    continued = states.where("n > 1").select((F.col("n") - 1).alias("n"), *[F.col(x).bitwiseXOR(F.col(f"own_{x}")).alias(x) for x in "ab"]).distinct()
    return distinct.join(continued, ["n", "a", "b"], "left_anti").select("conv", F.col("n").alias("n_turns"), "n_copies")


def format_chats(turns: DataFrame, block_turns: int = BLOCK_TURNS) -> DataFrame:
    """conv_id, part (from 0), n_turns and n_copies (of the conversation), rendered."""
    states = stored(prefixes(turns, block_turns), "turns")
    kept = maximal(states)
    piece = F.concat(F.lit(START), F.coalesce("role", F.lit("unknown")), F.lit("\n"), F.coalesce("text", F.lit("")), F.lit(END + "\n"))
    part = F.floor((F.col("n") - 1) / block_turns).cast("int").alias("part")
    said = states.select("conv", part, "n", piece.alias("piece")).join(kept, "conv")
    parts = said.groupBy("conv", "part", "n_turns", "n_copies").agg(F.sort_array(F.collect_list(F.struct("n", "piece"))).alias("pieces"))
    return parts.select(F.col("conv").alias("conv_id"), "part", "n_turns", "n_copies", F.array_join(F.col("pieces.piece"), "").alias("rendered"))
