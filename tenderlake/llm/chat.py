"""Chat formatting with collapse of cumulative snapshots. DataFrame operations only.

Systems that log a conversation after every turn leave many prefixes of it. Each conversation gets a
rolling hash of its turns: at every turn the exclusive or of the hashes of all turns so far, each of
which holds the turn's number, role and text. A conversation whose last hash is another's hash at an
earlier turn is a prefix of it; an anti-join leaves the maximal ones, which are rendered.

Running hashes are taken within blocks of turns and carried from block to block, so a conversation
of any length is spread over tasks. Equal conversations and equal prefixes are reduced to one row
before they meet.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tenderlake.llm.store import keep

# Turn numbers in one block: what one task sorts, and what one rendered part holds.
BLOCK = 512
# The template of a rendered turn.
OPEN, BREAK, CLOSE = "<|im_start|>", "\n", "<|im_end|>\n"


def rendered_turn(role: Column, text: Column) -> Column:
    return F.concat(F.lit(OPEN), F.coalesce(role, F.lit("unknown")), F.lit(BREAK), F.coalesce(text, F.lit("")), F.lit(CLOSE))


def _plain(conversations: DataFrame) -> DataFrame:
    return conversations.select(
        conversations["conv_id"].cast("bigint").alias("conv_id"), conversations["turn"].cast("bigint").alias("turn"), F.col("role").cast("string").alias("role"), F.col("text").cast("string").alias("text")
    )


def prefix_hashes(turns: DataFrame, block: int = BLOCK) -> DataFrame:
    """(conv_id, turn, h1, h2, n, last): two rolling hashes and the number of rows up to each turn number.

    Rows of one turn number enter together, so their order does not matter; repeated rows enter once.
    """
    content = lambda seed: F.xxhash64(F.lit(seed), "turn", F.coalesce("role", F.lit("\0")), F.coalesce("text", F.lit("\0")))
    rows = turns.select("conv_id", "turn", content(1).alias("a"), content(2).alias("b"))
    # A repeated row would cancel itself in the exclusive or.
    rows = rows.groupBy("conv_id", "turn", "a", "b").agg(F.lit(1).alias("one"))
    rows = rows.groupBy("conv_id", "turn").agg(F.bit_xor("a").alias("a"), F.bit_xor("b").alias("b"), F.count(F.lit(1)).alias("m"))
    rows = keep(rows.withColumn("block", F.expr(f"turn div {block}")), "turn-hashes")
    blocks = rows.groupBy("conv_id", "block").agg(F.bit_xor("a").alias("ba"), F.bit_xor("b").alias("bb"), F.sum("m").alias("bm"), F.max("turn").alias("bt"))
    before = Window.partitionBy("conv_id").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    after = Window.partitionBy("conv_id")
    blocks = blocks.select(
        "conv_id", "block",
        F.coalesce(F.bit_xor("ba").over(before), F.lit(0).cast("bigint")).alias("ca"),
        F.coalesce(F.bit_xor("bb").over(before), F.lit(0).cast("bigint")).alias("cb"),
        F.coalesce(F.sum("bm").over(before), F.lit(0).cast("bigint")).alias("cm"),
        F.max("bt").over(after).alias("end"),
    )
    within = Window.partitionBy("conv_id", "block").orderBy("turn")
    running = rows.select(
        "conv_id", "block", "turn", F.bit_xor("a").over(within).alias("a"), F.bit_xor("b").over(within).alias("b"), F.sum("m").over(within).alias("m")
    )
    return running.join(keep(blocks, "block-hashes"), ["conv_id", "block"]).select(
        "conv_id", "turn", F.col("a").bitwiseXOR(F.col("ca")).alias("h1"), F.col("b").bitwiseXOR(F.col("cb")).alias("h2"), (F.col("m") + F.col("cm")).alias("n"),
        (F.col("turn") == F.col("end")).alias("last"),
    )


def maximal_conversations(conversations: DataFrame) -> DataFrame:
    """(conv_id, copies): the conversations that no longer one continues, and how many equal ones each stands for.

    Of equal conversations the smallest conv_id stays. Turns are compared by number, role and text,
    nulls as values of their own. Rows without conv_id or turn belong to no conversation.
    """
    turns = _plain(conversations).filter("conv_id is not null and turn is not null")
    hashes = keep(prefix_hashes(turns), "prefixes")
    same = ["h1", "h2", "n", "turn"]
    whole = hashes.filter("last").groupBy(*same).agg(F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("copies"))
    prefixes = hashes.filter(~F.col("last")).groupBy(*same).agg(F.lit(1).alias("one")).select(*same)
    return whole.join(prefixes, same, "left_anti").select("conv_id", "copies")


def format_chats(conversations: DataFrame, block: int = BLOCK) -> DataFrame:
    """(conv_id, part, n_turns, copies, text): the maximal conversations as text.

    Turns stand in the order of turn, role and text; a repeated row stands once. A conversation is
    rendered in parts of ``block`` turn numbers, part 0 first, whose texts follow each other without
    anything between, so no row grows without bound. A null role is rendered as "unknown", a null text
    as empty. Rows without conv_id or turn can be placed in no conversation: each is rendered on its
    own, with part null. Other columns are not read. An empty table gives no rows.
    """
    turns = _plain(conversations)
    placed = turns.filter("conv_id is not null and turn is not null")
    kept = keep(maximal_conversations(conversations), "maximal")
    placed = placed.select("conv_id", F.expr(f"turn div {block}").alias("block"), F.struct("turn", F.col("role").isNotNull().alias("r"), "role", F.col("text").isNotNull().alias("t"), "text").alias("row"))
    parts = placed.join(kept, "conv_id").groupBy("conv_id", "copies", "block").agg(F.array_sort(F.collect_set("row")).alias("rows"))
    order = Window.partitionBy("conv_id").orderBy("block")
    joined = F.array_join(F.transform("rows", lambda r: rendered_turn(r["role"], r["text"])), "")
    parts = parts.select("conv_id", (F.row_number().over(order) - 1).cast("bigint").alias("part"), F.size("rows").cast("bigint").alias("n_turns"), "copies", joined.alias("text"))
    loose = turns.filter("conv_id is null or turn is null")
    loose = loose.select("conv_id", F.lit(None).cast("bigint").alias("part"), F.lit(1).cast("bigint").alias("n_turns"), F.lit(1).cast("bigint").alias("copies"), rendered_turn(F.col("role"), F.col("text")).alias("text"))
    return parts.unionByName(loose)
