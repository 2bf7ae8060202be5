"""Chat formatting: budgeted windows over conversations, with a loss mask.

Prefix sums of turn tokens deal a conversation's turns into spans at turn
boundaries.  A window is the conversation's system turn, a limited history of
the turns before its span, and the span, all within the budget; only the span's
assistant texts are under the loss mask, so repeated targets are never learnt twice.  Control strings
inside roles and texts are escaped reversibly.  Everything is DataFrame functions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import saved

#: The template's control strings.
START, END = "<|im_start|>", "<|im_end|>"
#: Tokens per window, and most turns and tokens of repeated history.
BUDGET, HISTORY_TURNS, HISTORY_TOKENS = 512, 2, 256
#: Tokens that the template adds to a turn.
TEMPLATE_TOKENS = 5
#: Turn numbers per block of the two-level prefix sums, and turns after which a span ends in any case.
BLOCK = 256


def escape(text: Column) -> Column:
    """Add a backslash between ``<`` and ``|`` (also after earlier backslashes): no control string is left."""
    return F.regexp_replace(text, r"<(\\*)\|", r"<\\$1|")


def unescape(text: Column) -> Column:
    """Undo :func:`escape`."""
    return F.regexp_replace(text, r"<\\(\\*)\|", r"<$1|")


def escape_role(role: Column) -> Column:
    """Escape a role for the first line of a turn: as a text, and without line breaks."""
    return escape(F.replace(F.replace(role, F.lit("\\"), F.lit("\\s")), F.lit("\n"), F.lit("\\n")))


def unescape_role(role: Column) -> Column:
    """Undo :func:`escape_role`."""
    return F.replace(F.replace(unescape(role), F.lit("\\n"), F.lit("\n")), F.lit("\\s"), F.lit("\\"))


def formatted_turn(role: Column, text: Column) -> Column:
    """One turn in the template."""
    return F.concat(F.lit(START), escape_role(role), F.lit("\n"), escape(text), F.lit(END + "\n"))


def turn_tokens(text: Column) -> Column:
    """Tokens of a turn: its words and the template's tokens."""
    return F.size(F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda w: w != "")) + F.lit(TEMPLATE_TOKENS)


def indexed_turns(conversations: DataFrame) -> DataFrame:
    """Turns with their place in the conversation and the tokens before them.

    Both are two-level prefix sums: over blocks of :data:`BLOCK` turn numbers, and
    over the blocks' totals, so a conversation that holds a third of all turns is
    dealt over its blocks.
    """
    turns = conversations.select(
        "conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"),
        F.coalesce(F.floor(F.col("turn") / BLOCK), F.lit(-1 << 60)).alias("block")).withColumn(
        "tokens", turn_tokens(F.col("text")))
    inside = Window.partitionBy("conv_id", "block").orderBy(F.asc_nulls_first("turn"), "role", "text")
    placed = turns.select("*", F.row_number().over(inside).alias("place"),
                          (F.sum("tokens").over(inside.rowsBetween(Window.unboundedPreceding, 0)) - F.col("tokens")).alias("ahead"))
    earlier = Window.partitionBy("c").orderBy("b").rowsBetween(Window.unboundedPreceding, -1)
    blocks = turns.groupBy(F.col("conv_id").alias("c"), F.col("block").alias("b")).agg(
        F.sum("tokens").alias("t"), F.count(F.lit(1)).alias("n")).select(
        "c", "b", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("n0"),
        F.coalesce(F.sum("t").over(earlier), F.lit(0)).alias("t0"))
    both = placed.join(blocks, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("block") == F.col("b")))
    return both.select("conv_id", (F.col("place") + F.col("n0")).alias("idx"), "role", "text", "tokens",
                       (F.col("ahead") + F.col("t0")).alias("before"))


def dealt_turns(turns: DataFrame, budget: int, history_turns: int, history_tokens: int) -> DataFrame:
    """``conv_id, idx, before, window, room``: the place of the turn each turn's span starts with, and the tokens of history it may repeat.

    What a window repeats depends on its first turn only, so a span that starts there
    holds the turns whose prefix sums end within the budget less that.  Spans are laid
    one after another inside blocks of :data:`BLOCK` turns (and end with them), so a
    long conversation is dealt over its blocks.
    """
    def whole(number: int | Column) -> Column:
        return (F.lit(number) if isinstance(number, int) else number).cast("long")

    system = turns.where((F.col("idx") == 1) & (F.col("role") == "system")).select(
        F.col("conv_id").alias("sc"), whole(F.col("tokens")).alias("system"))
    block = F.floor((F.col("idx") - 1) / BLOCK)
    held = turns.select("conv_id", "idx", whole(F.col("tokens")).alias("tokens"), "before", F.explode(F.sequence(
        block, F.floor((F.col("idx") - 1 + history_turns) / BLOCK))).alias("block"))  # also as history of the next block
    blocks = held.groupBy("conv_id", "block").agg(F.array_sort(F.collect_list(F.struct("idx", "tokens", "before"))).alias("all"))
    joined = blocks.join(system, F.col("conv_id").eqNullSafe(F.col("sc")), "left")

    def fixed(turn: Column) -> Column:
        return F.when(turn["idx"] > 1, F.coalesce("system", whole(0))).otherwise(whole(0))

    def room(turn: Column) -> Column:
        return F.greatest(whole(0), F.least(whole(history_tokens), whole(budget) - turn["tokens"] - fixed(turn)))

    def repeated(turn: Column, at: Column) -> Column:
        lowest = F.when(F.col("system").isNull(), 1).otherwise(2)
        cost = [whole(0)]
        for back in range(1, history_turns + 1):
            old = F.get(F.col("all"), at - back)
            took = turn["before"] - old["before"]
            cost.append(F.when((old["idx"] >= lowest) & (took <= room(turn)), took))
        return fixed(turn) + (F.greatest(*cost) if history_turns else cost[0])

    priced = F.filter(F.transform("all", lambda turn, at: F.struct(
        turn["idx"].alias("idx"), turn["before"].alias("before"), (turn["before"] + turn["tokens"]).alias("upto"), room(turn).alias("room"),
        (turn["before"] + budget - repeated(turn, at)).alias("limit"))), lambda t: t["idx"] > F.col("block") * BLOCK)

    def lay(spans: Column, turn: Column) -> Column:
        fresh = (spans["window"] == 0) | (turn["upto"] > spans["limit"])
        window = F.when(fresh, turn["idx"]).otherwise(spans["window"])
        return F.struct(window.alias("window"), F.when(fresh, turn["limit"]).otherwise(spans["limit"]).alias("limit"),
                        F.concat(spans["turns"], F.array(F.struct(
                            turn["idx"].alias("idx"), turn["before"].alias("before"), window.alias("window"), turn["room"].alias("room")))).alias("turns"))

    none = F.struct(whole(0).alias("window"), whole(0).alias("limit"),
                    F.array().cast("array<struct<idx:bigint,before:bigint,window:bigint,room:bigint>>").alias("turns"))
    return joined.select("conv_id", F.explode(F.aggregate(priced, none, lay, lambda spans: spans["turns"])).alias("t")).select("conv_id", "t.*")


def format_windows(conversations: DataFrame, budget: int = BUDGET, history_turns: int = HISTORY_TURNS,
                   history_tokens: int = HISTORY_TOKENS) -> DataFrame:
    """``conv_id, window, text, turns, loss``: the formatted windows of every conversation.

    ``window`` is the place of its first new turn.  A window repeats the first turn
    if it is a system turn, and of the ``history_turns`` turns before its span the
    last that fit ``history_tokens`` and the budget together.  Repeated and new turns
    stay within ``budget`` tokens, unless the system turn and one new turn alone do
    not; then the window holds just these.  ``turns`` has ``at, chars, repeated`` for
    each turn in the window's text, ``loss`` has ``at, chars`` of the assistant texts
    under the loss mask, all in code points.

    Null roles and texts are empty; turns are ordered by number (nulls first), role
    and text, and repeated rows are turns of their own; null conversation ids form
    one conversation; an empty table has no windows; other columns are ignored.
    """
    turns = saved(indexed_turns(conversations), "turns")
    laid = saved(dealt_turns(turns, budget, history_turns, history_tokens), "spans")
    starts = laid.where("idx = window").select("conv_id", "window", F.col("idx").alias("start"), F.col("before").alias("upto"), "room")
    wanted = starts.select(
        F.col("conv_id").alias("c"), F.col("window").alias("w"), "upto", "start", F.col("room").alias("left"),
        F.explode(F.array_distinct(F.filter(
            F.concat(F.array(F.lit(1).cast("long")), F.transform(
                F.sequence(F.lit(1), F.lit(max(history_turns, 1))), lambda back: F.col("start") - back)),
            lambda i: (i >= 1) & (i < F.col("start"))))).alias("i"))
    repeats = turns.join(wanted, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("idx") == F.col("i")))
    kept = ((F.col("idx") == 1) & (F.col("role") == "system")) | (
        (F.col("start") - F.col("idx") <= history_turns) & (F.col("upto") - F.col("before") <= F.col("left")))
    old = repeats.where(kept).select("conv_id", F.col("w").alias("window"), "idx", "role", "text", F.lit(True).alias("repeated"))
    windows = laid.select(F.col("conv_id").alias("c"), F.col("idx").alias("i"), "window")
    new = turns.join(windows, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("idx") == F.col("i"))).select(
        "conv_id", "window", "idx", "role", "text", F.lit(False).alias("repeated"))
    parts = old.unionByName(new).select(
        "conv_id", "window", "idx", "repeated", formatted_turn(F.col("role"), F.col("text")).alias("part"),
        F.when((F.col("role") == "assistant") & ~F.col("repeated"), F.length(escape(F.col("text")))).alias("target"))
    rows = parts.groupBy("conv_id", "window").agg(F.array_sort(F.collect_list(
        F.struct("idx", "repeated", "part", "target"))).alias("parts"))
    ends = F.aggregate("parts", F.array(F.lit(0)), lambda acc, p: F.concat(
        acc, F.array(F.element_at(acc, -1) + F.length(p["part"]))))
    placed = rows.withColumn("ends", ends)
    spans = F.zip_with("parts", F.slice("ends", 1, F.size("parts")), lambda p, at: F.struct(
        at.alias("at"), F.length(p["part"]).alias("chars"), p["repeated"].alias("repeated"), p["target"].alias("target")))
    tail = len(END) + 1
    return placed.withColumn("spans", spans).select(
        "conv_id", "window", F.concat_ws("", F.transform("parts", lambda p: p["part"])).alias("text"),
        F.transform("spans", lambda s: F.struct(s["at"].alias("at"), s["chars"].alias("chars"),
                                                s["repeated"].alias("repeated"))).alias("turns"),
        F.transform(F.filter("spans", lambda s: s["target"].isNotNull()), lambda s: F.struct(
            (s["at"] + s["chars"] - tail - s["target"]).alias("at"), s["target"].alias("chars"))).alias("loss"))


def digests(windows: DataFrame) -> DataFrame:
    """One row per conversation, read back from its windows' texts, turn spans and loss masks.

    The contract wants digests of a whole conversation's text, so a conversation's
    unescaped text meets in one row here (and only here).
    """
    def piece(span: Column) -> Column:
        return F.substring(F.col("text"), span["at"] + 1, span["chars"])

    def turn(span: Column) -> Column:
        body = F.substring(F.col("text"), span["at"] + len(START) + 1, span["chars"] - len(START) - len(END) - 1)
        role = F.substring_index(body, "\n", 1)
        text = F.substring(body, F.length(role) + 2, F.length(body))
        return F.concat(unescape_role(role), F.lit("\n"), unescape(text), F.lit("\n"))

    new = F.filter("turns", lambda s: ~s["repeated"])
    read = windows.select(
        "conv_id", "window", F.size(new).alias("n"), F.length("text").alias("chars"),
        F.concat_ws("", F.transform(new, turn)).alias("said"),
        F.concat_ws("", F.transform("loss", lambda s: unescape(piece(s)))).alias("learnt"))
    joined = read.groupBy("conv_id").agg(
        F.sum("n").alias("n_turns"), F.sum("chars").alias("formatted_chars"),
        F.array_sort(F.collect_list(F.struct("window", "said", "learnt"))).alias("all"))
    said = F.concat_ws("", F.transform("all", lambda w: w["said"]))
    learnt = F.concat_ws("", F.transform("all", lambda w: w["learnt"]))
    return joined.select(
        "conv_id", "n_turns", F.sha2(said.cast("binary"), 256).alias("turns_sha256"),
        F.length(learnt).cast("long").alias("loss_chars"), F.sha2(learnt.cast("binary"), 256).alias("loss_sha256"),
        "formatted_chars")
