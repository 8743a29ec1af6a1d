"""Chat formatting by quotation linking, in DataFrame operations only.

Lines that begin with ``>`` are quotes, the number of marks being their level.
A run of lines of one level is a passage. Passages and their lines are
normalised and hashed, and joined to the paragraphs and lines that earlier
messages of the conversation wrote themselves; the latest such message is the
original. A message replies to the original of its shallowest quotes, else to the
message before it: deeper ones are what the quoted message quoted. The
conversation comes out in reply order, without quotes: a message, then what
replies to it, each with all that replies to that in turn, in order of turns.

Reply order is a walk through the tree of replies. Runs of messages that each
reply to the one before are one node of it; the walk is a linked list of entries
and exits, and its places come from doubling jumps along the list, so that no
task holds a conversation. What a conversation is sorted by goes in blocks.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .lines import ascii_lower
from .storage import ROW_ID, dropped, saved, with_row_ids

MARKS = r"^[ \t]*(>[> \t]*)"
ATTRIBUTION = r"(?i)\b(wrote|schrieb|a écrit|escribió)[^:\n]*:\s*$"

#: Least length of a normalised line that is linked by itself (whole passages of any length are); turns that are numbered together.
MIN_CHARS, BLOCK = 12, 1_024

#: Stands for a null conv_id or turn.
NONE = -(1 << 63)


def normalised(text: Column) -> Column:
    """One space for each stretch of white space, none at the ends, A-Z lower-cased."""
    return ascii_lower(F.trim(F.regexp_replace(text, r"[ \t\n\x0B\f\r]+", " ")))


def _hashed(units: DataFrame) -> DataFrame:
    """With the 128-bit hash of ``unit`` and whether it is ``short``, without blank units."""
    units = units.withColumn("unit", normalised(F.col("unit"))).where("unit <> ''").withColumn("short", F.char_length("unit") < MIN_CHARS)
    return units.withColumn("h1", F.xxhash64("unit")).withColumn("h2", F.xxhash64(F.lit(1), "unit")).drop("unit")


def quoted_lines(messages: DataFrame) -> DataFrame:
    """The lines of messages that quote: conv_id, turn, role, at, line, level, content, attribution, passage, ``ROW_ID``."""
    some = messages.where(F.col("text").rlike(r"(?m)^[ \t]*>"))
    lines = some.select("conv_id", "turn", "role", *ROW_ID, F.posexplode(F.split("text", "\n", -1)).alias("at", "line"))
    level = F.length(F.regexp_replace(F.regexp_extract("line", MARKS, 1), "[^>]", ""))
    lines = lines.withColumn("level", level).withColumn("content", F.regexp_replace("line", MARKS, ""))
    message = Window.partitionBy(*ROW_ID).orderBy("at")  # a message's own lines
    attribution = (F.col("level") == 0) & F.col("line").rlike(ATTRIBUTION) & (F.lead("level", 1, 0).over(message) > 0)
    new = (F.col("level") != F.lag("level", 1, -1).over(message)).cast("int")
    return lines.withColumn("attribution", attribution).withColumn("passage", F.sum(new).over(message.rowsBetween(Window.unboundedPreceding, 0)))


def _originals(units: DataFrame, quotes: DataFrame) -> DataFrame:
    """``quotes`` with ``original``: the latest turn before their own whose units (conv_id, turn, h1, h2) hold the same text.

    Turns are looked up in blocks, so that a text which a long conversation
    repeats over and over doesn't meet in one task.
    """
    key = ["conv_id", "h1", "h2"]
    block = F.floor(F.col("turn") / BLOCK)
    keys = quotes.select(*key).distinct()
    units = units.join(keys, key, "left_semi").groupBy(*key, "turn").agg(F.lit(1).alias("own")).withColumn("block", block)
    quotes = quotes.withColumn("block", block)
    blocks = units.groupBy(*key, "block").agg(F.max("turn").alias("last")).unionByName(quotes.select(*key, "block", F.lit(None).cast("long").alias("last")))
    blocks = blocks.groupBy(*key, "block").agg(F.max("last").alias("last"))
    earlier = Window.partitionBy(*key).orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.select(*key, "block", F.max("last").over(earlier).alias("before"))
    both = quotes.withColumn("own", F.lit(0)).unionByName(units, allowMissingColumns=True)
    here = Window.partitionBy(*key, "block").orderBy("turn", "own").rowsBetween(Window.unboundedPreceding, 0)
    found = both.withColumn("inside", F.max(F.when(F.col("own") == 1, F.col("turn"))).over(here)).where("own = 0")
    return found.join(blocks, [*key, "block"], "left").withColumn("original", F.coalesce("inside", "before")).drop("own", "block", "inside", "before")


def _messages(conversations: DataFrame) -> DataFrame:
    return with_row_ids(
        conversations.select(
            F.coalesce(F.col("conv_id").cast("long"), F.lit(NONE)).alias("conv_id"),
            F.coalesce(F.col("turn").cast("long"), F.lit(NONE)).alias("turn"),
            F.col("role").cast("string").alias("role"),
            F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
        )
    )


def _shown(c: Column) -> Column:
    return F.when(c != NONE, c)


def _linked(messages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The quoting messages with ``body``, ``quotes`` and ``max_level``; their units with ``original`` (or null) and ``strength``.

    A link by a whole passage is stronger than one by a line of it, and that
    than one by a short passage.
    """
    lines = quoted_lines(messages)
    quoting = lines.where("level > 0").select("conv_id").distinct()

    # quotes: whole passages, and each of their lines
    who = ["conv_id", "turn", "role", *ROW_ID, "first_line", "level"]
    marked = lines.where("level > 0").withColumn("first_line", F.min("at").over(Window.partitionBy(*ROW_ID, "passage")))
    passages = marked.groupBy(*who).agg(F.sort_array(F.collect_list(F.struct("at", "content"))).alias("lines"))
    text = F.array_join(F.transform("lines", lambda x: x["content"]), "\n")
    asked = _hashed(passages.select(*who, F.lit(True).alias("whole"), text.alias("unit")).unionByName(marked.select(*who, F.lit(False).alias("whole"), F.col("content").alias("unit")))).where("whole or not short")

    # originals: whole bodies, paragraphs and lines that messages of these conversations wrote themselves
    plain = messages.where(~F.col("text").rlike(r"(?m)^[ \t]*>")).select("conv_id", "turn", F.col("text").alias("body"))
    own_line = (F.col("level") == 0) & ~F.col("attribution")
    bodies = lines.groupBy("conv_id", "turn", "role", *ROW_ID).agg(
        F.sort_array(F.collect_list(F.when(own_line, F.struct("at", "line")))).alias("own"),
        F.countDistinct(F.when(F.col("level") > 0, F.col("passage"))).alias("quotes"),
        F.max("level").alias("max_level"),
    )
    body = F.regexp_replace(F.array_join(F.transform("own", lambda x: x["line"]), "\n"), r"^(?:[ \t]*\n)+|(?:\n[ \t]*)+$", "")
    bodies = bodies.withColumn("body", body)
    written = plain.unionByName(bodies.select("conv_id", "turn", "body")).join(quoting, "conv_id", "left_semi")
    units = F.array_distinct(F.concat(F.array("body"), F.split("body", r"\n[ \t]*\n"), F.split("body", "\n")))
    units = _hashed(written.select("conv_id", "turn", F.explode(units).alias("unit")))

    strength = F.when(F.col("original").isNull(), -1).when(~F.col("whole"), 1).when(F.col("short"), 0).otherwise(2)
    return bodies, _originals(units, asked).withColumn("strength", strength)


def _next(rows: DataFrame, keys: list[str], at: str, down: bool = False) -> DataFrame:
    """Distinct rows (keys, at) with ``next``, the least greater ``at`` of the same keys (with ``down`` the greatest less), or null."""
    rows = rows.select(*keys, at).distinct().withColumn("block", F.floor(F.col(at) / BLOCK))
    order = (lambda c: F.desc(c)) if down else (lambda c: F.asc(c))
    edge = F.max(at) if down else F.min(at)
    blocks = rows.groupBy(*keys, "block").agg(edge.alias("edge"))
    blocks = blocks.select(*keys, "block", F.lead("edge").over(Window.partitionBy(*keys).orderBy(order("block"))).alias("beyond"))
    inside = F.lead(at).over(Window.partitionBy(*keys, "block").orderBy(order(at)))
    return rows.withColumn("inside", inside).join(blocks, [*keys, "block"]).select(*keys, at, F.coalesce("inside", "beyond").alias("next"))


def _last(marks: DataFrame, rows: DataFrame, keys: list[str], at: str) -> DataFrame:
    """``rows`` with ``head``, the greatest ``head`` of ``marks`` (keys, head) that is no greater than their ``at``; distinct rows are few in a block."""
    block = F.floor(F.col(at) / BLOCK)
    both = rows.withColumn("mark", F.lit(None).cast("long")).unionByName(marks.select(*keys, F.col("head").alias(at), F.col("head").alias("mark")), allowMissingColumns=True).withColumn("block", block)
    blocks = both.groupBy(*keys, "block").agg(F.max("mark").alias("edge"))
    earlier = Window.partitionBy(*keys).orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.select(*keys, "block", F.max("edge").over(earlier).alias("before"))
    inside = Window.partitionBy(*keys, "block").orderBy(at, F.asc_nulls_last("mark")).rowsBetween(Window.unboundedPreceding, 0)
    found = both.withColumn("inside", F.max("mark").over(inside)).where("mark is null")
    return found.join(blocks, [*keys, "block"]).withColumn("head", F.coalesce("inside", "before")).drop("block", "mark", "inside", "before")


def reply_places(messages: DataFrame) -> DataFrame:
    """(conv_id, place, reply_place) of messages (conv_id, place, parent): places in the walk through the tree of replies, for conversations where it differs.

    Places count from 0 without gaps; a parent's is less, and null only for the
    first. Replies to a message come in order of their places.
    """
    branches = saved(messages.where("parent is not null and parent <> place - 1").select("conv_id", F.col("place").alias("head"), "parent"), "branches")
    sizes = messages.join(branches.select("conv_id").distinct(), "conv_id", "left_semi").groupBy("conv_id").agg(F.count(F.lit(1)).alias("total"))
    sizes = saved(sizes, "sizes")
    heads = branches.select("conv_id", "head").unionByName(sizes.select("conv_id", F.lit(0).cast("long").alias("head")))
    conv = ["conv_id"]

    # runs of messages: where they end, and which run a parent lies in
    runs = _next(heads, conv, "head").join(sizes, "conv_id").select("conv_id", "head", (F.coalesce("next", "total") - F.col("head")).alias("size"), "total")
    runs = saved(runs, "runs")
    parents = saved(_last(heads, branches.select("conv_id", "parent").distinct(), conv, "parent").withColumnRenamed("head", "owner"), "owners")

    # of a run the children by parent from the last, and of one parent by place
    above = saved(_next(branches, ["conv_id", "parent"], "head"), "siblings")
    least = above.groupBy("conv_id", "parent").agg(F.min("head").alias("least"))
    lower = _next(parents, ["conv_id", "owner"], "parent", down=True).withColumnRenamed("next", "lower")
    lower = lower.join(least.select("conv_id", F.col("parent").alias("lower"), F.col("least").alias("beyond")), ["conv_id", "lower"], "left").select("conv_id", "owner", "parent", "beyond")
    lower = saved(lower, "lower")
    after = above.join(lower.hint("merge"), ["conv_id", "parent"]).select("conv_id", "head", "owner", F.coalesce("next", "beyond").alias("sibling"))
    last = parents.groupBy("conv_id", "owner").agg(F.max("parent").alias("parent"))
    child = last.join(least, ["conv_id", "parent"]).select("conv_id", F.col("owner").alias("head"), F.col("least").alias("child"))

    # entries are 2 * head, exits 2 * head + 1
    every = runs.join(child, ["conv_id", "head"], "left").join(after, ["conv_id", "head"], "left")
    leave = F.coalesce(F.col("sibling") * 2, F.col("owner") * 2 + 1)
    enter = F.coalesce(F.col("child") * 2, F.col("head") * 2 + 1)
    steps = every.select("conv_id", F.explode(F.array(
        F.struct((F.col("head") * 2).alias("at"), enter.alias("next"), F.col("size").alias("left")), F.struct((F.col("head") * 2 + 1).alias("at"), leave.alias("next"), F.lit(0).cast("long").alias("left"))
    )).alias("x")).select("conv_id", "x.*")
    steps = saved(steps, "steps")
    while not steps.where("next is not null").isEmpty():
        ahead = steps.select("conv_id", F.col("at").alias("next"), F.col("next").alias("far"), F.col("left").alias("more"))
        further = steps.join(ahead, ["conv_id", "next"], "left").select("conv_id", "at", F.col("far").alias("next"), (F.col("left") + F.coalesce("more", F.lit(0))).alias("left"))
        further = saved(further, "steps")
        dropped(steps)
        steps = further
    entries = steps.where("at % 2 = 0").select("conv_id", (F.col("at") / 2).cast("long").alias("head"), "left")
    starts = saved(runs.join(entries, ["conv_id", "head"]).select("conv_id", "head", (F.col("total") - F.col("left")).alias("start")), "starts")

    some = messages.join(sizes.select("conv_id"), "conv_id", "left_semi").select("conv_id", "place")
    owned = saved(_last(starts, some, conv, "place"), "owned")
    dropped(branches, sizes, runs, parents, above, lower, steps)
    return owned.join(starts.hint("merge"), ["conv_id", "head"]).select("conv_id", "place", (F.col("start") + F.col("place") - F.col("head")).alias("reply_place"))  # a long run can be split


def passage_links(conversations: DataFrame) -> DataFrame:
    """One row per quoted passage with text, of any level: conv_id, turn, role, first_line (from 0), level, original (a turn or null)."""
    _, found = _linked(_messages(conversations))
    best = found.groupBy("conv_id", "turn", "role", *ROW_ID, "first_line", "level").agg(F.max(F.struct("strength", "original"))["original"].alias("original"))
    return best.select(_shown(F.col("conv_id")).alias("conv_id"), _shown(F.col("turn")).alias("turn"), "role", "first_line", "level", _shown(F.col("original")).alias("original"))


def reply_ordered(conversations: DataFrame) -> DataFrame:
    """One row per row of ``conversations`` (conv_id, turn, role, text): conv_id, turn, role, position, reply_position, reply_to, linked, quotes, max_level, body.

    ``position`` counts the messages of a conversation from 0 by turn, equal turns
    by role and file order. ``reply_position`` counts them in reply order: behind
    a message come its replies by position, each with all that replies to it.
    ``reply_to`` is a turn, or null for the first
    message. ``linked`` says that quotes decided on it: those of the shallowest
    level with text in the message, first whole passages, then lines of MIN_CHARS
    or more, then whole passages that are shorter. ``quotes`` counts passages,
    and ``body`` is the text without quotes and the lines that announce them,
    null texts being empty; texts of any length are read whole. A null conv_id is
    one conversation; a null turn comes before all others. Repeated rows have
    positions of their own. An empty table gives an empty result; other columns,
    whatever their names, are not read.
    """
    messages = _messages(conversations)
    bodies, found = _linked(messages)
    links = found.groupBy(*ROW_ID).agg(F.max(F.struct(-F.col("level"), "strength", "original"))["original"].alias("original"))
    with_quotes = bodies.join(links, list(ROW_ID), "left").select("conv_id", "turn", "role", *ROW_ID, "body", "quotes", "max_level", "original")
    without = messages.where(~F.col("text").rlike(r"(?m)^[ \t]*>")).select(
        "conv_id", "turn", "role", *ROW_ID, F.col("text").alias("body"), F.lit(0).cast("long").alias("quotes"), F.lit(0).alias("max_level"), F.lit(None).cast("long").alias("original")
    )
    every = with_quotes.unionByName(without).withColumn("block", F.floor(F.col("turn") / BLOCK))

    # places, in blocks of turns (those without a turn in blocks of their files): a long conversation is numbered by many tasks
    unturned = F.col("turn") == NONE
    every = every.withColumns({"by_role": F.when(unturned, F.col("role")), "by_file": F.when(unturned, F.col(ROW_ID[0])), "by_rows": F.when(unturned, F.floor(F.col(ROW_ID[1]) / BLOCK))})
    cell = ["block", "by_role", "by_file", "by_rows"]
    inside = Window.partitionBy("conv_id", *cell).orderBy("turn", "role", *ROW_ID)
    blocks = every.groupBy("conv_id", *cell).agg(F.count(F.lit(1)).alias("n"), F.max("turn").alias("last"))
    earlier = Window.partitionBy("conv_id").orderBy(*cell).rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.select("conv_id", *cell, F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("offset"), F.max("last").over(earlier).alias("turn_before"))
    every = every.withColumn("place", F.row_number().over(inside) - 1).withColumn("turn_above", F.lag("turn").over(inside))
    same = [F.col(f"e.{c}").eqNullSafe(F.col(f"b.{c}")) for c in ("conv_id", *cell)]
    placed = every.alias("e").join(blocks.alias("b"), reduce(Column.__and__, same)).select("e.*", "offset", "turn_before")
    placed = placed.select("*", (F.col("offset") + F.col("place")).cast("long").alias("position"), F.coalesce("original", "turn_above", "turn_before").alias("reply_to"))
    placed = saved(placed.select("conv_id", "turn", "role", "position", "reply_to", "original", "quotes", F.col("max_level").cast("long").alias("max_level"), "body"), "placed")

    # in reply order: what has no link replies to the message before it
    linked = placed.where("original is not null").select("conv_id", "position", F.col("original").alias("turn"))
    first = placed.join(linked.select("conv_id", "turn").distinct(), ["conv_id", "turn"], "left_semi").groupBy("conv_id", "turn").agg(F.min("position").alias("found"))
    found = saved(linked.join(first.hint("merge"), ["conv_id", "turn"]).select("conv_id", "position", "found"), "found")
    tree = placed.select("conv_id", "position").join(found.hint("merge"), ["conv_id", "position"], "left")
    tree = saved(tree.select("conv_id", F.col("position").alias("place"), F.coalesce("found", F.when(F.col("position") > 0, F.col("position") - 1)).alias("parent")), "tree")
    places = saved(reply_places(tree).withColumnRenamed("place", "position"), "places")
    dropped(found, tree)
    return placed.join(places.hint("merge"), ["conv_id", "position"], "left").select(
        _shown(F.col("conv_id")).alias("conv_id"),
        _shown(F.col("turn")).alias("turn"),
        "role",
        "position",
        F.coalesce("reply_place", "position").alias("reply_position"),
        _shown(F.col("reply_to")).alias("reply_to"),
        F.col("original").isNotNull().alias("linked"),
        "quotes",
        "max_level",
        "body",
    )
