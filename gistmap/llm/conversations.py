"""Conversations rebuilt from loose message rows, read as an event log.

0. Where a table has the columns ``version`` (or ``event``), the rows of a message_id are its history: the highest version
   counts (of equal ones the last to arrive), and a message whose last event is ``delete`` is gone.
1. Retries fold: rows alike in chat, number, role, text and sending time are one message (its first arrival).
   The folded messages, without their texts, are written once and read by every later step.
2. A message without number gets the free place its sending time points to. Only the ends of gapless
   runs of numbers and the unnumbered messages meet for that. They meet in blocks of time, and what a block needs from the
   others (the nearest ends, the number of messages before it in a gap) is one row per block, so a chat of very many unnumbered messages
   is spread too.
3. Messages fold to blocks of 512 numbers, blocks to larger blocks, and these to the chat. Each state is a small summary and the fold is associative, so a chat that
   holds a third of all rows is spread over as many tasks as it has blocks.

A summary keeps the said roles as a reduced word: ``u``/``a`` for the first and last said user or
assistant text, with what lies between reduced to one letter; two users in a row set ``waits``.

Defined results: rows with null chat_id belong to no chat; a null or unknown role breaks its chat; blank
and null texts are not said but keep their place; an unnumbered message without sending time takes
the lowest free number; a chat of unnumbered messages only is numbered by sending time. An empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gistmap.runtime import scratch_table

BLOCK = 512
LEVELS = 3
#: Events of one chat that are ordered in one piece (were they evenly spread in time).
EVENTS = 4_096
# Role spellings.
ROLES = {"user": "user", "human": "user", "assistant": "assistant", "model": "assistant", "ai": "assistant", "system": "system"}


def uniform_role(role: Column) -> Column:
    """user, assistant, system, or null for anything else; case and spaces aside."""
    plain = F.lower(F.regexp_replace(role, r"[\s\p{Z}\p{C}]+", ""))
    return F.try_element_at(F.create_map(*[x for k, v in ROLES.items() for x in (F.lit(k), F.lit(v))]), plain)


def is_said(text: Column) -> Column:
    return F.coalesce(F.regexp_replace(text, r"[\s\p{Z}\p{C}]+", "") != "", F.lit(False))


def fold_versions(messages: DataFrame) -> DataFrame:
    """The last state of every message of an event log; rows without message_id and tables without history stay as they are."""
    version = F.col("version").cast("bigint") if "version" in messages.columns else None
    event = F.lower(F.trim("event")) if "event" in messages.columns else None
    if version is None and event is None:
        return messages
    order = F.struct(F.coalesce(version, F.lit(0)) if version is not None else F.lit(0), F.col("arrived_at"), F.xxhash64("text"))
    known = messages.where(F.col("message_id").isNotNull()).groupBy("message_id").agg(F.max_by(F.struct(*messages.columns), order).alias("m")).select("m.*")
    rows = known.unionByName(messages.where(F.col("message_id").isNull()))
    return rows if event is None else rows.where(F.coalesce(event != "delete", F.lit(True)))


def fold_retries(messages: DataFrame) -> DataFrame:
    """One row per message: (chat_id, turn_index, role, known, said, sent_at, key, message_id)."""
    rows = fold_versions(messages).where(F.col("chat_id").isNotNull()).select(
        "chat_id",
        F.col("turn_index").cast("bigint").alias("turn_index"),
        F.coalesce(uniform_role(F.col("role")), F.lit("?") if "role" not in messages.columns else F.concat(F.lit("?"), F.coalesce(F.col("role"), F.lit("")))).alias("role"),
        F.xxhash64("text", F.length("text")).alias("key"),
        is_said(F.col("text")).alias("said"),
        "sent_at",
        "message_id",
        "arrived_at",
    )
    first = F.min(F.struct("arrived_at", "message_id")).alias("first")
    rows = rows.groupBy("chat_id", "turn_index", "role", "key", "said", "sent_at").agg(first)
    return rows.select("chat_id", "turn_index", F.when(~F.col("role").startswith("?"), F.col("role")).alias("role"), "key", "said", "sent_at", F.col("first.message_id").alias("message_id"))


def folded_table(messages: DataFrame) -> DataFrame:
    """The folded messages, written once: the steps after read them several times."""
    return scratch_table(fold_retries(messages), "messages")


def place_unnumbered(folded: DataFrame) -> DataFrame:
    """Give every message without ``turn_index`` its number.

    For a message sent at s the last known run end or start before s decides: after an end, the next
    number; otherwise the number before the next start. Several in one gap follow one another by time.
    """
    loose = folded.where(F.col("turn_index").isNull())
    # only chats with loose messages take part; the semi join's key side is small
    numbered = folded.where(F.col("turn_index").isNotNull())
    chats = loose.select("chat_id").distinct()
    places = numbered.join(chats, "chat_id", "left_semi").groupBy("chat_id", "turn_index").agg(
        F.min("sent_at").alias("lo"), F.max("sent_at").alias("hi")
    )
    # written, as both kinds of ends and the places after and before them come from it
    places = scratch_table(places, "places")
    nxt = places.select("chat_id", (F.col("turn_index") - 1).alias("turn_index"))
    prv = places.select("chat_id", (F.col("turn_index") + 1).alias("turn_index"))
    key = ["chat_id", "turn_index"]
    ends = places.join(nxt, key, "left_anti").select("chat_id", F.col("hi").alias("at"), F.lit(0).alias("kind"), "turn_index", F.lit(None).cast("bigint").alias("message_id"))
    starts = places.join(prv, key, "left_anti").select("chat_id", F.col("lo").alias("at"), F.lit(2).alias("kind"), "turn_index", F.lit(None).cast("bigint").alias("message_id"))
    asks = loose.select("chat_id", F.col("sent_at").alias("at"), F.lit(1).alias("kind"), F.lit(None).cast("bigint").alias("turn_index"), "message_id")
    events = ends.unionByName(starts).unionByName(asks)
    timed = events.where(F.col("at").isNotNull()).withColumn("at", F.unix_micros("at"))
    # blocks of time, so long that a chat of n events has about n / EVENTS of them
    spans = timed.groupBy("chat_id").agg(F.min("at").alias("since"), (F.floor((F.max("at") - F.min("at")) / F.ceil(F.count("*") / EVENTS)) + 1).alias("width"))
    timed = timed.join(spans, "chat_id").withColumn("block", F.floor((F.col("at") - F.col("since")) / F.col("width"))).drop("since", "width")
    timed = scratch_table(timed, "events")
    mark = F.when(F.col("kind") != 1, F.struct("kind", "turn_index"))
    place = F.when(F.col("kind") != 1, F.struct("at", "kind", "turn_index"))
    blocks = timed.groupBy("chat_id", "block").agg(F.max_by(mark, place).alias("last"), F.min_by(mark, place).alias("first"))
    along = Window.partitionBy("chat_id").orderBy("block")
    blocks = blocks.select(
        "chat_id", "block", F.last("last", ignorenulls=True).over(along.rowsBetween(Window.unboundedPreceding, -1)).alias("earlier"),
        F.first("first", ignorenulls=True).over(along.rowsBetween(1, Window.unboundedFollowing)).alias("later"),
    )
    order = Window.partitionBy("chat_id", "block").orderBy("at", "kind", "turn_index", "message_id")
    timed = timed.withColumn("before", F.last(mark, ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, -1)))
    timed = timed.withColumn("after", F.first(mark, ignorenulls=True).over(order.rowsBetween(1, Window.unboundedFollowing)))
    asks = timed.where(F.col("kind") == 1).join(blocks, ["chat_id", "block"]).withColumn("before", F.coalesce("before", "earlier")).withColumn("after", F.coalesce("after", "later"))
    # rank among the loose messages of the same gap: in the block, and behind those of earlier blocks
    gap = ["chat_id", "g1", "g2"]
    asks = asks.withColumn("g1", F.coalesce("before.kind", F.lit(-1))).withColumn("g2", F.coalesce("before.turn_index", F.lit(-1)))
    asks = scratch_table(asks, "asks")
    counts = asks.groupBy(*gap, "block").agg(F.count("*").alias("n"))
    over = Window.partitionBy(*gap)
    counts = counts.select(*gap, "block", (F.sum("n").over(over.orderBy("block")) - F.col("n")).alias("ahead"), F.sum("n").over(over).alias("all"))
    asks = asks.join(counts, [*gap, "block"])
    up = F.row_number().over(Window.partitionBy(*gap, "block").orderBy("at", "message_id")) + F.col("ahead")
    placed = asks.withColumn("up", up).withColumn("down", F.col("all") - F.col("up") + 1).select(
        "message_id",
        F.when(F.col("before.kind") == 0, F.col("before.turn_index") + F.col("up"))
        .when(F.col("after.kind") == 2, F.col("after.turn_index") - F.col("down"))
        .when(F.col("before").isNotNull(), F.col("before.turn_index") + F.col("up"))
        .otherwise(F.col("up") - 1).alias("place"),
    )
    # no sending time: the lowest gap, else behind the last number
    lowest = ends.groupBy("chat_id").agg((F.min("turn_index") + 1).alias("place"))
    untimed = loose.where(F.col("sent_at").isNull()).join(lowest, "chat_id", "left").select("message_id", F.coalesce("place", F.lit(0)).alias("place"))
    placed = placed.unionByName(untimed)
    loose = loose.drop("turn_index").join(placed, "message_id").withColumnRenamed("place", "turn_index")
    return numbered.unionByName(loose.select(numbered.columns))


def _reduce(word: Column) -> Column:
    """Keep what matters at the edges of a word of u and a: the letters at both ends, and one a between users."""
    first, last = F.substring(word, 1, 1), F.substring(word, -1, 1)
    return (
        F.when(F.length(word) <= 1, word)
        .when((first == "u") & (last == "u"), F.when(word.contains("a"), "uau").otherwise("u"))
        .when(first == last, first)
        .otherwise(F.concat(first, last))
    )


def _fold(states: DataFrame, block: Column) -> DataFrame:
    """Merge neighbouring summaries of a chat into one per ``block``."""
    states = states.withColumn("block", block)
    merged = states.groupBy("chat_id", "block").agg(
        F.sum("n").alias("n"), F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.max("clash").alias("clash"), F.max("odd").alias("odd"),
        F.max("texts").alias("texts"), F.max("waits").alias("waits"),
        F.concat_ws("", F.transform(F.array_sort(F.collect_list(F.struct("at", "word"))), lambda s: s["word"])).alias("word"),
    )
    return merged.select(
        "chat_id", F.col("block").alias("at"), "n", "lo", "hi", "clash", "odd", "texts",
        (F.col("waits") | F.col("word").contains("uu")).alias("waits"), _reduce(F.col("word")).alias("word"),
    )


def judge_chats(placed: DataFrame) -> DataFrame:
    """(chat_id, reason, first_turn): reason is empty, broken, missing_reply, or null for a usable chat."""
    letter = F.when(F.col("said") & (F.col("role") == "user"), "u").when(F.col("said") & (F.col("role") == "assistant"), "a").otherwise("")
    # two messages on one number are counted in its block; the set holds at most three letters a number
    row = F.struct(F.col("turn_index").alias("at"), letter.alias("word"))
    blocks = placed.groupBy("chat_id", F.floor(F.col("turn_index") / BLOCK).alias("at")).agg(
        F.array_sort(F.collect_set(row)).alias("rows"), F.count("*").alias("messages"), F.max(F.col("role").isNull()).alias("odd"), F.max("said").alias("texts")
    )
    numbers = F.array_distinct(F.transform("rows", lambda r: r["at"]))
    word = F.concat_ws("", F.transform("rows", lambda r: r["word"]))
    states = blocks.select(
        "chat_id", "at", F.size(numbers).cast("bigint").alias("n"), F.array_min(numbers).alias("lo"), F.array_max(numbers).alias("hi"), (F.col("messages") > F.size(numbers)).alias("clash"),
        "odd", "texts", word.contains("uu").alias("waits"), _reduce(word).alias("word"),
    )
    for _ in range(LEVELS - 1):
        states = _fold(states, F.floor(F.col("at") / BLOCK))
    chats = _fold(states, F.lit(0))
    broken = F.col("clash") | F.col("odd") | (F.col("n") != F.col("hi") - F.col("lo") + 1) | F.col("word").startswith("a")
    reason = F.when(~F.col("texts"), "empty").when(broken, "broken").when(F.col("waits") | F.col("word").endswith("u"), "missing_reply")
    return chats.select("chat_id", reason.alias("reason"), F.col("lo").alias("first_turn"))


def dropped_chats(messages: DataFrame) -> DataFrame:
    """(chat_id, reason) of every chat that cannot be used."""
    return judge_chats(place_unnumbered(folded_table(messages))).where(F.col("reason").isNotNull()).select("chat_id", "reason")


def rebuilt_turns(messages: DataFrame) -> DataFrame:
    """(chat_id, turn_index, role, text, message_id) of usable chats, numbered from 0, roles uniform.

    Rows stay loose on purpose: nesting would gather a chat of any length in one row. Order by
    (chat_id, turn_index) gives the conversations.
    """
    placed = place_unnumbered(folded_table(messages))
    kept = judge_chats(placed).where(F.col("reason").isNull()).select("chat_id", "first_turn")
    turns = placed.join(kept, "chat_id").select("chat_id", (F.col("turn_index") - F.col("first_turn")).alias("turn_index"), "role", "message_id")
    # a row that is there twice has its text once
    texts = fold_versions(messages).select("message_id", "text").dropDuplicates(["message_id"])
    return turns.join(texts, "message_id").select("chat_id", "turn_index", "role", "text", "message_id")
