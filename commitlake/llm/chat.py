"""Quotation linking of messages and reply-ordered conversations.

A line's quote level is the number of ``>`` before its text.  Neighbouring
lines of one level above 0 are a quoted passage; what is at level 0 is the
message's own text, and a line "... wrote:" just before a quote belongs to it.
Passages are normalised (lower case, white space collapsed) and hashed.  Every
message offers the hashes of its own whole text, paragraphs and lines; the
original of a hash in a conversation is the earliest message that offers it.
A quoted passage is linked to the original of its whole hash, or else to the
message that is the original of most of its lines (ties: the earliest), among
earlier turns only.  A message replies to the latest original of its passages
of the lowest linked level, or to the previous turn if nothing is linked.
Positions are those of a depth-first walk of the replies: a message is followed
by all that descends from it, answers to one message in the order of their turns.

Such a walk keeps runs of messages that each reply to the previous turn whole:
after a run come the runs that reply into it, those that reply latest in it first,
then by turn, each with its own descendants.  So only conversations in which a
message replies elsewhere are walked, by runs: every run's entry and exit point to
the next one of the walk, and pointer doubling sums the messages that follow, in
as many rounds as the number of runs has binary digits.

Each (conversation, hash) contributes one row, its earliest turn, so a passage
that all messages share makes no pairs.  Positions are counted in buckets of
turns, so that a conversation may be of any length.

Edge cases: null and empty texts have neither passages nor quotes; a text of
quotes alone has an empty own text; rows of one (conversation, turn) share its
position and link; null conversations form one conversation that is never
linked by quotes; null turns come first; an empty table gives an empty result.
Extra columns are neither read nor returned.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window, functions as F

from .ranking import positions
from .storage import materialize

_LEVEL = re.compile(r"(?:[ \t]*>)+[ \t]?")
_WROTE = re.compile(r".{0,200}\b(?:wrote|schrieb|a écrit|escribió) ?:[ \t]*")
#: Distinct turns that one task orders at a time.
TURNS_PER_BUCKET = 1000


def quote_level(line: str) -> tuple[int, str]:
    m = _LEVEL.match(line)
    return (m[0].count(">"), line[m.end() :]) if m else (0, line)


def normalised(text: str) -> str:
    return " ".join(text.lower().split())


def passage_hash(text: str) -> int:
    value = xxhash.xxh64_intdigest(text.encode("utf-8", "surrogatepass"))
    return value - (1 << 64) if value >> 63 else value


def parse(text: str | None) -> tuple[str, list[str], list[tuple[int, str, list[str]]]]:
    """Own text, the normalised passages it offers, and quoted (level, passage, lines)."""
    lines = [quote_level(x) for x in (text or "").split("\n")]
    for i in range(len(lines) - 1):
        if lines[i][0] == 0 and lines[i + 1][0] and _WROTE.fullmatch(lines[i][1]):
            lines[i] = (-1, "")
    own, paragraphs, quotes, block = [], [], [], []
    for i, (level, line) in enumerate([*lines, (-2, "")]):
        if level == 0:
            own.append(line)
        if block and (level != block[0][0] or level >= 0 and not line.strip()):
            whole = normalised(" ".join(x for _, x in block))
            if whole and block[0][0] == 0:
                paragraphs.append(whole)
            elif whole:
                quotes.append((block[0][0], whole, [n for _, x in block if (n := normalised(x))]))
            block = []
        if level >= 0 and line.strip():
            block.append((level, line))
    said = "\n".join(own).strip("\n")
    offers = dict.fromkeys([normalised(said), *paragraphs, *map(normalised, own)])
    return said, [x for x in offers if x], quotes


def parsed(messages: DataFrame) -> DataFrame:
    """(conv_id, turn, role, own, offers, quotes) of each message, passages as hashes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [parse(t.as_py()) for t in batch.column(3)]
            quotes = [[{"level": level, "whole": passage_hash(w), "lines": [passage_hash(x) for x in ls]} for level, w, ls in r[2]] for r in rows]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:3], pa.array([r[0] for r in rows], pa.string()), pa.array([[passage_hash(x) for x in r[1]] for r in rows], pa.list_(pa.int64())), pa.array(quotes, kinds)],
                ["conv_id", "turn", "role", "own", "offers", "quotes"],
            )

    kinds = pa.list_(pa.struct([("level", pa.int64()), ("whole", pa.int64()), ("lines", pa.list_(pa.int64()))]))
    rows = messages.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), F.col("role").cast("string"), F.col("text").cast("string"))
    return rows.mapInArrow(run, "conv_id long, turn long, role string, own string, offers array<long>, quotes array<struct<level:long,whole:long,lines:array<long>>>")


def _links(rows: DataFrame) -> DataFrame:
    """(conv_id, turn, linked, quoted_turn) for messages with a linked passage."""
    offers = rows.select("conv_id", "turn", F.explode("offers").alias("hash"))
    quoted = rows.filter(F.size("quotes") > 0).select("conv_id", "turn", F.posexplode("quotes").alias("passage", "q"))
    asked = quoted.select("conv_id", "turn", "passage", "q.level", F.lit(0).alias("rank"), F.col("q.whole").alias("hash")).unionByName(
        quoted.select("conv_id", "turn", "passage", "q.level", F.lit(1).alias("rank"), F.explode("q.lines").alias("hash"))
    )
    wanted = asked.select("conv_id", "hash").distinct()
    first = offers.join(wanted, ["conv_id", "hash"], "left_semi").groupBy("conv_id", "hash").agg(F.min("turn").alias("original"))
    found = asked.join(first, ["conv_id", "hash"]).filter("original < turn")
    found = found.groupBy("conv_id", "turn", "passage", "level", "rank", "original").agg(F.count("*").alias("lines"))
    best = F.min_by("original", F.struct("rank", (-F.col("lines")).alias("lines"), "original"))
    passages = found.groupBy("conv_id", "turn", "passage", "level").agg(best.alias("original"))
    return passages.groupBy("conv_id", "turn").agg(
        F.count("*").alias("n_linked"), F.max_by("original", F.struct((-F.col("level")).alias("level"), "original")).alias("quoted_turn")
    )


def _nth_run(runs: DataFrame) -> DataFrame:
    """Adds ``nth``: the place of a run among those below the same run, by (reply_rank descending, start)."""
    at_once = positions(runs, ["conv_id", "reply_rank"], F.floor(F.col("start") / TURNS_PER_BUCKET), ["start"]).withColumnRenamed("position", "inside")
    spots = materialize(runs.groupBy("conv_id", "above", "reply_rank").agg(F.count("*").alias("n")), "chat-spots")
    later = positions(spots, ["conv_id", "above"], F.floor(-F.col("reply_rank") / TURNS_PER_BUCKET), [F.desc("reply_rank")], F.col("n"))
    later = later.select("conv_id", "reply_rank", F.col("before").alias("earlier"))
    return at_once.join(later, ["conv_id", "reply_rank"]).withColumn("nth", F.col("earlier") + F.col("inside")).drop("inside", "earlier")


def _walked(ranked: DataFrame) -> DataFrame:
    """(conv_id, rank, place) in conversations where a message replies to another one than the previous; ``ranked(conv_id, rank, reply_rank)``."""
    elsewhere = (F.col("rank") > 0) & (F.col("reply_rank") != F.col("rank") - 1)
    walked = ranked.filter(elsewhere).select("conv_id").distinct()
    messages = ranked.join(walked, "conv_id", "left_semi").withColumn("starts", F.when((F.col("rank") == 0) | elsewhere, F.col("rank")))
    # The run of a message is the last start up to it, found in its bucket or else before.
    messages = materialize(messages.withColumn("bucket", F.floor(F.col("rank") / TURNS_PER_BUCKET)), "chat-walked")
    lasts = messages.groupBy("conv_id", "bucket").agg(F.max("starts").alias("last"))
    earlier = Window.partitionBy("conv_id").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    lasts = lasts.select("conv_id", "bucket", F.max("last").over(earlier).alias("before"))
    upto = Window.partitionBy("conv_id", "bucket").orderBy("rank")
    messages = messages.join(lasts, ["conv_id", "bucket"]).withColumn("start", F.coalesce(F.max("starts").over(upto), "before"))
    messages = materialize(messages.select("conv_id", "rank", "reply_rank", "start"), "chat-runs")

    sizes = messages.groupBy("conv_id", "start").agg(F.count("*").alias("size"))
    above = messages.select("conv_id", F.col("rank").alias("reply_rank"), F.col("start").alias("above"))
    runs = messages.filter("rank = start and rank > 0").select("conv_id", "start", "reply_rank").join(above, ["conv_id", "reply_rank"])
    runs = materialize(_nth_run(materialize(runs, "chat-replies")), "chat-nth")
    below = runs.filter("nth = 0").select("conv_id", F.col("above").alias("start"), F.col("start").alias("first"))
    sibling = runs.select("conv_id", "above", (F.col("nth") - 1).alias("nth"), F.col("start").alias("next"))
    enter, leave = (lambda c: 2 * F.col(c)), (lambda c: 2 * F.col(c) + 1)
    all_runs = sizes.join(below, ["conv_id", "start"], "left").join(runs.join(sibling, ["conv_id", "above", "nth"], "left").select("conv_id", "start", "above", "next"), ["conv_id", "start"], "left")
    steps = F.array(
        F.struct(enter("start").alias("at"), F.coalesce(enter("first"), leave("start")).alias("then"), F.col("size").alias("n")),
        F.struct(leave("start").alias("at"), F.coalesce(enter("next"), leave("above")).alias("then"), F.lit(0).cast("long").alias("n")),
    )
    tour = materialize(all_runs.select("conv_id", F.explode(steps).alias("s")).select("conv_id", "s.*"), "chat-tour")
    while not tour.filter("then is not null").isEmpty():
        ahead = tour.select("conv_id", F.col("at").alias("then"), F.col("then").alias("far"), F.col("n").alias("more"))
        tour = materialize(tour.join(ahead, ["conv_id", "then"], "left").select("conv_id", "at", F.col("far").alias("then"), (F.col("n") + F.coalesce("more", F.lit(0))).alias("n")), "chat-tour")
    following = tour.filter("at % 2 = 0").select("conv_id", F.expr("at div 2").alias("start"), F.col("n").alias("following"))
    whole = following.filter("start = 0").select("conv_id", F.col("following").alias("whole"))
    first = following.join(whole, "conv_id").select("conv_id", "start", (F.col("whole") - F.col("following")).alias("first"))
    return messages.join(first, ["conv_id", "start"]).select("conv_id", "rank", (F.col("first") + F.col("rank") - F.col("start")).alias("place"))


def conversations(messages: DataFrame) -> DataFrame:
    """Per message: conv_id, turn, role, position, reply_to, n_quotes, n_linked and its own text without quotes."""
    rows = materialize(parsed(messages), "chat-messages")
    turns = materialize(rows.select("conv_id", "turn").distinct(), "chat-turns")
    ranked = positions(turns, ["conv_id"], F.floor(F.col("turn") / TURNS_PER_BUCKET), ["turn"]).withColumnRenamed("position", "rank")
    ranked = materialize(ranked, "chat-ranks")
    linked = materialize(_links(rows), "chat-links")
    quoted = linked.join(ranked.select("conv_id", F.col("turn").alias("quoted_turn"), F.col("rank").alias("quoted_rank")), ["conv_id", "quoted_turn"])
    ranked = ranked.join(quoted, ["conv_id", "turn"], "left").withColumn("reply_rank", F.coalesce("quoted_rank", F.col("rank") - 1))
    ranked = materialize(ranked, "chat-replies")
    before = ranked.select(F.col("conv_id").alias("_conv"), (F.col("rank") + 1).alias("_next"), F.col("turn").alias("previous"))
    placed = ranked.join(before, F.col("conv_id").eqNullSafe(F.col("_conv")) & (F.col("rank") == F.col("_next")), "left").drop("_conv", "_next")
    if not linked.isEmpty():
        placed = placed.join(_walked(ranked.select("conv_id", "rank", "reply_rank")), ["conv_id", "rank"], "left")
        placed = placed.withColumn("rank", F.coalesce("place", "rank"))
    placed = placed.select(
        F.col("conv_id").alias("_conv"), F.col("turn").alias("_turn"), F.col("rank").alias("position"),
        F.coalesce("quoted_turn", "previous").alias("reply_to"), F.coalesce("n_linked", F.lit(0)).alias("n_linked"),
    )
    out = rows.join(placed, F.col("conv_id").eqNullSafe(F.col("_conv")) & F.col("turn").eqNullSafe(F.col("_turn")))
    return out.select("conv_id", "turn", "role", "position", "reply_to", F.size("quotes").cast("long").alias("n_quotes"), "n_linked", F.col("own").alias("text"))


def rendered(ordered: DataFrame, messages_per_row: int = 500) -> DataFrame:
    """Chat text from ``conversations``: (conv_id, part, text), at most so many positions in a row; repeated rows are said once."""
    line = F.concat(F.lit("<|"), F.coalesce("role", F.lit("")), F.lit("|>\n"), F.coalesce("text", F.lit("")), F.lit("\n"))
    part = F.floor(F.col("position") / messages_per_row)
    said = F.array_sort(F.collect_set(F.struct("position", line.alias("line"))))
    return ordered.groupBy("conv_id", part.alias("part")).agg(F.array_join(said["line"], "").alias("text"))
