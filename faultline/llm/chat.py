"""Chat formatting by quotation linking, in DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch

#: Turns a bucket holds; the last original of a text is looked up within a bucket and then across buckets.
BUCKET = 4096
MARKS = r"^(?:[ \t]*>)+"
#: A line that only says who wrote the quote below it.
ATTRIBUTION = r"(?i)^\s*(?:on|am|le|el)\b.*\b(?:wrote|writes|schrieb\b.*|a \u00e9crit|escribi\u00f3)\s*:\s*$"
KEY = ("conv_id", "turn")


def normalised(text: Column) -> Column:
    """Lower case; runs of anything but letters and digits are one space."""
    return F.btrim(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]+", " "))


def parse(messages: DataFrame) -> DataFrame:
    """messages with fl_own, the text outside quotes, and fl_passages: (level, text, first line) of each maximal run of
    lines of one quote level, own text being level 0. A line's level is the number of > before its text. Lines right above a deeper
    level that only name the writer of what follows are no text and left out.
    """
    d = messages.withColumn("fl_lines", F.split(F.coalesce(F.col("text"), F.lit("")), "\n"))
    d = d.withColumn("fl_levels", F.transform("fl_lines", lambda x: F.length(F.regexp_replace(F.regexp_extract(x, MARKS, 0), "[^>]", ""))))
    d = d.withColumn("fl_lines", F.transform("fl_lines", lambda x: F.regexp_replace(x, MARKS + "[ \t]?", "")))
    names = F.transform("fl_lines", lambda x, i: (F.coalesce(F.get("fl_levels", i + 1), F.lit(0)) > F.get("fl_levels", i)) & F.rlike(x, F.lit(ATTRIBUTION)))
    d = d.withColumn("fl_names", names).withColumn("fl_named", F.exists("fl_names", lambda x: x))
    for c in ("fl_lines", "fl_levels"):
        d = d.withColumn(c, F.when(F.col("fl_named"), F.filter(c, lambda x, i: ~F.get("fl_names", i))).otherwise(F.col(c)))
    d = d.drop("fl_names", "fl_named")
    n = F.size("fl_lines")
    d = d.withColumn("fl_starts", F.filter(F.sequence(F.lit(0), n - 1), lambda i: (i == 0) | (F.get("fl_levels", i) != F.get("fl_levels", i - 1))))
    passage = lambda s, k: F.struct(F.get("fl_levels", s).alias("level"), F.array_join(F.slice("fl_lines", s + 1, F.coalesce(F.get("fl_starts", k + 1), n) - s), "\n").alias("text"), s.alias("line"))
    d = d.withColumn("fl_passages", F.transform("fl_starts", passage))
    own = F.array_join(F.transform(F.filter("fl_passages", lambda p: p["level"] == 0), lambda p: p["text"]), "\n")
    return d.withColumn("fl_own", F.btrim(own, F.lit(" \t\r\n"))).drop("fl_lines", "fl_levels", "fl_starts")


def _hashes(text: Column) -> Column:
    """Hash of the normalised passage, then of each of its lines and paragraphs; blank ones left out."""
    parts = F.concat(F.array(text), F.split(text, "\n"), F.split(text, r"\n[ \t]*\n"))
    kept = F.filter(F.transform(parts, lambda p: normalised(p)), lambda p: p != "")
    return F.array_distinct(F.transform(kept, lambda p: F.xxhash64(p)))


def _latest(originals: DataFrame, quotes: DataFrame) -> DataFrame:
    """quotes (conv_id, hash, turn, …) with source_turn, the last turn before theirs whose own text has the hash.

    Originals and quotes of a hash run through one window in turn order, so no pairs are made; the window is cut into
    buckets of turns, and what a bucket starts with comes from a window over buckets.
    """
    names = [c for c in quotes.columns if c not in ("conv_id", "hash", "turn")]
    o = originals.select("conv_id", "hash", "turn", F.col("turn").alias("source"), *[F.lit(None).cast(quotes.schema[c].dataType).alias(c) for c in names])
    q = quotes.select("conv_id", "hash", "turn", F.lit(None).cast("long").alias("source"), *names)
    both = o.distinct().union(q).withColumn("bucket", F.floor(F.col("turn") / BUCKET))
    # a message must not answer itself: at one turn quotes come before originals
    inside = Window.partitionBy("conv_id", "hash", "bucket").orderBy("turn", F.col("source").isNotNull()).rowsBetween(Window.unboundedPreceding, -1)
    found = both.withColumn("near", F.last("source", True).over(inside)).where("source IS NULL")
    ends = o.withColumn("bucket", F.floor(F.col("turn") / BUCKET)).groupBy("conv_id", "hash", "bucket").agg(F.max("turn").alias("end"))
    marks = q.withColumn("bucket", F.floor(F.col("turn") / BUCKET)).select("conv_id", "hash", "bucket").distinct().join(ends, ["conv_id", "hash", "bucket"], "full")
    before = marks.withColumn("far", F.last("end", True).over(Window.partitionBy("conv_id", "hash").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1))).drop("end")
    out = found.join(before, ["conv_id", "hash", "bucket"], "left").withColumn("source_turn", F.coalesce("near", "far"))
    return out.where("source_turn < turn").drop("near", "far", "bucket", "source")


def linked(conversations: DataFrame, scratch: Scratch) -> DataFrame:
    """conv_id, turn, role, text (without quotes), max_level, n_quotes, reply_to, thread_turn, depth, place: for every message, the
    turn that its quote comes from, the turn its thread begins with and its place in the thread's reply order, where each message
    is followed by its replies in order of turn, each with its own replies behind it. ordered() sorts by these.

    A quote links to the latest earlier message of its conversation whose own text, or a line or paragraph of it, is
    equal in normalised form; whole passages go before lines, lower levels before higher, then the first in the text.
    Messages without such a quote begin a thread. Null text is empty; messages without conv_id or turn are threads of
    their own (thread_turn is their turn); rows repeated or of one (conv_id, turn) are one place and link alike.
    No rows: no rows.
    """
    parsed = parse(conversations.select("conv_id", "turn", "role", "text"))
    quote = F.filter("fl_passages", lambda p: (p["level"] > 0) & (normalised(p["text"]) != ""))
    parsed = parsed.withColumn("fl_quotes", quote)
    slim = scratch.keep(parsed.select("conv_id", "turn", "role", F.col("fl_own").alias("text"), _hashes(F.col("fl_own")).alias("own"), "fl_quotes"))
    with_key = slim.where("conv_id IS NOT NULL AND turn IS NOT NULL")
    quotes = with_key.select("conv_id", F.col("turn").cast("long").alias("turn"), F.explode("fl_quotes").alias("q"))
    quotes = quotes.select("conv_id", "turn", F.col("q.level").alias("level"), F.col("q.line").alias("line"), F.posexplode(_hashes(F.col("q.text"))).alias("part", "hash")).distinct()
    quotes = scratch.keep(quotes)
    # only texts that someone quotes matter
    originals = with_key.select("conv_id", F.col("turn").cast("long").alias("turn"), F.explode("own").alias("hash"))
    originals = originals.join(quotes.select("conv_id", "hash").distinct(), ["conv_id", "hash"], "left_semi")
    best = F.min(F.struct((F.col("part") > 0).alias("loose"), "level", "line", "part", (-F.col("source_turn")).alias("late"))).alias("x")
    links = scratch.keep(_latest(originals, quotes).groupBy(*KEY).agg(best).select("conv_id", "turn", (-F.col("x.late")).alias("reply_to"), F.lit(1).alias("depth")))
    roots = _roots(links, scratch)
    # written, so that few links are seen to be few and messages need not be shuffled for them
    l = scratch.keep(_placed(roots, scratch)).select(F.col("conv_id").alias("c2"), F.col("turn").alias("t2"), "reply_to", "root", "depth", "place")
    out = slim.join(l, (F.col("conv_id") == F.col("c2")) & (F.col("turn") == F.col("t2")), "left")
    levels = F.coalesce(F.array_max(F.transform("fl_quotes", lambda q: q["level"])), F.lit(0))
    return out.select("conv_id", "turn", "role", "text", levels.alias("max_level"), F.size("fl_quotes").alias("n_quotes"), "reply_to", F.coalesce("root", F.col("turn").cast("long")).alias("thread_turn"), F.coalesce("depth", F.lit(0)).alias("depth"), F.coalesce("place", F.lit(0).cast("long")).alias("place"))


def ordered(messages: DataFrame, n: int) -> DataFrame:
    """The linked messages as conversations: in n ranges of conv_id, sorted by thread and place in it, so that reading the
    ranges one after the other gives every thread in reply order.
    """
    by = ("conv_id", "thread_turn", "place", "turn")
    return messages.repartitionByRange(n, *by).sortWithinPartitions(*by)


def _following(rows: DataFrame, keys: list[str]) -> DataFrame:
    """rows (keys, turn) with following, the next turn of the keys: a window over buckets of turns and one across buckets."""
    d = rows.withColumn("bucket", F.floor(F.col("turn") / BUCKET))
    inside = d.withColumn("near", F.lead("turn").over(Window.partitionBy(*keys, "bucket").orderBy("turn")))
    starts = d.groupBy(*keys, "bucket").agg(F.min("turn").alias("start"))
    starts = starts.withColumn("far", F.lead("start").over(Window.partitionBy(*keys).orderBy("bucket"))).drop("start")
    return inside.join(starts, [*keys, "bucket"]).withColumn("following", F.coalesce("near", "far")).drop("near", "far", "bucket")


def _placed(roots: DataFrame, scratch: Scratch) -> DataFrame:
    """roots (conv_id, turn, reply_to, root, depth) with place, the number of messages before theirs when a thread is walked
    depth first: the walk enters and leaves every message, and how many are entered from a step on is summed along it by
    jumping pointers, so rounds are the logarithm of the largest thread and no path is ever written out.
    """
    child = _following(roots.select("conv_id", "reply_to", "turn"), ["conv_id", "reply_to"])
    first = child.groupBy("conv_id", "reply_to").agg(F.min("turn").alias("child")).select(F.col("conv_id").alias("c2"), F.col("reply_to").alias("t2"), "child")
    tops = roots.select("conv_id", F.col("root").alias("turn")).distinct()
    nodes = child.unionByName(tops, True).join(first, (F.col("conv_id") == F.col("c2")) & (F.col("turn") == F.col("t2")), "left")
    step = lambda turn, leaves: F.struct(turn.alias("turn"), leaves.alias("leaves"))
    enter = F.when(F.col("child").isNotNull(), step(F.col("child"), F.lit(False))).otherwise(step(F.col("turn"), F.lit(True)))
    leave = F.when(F.col("following").isNotNull(), step(F.col("following"), F.lit(False))).when(F.col("reply_to").isNotNull(), step(F.col("reply_to"), F.lit(True)))
    steps = nodes.select("conv_id", "turn", F.explode(F.array(F.struct(F.lit(False).alias("leaves"), enter.alias("to"), F.lit(1).cast("long").alias("n")), F.struct(F.lit(True).alias("leaves"), leave.alias("to"), F.lit(0).cast("long").alias("n")))).alias("x"))
    now = scratch.keep(steps.select("conv_id", "turn", "x.*"))
    while not now.where("to IS NOT NULL").isEmpty():
        ahead = now.select(F.col("conv_id").alias("c2"), F.col("turn").alias("t2"), F.col("leaves").alias("l2"), F.col("to").alias("to2"), F.col("n").alias("n2"))
        new = now.join(ahead, (F.col("conv_id") == F.col("c2")) & (F.col("to.turn") == F.col("t2")) & (F.col("to.leaves") == F.col("l2")), "left")
        new = scratch.keep(new.select("conv_id", "turn", "leaves", F.col("to2").alias("to"), (F.col("n") + F.coalesce("n2", F.lit(0))).alias("n")))
        scratch.drop(now)
        now = new
    entered = now.where("NOT leaves").select("conv_id", "turn", "n")
    out = roots.join(entered, ["conv_id", "turn"])
    top = entered.select(F.col("conv_id").alias("c2"), F.col("turn").alias("t2"), F.col("n").alias("all"))
    return out.join(top, (F.col("conv_id") == F.col("c2")) & (F.col("root") == F.col("t2"))).withColumn("place", F.col("all") - F.col("n")).drop("c2", "t2", "all", "n")


def _roots(links: DataFrame, scratch: Scratch) -> DataFrame:
    """links with root, where following reply_to ends: pointers jump, so rounds are the logarithm of the longest thread."""
    now = scratch.keep(links.withColumn("root", F.col("reply_to")))
    while True:
        up = now.select(F.col("conv_id").alias("c2"), F.col("turn").alias("t2"), F.col("root").alias("up"), F.col("depth").alias("more"))
        new = now.join(up, (F.col("conv_id") == F.col("c2")) & (F.col("root") == F.col("t2")), "left")
        new = scratch.keep(new.select("conv_id", "turn", "reply_to", F.coalesce("up", "root").alias("root"), (F.col("depth") + F.coalesce("more", F.lit(0))).alias("depth"), F.col("up").isNotNull().alias("moved")))
        moved = not new.where("moved").isEmpty()
        now = new.drop("moved")
        if not moved:
            return now
