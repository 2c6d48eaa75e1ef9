"""Mixing sources to target weights by Pareto order sampling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, Scratch, carried

#: Bits of a rank, and how many of them each refinement round settles.
RANK_BITS, ROUND_BITS = 52, 13
#: Inclusion chances within a source are proportional to this power of a document's size.
POWER = 0.5


def source_targets(sizes: DataFrame, total: float, weights: tuple[float, ...], cap: float) -> DataFrame:
    """(source, source_size, target) for sizes (source, source_size), one row each.

    Sources by code point, null last, weigh `weights`, repeating; they share total x all sizes; a target stops at
    cap x its source's size and the excess is reshared by weight until none is above. Only two sums come to the driver
    in a round; a source of size 0 has target 0. No sources: no rows.
    """
    order = Window.orderBy(F.col("source").isNull(), "source")  # one row for each source
    cycle = F.array(*[F.lit(float(w)) for w in weights])
    t = sizes.withColumn("w", F.element_at(cycle, ((F.row_number().over(order) - 1) % len(weights) + 1).cast("int")))
    top = F.col("source_size") * F.lit(float(cap))
    level, free = None, F.lit(True)
    share = t.agg(F.sum("source_size")).first()[0]
    while share:
        full = F.lit(False) if level is None else top <= F.col("w") * F.lit(level)
        got = t.agg(F.sum(F.when(full, top)), F.sum(F.when(~full, F.col("w")))).first()
        if not got[1]:
            break
        new = (total * share - (got[0] or 0.0)) / got[1]
        if level is not None and new <= level:
            break
        level = new
    return t.select("source", "source_size", (F.least(top, F.col("w") * F.lit(level)) if level else F.lit(0.0)).alias("target"))


def pareto_key(unit: Column, inclusion: Column) -> Column:
    """Order-preserving integer rank of (u/(1-u)) / (p/(1-p)): smaller goes first."""
    ratio = unit / (F.lit(1.0) - unit) * (F.lit(1.0) - inclusion) / inclusion
    return F.floor(ratio / (F.lit(1.0) + ratio) * F.lit(float((1 << RANK_BITS) - 1))).cast("long")


def _sized(docs: DataFrame, weight: str | None, seed: int, power: float) -> DataFrame:
    """docs with fl_size, fl_unit (the random number of a row) and fl_w, to which inclusion chances are proportional."""
    draw = F.pmod(F.xxhash64(F.col("doc_id"), F.xxhash64("text"), F.lit(seed)), F.lit(1 << 50)).cast("double")
    d = docs.withColumns({
        "fl_size": F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long"),
        "fl_unit": (draw + 0.5) / float(1 << 50),
    })
    return d.withColumn("fl_w", F.greatest(F.coalesce(F.col(weight).cast("double"), F.lit(0.0)), F.lit(0.0)) if weight else F.pow(F.col("fl_size").cast("double"), F.lit(power)))


def _with_levels(plan: DataFrame, rows: DataFrame, scratch: Scratch) -> DataFrame:
    """plan with fl_level, fl_rest and fl_certain: a document's inclusion chance is fl_level x fl_w, and those where that is 1 or more are
    in for certain; the chances' mean of words is fl_need. fl_rest is what is left to sample beside the fl_certain words.

    Each round takes out what the level makes certain and raises the level for the rest, one sum over rows by source, until
    nothing more is certain; a source can't be all certain, as fl_need is less than its size.
    """
    levels = None
    while True:
        if levels is None:
            sums = rows.groupBy("source").agg(F.lit(0).cast("long").alias("certain"), F.sum(F.col("fl_size") * F.col("fl_w")).alias("open"))
        else:
            d = rows.join(levels, rows["source"].eqNullSafe(levels["l_source"]))
            sure = F.col("level") * F.col("fl_w") >= 1
            sums = d.groupBy("source").agg(F.sum(F.when(sure, F.col("fl_size")).otherwise(0)).alias("certain"), F.sum(F.when(sure, 0.0).otherwise(F.col("fl_size") * F.col("fl_w"))).alias("open"))
        need = plan.select(F.col("fl_source").alias("n_source"), "fl_need")
        new = sums.join(need, F.col("source").eqNullSafe(F.col("n_source")))
        level = F.when(F.col("open") > 0, (F.col("fl_need") - F.col("certain")) / F.col("open")).otherwise(0.0)
        new = scratch.keep(new.select(F.col("source").alias("l_source"), "certain", F.greatest(level, F.lit(0.0)).alias("level")))
        mark = new.agg(F.sum("certain")).first()[0]
        if levels is not None and mark == seen:
            break
        levels, seen = new, mark
    out = plan.join(levels, F.col("fl_source").eqNullSafe(F.col("l_source"))).drop("l_source")
    return out.withColumnsRenamed({"level": "fl_level", "certain": "fl_certain"}).withColumn("fl_rest", F.col("fl_need") - F.col("fl_certain"))


def _ranked(rows: DataFrame, plan: DataFrame) -> DataFrame:
    """rows beside their source's plan, with fl_sure and, for the others, fl_key, the rank in Pareto order."""
    chance = F.col("fl_level") * F.col("fl_w")
    out = rows.join(plan, rows["source"].eqNullSafe(plan["fl_source"])).withColumn("fl_sure", chance >= 1)
    return out.withColumn("fl_key", F.when(F.col("fl_sure"), F.lit(None).cast("long")).when(chance > 0, pareto_key(F.col("fl_unit"), chance)).otherwise(F.lit((1 << RANK_BITS) - 1)))


def fit_mix(docs: DataFrame, scratch: Scratch, total: float = 1.5, weights: tuple[float, ...] = (5, 2, 1), cap: float = 2.0, weight: str | None = None, seed: int = 9, power: float = POWER) -> DataFrame:
    """The plan of a mix, one row per source: size, target, whole copies, words left to sample and the last rank taken.

    The last rank is found by refining a histogram of ranks in four rounds, so that no source is sorted or gathered
    in one task, whatever share of the rows it has.
    """
    rows = scratch.keep(_sized(docs, weight, seed, power).select("source", "fl_size", "fl_unit", "fl_w"))
    sums = scratch.keep(rows.groupBy("source").agg(F.sum("fl_size").alias("source_size")))
    plan = source_targets(sums, total, weights, cap)
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("int")
    plan = plan.withColumn("fl_whole", whole).withColumn("fl_need", F.col("target") - F.col("fl_whole") * F.col("source_size"))
    plan = scratch.keep(plan.withColumnRenamed("source", "fl_source"))
    plan = scratch.keep(_with_levels(plan, rows, scratch))
    part = _ranked(rows, plan).where("fl_rest > 0 AND NOT fl_sure").select("fl_source", "fl_size", "fl_key")
    border = plan.where("fl_rest > 0").select(F.col("fl_source").alias("b"), F.col("fl_rest").alias("need"), F.lit(0).cast("long").alias("prefix"), F.lit(0).cast("long").alias("n"))
    for left in range(RANK_BITS - ROUND_BITS, -1, -ROUND_BITS):
        near = part.join(border, F.col("fl_source").eqNullSafe(F.col("b")) & (F.shiftright("fl_key", left + ROUND_BITS) == F.col("prefix")))
        bins = near.groupBy("b", "need", F.shiftright("fl_key", left).alias("bin")).agg(F.sum("fl_size").alias("n"))
        w = Window.partitionBy("b").orderBy("bin")  # at most 2 ** ROUND_BITS rows
        run = bins.withColumn("upto", F.sum("n").over(w)).withColumn("last", F.lead("bin").over(w).isNull())
        hit = run.where((F.col("upto") - F.col("n") < F.col("need")) & ((F.col("upto") >= F.col("need")) | F.col("last")))
        border = scratch.keep(hit.select("b", (F.col("need") - (F.col("upto") - F.col("n"))).alias("need"), F.col("bin").alias("prefix"), "n"))
    last = F.when(F.abs(F.col("n") - F.col("need")) <= F.col("need"), F.col("prefix")).otherwise(F.col("prefix") - 1)
    plan = plan.join(border.select("b", last.alias("fl_border")), F.col("fl_source").eqNullSafe(F.col("b")), "left").drop("b")
    return scratch.keep(plan)


def apply_mix(docs: DataFrame, plan: DataFrame, weight: str | None = None, seed: int = 9, power: float = POWER) -> DataFrame:
    """docs with fl_size, source_size, target and fl_copies."""
    ranked = _ranked(_sized(docs, weight, seed, power), plan)
    extra = F.coalesce((F.col("fl_sure") | (F.col("fl_key") <= F.col("fl_border"))).cast("int"), F.lit(0))
    return ranked.withColumn("fl_copies", F.col("fl_whole") + extra).drop("fl_key", "fl_sure", "fl_border", "fl_need", "fl_rest", "fl_level", "fl_certain", "fl_whole", "fl_unit", "fl_w", "fl_source")


def mix(docs: DataFrame, scratch: Scratch, **how) -> DataFrame:
    """doc_id, source, size, source_size, target, copies, taken for every row of docs (doc_id, text, source).

    Each source first gives floor(target / size) whole copies of every document. The rest is a Pareto sample with inclusion chances
    in proportion to the column `weight`, or to the POWER-th power of a document's size: those whose chance comes to 1 give one more
    whole copy for certain, the others are ranked by random odds over inclusion odds and taken in rank order up to a fixed
    size in words; the document on the border is in if that comes nearer to the target. Null text has size 0; a null source is
    one of its own; repeated rows of one id and text share one draw. No rows: no rows.
    """
    own = docs.select("doc_id", "text", "source", *([how["weight"]] if how.get("weight") else []))
    got = apply_mix(own, fit_mix(own, scratch, **how), how.get("weight"), how.get("seed", 9), how.get("power", POWER))
    return got.select("doc_id", "source", F.col("fl_size").alias("size"), "source_size", "target", F.col("fl_copies").alias("copies"), (F.col("fl_copies") * F.col("fl_size")).cast("long").alias("taken"))


def mixed_documents(docs: DataFrame, scratch: Scratch, **how) -> DataFrame:
    """The rows of docs as the mix has them: not at all, once or as often as their copies say; columns as in docs, whatever their names.

    Null and empty texts have size 0 and are taken with their source's whole copies; repeated rows share one draw and are all in or all
    out; ties in rank are in or out together. No rows: no rows.
    """
    weight, seed = how.get("weight"), how.get("seed", 9)
    plan = fit_mix(docs.select("doc_id", "text", "source", *([weight] if weight else [])), scratch, **how).drop("source_size", "target")
    own = carried(docs, "doc_id", "text", "source", *([weight] if weight else []))
    got = apply_mix(own, plan, weight, seed, how.get("power", POWER))
    return got.withColumn("fl_copy", F.explode(F.array_repeat(F.lit(0), F.col("fl_copies")))).select("fl_all.*")
