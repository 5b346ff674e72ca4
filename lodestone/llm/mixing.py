"""Mixing sources to target weights by entropy balancing.

Of all document rates between 0 and `cap` that meet each source's word total,
the most even (by the entropy of a bounded rate) is an exponential tilt along
the constrained amount: rate / (cap - rate) = exp(lambda * size / mean size)
/ (cap - 1). The multipliers solve the convex dual, here by safeguarded Newton
steps; a step is a grouped sum over the histogram of sizes, so its cost does
not depend on the number of documents.
"""

from __future__ import annotations

import logging

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .store import saved, small

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (5, 2, 1)
CAP = 3
TOLERANCE = 1e-9
#: Sources whose tables are broadcast at most.
SOURCES = 100_000
_BINS = 1024


def size_of(text_col: str = "text") -> Column:
    return F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORD)), F.lit(0)).cast("long")


def targets(sized: DataFrame, weights: tuple[int, ...] = WEIGHTS, cap: int = CAP) -> DataFrame:
    """(source, docs, source_size, target): shares of all words by weight, none above cap times its source.

    The levels are those that repeated resharing of the excess ends at: with
    sources in order of cap * size / weight, those before the first that stays
    below its cap are full, and the rest shares what remains by weight. One
    row per source goes through one sort.
    """
    sums = sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("docs"))
    place = F.row_number().over(Window.orderBy(F.col("source").isNull(), "source")) - 1
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.pmod(place, F.lit(len(weights))) + 1).cast("int"))
    order = Window.orderBy((F.col("source_size") * cap / F.col("weight")).alias("r"), F.col("source").isNull(), "source")
    lower, upper = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(0, Window.unboundedFollowing)
    every = Window.partitionBy()
    room = F.sum("source_size").over(every) - cap * F.coalesce(F.sum("source_size").over(lower), F.lit(0))
    out = sums.withColumn("weight", weight).withColumn("level", room / F.sum("weight").over(upper))
    out = out.withColumn("full", F.col("source_size") * cap / F.col("weight") <= F.col("level"))
    level = F.max(F.when(~F.col("full"), F.col("level"))).over(every)
    target = F.when(F.col("full"), (F.col("source_size") * cap).cast("double")).otherwise(F.col("weight") * level)
    return out.select("source", "docs", "source_size", target.alias("target"))


def _rate(cap: int) -> Column:
    tilt = F.exp(-F.col("lam") * F.col("size") / F.col("mean"))
    inside = F.lit(float(cap)) / (1 + (cap - 1) * tilt)
    return F.when(F.col("lam").isNull(), F.when(F.col("target") > 0, float(cap)).otherwise(0.0)).otherwise(inside)


def _mark(state: DataFrame, few: bool) -> DataFrame:
    """A table of one row per source at most, for broadcast if the sources were counted to be few."""
    return F.broadcast(state) if few else state


def _with(rows: DataFrame, state: DataFrame, few: bool) -> DataFrame:
    """rows with their source's columns of state; state has one row per source."""
    named = state.withColumnRenamed("source", "_source")
    return rows.join(_mark(named, few), F.col("source").eqNullSafe(F.col("_source"))).drop("_source")


def _next(state: DataFrame, sums: DataFrame, few: bool, *columns: str) -> DataFrame:
    """state with columns of sums, null for sources that sums lacks."""
    return state.alias("s").join(_mark(sums, few).alias("g"), F.col("s.source").eqNullSafe(F.col("g.source")), "left").select("s.*", *columns)


def multipliers(sized: DataFrame, goals: DataFrame, cap: int = CAP, rounds: int = 80, few: bool = False) -> DataFrame:
    """goals with mean and lam. lam is null where the bound is met exactly: all documents at cap, or none.

    A round is one job: the grouped sums, and the sources' next multipliers, which are written.
    """
    histogram = saved(sized.where("size > 0").groupBy("source", "size").agg(F.count("*").alias("n")), "histogram")
    solvable = (F.col("target") > 0) & (F.col("target") < F.col("source_size") * cap * (1 - 1e-12))
    state = goals.withColumn("mean", F.greatest(F.col("source_size") / F.col("docs"), F.lit(1e-9)))
    state = state.withColumn("lam", F.when(solvable, F.lit(0.0)))
    none = F.lit(None).cast("double")
    state = saved(state.withColumns({"low": none, "high": none, "gap": F.when(solvable, F.lit(1.0)).otherwise(0.0)}), "dual")
    rate = F.col("r")
    for _ in range(rounds):
        mass = F.col("n") * F.col("size")
        sums = _with(histogram, state.where("lam IS NOT NULL"), few).withColumn("r", _rate(cap)).groupBy("source").agg(
            F.sum(mass * rate).alias("got"), F.sum(mass * F.col("size") / F.col("mean") * rate * (1 - rate / cap)).alias("slope")
        )
        now = _next(state, sums, few, "got", "slope")
        now = now.withColumn("error", F.col("got") - F.col("target"))
        now = now.withColumn("low", F.when(F.col("error") < 0, F.col("lam")).otherwise(F.col("low")))
        now = now.withColumn("high", F.when(F.col("error") > 0, F.col("lam")).otherwise(F.col("high")))
        most = 2 + F.abs("lam")
        step = F.greatest(-most, F.least(most, -F.col("error") / F.greatest(F.col("slope"), F.lit(1e-300))))
        tried = F.col("lam") + step
        outside = (tried <= F.col("low")) | (tried >= F.col("high"))
        middle = (F.col("low") + F.col("high")) / 2
        now = now.withColumn("gap", F.coalesce(F.abs("error") / F.col("target"), F.lit(0.0)))
        now = now.withColumn("lam", F.when(F.col("gap") <= TOLERANCE, F.col("lam")).when(F.coalesce(outside, F.lit(False)), middle).otherwise(tried))
        state = saved(now.select(*state.columns), "dual")
        if (left := state.agg(F.max("gap")).first()[0] or 0) <= TOLERANCE:
            break
    else:
        logging.getLogger(__name__).warning("a source's words are %.1e off its target after %d rounds", left, rounds)
    return state.withColumn("lam", F.round("lam", 10)).select("source", "docs", "source_size", "target", "mean", "lam")


def _draws(rows: DataFrame, id_col: str, cap: int) -> DataFrame:
    """rows with rate, the copies a hash draws from it (low), and how far the draw is from its next step (phase)."""
    draw = F.shiftrightunsigned(F.xxhash64(F.col(id_col).cast("long"), F.lit("mix")), 11) / F.lit(float(1 << 53))
    out = rows.withColumn("rate", _rate(cap)).withColumn("_at", F.col("rate") + draw)
    return out.withColumn("low", F.least(F.floor("_at"), F.lit(cap)).cast("int")).withColumn("phase", F.col("_at") - F.floor("_at")).drop("_at")


def _side(cap: int) -> tuple[Column, Column]:
    """Position in the order in which copies are added (way 1) or taken away (way -1), and whether one can be."""
    at = F.when(F.col("way") > 0, 1 - F.col("phase")).otherwise(F.col("phase"))
    can = F.when(F.col("way") > 0, (F.col("low") < cap) & (F.col("rate") > 0)).otherwise(F.col("low") > 0)
    return at, can & (F.col("way") != 0)


def rounding(sized: DataFrame, state: DataFrame, cap: int = CAP, few: bool = False) -> DataFrame:
    """state with way and cut: rows of a source before `cut` get a copy more (way 1) or less (way -1).

    Drawn copies meet a source's target on average. The rest is made up by
    the rows nearest to their next step, as many as it takes: a weighted
    quantile, found by three counts over ever finer bins of the position. What
    is left is below half of one document.
    """
    drawn = _draws(_with(sized, state, few), "doc_id", cap)
    sums = drawn.groupBy("source").agg(F.sum(F.col("low") * F.col("size")).alias("taken"))
    joined = _next(state, sums, few, "taken")
    off = F.col("target") - F.coalesce("taken", F.lit(0))
    cuts = joined.withColumns({"need": F.abs(off), "way": F.signum(off).cast("int"), "lo": F.lit(0.0), "full": F.lit(False), "cut": F.lit(0.0)}).drop("taken")
    cuts = saved(cuts, "cuts")
    at, can = _side(cap)
    width = 1.0
    for level in range(3):
        candidates = _draws(_with(sized, cuts, few), "doc_id", cap).withColumn("at", at).where(can & (F.col("size") > 0))
        inside = candidates.where((F.col("at") >= F.col("lo")) & (F.col("at") < F.col("lo") + width) & ~F.col("full"))
        bins = inside.withColumn("bin", F.floor((F.col("at") - F.col("lo")) / (width / _BINS)).cast("int")).groupBy("source", "bin").agg(F.sum("size").alias("mass"))
        upto = Window.partitionBy("source").orderBy("bin")
        summed = _with(bins.withColumn("sum", F.sum("mass").over(upto)), cuts.select("source", "need"), few)
        crossing = summed.where(F.col("sum") > F.col("need")).groupBy("source").agg(F.min_by(F.struct("bin", "mass", "sum"), "bin").alias("x"))
        next_ = _next(cuts, crossing, few, "x")
        step = width / _BINS
        lo = F.col("lo") + F.col("x.bin") * step
        rest = F.col("need") - (F.col("x.sum") - F.col("x.mass"))
        full = F.col("full") | (F.col("x").isNull() if level == 0 else F.lit(False))
        cut = F.when(full, F.lit(2.0)).otherwise(F.when(rest * 2 > F.col("x.mass"), lo + step).otherwise(lo))
        next_ = next_.withColumns({"cut": F.when(full | F.col("x").isNotNull(), cut).otherwise(F.col("cut")), "full": full, "need": F.coalesce(rest, F.col("need")), "lo": F.coalesce(lo, F.col("lo"))}).drop("x")
        cuts, width = saved(next_, "cuts"), step
    return cuts.select("source", "docs", "source_size", "target", "mean", "lam", "way", "cut")


def _copies(cap: int) -> Column:
    at, can = _side(cap)
    return F.col("low") + F.when(can & (at < F.col("cut")), F.col("way")).otherwise(0)


def plan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[int, ...] = WEIGHTS, cap: int = CAP) -> tuple[DataFrame, DataFrame, bool]:
    """The saved table (doc_id, source, size), the plan, a row per source, and whether the sources are few enough to broadcast."""
    sized = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(source_col).alias("source"), size_of(text_col).alias("size"))
    sized = saved(sized, "sizes")
    goals = saved(targets(sized, weights, cap), "targets")
    few = small(goals, SOURCES) is not goals
    return sized, saved(rounding(sized, multipliers(sized, goals, cap, few=few), cap, few), "mix"), few


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[int, ...] = WEIGHTS, cap: int = CAP) -> DataFrame:
    """One row per row of docs: doc_id, size, source_size, target, taken, copies, rate.

    Sources in code-point order, null last, take the weights in turn. A
    document's copies come from a hash of its id, so reruns agree and repeated
    rows share their fate. Null, empty and wordless texts have size 0 and take
    nothing; sources without words have target 0. Empty tables give empty
    results; other columns are ignored. Rows without an id share one draw.
    """
    sized, state, few = plan(docs, id_col, text_col, source_col, weights, cap)
    done = _draws(_with(sized, state, few), "doc_id", cap).withColumn("copies", _copies(cap))
    return done.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).cast("long").alias("taken"), "copies", "rate")


def mixed_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[int, ...] = WEIGHTS, cap: int = CAP) -> DataFrame:
    """docs as the mix takes them: each row as often as its copies, all columns kept.

    Wordless texts have no copies to count and stay once.
    """
    _, state, few = plan(docs, id_col, text_col, source_col, weights, cap)
    named = state.select(F.struct("*").alias("_plan"))
    own = F.struct(F.col(id_col).cast("long").alias("doc_id"), size_of(text_col).alias("size")).alias("_own")
    joined = docs.withColumn("_row", F.struct(*docs.columns)).select("_row", own, F.col(source_col).alias("_source"))
    joined = joined.join(_mark(named, few), F.col("_source").eqNullSafe(F.col("_plan.source")))
    done = _draws(joined.select("_row", "_own.*", "_plan.*"), "doc_id", cap).withColumn("copies", F.when(F.col("size") == 0, 1).otherwise(_copies(cap)))
    return done.where("copies > 0").select(F.explode(F.array_repeat("_row", F.col("copies").cast("int"))).alias("_row")).select("_row.*")
