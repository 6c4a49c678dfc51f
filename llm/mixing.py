"""Mixing sources to target weights by entropy balancing; DataFrame operations only."""

from __future__ import annotations

from fractions import Fraction
from math import log

from pyspark.sql import Column, DataFrame, functions as F

from llm.tables import settled

SPACE = r"\x20\x09-\x0D"
#: Documents that share one rounding group, on average.
GROUP = 1_024
#: Identical rows written out by one element.
RUN = 10_000
NEAR, ROUNDS = 1e-9, 200


def word_count(text: Column) -> Column:
    """Number of ``[^\\x20\\x09-\\x0D]+``, without an array of them."""
    marks = F.regexp_replace(text, rf"[{SPACE}]*+[^{SPACE}]++[{SPACE}]*+", "x")
    # A text without words is left as it is.
    return F.coalesce(F.length(F.regexp_replace(marks, rf"[{SPACE}]+", "")), F.lit(0)).cast("long")


def ranked(sources: DataFrame) -> DataFrame:
    """``sources`` with ``rank`` from 0 by ``source`` in code-point order, null last; no task sees all of them."""
    order = F.col("source").asc_nulls_last()
    parted = settled(sources.repartitionByRange(order).withColumn("part", F.spark_partition_id()), "parted")
    sizes = dict(parted.groupBy("part").count().collect())  # one for each shuffle partition
    before, offsets = 0, []
    for part in range(max(sizes, default=-1) + 1):
        offsets.append(before)
        before += sizes.get(part, 0)
    if not offsets:
        return sources.withColumn("rank", F.lit(0).cast("long"))
    numbered = parted.withColumns(
        {
            "row": F.expr("row_number() over (partition by part order by source asc nulls last)"),
            "offset": F.element_at(F.array(*[F.lit(o).cast("long") for o in offsets]), F.col("part") + 1),
        }
    )
    return numbered.withColumn("rank", F.col("offset") + F.col("row") - 1).drop("part", "row", "offset")


def shared_targets(sources: DataFrame, share: Fraction, most: Fraction) -> DataFrame:
    """``sources(weight, source_size)`` with ``target``: ``share`` of all words by weight, none above ``most`` times its own.

    What sources can't take goes to the others by weight, until none is above.
    """
    total = sources.agg(F.sum("source_size")).first()[0] or 0
    full, weight = 0, sources.agg(F.sum("weight")).first()[0] or 0
    level = None
    while weight:
        level = (share * total - most * full) / weight
        above = F.col("weight") * float(level) > float(most) * F.col("source_size")
        now = sources.agg(F.sum(F.when(above, F.col("source_size"))), F.sum(F.when(~above, F.col("weight")))).first()
        if (now[0] or 0, now[1] or 0) == (full, weight):
            break
        full, weight = now[0] or 0, now[1] or 0
    cap = float(most) * F.col("source_size")
    if not weight or level is None:
        return sources.withColumn("target", cap)
    given = F.col("weight") * float(level.numerator) / float(level.denominator)
    return sources.withColumn("target", F.when(given > cap, cap).otherwise(given))


def rate(base: float, most: float) -> Column:
    """Copies wanted of a document: the base rate tilted by ``lam`` per mean size, at most ``most``; all of a full source."""
    tilt = F.least(F.lit(log(most) - log(base)), F.col("lam") * F.col("size") / F.col("mean"))
    return F.when(F.col("full") & (F.col("size") > 0), F.lit(most)).otherwise(F.least(F.lit(most), base * F.exp(tilt)))


def solve(histogram: DataFrame, sources: DataFrame, base: float, most: float) -> DataFrame:
    """``sources(rank, mean, target, full)`` with the multiplier ``lam`` at which the rates meet the target.

    ``histogram(rank, size, n)`` stands for the documents. The dual is convex and
    separable by source: Newton steps on the logarithm of its gradient, all
    sources at once, one aggregation a step. A bracket keeps a step from leaving
    what earlier steps have shown; such a step halves the bracket instead. Sums
    are decimal, so that reruns in another order agree to the last digit.
    """
    open_ = settled(
        sources.where(~F.col("full")).select("rank", "mean", "target", F.lit(0.0).alias("lam"), F.lit(None).cast("double").alias("low"), F.lit(None).cast("double").alias("high"), F.lit(False).alias("full")),
        "newton",
    )
    done = [sources.where("full").select("rank", F.lit(0.0).alias("lam"))]
    words = F.col("n") * F.col("size") * F.col("r")
    bends = F.when(F.col("r") < most, words * F.col("size") / F.col("mean")).otherwise(0.0)
    for _ in range(ROUNDS):
        if open_.isEmpty():
            break
        met = histogram.join(open_, "rank").withColumn("r", rate(base, most))
        sums = met.groupBy("rank", "mean", "target", "lam", "low", "high").agg(
            F.sum(words.cast("decimal(38,9)")).cast("double").alias("f"), F.sum(bends.cast("decimal(38,9)")).cast("double").alias("d")
        )
        over = F.col("f") > F.col("target")
        moved = sums.withColumns({"high": F.when(over, F.col("lam")).otherwise(F.col("high")), "low": F.when(over, F.col("low")).otherwise(F.col("lam"))})
        newton = F.col("lam") + F.when(F.col("d") > 0, F.log(F.col("target") / F.col("f")) * F.col("f") / F.col("d"))
        beyond = F.when(over, F.col("lam") - 1 - F.abs("lam")).otherwise(F.col("lam") + 1 + F.abs("lam"))
        middle = F.coalesce((F.col("low") + F.col("high")) / 2, beyond)
        inside = (newton > F.coalesce("low", F.lit(float("-inf")))) & (newton < F.coalesce("high", F.lit(float("inf"))))
        stepped = moved.select(
            "rank", "mean", "target", "low", "high", F.lit(False).alias("full"), "lam",
            F.when(F.coalesce(inside, F.lit(False)), newton).otherwise(middle).alias("next"),
            (F.abs(F.col("f") - F.col("target")) <= NEAR * F.col("target")).alias("met"),
        )
        stepped = settled(stepped, "newton")
        stay = F.col("met") | (F.col("next") == F.col("lam"))
        done.append(stepped.where(stay).select("rank", "lam"))
        open_ = stepped.where(~stay).select("rank", "mean", "target", F.col("next").alias("lam"), "low", "high", "full")
    done.append(open_.select("rank", "lam"))
    out = done[0]
    for part in done[1:]:
        out = out.unionByName(part)
    return sources.join(out, "rank")


def rounded(rates: DataFrame, most: float) -> DataFrame:
    """``rates(rank, doc_id, size, m, r, group)`` with ``copies`` of all ``m`` equal rows together.

    In each group the largest documents are rounded first, and what rounding
    gains or loses in words is carried to the next, so that a group ends within
    about its smallest document of what its rates ask for.
    """
    keep = [c for c in rates.columns if c not in ("rank", "group", "size", "doc_id", "m", "r")]
    item = F.struct((-F.col("size")).alias("minus"), "doc_id", "m", "r", *keep)
    grouped = rates.groupBy("rank", "group").agg(F.sort_array(F.collect_list(item)).alias("items"))

    def step(acc: Column, x: Column) -> Column:
        size = -x["minus"]
        asked = x["m"] * x["r"] + F.when(size > 0, acc["err"] / size).otherwise(0.0)
        taken = F.least(F.lit(most) * x["m"], F.greatest(F.lit(0.0), F.floor(asked + 0.5).cast("double")))
        return F.struct(
            (acc["err"] + size * (x["m"] * x["r"] - taken)).alias("err"), F.concat(acc["copies"], F.array(taken.cast("long"))).alias("copies")
        )

    start = F.struct(F.lit(0.0).alias("err"), F.array().cast("array<bigint>").alias("copies"))
    walked = grouped.select("items", F.aggregate("items", start, step)["copies"].alias("all"))
    rows = walked.select("all", F.posexplode("items").alias("at", "x"))
    return rows.select("x.doc_id", (-F.col("x.minus")).alias("size"), "x.m", "x.r", *[F.col(f"x.{c}").alias(c) for c in keep], F.element_at("all", F.col("at") + 1).alias("copies"))


def mix_sources(
    docs: DataFrame, weights: tuple[int, ...] = (5, 2, 1), share: Fraction = Fraction(3, 2), most: int = 2,
    id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
) -> DataFrame:
    """``doc_id, size, source_size, target, taken, copies, rate`` of every document.

    A document's size is its number of words. Sources in code-point order, null
    last, weigh ``weights`` in turn and share ``share`` times all words; a target
    stops at ``most`` times its source's words and the rest is shared by weight
    among the others. Among all rates that meet the targets and stay within
    ``most`` copies, those of least relative entropy to the even rate ``share``
    are taken: ``share * exp(lam * size)`` with one multiplier a source, found by
    Newton steps on the convex dual. Rates are then rounded into whole copies;
    ``taken`` is ``copies * size``. A source at its stop takes all documents
    ``most`` times.

    Null and empty texts have size 0 and take nothing, whatever their copies; a
    source without words has target 0. Rows that repeat an id are documents of
    their own; equal rows are rounded together. An empty table gives an empty
    result, and reruns agree. A hot source is split: its documents are first
    counted by size, and rounded in hashed groups of about a thousand.
    """
    sized = docs.select(
        F.col(id_col).cast("long").alias("doc_id"), F.col(source_col).cast("string").alias("source"), word_count(F.col(text_col).cast("string")).alias("size")
    )
    sized = settled(sized, "sized")
    totals = settled(sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("rows")), "sources")
    order = settled(ranked(totals), "ranked")
    turn = F.element_at(F.array(*[F.lit(w) for w in weights]), (F.col("rank") % len(weights) + 1).cast("int"))
    base, cap = float(share), float(most)
    targets = shared_targets(order.withColumn("weight", turn), share, Fraction(most))
    full = F.col("target") >= cap * F.col("source_size")
    targets = settled(targets.withColumns({"full": full, "mean": F.greatest(F.col("source_size") / F.col("rows"), F.lit(1e-9))}), "targets")
    ids = targets.select(F.col("source").alias("own"), "rank")
    placed = sized.join(ids, F.col("source").eqNullSafe(F.col("own"))).groupBy("rank", "doc_id", "size").agg(F.count("*").alias("m"))
    placed = settled(placed, "placed")
    histogram = settled(placed.where("size > 0").groupBy("rank", "size").agg(F.sum("m").alias("n")), "histogram")
    solved = settled(solve(histogram, targets, base, cap), "solved")
    rates = placed.join(solved.drop("source", "weight"), "rank").withColumn("r", rate(base, cap))
    groups = F.ceil(F.col("rows") / GROUP)
    rates = rates.withColumn("group", F.pmod(F.xxhash64("doc_id", "size"), groups)).select("rank", "group", "doc_id", "size", "m", "r", "source_size", "target")
    whole = rounded(rates, cap)
    runs = whole.withColumn("run", F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"(m - 1) div {RUN}"))))
    rows = runs.withColumn("i", F.explode(F.sequence(F.col("run") * RUN, F.least("m", (F.col("run") + 1) * RUN) - 1)))
    one = F.expr("copies div m") + F.when(F.col("i") < F.col("copies") % F.col("m"), 1).otherwise(0)
    rows = rows.withColumn("copies", one.cast("long"))
    return rows.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"), "copies", F.col("r").alias("rate"))
