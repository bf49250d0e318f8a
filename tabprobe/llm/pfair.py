"""Mixing sources to target weights by Pfair scheduling, in DataFrame operations only.

A source's rows are cut into blocks. With weight w, its block j (from 0) may run from slot floor(j / w) and must
run before slot ceil((j + 1) / w). Earliest deadline first over these windows, narrowed so that k sources have their shares
to 1 - 1 / (2k - 2) blocks, puts every block into its window: after any number of slots the shares hold to less than one block. Slots are worked out in rounds that don't
wait for each other: what each source has had at the two ends of a round follows from the weights alone (``_reached``).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tabprobe.functions.joins import bounded_broadcast
from tabprobe.llm.common import numbered, written


def tempered_weights(docs: DataFrame, power: float = 0.5, source: str = "source") -> DataFrame:
    """Target weights ``source, weight`` in proportion to (rows of the source) ** power; null is a source too."""
    return docs.groupBy(F.col(source).cast("string").alias("source")).agg(
        F.pow(F.count(F.lit(1)).cast("double"), F.lit(power)).alias("weight"))


def quantised(weights: DataFrame, period: int) -> DataFrame:
    """``source, q``: weights as whole shares of a period, each 1 at least, largest remainders first, summing to Q.

    Q is ``period``, or the number of sources times 8 where that is more. One row a source.
    """
    one = W.partitionBy(F.lit(0))
    base = (weights.where(F.col("weight") > 0).withColumn("k", F.count(F.lit(1)).over(one))
            .withColumn("period", F.greatest(F.lit(period), F.col("k") * 8))
            .withColumn("x", 1 + F.col("weight") / F.sum("weight").over(one) * (F.col("period") - F.col("k")))
            .withColumn("q", F.floor("x")).withColumn("left", F.col("period") - F.sum("q").over(one))
            .withColumn("r", F.row_number().over(one.orderBy(F.desc(F.col("x") - F.col("q")), "source"))))
    return base.select("source", (F.col("q") + (F.col("r") <= F.col("left")).cast("long")).alias("q"),
                       F.col("period").cast("long").alias("period"))


def _window(done: Column, q: Column, period: Column) -> tuple[Column, Column]:
    """First slot of block ``done`` and the slot before which it must run, for weight q / period, in whole numbers."""
    return _div(done * period, q), _div((done + 1) * period + q - 1, q)


def _close(done: Column, q: Column, period: Column, edge: Column) -> tuple[Column, Column]:
    """The window of block ``done`` in which the share is held to 1 - edge / period blocks: in ``_window``, mostly narrower."""
    return _div(done * period + edge + q - 1, q) - 1, _div((done + 1) * period - edge, q) + 1


def _div(a: Column, b: Column) -> Column:
    return F.call_function("div", a, b)


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` worked out once."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _edge(shares: Column, period: Column) -> Column:
    """1 / (2k - 2) of a block for k sources, in 1 / period: with it windows can always be met (Tijdeman, 1980)."""
    return _div(period, F.greatest(F.size(shares) * 2 - 2, F.lit(2)).cast("long"))


def _reached(shares: Column, end: Column, length: Column, period: Column) -> Column:
    """Blocks that each source has had by slot ``end``: those due by then, or one more.

    The blocks begun but not due by ``end`` are taken by deadline, if all blocks that must lie in [s, end) still fit there
    for every s of the last ``length`` slots. So the blocks between two ends fit into the round between them, and those left
    over after it: the first as it is checked, the others as no choice leaves fewer blocks of early deadline.
    """
    return _let(F.transform(shares, lambda s: _div(s["q"] * end + _edge(shares, period) + period - 1, period) - 1), lambda part: _rounded(shares, part, end, length, period))


def _rounded(shares: Column, part: Column, end: Column, length: Column, period: Column) -> Column:
    edge = _edge(shares, period)
    first = F.greatest(end - length, F.lit(0).cast("long"))

    def must(at: Column) -> Column:
        each = F.zip_with(shares, part, lambda s, n: F.greatest(n - _div(s["q"] * at + period - edge, period), F.lit(0).cast("long")))
        return F.aggregate(each, F.lit(0).cast("long"), lambda x, y: x + y)

    room = F.when(end > 0, F.transform(F.sequence(first, F.greatest(end - 1, first)), lambda at: end - at - must(at)))

    def block(s: Column, n: Column) -> Column:
        release, deadline = _close(n, s["q"], period, edge)
        return F.when(release < end, F.struct(deadline.alias("deadline"), s["source"].alias("source"), release.alias("release")))

    begun = F.zip_with(shares, part, block)
    left = end - F.aggregate(part, F.lit(0).cast("long"), lambda x, y: x + y)
    start = F.struct(room.alias("room"), left.alias("left"), F.array().cast("array<string>").alias("more"))

    def step(state: Column, b: Column) -> Column:
        upto = (b["release"] - first + 1).cast("int")  # the s of this round up to its release
        fit = (state["left"] > 0) & ((upto <= 0) | (F.array_min(F.slice(state["room"], 1, F.greatest(upto, F.lit(1)))) > 0))
        return _let(fit, lambda fits: F.struct(F.when(fits, F.transform(state["room"], lambda x, i: x - (i < upto).cast("long"))).otherwise(state["room"]).alias("room"),
                        (state["left"] - fits.cast("long")).alias("left"),
                        F.when(fits, F.array_append(state["more"], b["source"])).otherwise(state["more"]).alias("more")))

    taken = F.aggregate(F.array_sort(F.filter(begun, lambda x: x.isNotNull())), start, step)["more"]
    return _let(taken, lambda more: F.zip_with(shares, part, lambda s, n: n + F.array_contains(more, s["source"]).cast("long")))


def schedule(shares: DataFrame, rounds: int, length: int | None = None) -> DataFrame:
    """``slot, source, block``: the first ``rounds`` rounds of ``length`` slots (default: the period), one row a slot.

    ``shares``: ``source, q, period`` as ``quantised`` gives them, one row a source. Each round is a row of its own.
    """
    row = shares.groupBy("period").agg(F.array_sort(F.collect_list(F.struct("source", "q"))).alias("shares"))
    each = shares.sparkSession.range(0, rounds, 1, max(1, min(rounds, 200))).crossJoin(F.broadcast(row))  # one row
    size = F.col("period") if length is None else F.lit(length).cast("long")
    each = each.withColumn("t0", F.col("id") * size).withColumn("t1", (F.col("id") + 1) * size)
    each = (each.withColumn("had", _reached(F.col("shares"), F.col("t0"), size, F.col("period")))
            .withColumn("goal", _reached(F.col("shares"), F.col("t1"), size, F.col("period"))))
    # the goal is part of the state as a column named in the step would be worked out anew at each slot
    start = F.struct(F.col("had").alias("done"), F.col("goal").alias("goal"), F.array().cast("array<struct<i:int,block:bigint>>").alias("order"))

    def step(state: Column, slot: Column) -> Column:
        def option(s: Column, i: Column) -> Column:
            release, deadline = _close(s["done"], s["shares"]["q"], F.col("period"), _edge(F.col("shares"), F.col("period")))
            return F.when((s["done"] < s["goal"]) & (release <= slot), F.struct(
                F.least(deadline, F.col("t1")).alias("deadline"), i.alias("i"), s["done"].alias("block")))

        first = F.array_min(F.transform(F.arrays_zip(F.col("shares"), state["done"].alias("done"), state["goal"].alias("goal")), option))
        return _let(first, lambda pick: F.struct(F.transform(state["done"], lambda d, i: F.when(i == pick["i"], d + 1).otherwise(d)).alias("done"),
                        state["goal"].alias("goal"),
                        F.array_append(state["order"], F.struct(pick["i"].alias("i"), pick["block"].alias("block"))).alias("order")))

    order = F.aggregate(F.sequence(F.col("t0"), F.col("t1") - 1), start, step)["order"]
    told = each.select("t0", "shares", F.posexplode(order).alias("at", "o"))
    return told.select((F.col("t0") + F.col("at")).alias("slot"), F.expr("shares[o.i].source").alias("source"), F.col("o.block").alias("block"))


def period_schedule(shares: DataFrame) -> DataFrame:
    """``source, turn, slot0, release0, deadline0, q, period``: one period by earliest deadline first, one row a slot."""
    turned = schedule(shares, 1).select("source", F.col("block").alias("turn"), F.col("slot").alias("slot0")).join(shares, "source")
    release, deadline = _window(F.col("turn"), F.col("q"), F.col("period"))
    return turned.withColumn("release0", release).withColumn("deadline0", deadline)


def _positions(rows: DataFrame, span: int) -> DataFrame:
    """``slot, mix_source, before``: rows in earlier slots. Sums over spans of slots first, so that no task gets all slots' rows."""
    sizes = rows.groupBy("span", "slot", "mix_source").agg(F.count(F.lit(1)).alias("n"))
    spans = sizes.groupBy("span").agg(F.sum("n").alias("m"))
    ahead = spans.select("span", F.coalesce(F.sum("m").over(
        W.orderBy("span").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("ahead"))
    within = F.coalesce(F.sum("n").over(W.partitionBy("span").orderBy("slot", "mix_source").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    return (sizes.withColumn("w", within).join(ahead, "span")
            .select("slot", "mix_source", (F.col("ahead") + F.col("w")).alias("before")))


#: Weights are whole shares of 2 ** FINE_BITS, or less for so many blocks that slots times shares would leave 62 bits.
FINE_BITS = 40
#: Slots are worked out as far as this many times the number of blocks; only blocks of sources whose weight is far below
#: their rows, long after another source has run out, lie behind.
REACH = 4


def pfair_mix(docs: DataFrame, weights: DataFrame | None = None, block_rows: int = 16, period: int = 1000,
              source: str = "source", order: str = "doc_id", span: int = 4096) -> DataFrame:
    """``docs`` with ``mix_source, block, release, deadline, slot, position``: every row, in the order of ``position``.

    ``weights`` has ``source, weight`` (default: ``tempered_weights``); a source without a positive weight there gets
    the smallest share. Rows of a source are taken by a hash order that does not depend on how they are stored; a block
    is ``block_rows`` of them in a row (the last one of a source may be shorter). ``position`` is 0, 1, 2, ... without
    gaps. While no source has run out, each has had its share of any first t slots to less than one block (and what
    rounding to 2 ** -40 adds: t * (sources + 1) / 2 ** 40); where one runs out its slots stay idle and the others go on
    in their own windows. ``period`` slots are worked out together. Behind ``REACH`` times as many slots as blocks a block
    takes the last slot of its window, which it may share. No row is dropped or repeated. Null sources
    are a source; null or repeated ids are ordinary rows; an empty table gives an empty result.
    """
    names = docs.columns
    src = F.col(f"`{source}`").cast("string")
    tagged = docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("row"), F.coalesce(src, F.lit("")).alias("mix_source"),
                         F.col(f"`{order}`").alias("o"))
    present = tagged.groupBy("mix_source").agg(F.count(F.lit(1)).alias("rows"))
    asked = (weights if weights is not None else tempered_weights(docs, source=source)).groupBy(
        F.coalesce(F.col("source"), F.lit("")).alias("mix_source")).agg(F.sum("weight").alias("weight"))
    wanted = present.join(asked, "mix_source", "left").select(
        F.col("mix_source").alias("source"), F.expr(f"(rows + {block_rows - 1}) div {block_rows}").alias("blocks"),
        F.when(F.col("weight") > 0, F.col("weight").cast("double")).otherwise(F.lit(1e-12)).alias("weight"))
    total, blocks = wanted.join(present.withColumnRenamed("mix_source", "source"), "source").agg(
        F.coalesce(F.sum("rows"), F.lit(0)), F.coalesce(F.sum("blocks"), F.lit(0))).first()
    fine = min(2**FINE_BITS, 2**62 // (REACH * blocks + 2 * period + 2))
    shares = quantised(wanted, fine)
    last = F.max(F.ceil(F.col("blocks") * F.col("period").cast("double") / F.col("q")))  # the slot by which all are through
    through = shares.join(wanted.select("source", "blocks"), "source").agg(last.cast("long")).first()[0] or 0
    rounds = -(-min(through, REACH * blocks) // period)
    plan = schedule(shares, rounds, period).withColumnRenamed("source", "mix_source")
    rows = numbered(tagged, ["mix_source"], [F.xxhash64("o"), F.col("o")], F.xxhash64("o", F.lit(5)), "idx",
                    buckets=max(16, total // 1_000_000))
    release, deadline = _window(F.col("block"), F.col("q"), F.col("period"))
    timed = (rows.withColumn("block", F.expr(f"idx div {block_rows}"))
             .join(bounded_broadcast(shares.withColumnRenamed("source", "mix_source"), shares.count()), "mix_source")  # a row a source
             .join(plan, ["mix_source", "block"], "left")
             .withColumn("release", release).withColumn("deadline", deadline)
             .withColumn("slot", F.coalesce(F.col("slot"), F.col("deadline") - 1)))
    # behind the rounds slots are sparse: as many spans there as before
    worked, wide = rounds * period, max(span, (through - rounds * period) // max(1, rounds * period // span))
    timed = timed.withColumn("span", F.when(F.col("slot") < worked, F.expr(f"slot div {span}")).otherwise(
        F.expr(f"{worked // span + 1} + (slot - {worked}L) div {wide}L")))
    placed = timed.join(_positions(timed.select("span", "slot", "mix_source"), span), ["slot", "mix_source"])
    position = (F.col("before") + F.col("idx") - F.col("block") * block_rows).cast("long")
    return placed.select("row.*", "mix_source", "block", "release", "deadline", "slot", position.alias("position"))


def mixed_documents(docs: DataFrame, **options) -> DataFrame:
    """``docs`` (``doc_id``, ``text``, ``source`` and others) sorted by the position of a Pfair mix: all rows, no new columns.

    The mix is worked out on slim rows; texts move to their positions and to their place in the order. Null ids, null and empty texts and equal rows are rows like others; columns may have any names.
    """
    none = F.lit(-(2**63))
    key = [F.coalesce(F.col("doc_id").cast("long"), none).alias("__d"), F.xxhash64("text").alias("__h")]
    slim = docs.select(*key, F.col("source")).withColumn("o", F.xxhash64("__d", "__h"))
    mix = written(pfair_mix(slim, order="o", **options).select("__d", "__h", "position"), "mix")
    # equal rows take their places in any order: both sides are numbered, and a row meets one place
    places = numbered(mix, ["__d", "__h"], [F.col("position")], F.col("position"), "__i", buckets=16)
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), *key)
    many = written(mix.groupBy("__d", "__h").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("__d", "__h"), "equal")
    # the numbers of rows are fixed in a table before they are used twice
    equal = written(rows.join(many, ["__d", "__h"], "left_semi").withColumn("__u", F.monotonically_increasing_id()), "equal-rows")
    equal = numbered(equal, ["__d", "__h"], [F.col("__u")], F.col("__u"), "__i", buckets=16).drop("__u")
    rows = rows.join(many, ["__d", "__h"], "left_anti").withColumn("__i", F.lit(0).cast("long")).unionByName(equal)
    return rows.join(places, ["__d", "__h", "__i"]).orderBy("position").select("row.*")
