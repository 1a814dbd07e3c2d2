"""What each trip costs from a pre-purchased shift and at auction.

A booking meets every auction of its id and every shift of its chauffeur. The reports over those
combinations are computed without producing them: sums factor into per-chauffeur sums, and "how
many combinations lie above a limit" becomes a rank lookup among the chauffeur's rates.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from fareloom.functions.exact import dec, half_even, mean, product_total, ratio, std
from fareloom.functions.keys import collapse, key_names, null_key, restore_key
from fareloom.functions.ordered import MICRO, micro, quantile_row, sums_before
from fareloom.functions.scalars import duration_divisor
from fareloom.functions.stats import on_bins
from fareloom.operators.auctions import PAIRS, PRICE, rates_per_chauffeur
from fareloom.operators.balance import beside
from fareloom.session import written

RATE = "hourly_rate_eur"
CHAUFFEUR = key_names("chauffeur_uuid")
WIDE = "decimal(38,0)"


def _trips(bookings: DataFrame, auctions: DataFrame, *more: Column) -> DataFrame:
    """Bookings with the prices of their auctions (NULL without one), equal rows counted."""
    booked = bookings.groupBy(
        *null_key(bookings, "booking_uuid"), *null_key(bookings, "chauffeur_uuid"),
        "booked_duration", *more
    ).agg(F.count("*").alias("repeats"))
    prices = collapse(auctions, "booking_uuid", F.count("*").alias("n"), also=(F.col(PRICE),))
    return booked.join(prices, key_names("booking_uuid"), "left").withColumn(
        "copies", F.col("repeats") * F.coalesce(F.col("n"), F.lit(1)))


def booking_costs(bookings: DataFrame, auctions: DataFrame, shifts: DataFrame,
                  duration_unit: str = "h") -> DataFrame:
    """One row per booking, auction price and distinct rate of its chauffeur's shifts.

    ``copies`` counts the joined rows a row stands for: shifts of one chauffeur at one rate give
    equal costs, so they are kept as a count instead of being repeated.
    """
    divisor = F.lit(float(duration_divisor(duration_unit)))
    rates = collapse(shifts, "chauffeur_uuid", F.count("*").alias("n_shifts"), also=(F.col(RATE),))
    joined = _trips(bookings, auctions).join(rates, CHAUFFEUR, "left")
    cost = F.col(RATE) * (F.col("booked_duration") / divisor)
    return joined.select(
        restore_key("booking_uuid"), restore_key("chauffeur_uuid"), "booked_duration", PRICE, RATE,
        cost.alias("pre_purchased_cost"),
        (F.col(PRICE) - cost).alias("cost_diff"),
        (F.col("copies") * F.coalesce(F.col("n_shifts"), F.lit(1))).alias("copies"),
    )


def _trip_cells(bookings: DataFrame, auctions: DataFrame, *more: str) -> DataFrame:
    """Trips counted per chauffeur, duration and price: what shifts are then set against.

    Several branches of a report start from them, so they are written out once.
    """
    keep = [F.col(c) for c in more]
    return written(_trips(bookings, auctions, *keep).groupBy(
        *CHAUFFEUR, "booked_duration", PRICE, *more).agg(F.sum("copies").alias("copies")),
        "trip-cells")


def _with_chauffeur(cells: DataFrame, known: DataFrame, how: str = "inner") -> DataFrame:
    """``cells`` with what ``known`` holds of their chauffeur, of whom it has one row each.

    Cells of a missing chauffeur, who may have most of them, meet that one row as a broadcast and
    are not shuffled. ``known`` is a written table, so that the join of the others can be split
    where one chauffeur has very many.
    """
    absent = F.col(CHAUFFEUR[1])
    present = cells.where(~absent).join(known.where(~absent), CHAUFFEUR, how)
    # One row at most: ``known`` is grouped by the chauffeur.
    missing = cells.where(absent).join(F.broadcast(known.where(absent)), CHAUFFEUR, how)
    return present.unionByName(missing)


def _difference_sums(cells: DataFrame, shifts: DataFrame, divisor: int) -> DataFrame:
    """Per trip cell: joined rows, known differences, and their exact sum times ``divisor``."""
    joined = _with_chauffeur(cells, written(rates_per_chauffeur(shifts), "chauffeurs"), "left")
    copies = F.col("copies").cast(PAIRS)
    known = F.col(PRICE).isNotNull() & F.col("booked_duration").isNotNull()
    n_diff = F.when(known, copies * F.coalesce(F.col("n_rate"), F.lit(0))).otherwise(F.lit(0))
    scaled = (
        dec(PRICE) * F.lit(divisor) * F.col("n_rate") - dec("booked_duration") * F.col("sum_rate"))
    return joined.select(
        "*",
        (copies * F.coalesce(F.col("n_shifts"), F.lit(1))).alias("rows"),
        n_diff.alias("n_diff"),
        F.when(known & (F.col("n_rate") > 0), (scaled * F.col("copies"))).alias("sum_diff"),
    )


def _mean_difference(divisor: int) -> Column:
    return ratio(F.sum("sum_diff"), F.sum("n_diff")) / F.lit(float(divisor))


def cost_comparison_summary(bookings: DataFrame, auctions: DataFrame, shifts: DataFrame,
                            duration_unit: str = "h") -> DataFrame:
    """Total shift cost, mean price, mean difference, and which side is cheaper how often."""
    divisor = duration_divisor(duration_unit)
    shift_cost = shifts.agg(product_total("shift_working_hours", RATE).alias("total"))
    price = auctions.agg(mean(PRICE).alias("mean"))
    trips = _trip_cells(bookings, auctions)
    difference = _difference_sums(trips, shifts, divisor).agg(
        _mean_difference(divisor).alias("mean"))
    cells, (rates, limits) = _difference_cells(trips, divisor), _rate_tables(shifts)
    signs = F.array(*[
        F.struct(F.lit(i).alias("id"), F.lit(i).cast(WIDE).alias("edge")) for i in (0, 1)])
    counted = _at_least(cells.withColumn("edges", signs), rates, limits).agg(
        F.sum(F.when(F.col("id") == 0, F.col("all_copies"))).alias("n"),
        F.sum(F.when(F.col("id") == 0, F.col("copies"))).alias("not_negative"),
        F.sum(F.when(F.col("id") == 1, F.col("copies"))).alias("positive"),
    )
    return beside(counted, s=shift_cost, p=price, d=difference).select(
        F.col("s.total").alias("total_shift_cost"),
        F.col("p.mean").alias("avg_auction_price"),
        F.col("d.mean").alias("avg_cost_diff"),
        (ratio(F.col("n") - F.col("not_negative"), F.col("n")) * 100).alias("auction_cheaper_pct"),
        (ratio(F.col("positive"), F.col("n")) * 100).alias("shift_cheaper_pct"),
    )


def cost_diff_by_hour(bookings: DataFrame, auctions: DataFrame, shifts: DataFrame,
                      duration_unit: str = "h") -> DataFrame:
    divisor = duration_divisor(duration_unit)
    timed = bookings.dropna(subset=["booked_start_at"]).withColumn(
        "hour", F.hour("booked_start_at"))
    trips = _trip_cells(timed, auctions, "hour")
    return _difference_sums(trips, shifts, divisor).groupBy("hour").agg(
        _mean_difference(divisor).alias("avg_cost_diff"))


def cost_diff_by_duration_quantile(bookings: DataFrame, auctions: DataFrame, shifts: DataFrame,
                                   bins: int = 5, duration_unit: str = "h") -> DataFrame:
    """Mean difference in right-closed quantile bins of the booked duration.

    The quantiles are over the joined rows. Equal edges merge, a bin nothing falls into has a
    NULL mean, and a constant duration has no bins: ``cost_diff_by_duration`` then gives the
    summary.
    """
    divisor = duration_divisor(duration_unit)
    trips = _trip_cells(bookings, auctions)
    by_duration = written(_difference_sums(trips, shifts, divisor).dropna(
        subset=["booked_duration"]
    ).groupBy("booked_duration").agg(
        F.sum("rows").alias("rows"), F.sum("n_diff").alias("n_diff"),
        F.sum("sum_diff").alias("sum_diff")), "duration-cells")
    # As many edges as bins and one more, so that they can be named in the plan.
    edges = quantile_row(
        by_duration, F.col("booked_duration"), [i / bins for i in range(bins + 1)],
        F.col("rows")).select(F.array_distinct("q")).first()[0] or []
    value = F.col("booked_duration")
    # Bin i is (edge[i], edge[i+1]]; the first also holds its lower edge.
    number = F.lit(0)
    for i, edge in enumerate(edges[1:-1], start=1):
        number = F.when(value > F.lit(edge), F.lit(i)).otherwise(number)
    binned = by_duration.groupBy(number.alias("bin")).agg(
        half_even(_mean_difference(divisor)).alias("avg_cost_diff"))
    axis = by_duration.sparkSession.createDataFrame(
        [(i, low / divisor, high / divisor) for i, (low, high) in enumerate(zip(edges, edges[1:]))],
        "bin int, duration_from double, duration_to double")
    return axis.join(binned, "bin", "left")


def cost_diff_by_duration(bookings: DataFrame, auctions: DataFrame, shifts: DataFrame,
                          bins: int = 5, duration_unit: str = "h") -> DataFrame:
    """The report by duration: quantile bins, or the summary where no two durations differ."""
    binned = cost_diff_by_duration_quantile(bookings, auctions, shifts, bins, duration_unit)
    return cost_diff_summary(bookings, auctions, shifts, duration_unit) if binned.isEmpty() \
        else binned


def cost_diff_summary(bookings: DataFrame, auctions: DataFrame, shifts: DataFrame,
                      duration_unit: str = "h") -> DataFrame:
    """Eight-number summary of the differences over all joined rows."""
    costs = booking_costs(bookings, auctions, shifts, duration_unit).dropna(subset=["cost_diff"])
    cells = written(costs.groupBy("cost_diff").agg(
        F.sum(F.col("copies").cast("decimal(20,0)")).alias("n")), "differences")
    x = F.col("cost_diff")
    centred = cells.withColumn("mean", cells.agg(
        ratio(F.sum(dec(x) * F.col("n").cast("decimal(18,0)")), F.sum("n"))).scalar())
    moments = centred.agg(
        F.coalesce(F.sum("n"), F.lit(0)).cast("bigint").alias("count"),
        F.max("mean").alias("mean"),
        half_even(F.sqrt(ratio(F.sum(F.col("n") * F.pow(x - F.col("mean"), F.lit(2))),
                               F.sum("n") - 1)), 6).alias("std"),
        F.min(x).alias("min"), F.max(x).alias("max"))
    cut = quantile_row(cells, x, [0.25, 0.5, 0.75], F.col("n"))
    return beside(moments, c=cut).select(
        "count", "mean", "std", "min",
        *[F.get("c.q", F.lit(i)).alias(name) for i, name in enumerate(("q25", "q50", "q75"))],
        "max")


def cost_summary(shifts: DataFrame, auctions: DataFrame) -> DataFrame:
    prices = auctions.agg(mean(PRICE).alias("mean"), std(PRICE).alias("std"),
                          F.min(PRICE).alias("min"), F.max(PRICE).alias("max"))
    supply = shifts.agg(product_total("shift_working_hours", RATE).alias("total_shift_cost"),
                        mean(RATE).alias("avg_hourly_rate"))
    return beside(supply, p=prices).select(
        "total_shift_cost", "avg_hourly_rate",
        F.col("p.mean").alias("avg_auction_price"), F.col("p.std").alias("std_auction_price"),
        F.col("p.min").alias("min_auction_price"), F.col("p.max").alias("max_auction_price"))


# --- counting combinations by rank -----------------------------------------------------------
#
# With prices, rates and durations as integers (micro-units), the value of a combination is
# base + rate * slope, exact in decimal(38,0). "value >= edge" is then a bound on the rate, and
# the number of the chauffeur's shifts beyond that bound comes from sums_before.


def _rate_tables(shifts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Shift counts per chauffeur and rate, and the range and number of each chauffeur's rates."""
    known = shifts.dropna(subset=[RATE])
    rates = written(known.groupBy(
        *null_key(known, "chauffeur_uuid"), micro(F.col(RATE)).alias("code")
    ).agg(F.count("*").alias("n")), "rates")
    limits = written(rates.groupBy(*CHAUFFEUR).agg(
        F.min("code").alias("low"), F.max("code").alias("high"), F.sum("n").alias("n_rate")),
        "rate-limits")
    return rates, limits


def _difference_cells(trips: DataFrame, divisor: int) -> DataFrame:
    """Cells of price - rate * duration, scaled by divisor * 10**12."""
    return trips.dropna(subset=[PRICE, "booked_duration"]).select(
        *CHAUFFEUR,
        (micro(F.col(PRICE)).cast(WIDE) * F.lit(divisor * MICRO).cast(WIDE)).alias("base"),
        (-micro(F.col("booked_duration"))).cast(WIDE).alias("slope"),
        "copies")


def _cost_cells(trips: DataFrame) -> DataFrame:
    """Cells of rate * duration, scaled by divisor * 10**12."""
    return trips.dropna(subset=["booked_duration"]).groupBy(
        *CHAUFFEUR, F.lit(0).cast(WIDE).alias("base"),
        micro(F.col("booked_duration")).cast(WIDE).alias("slope"),
    ).agg(F.sum("copies").alias("copies"))


def _floor_div(a: Column, b: Column, low: Column, high: Column) -> Column:
    """floor(a / b) for b > 0, clamped to [low, high] before dividing so that it fits a bigint."""
    clamped = F.least(F.greatest(a, low.cast(WIDE) * b), high.cast(WIDE) * b)
    return F.call_function("div", clamped, b) - F.when(clamped % b < 0, 1).otherwise(0)


def _at_least(cells: DataFrame, rates: DataFrame, limits: DataFrame) -> DataFrame:
    """For every cell and every ``edges`` entry: how many combinations have value >= edge.

    Rows ``id, copies, all_copies``. Only edges that separate a chauffeur's rates are looked up.
    """
    long = _with_chauffeur(cells, limits).select(
        *CHAUFFEUR, "base", "slope", "copies", "low", "high", "n_rate",
        F.inline("edges")).withColumn("steep", F.abs("slope"))
    gap = F.when(F.col("slope") > 0, F.col("edge") - F.col("base")).otherwise(
        F.col("base") - F.col("edge"))
    low, high = F.col("low") - 1, F.col("high") + 1
    # Rising values: rates from ceil(gap/steep) on; falling ones: rates up to floor(gap/steep).
    bound = F.when(F.col("slope") > 0, -_floor_div(-gap, F.col("steep"), -high, -low)).when(
        F.col("slope") < 0, _floor_div(gap, F.col("steep"), low, high) + 1)
    bounded = long.withColumn("bound", bound)
    inside = (F.col("bound") > F.col("low")) & (F.col("bound") <= F.col("high"))
    probes = bounded.where(inside).select(*CHAUFFEUR, F.col("bound").alias("code"))
    ranks = sums_before(rates, probes, "code", ["n"], CHAUFFEUR).select(
        *CHAUFFEUR, F.col("code").alias("bound"), "before_n")
    before = F.when(F.col("bound") <= F.col("low"), 0).when(
        F.col("bound") > F.col("high"), F.col("n_rate")).otherwise(F.col("before_n"))
    count = (
        F.when(F.col("slope") > 0, F.col("n_rate") - before)
        .when(F.col("slope") < 0, before)
        .otherwise(F.when(F.col("base") >= F.col("edge"), F.col("n_rate")).otherwise(0))
    )
    pairs = F.col("copies").cast(PAIRS)
    return bounded.join(ranks, [*CHAUFFEUR, "bound"], "left").select(
        "id", (pairs * count).alias("copies"), (pairs * F.col("n_rate")).alias("all_copies"))


def _value_range(cells: DataFrame, limits: DataFrame) -> DataFrame:
    at = [F.col("base") + F.col("slope") * F.col(c).cast(WIDE) for c in ("low", "high")]
    return _with_chauffeur(cells, limits).select(
        "*", F.least(*at).alias("value_low"), F.greatest(*at).alias("value_high"))


def _binned_combinations(cells: DataFrame, rates: DataFrame, limits: DataFrame,
                         edges: DataFrame, bins: int) -> DataFrame:
    """Counts per bin of [low, high] (one row of ``edges``, integers), the top edge closed.

    A cell puts all its combinations into the bin of its smallest value; at every bin edge
    between its extremes, those beyond the edge move up one bin.
    """
    span = F.col("e.high") - F.col("e.low")

    def bin_of(c: str) -> Column:
        scaled = (F.col(c) - F.col("e.low")) * F.lit(bins).cast(WIDE)
        return F.when(span == 0, F.lit(1)).otherwise(F.least(
            F.call_function("div", scaled, F.greatest(span, F.lit(1).cast(WIDE))).cast("int") + 1,
            F.lit(bins)))

    # Values, edges and slopes are multiplied by the number of bins to keep the edges integer.
    many = F.lit(bins).cast(WIDE)
    placed = _value_range(cells, limits).withColumn(
        "e", edges.select(F.struct(*edges.columns)).scalar()
    ).withColumns({"first": bin_of("value_low"), "last": bin_of("value_high")})
    start = placed.select(
        F.col("first").alias("bin"),
        (F.col("copies").cast(PAIRS) * F.col("n_rate")).alias("n"))
    crossing = placed.where(F.col("last") > F.col("first")).select(
        *CHAUFFEUR, (F.col("base") * many).alias("base"), (F.col("slope") * many).alias("slope"),
        "copies",
        F.transform(F.sequence(F.col("first"), F.col("last") - 1), lambda i: F.struct(
            i.alias("id"), (F.col("e.low") * many + span * i.cast(WIDE)).cast(WIDE).alias("edge")
        )).alias("edges"))
    moves = _at_least(crossing, rates, limits).select(F.inline(F.array(
        F.struct((F.col("id") + 1).alias("bin"), F.col("copies").alias("n")),
        F.struct(F.col("id").alias("bin"), (-F.col("copies")).alias("n")))))
    return start.unionByName(moves).groupBy("bin").agg(F.sum("n").cast("bigint").alias("n"))


def cost_diff_histogram(bookings: DataFrame, auctions: DataFrame, shifts: DataFrame,
                        bins: int = 50, duration_unit: str = "h") -> DataFrame:
    divisor = duration_divisor(duration_unit)
    cells = _difference_cells(_trip_cells(bookings, auctions), divisor)
    rates, limits = _rate_tables(shifts)
    edges = written(_value_range(cells, limits).agg(
        F.min("value_low").alias("low"), F.max("value_high").alias("high")), "edges")
    counted = _binned_combinations(cells, rates, limits, edges, bins).withColumn(
        "series", F.lit("cost_diff"))
    return on_bins(counted, _edges_as_numbers(edges, divisor), ["cost_diff"], bins)


def cost_vs_price_histogram(bookings: DataFrame, auctions: DataFrame, shifts: DataFrame,
                            bins: int = 50, duration_unit: str = "min") -> DataFrame:
    """Shift cost and auction price of all combinations, on the same bin edges."""
    divisor = duration_divisor(duration_unit)
    trips = _trip_cells(bookings, auctions)
    cells, (rates, limits) = _cost_cells(trips), _rate_tables(shifts)
    prices = _difference_sums(trips, shifts, divisor).dropna(subset=[PRICE]).groupBy(
        (micro(F.col(PRICE)).cast(WIDE) * F.lit(divisor * MICRO).cast(WIDE)).alias("value")
    ).agg(F.sum("rows").alias("n"))
    extremes = _value_range(cells, limits).select("value_low", "value_high").unionByName(
        prices.select(F.col("value").alias("value_low"), F.col("value").alias("value_high")))
    edges = written(extremes.agg(
        F.min("value_low").alias("low"), F.max("value_high").alias("high")), "edges")
    costs = _binned_combinations(cells, rates, limits, edges, bins).withColumn(
        "series", F.lit("shift_cost"))
    span = F.col("e.high") - F.col("e.low")
    bin_number = F.when(span == 0, F.lit(1)).otherwise(F.least(
        F.call_function("div", (F.col("value") - F.col("e.low")) * F.lit(bins).cast(WIDE),
                        F.greatest(span, F.lit(1).cast(WIDE))).cast("int") + 1, F.lit(bins)))
    priced = prices.withColumn("e", edges.select(F.struct(*edges.columns)).scalar()).groupBy(
        bin_number.alias("bin")
    ).agg(F.sum("n").cast("bigint").alias("n")).withColumn("series", F.lit("auction_price"))
    return on_bins(costs.unionByName(priced), _edges_as_numbers(edges, divisor),
                   ["shift_cost", "auction_price"], bins)


def _edges_as_numbers(edges: DataFrame, divisor: int) -> DataFrame:
    scale = F.lit(float(divisor) * MICRO * MICRO)
    return edges.select(F.struct(
        (F.col("low").cast("double") / scale).alias("low"),
        (F.col("high").cast("double") / scale).alias("high")).alias("edges"))
