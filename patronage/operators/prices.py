"""Hourly prices as dense vectors.

Sales are priced by the hour and the currency. Instead of a row for each, a
currency has one row for every span of SPAN_HOURS hours, whose array holds what one
unit of the currency was worth in ETH, hour by hour. Sales join these rows on the
currency and the span and pick their hour by its place in the array. The price side
has a hundredth of the rows of the price table, and its size is known before it is
broadcast: at most 8 bytes an hour.

The price table is read once and dealt once, by span. Everything else (the WETH
price of an hour, the check that keys are unique, the vectors) follows within the
span, which holds SPAN_HOURS rows a currency at most.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from patronage.functions.pricing import ETH_REFERENCE_SYMBOL
from patronage.functions.timefuncs import trunc_ntz

#: Hours of a vector (about five days; ten years are 685 spans): a power of two, so
#: that span and place are cut from the hour's number.
SPAN_BITS = 7
SPAN_HOURS = 1 << SPAN_BITS

#: Price tables of at most this many bytes (Spark's estimate) are broadcast as vectors
#: without being measured.
SMALL_BYTES = 10 << 20
#: Hours in all vectors, at most, that are broadcast (32 MB): measured where the
#: table is not small.
BROADCAST_CELLS = 4_000_000


def span_and_place(time: str) -> tuple[str, str]:
    """The span that a time (a column's name) lies in, and the place of its hour there,
    as SQL: from the whole hours of the wall clock since 1970."""
    number = f"(datediff(CAST({time} AS DATE), DATE'1970-01-01') * 24 + hour({time}))"
    return f"shiftright({number}, {SPAN_BITS})", f"({number} & {SPAN_HOURS - 1})"


def prices_in_scope(token_prices: DataFrame, snapshot: Column | None, day_column: str | None = None) -> DataFrame:
    """Prices of the hours up to the snapshot. ``day_column``: a date partition
    column, so that folders of later days are not read."""
    if snapshot is None:
        return token_prices
    cond = F.col("hour") <= trunc_ntz("hour", snapshot)
    if day_column and day_column in token_prices.columns:
        cond = cond & (F.col(day_column).cast("date") <= snapshot.cast("date"))
    return token_prices.filter(cond)


def _not_unique(what: str, *keys: str) -> str:
    shown = ", ', ', ".join(f"CAST({k} AS STRING)" for k in keys)
    return f"raise_error(concat('{what}: key ({', '.join(keys)}) is not unique: ', {shown}))"


def hourly_rates(token_prices: DataFrame, snapshot: Column | None = None, day_column: str | None = None) -> DataFrame:
    """(span, hour, token_address, rate), dealt by span: ETH for a unit of the token in
    that hour, its price over that of WETH (null where either is missing or WETH is
    at 0).

    Several prices for one token and hour, or several WETH prices for one hour, fail
    the query. Prices at times that are not whole hours price no sale and are left out.
    """
    span, _ = span_and_place("hour")
    weth = f"CASE WHEN symbol = '{ETH_REFERENCE_SYMBOL}' THEN struct(price) END"
    rows = (
        prices_in_scope(token_prices, snapshot, day_column)
        .filter("minute(hour) = 0 AND extract(SECOND FROM hour) = 0")
        .selectExpr(f"{span} AS span", "hour", "token_address", "price", f"{weth} AS _weth")
        .repartition("span")
        .selectExpr(
            "span", "hour", "token_address", "price",
            "max(_weth) OVER (PARTITION BY span, hour) AS _weth", "count(_weth) OVER (PARTITION BY span, hour) AS _weths",
        )
    )
    one = rows.groupBy("span", "hour", "token_address").agg(
        F.expr("max(price) AS _price"), F.expr("count(1) AS _n"), F.expr("max(_weth.price) AS _weth"), F.expr("max(_weths) AS _weths")
    )
    rate = f"""CASE WHEN _weths > 1 THEN {_not_unique("WETH prices", "hour")}
                    WHEN _n > 1 THEN {_not_unique("hourly token prices", "hour", "token_address")}
                    ELSE try_divide(_price, _weth) END AS rate"""
    return one.selectExpr("span", "hour", "token_address", rate)


def rate_vectors(rates: DataFrame) -> DataFrame:
    """(currency, span, first, rates): rates[i] is that of place first + i in the span.

    ``rates`` has one row for a token and hour, so a group has at most SPAN_HOURS rows
    whatever the data; hours without a price are null.
    """
    _, place = span_and_place("hour")
    cells = rates.filter("token_address IS NOT NULL").groupBy("span", "token_address")
    cells = cells.agg(F.expr(f"sort_array(collect_list(struct({place} AS place, rate))) AS _cells"))
    # the nulls between a cell and the one before, then the cell
    gap = "x.place - coalesce(get(_cells, i - 1).place + 1, x.place)"
    filled = f"flatten(transform(_cells, (x, i) -> concat(array_repeat(CAST(NULL AS DOUBLE), {gap}), array(x.rate))))"
    return cells.selectExpr("token_address AS currency", "span", "_cells[0].place AS first", f"{filled} AS rates")


def estimated_bytes(df: DataFrame) -> int:
    """Spark's estimate of the size of ``df`` (from file sizes; nothing is read)."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def count_cells(token_prices: DataFrame, snapshot: Column | None = None, day_column: str | None = None) -> int:
    """Hours in all vectors of the table: one aggregate, combined map-side, of which
    one number comes back."""
    span, place = span_and_place("hour")
    spans = (
        prices_in_scope(token_prices, snapshot, day_column)
        .groupBy("token_address", F.expr(span).alias("span"))
        .agg(F.expr(f"CAST(max({place}) - min({place}) + 1 AS LONG) AS cells"))
    )
    return spans.agg(F.sum("cells")).collect()[0][0] or 0


def vectors_for_join(
    token_prices: DataFrame,
    snapshot: Column | None = None,
    day_column: str | None = None,
    small_bytes: int = SMALL_BYTES,
    broadcast_cells: int = BROADCAST_CELLS,
) -> tuple[DataFrame, bool]:
    """The vectors, and whether they are marked for broadcast: if Spark estimates the
    price table at ``small_bytes`` or less, or if at most ``broadcast_cells`` hours
    are counted in it."""
    vectors = rate_vectors(hourly_rates(token_prices, snapshot, day_column))
    small = (
        estimated_bytes(token_prices) <= small_bytes
        or count_cells(token_prices, snapshot, day_column) <= broadcast_cells
    )
    return (F.broadcast(vectors) if small else vectors), small
