"""Requests by address: grouping, pacing, runs and statistics.

``order`` is the name of a unique integer column that gives the order of the requests (a line
number, ``monotonically_increasing_id``, a time). Work over that order is done in two levels: inside
``slices`` slices of about equal numbers of requests, with bounds at quantiles of the order, and over
one summary row per slice. So the upper level holds a fixed number of rows, and the lower one a fixed
part of the requests, whatever the values of the order and the size of an address. Requests without an
order value have no place; they are handed back apart.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from webspark.functions.binding import let

# Name of the group of requests without address, seconds between two requests of one
# address.
NO_ADDRESS = "<nil>"
DELAY_SECONDS = 1

SLICES = 1024


def address_key(ip: str = "ip") -> Column:
    """The address, one shared name for requests without any."""
    return F.coalesce(F.col(ip), F.lit(NO_ADDRESS))


def group_by_address(requests: DataFrame, order: str, ip: str = "ip") -> DataFrame:
    """(address, requests, first, last): size and extent of every address's group."""
    return requests.groupBy(address_key(ip).alias("address")).agg(
        F.count(F.lit(1)).alias("requests"),
        F.min(order).alias("first"),
        F.max(order).alias("last"),
    )


def _sliced(requests: DataFrame, order: str, slices: int) -> DataFrame:
    """Requests with the number of their slice. The bounds are one row of at most ``slices`` numbers.
    They are looked up in two steps of about a square root of them each."""
    # Lists of numbers are JSON texts, which are folded to one literal: a call or a parsed literal for each number
    # takes seconds of the driver.
    steps = f"from_json('{[k / slices for k in range(1, slices)]}', 'array<double>')"
    found = F.expr(f"percentile_approx(`{order}`, {steps}, {max(10_000, 10 * slices)})")
    bounds = sorted(set(requests.agg(found).first()[0] or [])) if slices > 1 else []
    size = max(1, int(len(bounds) ** 0.5))
    groups = [bounds[k : k + size] for k in range(0, len(bounds), size)]
    if not groups:
        return requests.withColumn("ws_slice", F.lit(0))
    firsts = f"from_json('{[g[0] for g in groups]}', 'array<bigint>')"
    rest = f"from_json('{groups}', 'array<array<bigint>>')"
    group = f"size(filter({firsts}, ws_b -> ws_b <= `{order}`))"
    inside = f"size(filter(element_at({rest}, ws_g), ws_b -> ws_b <= `{order}`))"
    place = let(group, "ws_g", lambda g: f"if({g} = 0, 0, ({g} - 1) * {size} + {inside})")
    return requests.withColumn("ws_slice", F.expr(place))


def _placed(requests: DataFrame, order: str) -> tuple[DataFrame, DataFrame]:
    """(requests with an order value, those without)."""
    return requests.filter(F.col(order).isNotNull()), requests.filter(F.col(order).isNull())


def politeness_plan(
    requests: DataFrame,
    order: str,
    ip: str = "ip",
    delay: int = DELAY_SECONDS,
    slices: int = SLICES,
) -> tuple[DataFrame, DataFrame]:
    """(planned, requests without an order value). Planned requests have ``address``, ``position`` (from 0, in order, within the address) and
    ``start_after``, the seconds from the start of the group before which the request may not go."""
    placed, without = _placed(requests, order)
    sliced = _sliced(placed, order, slices).withColumn("address", address_key(ip))
    earlier = (
        Window.partitionBy("address")
        .orderBy("ws_slice")
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    before = (
        sliced.groupBy("address", "ws_slice")
        .agg(F.count(F.lit(1)).alias("ws_n"))
        .select(
            "address",
            "ws_slice",
            F.coalesce(F.sum("ws_n").over(earlier), F.lit(0)).alias("ws_before"),
        )
    )
    inside = Window.partitionBy("address", "ws_slice").orderBy(order)
    planned = (
        sliced.withColumn("ws_row", F.row_number().over(inside) - 1)
        .join(before, ["address", "ws_slice"])
        .withColumn("position", F.col("ws_before") + F.col("ws_row"))
        .withColumn("start_after", F.col("position") * F.lit(delay))
        .select(*requests.columns, "address", "position", "start_after")
    )
    return planned, without


def run_batches(
    requests: DataFrame, order: str, ip: str = "ip", slices: int = SLICES
) -> tuple[DataFrame, DataFrame]:
    """(numbered, requests without an order value). Numbered requests have ``batch``, the number (from 0) of their run of one address in the order.

    A new run starts where the previous request has an address and this one has another or none;
    after a request without address nothing starts.
    """
    placed, without = _placed(requests, order)
    sliced = _sliced(placed, order, slices)
    inside = Window.partitionBy("ws_slice").orderBy(order)
    so_far = inside.rowsBetween(Window.unboundedPreceding, Window.currentRow)

    def breaks(previous: Column, current: Column) -> Column:
        return (previous.isNotNull() & ~previous.eqNullSafe(current)).cast("bigint")

    local = sliced.withColumn(
        "ws_change", breaks(F.lag(ip).over(inside), F.col(ip))
    ).withColumn("ws_local", F.sum("ws_change").over(so_far))
    # One row per slice, at most `slices` of them: the only rows that meet in one task.
    upper = Window.orderBy("ws_slice")
    start = (
        local.groupBy("ws_slice")
        .agg(
            F.min_by(F.struct(ip), order).alias("ws_first"),
            F.max_by(F.struct(ip), order).alias("ws_last"),
            F.sum("ws_change").alias("ws_changes"),
        )
        .select(
            "ws_slice",
            (
                breaks(F.lag(F.col(f"ws_last.{ip}")).over(upper), F.col(f"ws_first.{ip}"))
                + F.lag("ws_changes", 1, 0).over(upper)
            ).alias("ws_step"),
        )
        .select(
            "ws_slice",
            F.sum("ws_step")
            .over(upper.rowsBetween(Window.unboundedPreceding, Window.currentRow))
            .alias("ws_start"),
        )
    )
    numbered = (
        local.join(start, "ws_slice")
        .withColumn("batch", F.col("ws_start") + F.col("ws_local"))
        .select(*requests.columns, "batch")
    )
    return numbered, without


def pending_stats(requests: DataFrame, ip: str = "ip") -> DataFrame:
    """(address, pending): waiting requests of every address. Rows, not one map: the number of
    addresses has no bound."""
    return requests.groupBy(address_key(ip).alias("address")).agg(
        F.count(F.lit(1)).alias("pending")
    )


def pending_totals(requests: DataFrame, ip: str = "ip") -> DataFrame:
    """(workers, urls): number of addresses and of waiting requests, in one row."""
    return pending_stats(requests, ip).agg(
        F.count(F.lit(1)).alias("workers"), F.coalesce(F.sum("pending"), F.lit(0)).alias("urls")
    )
