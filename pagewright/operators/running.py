"""Running values over an ordered log that stay exact when one key holds most of the rows.

A log is cut into segments by the rank of its order and kept; its rows are exchanged once by (key, segment), which serves
all running values of its keys and of finer ones. Each segment is summarized, a window over the few summaries carries
values forward, and the rows themselves only meet a window over their own segment. No task ever holds a whole key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from pagewright.session import checkpointed

SEGMENT_ROWS = 65536
MOST_SEGMENTS = 1024


def _cuts(df: DataFrame, order: str, segment_rows: int) -> list[int]:
    """Order positions that divide the log into parts of about `segment_rows` rows, MOST_SEGMENTS at most: quantiles, so
    it does not matter how sparse or how uneven the positions are. One pass over one column."""
    ranks = [k / MOST_SEGMENTS for k in range(1, MOST_SEGMENTS)]
    told = df.agg(F.count(order).alias("n"), F.percentile_approx(order, ranks, 4 * MOST_SEGMENTS).alias("at")).first()
    parts = min(MOST_SEGMENTS, -(-told.n // segment_rows))
    return sorted({told.at[round(k * MOST_SEGMENTS / parts) - 1] for k in range(1, parts)})


def _segment(order: str, cuts: list[int]) -> Column:
    """How many cuts lie below a position, by halving."""
    def below(cuts: list[int], first: int) -> Column:
        if not cuts:
            return F.lit(first)
        middle = len(cuts) // 2
        return F.when(F.col(order) <= cuts[middle], below(cuts[:middle], first)).otherwise(below(cuts[middle + 1:], first + middle + 1))

    return below(cuts, 0).cast("bigint")


def segmented(df: DataFrame, order: str, segment_rows: int = SEGMENT_ROWS, dense: bool = False) -> DataFrame:
    """The log with its segment number `_seg`, kept in the checkpoint folder, since rows and summaries read it.

    A segment of a key holds at most about the larger of `segment_rows` rows and a 1024th of the log. With `dense`
    positions (line numbers) a segment is a range of that many positions, and no pass over the log is needed to cut it."""
    if dense:
        segment = F.floor(F.col(order) / segment_rows).cast("bigint")
    else:
        segment = _segment(order, _cuts(df, order, segment_rows))
    return checkpointed(df.withColumn("_seg", segment))


def running(df: DataFrame, keys: list[str], order: str, values: dict[str, tuple[str, Column]],
            inclusive: bool = False, segment_rows: int = SEGMENT_ROWS, dense: bool = False) -> DataFrame:
    """Add running values per key: `values` maps a name to ("last" | "max" | "sum", column).

    `last` is the latest non-null value. Rows see the values before them, or with `inclusive` up
    to and including their own. `order` must be integer and distinct within a key. A frame that is `segmented` by the
    keys, or by some of them, is used as it is and stays so: several values need no further exchange of its rows.
    """
    own = "_seg" not in df.columns
    rows = segmented(df, order, segment_rows, dense) if own else df
    group = [*keys, "_seg"]
    rows = rows.withColumns({f"_in_{name}": column for name, (_, column) in values.items()})
    per_segment = {"last": lambda c: F.max_by(c, F.when(c.isNotNull(), F.col(order))), "max": F.max, "sum": F.sum}
    over_segments = {"last": lambda c: F.last(c, ignorenulls=True), "max": F.max, "sum": F.sum}
    merge = {"last": lambda here, before: F.coalesce(here, before), "max": lambda here, before: F.greatest(here, before),
             "sum": lambda here, before: F.coalesce(here, F.lit(0)) + F.coalesce(before, F.lit(0))}

    earlier = Window.partitionBy(*keys).orderBy("_seg").rowsBetween(Window.unboundedPreceding, -1)
    totals = rows.groupBy(*group).agg(*[
        per_segment[kind](F.col(f"_in_{name}")).alias(f"_total_{name}") for name, (kind, _) in values.items()])
    # Null keys are keys as well, so the join compares them as equal.
    carried = totals.select(*[F.col(c).alias(f"_of_{c}") for c in group], *[
        over_segments[kind](F.col(f"_total_{name}")).over(earlier).alias(f"_carry_{name}")
        for name, (kind, _) in values.items()])
    within = Window.partitionBy(*group).orderBy(order).rowsBetween(
        Window.unboundedPreceding, Window.currentRow if inclusive else -1)
    local = rows.withColumns({f"_here_{name}": over_segments[kind](F.col(f"_in_{name}")).over(within)
                              for name, (kind, _) in values.items()})
    same = F.lit(True)
    for c in group:
        same = same & F.col(c).eqNullSafe(F.col(f"_of_{c}"))
    return local.join(carried, same).select(*[c for c in rows.columns if not c.startswith("_in_") and not (own and c == "_seg")], *[
        merge[kind](F.col(f"_here_{name}"), F.col(f"_carry_{name}")).alias(name)
        for name, (kind, _) in values.items()])
