"""Ordered computations whose groups may be far larger than one task.

A plain window sorts a whole group in one task. Here a group is cut into slices
of consecutive positions: each slice is worked on its own, one summary row per
slice is aggregated (with map-side combine), and the summaries carry the result
across slice borders. Summaries are sliced in turn, ``LEVELS`` times, so that not
even sparse positions (a row per slice) put the summaries of a group into one task:
no window holds more than ``width`` distinct positions, whatever they are.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SLICE = "_slice"
WIDTH = 1 << 20          # positions per slice of a dense group
SCAN_WIDTH = 1 << 12     # scans per slice of one process
HOT_ROWS = 4_000_000     # a (host, PID) group beyond this is sliced
LEVELS = 2               # times that slices are cut; with WIDTH, windows stay below its size for 60 bits of positions


def slice_of(pos: str, width: int) -> str:
    return f"`{pos}` div {int(width)}L"


def over(keys: Sequence[str], order: str, last: str | None = "CURRENT ROW") -> str:
    """OVER clause of the rows of a group up to ``last``; without a frame if None."""
    frame = f" ROWS BETWEEN UNBOUNDED PRECEDING AND {last}" if last else ""
    return f"OVER (PARTITION BY {', '.join(f'`{k}`' for k in keys)} ORDER BY `{order}`{frame})"


def running(
    df: DataFrame, keys: Sequence[str], pos: str, latest: dict[str, str],
    inclusive: bool = True, width: int | None = None, levels: int = LEVELS,
) -> DataFrame:
    """Greatest value of each SQL expression over the rows up to this one.

    With an expression ``struct(pos, values...)`` that is null on rows of no
    interest this is "the last such row"; with ``struct(group, -pos, value)`` it
    is "the first such row of the current group". ``keys`` must not be null.
    """
    last = "CURRENT ROW" if inclusive else "1 PRECEDING"
    if width is None or levels == 0:
        return df.selectExpr("*", *[f"max({e}) {over(keys, pos, last)} AS {n}" for n, e in latest.items()])
    name = f"{pos}_" if pos.startswith(SLICE) else SLICE
    part = [*keys, name]
    sliced = df if name in df.columns else df.selectExpr("*", f"{slice_of(pos, width)} AS {name}")
    local = sliced.selectExpr("*", *[f"max({e}) {over(part, pos, last)} AS {n}" for n, e in latest.items()])
    summaries = sliced.groupBy(*part).agg(*[F.expr(f"max({e})").alias(f"_of_{n}") for n, e in latest.items()])
    carried = running(summaries, keys, name, {f"_carry_{n}": f"_of_{n}" for n in latest}, False, width, levels - 1)
    return local.join(carried.select(*part, *[f"_carry_{n}" for n in latest]), part, "left").selectExpr(
        *[f"`{c}`" for c in df.columns if c not in latest],
        *[f"greatest({n}, _carry_{n}) AS {n}" for n in latest],
    )


def ordinals(
    df: DataFrame, keys: Sequence[str], pos: str, name: str, width: int = WIDTH
) -> DataFrame:
    """Number the rows of each group 0, 1, 2, ... by position."""
    part = [*keys, SLICE]
    sliced = df.selectExpr("*", f"{slice_of(pos, width)} AS {SLICE}")
    local = sliced.selectExpr("*", f"row_number() {over(part, pos, None)} AS _local")
    counted = sliced.groupBy(*part).agg(F.expr("count(1) AS _rows"))
    # Numbers of slices of slices, for the same reason as in ``running``.
    above = [*keys, f"{SLICE}_"]
    nested = counted.selectExpr("*", f"{slice_of(SLICE, width)} AS {SLICE}_")
    lower = nested.groupBy(*above).agg(F.sum("_rows").alias("_all")).selectExpr(
        *[f"`{c}`" for c in above], f"coalesce(sum(_all) {over(keys, f'{SLICE}_', '1 PRECEDING')}, 0L) AS _lower")
    before = nested.selectExpr(
        "*", f"coalesce(sum(_rows) {over(above, SLICE, '1 PRECEDING')}, 0L) AS _inner").join(lower, above).selectExpr(
        *[f"`{c}`" for c in part], "_inner + _lower AS _before")
    return local.join(before, part).selectExpr(
        *[f"`{c}`" for c in df.columns], f"_before + _local - 1 AS `{name}`"
    )


def neighbours(
    df: DataFrame, keys: Sequence[str], ordinal: str,
    previous: dict[str, str] | None = None, following: dict[str, str] | None = None,
    width: int | None = SCAN_WIDTH,
) -> DataFrame:
    """Add columns of the row at ``ordinal - 1`` / ``ordinal + 1`` of the group.

    One shuffle: rows at the border of a slice are copied into the adjoining
    slice as context (2 / width more rows) and dropped again afterwards. The
    slice column stays, so that later steps can reuse the partitioning. Without
    a width, groups are known to be small and are not sliced.
    """
    if width is None:
        return df.selectExpr("*", *_adjoining(keys, ordinal, previous, following))
    home, offset = slice_of(ordinal, width), f"`{ordinal}` % {int(width)}L"
    spread = df.selectExpr("*", f"""explode(array_compact(array({home},
        CASE WHEN {offset} = {width - 1}L THEN {home} + 1 END,
        CASE WHEN {offset} = 0 THEN {home} - 1 END))) AS {SLICE}""")
    found = _adjoining([*keys, SLICE], ordinal, previous, following)
    return spread.selectExpr("*", *found).where(f"{SLICE} = {home}")


def _adjoining(part: Sequence[str], ordinal: str, previous: dict[str, str] | None,
               following: dict[str, str] | None) -> list[str]:
    clause = over(part, ordinal, None)
    return [
        f"CASE WHEN {f}(`{ordinal}`) {clause} = `{ordinal}` {sign} 1 THEN {f}(`{source}`) {clause} END AS `{name}`"
        for f, sign, wanted in (("lag", "-", previous), ("lead", "+", following))
        for name, source in (wanted or {}).items()
    ]


def by_heat(
    df: DataFrame, keys: Sequence[str], work: Callable[[DataFrame, int | None], DataFrame],
    hot_rows: int = HOT_ROWS, width: int = WIDTH,
) -> DataFrame:
    """``work(rows, None)`` for ordinary groups and ``work(rows, width)`` for hot ones, in one plan.

    Groups of a sparse position (one PID among a host's notices) are rarely large, so
    slicing them all would only add summaries. A narrow count, combined before its
    shuffle, finds the groups over ``hot_rows`` while the query runs; nothing runs
    while it is planned. There is at most one such group for every ``hot_rows`` rows
    (250,000 in 10^12 rows), which bounds what is broadcast. Where there is none,
    adaptive execution drops the second branch.
    """
    hot = F.broadcast(df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_rows")).where(F.col("_rows") > hot_rows).select(*keys))
    return work(df.join(hot, list(keys), "left_anti"), None).unionByName(
        work(df.join(hot, list(keys), "left_semi"), width)
    )


def as_of(
    rows: DataFrame, facts: DataFrame, keys: Sequence[str], pos: str, fact: str, name: str,
    at_same_pos: bool = True, dense: bool = False, width: int = WIDTH, hot_rows: int = HOT_ROWS,
    strict: str = "false",
) -> DataFrame:
    """Attach to each row the latest fact (SQL text over ``facts``) at or before its position.

    Union and running maximum: linear in both sides, no pairs of rows and facts.
    ``dense`` says the position is dense within a group (always slice). Rows for
    which ``strict`` (SQL text) holds never see facts of their own position.
    """
    side = 0 if at_same_pos else 1
    quoted = [f"`{k}`" for k in keys]
    fact_rows = facts.selectExpr(*quoted, f"`{pos}`", f"{fact} AS _fact", f"`{pos}` * 2 + {side} AS _asof_at")
    tagged = rows.selectExpr("*", "true AS _row", f"`{pos}` * 2 + CASE WHEN {strict} THEN -1 ELSE {1 - side} END AS _asof_at")
    both = tagged.unionByName(fact_rows, allowMissingColumns=True)
    seen = "CASE WHEN _row IS NULL THEN struct(_asof_at AS at, _fact AS fact) END"

    def carry(part: DataFrame, slices: int | None) -> DataFrame:
        return running(part, keys, "_asof_at", {"_asof": seen}, width=slices)

    done = carry(both, width) if dense else by_heat(both, keys, carry, hot_rows, width)
    return done.where("_row").selectExpr(*[f"`{c}`" for c in rows.columns], f"_asof.fact AS `{name}`")
