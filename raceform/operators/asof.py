"""Point-in-time aggregates: only history strictly before the entry's own day or year is used.

One pass replaces a loop over dates. History is cut down per (key, day) to the day's sums and
its newest N rows, both trimmed before the shuffle. Windows over that calendar-bounded table
give the state before each day for every N at once. No history row is ever paired with an
entry, and no task holds all rows of a key.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from raceform.functions.exact import sum_of_squares

ALL = "all"


@dataclass(frozen=True)
class FormSpec:
    """Which statistics to build over the last N rows (or ``"all"``).

    ``metrics`` maps each column to its number of decimals. Sums are kept as whole numbers
    of that unit, so they do not depend on the order rows arrive in.
    """

    metrics: Mapping[str, int]
    windows: Sequence[int | str] = (3, 5, 7, ALL)
    avg: Sequence[str] = field(default_factory=tuple)
    std: Sequence[str] = field(default_factory=tuple)
    max: Sequence[str] = field(default_factory=tuple)
    total: Sequence[str] = field(default_factory=tuple)
    days_since: str | None = None

    @property
    def depth(self) -> int:
        return max([n for n in self.windows if n != ALL], default=0)


# Formulas are SQL text: a form table has hundreds of them, and text is parsed in one call each.
def _units(column: str, decimals: int) -> str:
    return f"CAST(round(`{column}` * {10**decimals}) AS BIGINT)" if decimals else f"CAST(`{column}` AS BIGINT)"


def mean_of(total: str, n: str, decimals: int) -> str:
    scaled = f"CAST({total} AS DOUBLE) / {10**decimals}D" if decimals else f"CAST({total} AS DOUBLE)"
    return f"try_divide({scaled}, CAST({n} AS DOUBLE))"


def sample_std_of(total: str, squares: str, n: str, decimals: int) -> str:
    """Sample standard deviation from exact sums; null below two values."""
    t, q, k = (f"CAST({x} AS DOUBLE)" for x in (total, squares, n))
    return f"CASE WHEN {n} > 1 THEN sqrt(greatest({q} - {t} * {t} / {k}, 0D) / ({k} - 1)) / {10**decimals}D END"


def form_table(points: DataFrame, history: DataFrame, key: str, date: str, order: Sequence[str], spec: FormSpec) -> DataFrame:
    """State before each (key, date) of ``points`` (distinct pairs), one row per pair."""
    metrics, depth = spec.metrics, max(spec.depth, 1)
    named = lambda df: df.where(F.col(key).isNotNull() & F.col(date).isNotNull())
    units = named(history).select(
        key, date, *[c for c in order if c not in (key, date)], *[F.expr(f"{_units(m, d)} AS `_m_{m}`") for m, d in metrics.items()]
    )
    whole_day = [F.count(F.lit(1)).alias("_rows")]
    if ALL in spec.windows:
        whole_day += [
            (sum_of_squares(F.col(f"_m_{m}")) if n.startswith("q_") else F.expr(a)).alias(f"_day_{n}")
            for m in metrics for n, a in _aggregates(m, spec).items()
        ]
    # Both sides come out of a shuffle on (key, date); their join and everything up to the
    # shuffle on key moves no rows again. At most `depth` rows per key and day remain.
    daily = units.groupBy(key, date).agg(*whole_day).withColumn("_rn", F.lit(1))
    w_day = Window.partitionBy(key, date).orderBy(*[F.col(c).desc() for c in order])
    newest = units.withColumn("_rn", F.row_number().over(w_day)).where(F.col("_rn") <= depth) if spec.depth else (
        units.select(key, date).distinct().withColumn("_rn", F.lit(1)))
    known = newest.join(daily, [key, date, "_rn"], "left").withColumn("_asked", F.lit(False))
    asked = named(points.select(key, date)).distinct().withColumn("_asked", F.lit(True))
    rows = known.unionByName(asked, allowMissingColumns=True).repartition(key)

    # After each history row: statistics of the newest N rows so far.
    sliding = [
        F.expr(f"{a} OVER (PARTITION BY `{key}`, _asked ORDER BY `{date}`, _rn DESC ROWS {n - 1} PRECEDING) AS `_{n}_{name}`")
        for n in spec.windows if n != ALL for m in metrics for name, a in _aggregates(m, spec).items()
    ]
    names = [f"_{n}_{name}" for n in spec.windows if n != ALL for m in metrics for name in _aggregates(m, spec)]
    after = rows.select("*", *sliding)
    day_end = F.when(F.col("_rn") == 1, F.struct(F.col(date).alias("_last_day"), *names))

    # Before each asked day: the state after the last earlier day, and sums over all earlier days.
    earlier = f"(PARTITION BY `{key}` ORDER BY unix_date(`{date}`) RANGE BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
    w = Window.partitionBy(key).orderBy(F.unix_date(date)).rangeBetween(Window.unboundedPreceding, -1)
    before = [F.last(day_end, True).over(w).alias("_recent")]
    if ALL in spec.windows:
        before += [
            F.expr(f"{'max' if name.startswith('x_') else 'sum'}(`_day_{name}`) OVER {earlier} AS `_all_{name}`")
            for m in metrics for name in _aggregates(m, spec)
        ]
    state = after.select(key, date, "_asked", *before).where("_asked")

    out = [F.col(key), F.col(date)]
    for n in spec.windows:
        for m, d in metrics.items():
            prefix = "_all_" if n == ALL else f"_recent._{n}_"
            out += _statistics(m, d, n, lambda name, prefix=prefix: f"{prefix}{name}", spec)
    if spec.days_since:
        out.append(F.datediff(F.col(date), F.col("_recent")["_last_day"]).cast("double").alias(spec.days_since))
    return state.select(*out)


def _aggregates(m: str, spec: FormSpec) -> dict[str, str]:
    """Mergeable parts of a metric's statistics, over the unit column ``_m_<metric>``. Squares are decimals, which hold any of them."""
    u = f"`_m_{m}`"
    parts = {f"n_{m}": f"count({u})", f"s_{m}": f"sum({u})"}
    if m in spec.std:
        parts[f"q_{m}"] = f"sum(CAST({u} AS DECIMAL(19,0)) * CAST({u} AS DECIMAL(19,0)))"
    if m in spec.max:
        parts[f"x_{m}"] = f"max({u})"
    return parts


def _statistics(m: str, d: int, n: int | str, part: Callable[[str], str], spec: FormSpec) -> list[Column]:
    total, count = part(f"s_{m}"), part(f"n_{m}")
    formulas = {}
    if m in spec.avg:
        formulas["avg"] = mean_of(total, count, d)
    if m in spec.std:
        formulas["std"] = sample_std_of(total, part(f"q_{m}"), count, d)
    if m in spec.max:
        formulas["max"] = f"CAST({part(f'x_{m}')} AS DOUBLE) / {10**d}D"
    if m in spec.total:
        # An all-null sum over existing rows is 0; without any earlier row it is null.
        formulas["total"] = f"CASE WHEN {count} IS NOT NULL THEN CAST(coalesce({total}, 0) AS DOUBLE) / {10**d}D END"
    return [F.expr(f"{text} AS `{name}_{m}_{n}`") for name, text in formulas.items()]


def form_features(
    entries: DataFrame, history: DataFrame, key: str, date: str, order: Sequence[str], spec: FormSpec, points: DataFrame | None = None
) -> DataFrame:
    """Entries with their form columns; entries without earlier history keep null features.

    ``points`` holds at least the (key, date) pairs of the entries, for entries that are costly to work out a second time.
    """
    return entries.join(form_table(entries if points is None else points, history, key, date, order, spec), [key, date], "left")


def rolling_form(history: DataFrame, key: str, date: str, spec: FormSpec) -> DataFrame:
    """Form features when history is the entry table itself and (key, date) is unique.

    A key then has at most one row per calendar day, so a single window per N is enough:
    one shuffle, no join.
    """
    metrics = spec.metrics
    units = history.select("*", *[F.expr(f"{_units(m, d)} AS `_m_{m}`") for m, d in metrics.items()])
    parts, out = [], []
    for n in spec.windows:
        first = "UNBOUNDED" if n == ALL else n
        over = f"OVER (PARTITION BY `{key}` ORDER BY `{date}` ROWS BETWEEN {first} PRECEDING AND 1 PRECEDING)"
        for m, d in metrics.items():
            # count() over an empty frame is 0; the null that "no earlier row" means comes from the row count.
            parts += [
                F.expr(f"CASE WHEN count(1) {over} > 0 THEN {a} {over} END AS `_{n}_{name}`")
                for name, a in _aggregates(m, spec).items()
            ]
            out += _statistics(m, d, n, lambda name, n=n: f"`_{n}_{name}`", spec)
    if spec.days_since:
        earlier = F.lag(date, 1).over(Window.partitionBy(key).orderBy(date))
        out.append(F.datediff(F.col(date), earlier).cast("double").alias(spec.days_since))
    return units.select("*", *parts).select(*history.columns, *out)


# Jockey-year form -----------------------------------------------------------------

JOCKEY_CATEGORIES = ("graded", "special", "regular", "turf", "dirt")


def jockey_year_wide(long: DataFrame, jockey: str = "jockey_id", year: str = "year") -> DataFrame:
    """Starts and wins per category as columns, one row per jockey and year."""
    aggs = []
    for c in JOCKEY_CATEGORIES:
        mine = F.col("category") == c
        aggs += [
            F.sum(F.when(mine, F.col("starts"))).alias(f"{c}_starts"),
            F.sum(F.when(mine, F.col("wins"))).alias(f"{c}_wins"),
        ]
    return long.groupBy(jockey, year).agg(*aggs)


def _total(values: Column) -> Column:
    """Sum of an array of whole numbers, nulls counting as 0."""
    return F.aggregate(values, F.lit(0).cast("bigint"), lambda acc, x: acc + F.coalesce(x, F.lit(0)).cast("bigint"))


def jockey_form(
    entries: DataFrame, yearly: DataFrame, pairs: Mapping[str, tuple[str, str]],
    jockey: str = "jockey_id", year: str = "year", n: int | str = 2,
) -> DataFrame:
    """Ratio of sums over the jockey's latest ``n`` listed years before the entry's year.

    ``pairs`` maps an output column to (numerator, denominator) columns of ``yearly``, which
    has one row per jockey and year. Windows run over jockey-years, a handful per jockey.
    """
    columns = sorted({c for pair in pairs.values() for c in pair})
    asked = entries.select(jockey, year).where(F.col(jockey).isNotNull() & F.col(year).isNotNull()).distinct()
    merged = (
        yearly.select(jockey, year, F.struct(*columns).alias("_y"))
        .unionByName(asked.withColumn("_asked", F.lit(True)), allowMissingColumns=True)
        .groupBy(jockey, year)
        .agg(F.first("_y", True).alias("_y"), F.max("_asked").alias("_asked"))
    )
    if n == ALL:
        before = Window.partitionBy(jockey).orderBy(year).rowsBetween(Window.unboundedPreceding, -1)
        sums = {c: F.sum(F.col("_y")[c]).over(before) for c in columns}
        state = merged.select(jockey, year, "_asked", *[s.alias(c) for c, s in sums.items()])
    else:
        lags = [F.expr(f"lag(_y, {i}) IGNORE NULLS OVER (PARTITION BY `{jockey}` ORDER BY `{year}`)") for i in range(1, n + 1)]
        recent = merged.select(jockey, year, "_asked", F.array_compact(F.array(*lags)).alias("_recent"))
        state = recent.select(jockey, year, "_asked", *[
            _total(F.col("_recent")[c]).alias(c) for c in columns
        ])
    ratios = [F.try_divide(F.col(a).cast("double"), F.col(b).cast("double")).alias(name) for name, (a, b) in pairs.items()]
    return entries.join(state.where("_asked").select(jockey, year, *ratios), [jockey, year], "left")
