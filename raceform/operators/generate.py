"""Row generators: candidate race pages and the course dimension."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from raceform.functions.codes import COURSES

# The candidate grid.
MEETINGS = 7
DAYS = 13
RACES = 12
# Tasks for each core that generate pages.
TASKS_PER_CORE = 4
# Site address put before the race id; callers pass their own.
PAGE_PREFIX = "https://example.com/race/"


def courses(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(COURSES.items()), "course_id int, place string")


def candidate_pages(seasons: DataFrame, literal_ids: bool = False, prefix: str = PAGE_PREFIX) -> DataFrame:
    """All candidate pages of the given ``(year, course_id, place)`` rows.

    One explode of a single range per season row, so generation scales with the input rows. Season rows are few and small, so they may come in
    one partition; they are dealt to all cores first.
    ``literal_ids`` puts a ``0`` before two-digit days as well, which gives 13-character ids.
    """
    per_season = MEETINGS * DAYS * RACES
    k = F.col("k")
    meeting = F.floor(k / (DAYS * RACES)) + 1
    day = F.floor((k % (DAYS * RACES)) / RACES) + 1
    race = k % RACES + 1
    day_text = F.concat(F.lit("0"), day.cast("string")) if literal_ids else _two_digits(day)
    race_id = F.concat(
        F.col("year").cast("string"), _two_digits(F.col("course_id")), _two_digits(meeting), day_text, _two_digits(race)
    )
    tasks = TASKS_PER_CORE * seasons.sparkSession.sparkContext.defaultParallelism
    return (
        seasons.select("year", "course_id", "place").repartition(tasks)
        .select("year", "course_id", "place", F.explode(F.sequence(F.lit(0), F.lit(per_season - 1))).alias("k"))
        .select(
            F.concat(F.lit(prefix), race_id).alias("url"),
            race_id.alias("current_race_id"),
            (F.col("course_id") - 1).cast("int").alias("racecourse_i"),
            "place",
            (race - 1).cast("int").alias("race_number_i"),
            F.col("year").cast("int").alias("year"),
        )
    )


def _two_digits(c: Column) -> Column:
    """Left-padded to two characters; longer numbers keep all their digits."""
    text = c.cast("string")
    return F.when(F.length(text) < 2, F.lpad(text, 2, "0")).otherwise(text)


def season_candidates(
    spark: SparkSession, year_start: int, year_end: int, literal_ids: bool = False, prefix: str = PAGE_PREFIX
) -> DataFrame:
    """Candidates of every course for an inclusive range of years."""
    seasons = courses(spark).select(
        F.explode(F.sequence(F.lit(year_start), F.lit(year_end))).alias("year"), "course_id", "place"
    )
    return candidate_pages(seasons, literal_ids, prefix)
