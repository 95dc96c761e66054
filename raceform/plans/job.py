"""Ingest, preprocess and train in order; tables are the only hand-over."""

from __future__ import annotations

from datetime import datetime, timezone
from uuid import uuid4

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from raceform.operators import ml
from raceform.plans.incremental import modelling_run
from raceform.plans.ingest import ingest, raw_table
from raceform.plans.training import Trained, train
from raceform.sources.runs import RunStore


def new_run() -> str:
    """Name of a run: its second, and what tells it from others of that second."""
    return f"{datetime.now(timezone.utc):%Y%m%d%H%M%S}-{uuid4().hex[:8]}"


def modelling_rows(spark: SparkSession, base: str) -> DataFrame:
    """The modelling table as the runs so far have left it."""
    store = RunStore(spark, f"{base}/store")
    return store.read("dm_race", store.schema("dm_race"))


def prepare(
    spark: SparkSession, pages: DataFrame, candidates: DataFrame, base: str, since: str | None = None, parsed_at: Column | None = None, run: str | None = None
) -> DataFrame:
    """Ingest and preprocess; returns the modelling table.

    A run takes what arrived at or after ``since``, by default where the last run ended. What it makes becomes current at once, at its end; a run that died is
    repeated by calling again. Rows of a runner that comes again take the place of the earlier ones; codes of earlier runs stay.
    """
    run = run or new_run()
    ingest(pages, candidates, f"{base}/raw_race", f"{base}/url_collected", parsed_at)
    raw, store = raw_table(spark, f"{base}/raw_race").read(), RunStore(spark, f"{base}/store")
    rows = modelling_run(raw, store, run, since or store.fact("upto"))
    store.upsert("dm_race", rows, ["race_id", "horse"], run, ["year"])
    newest = rows.agg(F.max("update_at")).first()[0] or store.fact("upto")
    store.commit(run, **({"upto": newest} if newest else {}))
    return modelling_rows(spark, base)


def run(
    spark: SparkSession, pages: DataFrame, candidates: DataFrame, base: str, since: str | None, first_year: int, last_year: int,
    parsed_at: Column | None = None, rounds: int = ml.ROUNDS, min_rows: int = ml.MIN_ROWS_PER_LEAF,
) -> Trained:
    dm = prepare(spark, pages, candidates, base, since, parsed_at)
    trained = train(dm, first_year, last_year, rounds=rounds, min_rows=min_rows)
    version, path = ml.save_model(trained.model, f"{base}/model")
    ml.register(spark, f"{base}/registry", [("base", "top3", bucket, surface, version, path) for bucket in ml.BUCKETS for surface in ml.SURFACES])
    return trained
