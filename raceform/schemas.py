"""Explicit schemas of the race tables. Names and order are part of the data contract."""

from __future__ import annotations

from pyspark.sql import types as T


_TYPES = {
    "string": T.StringType(), "int": T.IntegerType(), "bigint": T.LongType(), "double": T.DoubleType(), "date": T.DateType(),
}


def struct(text: str) -> T.StructType:
    """Schema from ``name type, ...`` text; unlike the built-in parser it needs no running session."""
    pairs = [part.split() for part in text.split(",")]
    return T.StructType([T.StructField(name, _TYPES[kind]) for name, kind in pairs])


# One row per runner per race, as parsed from a result page.
RAW_RACE = struct(
    "race_id string, horse string, jockey string, horse_number string, run_time string, odds string, "
    "pass_order string, rank string, weight int, weight_change int, gender string, age string, load string, "
    "rise string, popularity string, race_name string, date string, event string, class string, "
    "turf_or_dirt string, distance string, lap string, racecourse string, weather string, place_id int, "
    "place_name string, update_at string"
)

URL_CANDIDATES = struct(
    "url string, current_race_id string, racecourse_i int, place string, race_number_i int, year int"
)

URL_COLLECTED = struct("url string")

HORSE_HISTORY = struct(
    "horse_id string, date date, rank string, prize double, last3f double, passing string, "
    "breeder string, sire_id string, sire_sire_id string, dam_sire_id string"
)

JOCKEY_YEAR = struct("jockey_id string, year int, category string, starts bigint, wins bigint")

PEDIGREE = struct("horse_id string, pos int, ancestor string")

MODEL_REGISTRY = struct(
    "feature_set string, target string, bucket string, surface string, version string, path string"
)

# Features that are looked up one to five starts back.
LAG_FEATURES = [
    "horse_number", "jockey", "load", "odds", "weight", "weight_change", "rise", "pass_order", "rank",
    "distance", "class", "run_time", "turf_or_dirt", "weather", "racecourse",
]

# Columns known only after the race, plus row bookkeeping: never model inputs.
NOT_FEATURES = ["rank", "odds", "popularity", "rise", "run_time", "pass_order", "race_id", "update_at"]
