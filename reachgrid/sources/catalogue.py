"""Catalogue of recorded feed days: cities, months, days, assets, nearest dates."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Recording variants, and the files a feed must hold.
VARIANTS = ("p50", "p85", "static_gtfs")
FEED_FILES = ("agency.txt", "stops.txt", "routes.txt", "trips.txt", "stop_times.txt")
CALENDAR_FILES = ("calendar.txt", "calendar_dates.txt")

SCHEMA = """struct<generated_at:string,cities:map<string,struct<display_name:string,
days:array<struct<date:string,status:string,assets:map<string,string>>>>>>"""


def slim(manifests: DataFrame, column: str = "body") -> DataFrame:
    """(city, display_name, date, status, variant, url): one row per recording variant."""
    parsed = manifests.select(F.from_json(column, F.lit(SCHEMA)).alias("m"))
    city = parsed.select(F.explode("m.cities").alias("city", "c"))
    day = city.select("city", F.coalesce("c.display_name", "city").alias("display_name"), F.explode("c.days").alias("d"))
    assets = F.array(*[F.struct(F.lit(v).alias("variant"), F.element_at("d.assets", F.lit(v)).alias("url")) for v in VARIANTS])
    return day.select("city", "display_name", F.col("d.date").alias("date"), F.coalesce("d.status", F.lit("ok")).alias("status"),
                      F.inline(assets))


def cities(flat: DataFrame) -> DataFrame:
    return flat.select("city", "display_name").distinct().orderBy(F.lower("display_name"), "city")


def months(flat: DataFrame, city: str) -> DataFrame:
    return flat.where((F.col("city") == city) & F.col("date").isNotNull()).select(
        F.substring("date", 1, 7).alias("month")).distinct().orderBy(F.desc("month"))


def days(flat: DataFrame, city: str, month: str) -> DataFrame:
    return flat.where((F.col("city") == city) & F.col("date").startswith(month)).select("date", "status").distinct().orderBy(F.desc("date"))


def resolve(flat: DataFrame, city: str, date: str, variant: str, k: int = 3) -> DataFrame:
    """The asset of the day, or the k nearest recorded days when the day is not recorded.

    (date, gap, url): gap 0 is the day itself; a NULL url means the variant was not built.
    """
    if variant not in VARIANTS:
        raise ValueError(f"unknown variant {variant!r}")
    have = flat.where((F.col("city") == city) & (F.col("variant") == variant) & F.col("date").isNotNull())
    gap = F.abs(F.date_diff(F.col("date").cast("date"), F.lit(date).cast("date")))
    near = have.groupBy("date").agg(F.max("url").alias("url")).withColumn("gap", gap).orderBy("gap", "date").limit(k)
    exact = near.select(F.min("gap").alias("g")).scalar()
    return near.where((exact > 0) | (F.col("gap") == 0)).select("date", "gap", "url")


def missing_files(files: DataFrame, required: Sequence[str] = FEED_FILES) -> DataFrame:
    """(feed, missing): required files a feed lacks, and 'calendar' when it has neither calendar file."""
    wanted = F.array(*[F.lit(f) for f in required])
    relevant = files.where(F.col("file").isin(*required, *CALENDAR_FILES))
    have = files.select("feed").distinct().join(relevant.groupBy("feed").agg(F.collect_set("file").alias("have")), "feed", "left")
    got = F.coalesce("have", F.array().cast("array<string>"))
    calendar = F.when(F.arrays_overlap(got, F.array(*[F.lit(f) for f in CALENDAR_FILES])), F.array().cast("array<string>")).otherwise(
        F.array(F.lit("calendar.txt or calendar_dates.txt")))
    return have.select("feed", F.concat(F.array_except(wanted, got), calendar).alias("missing"))
