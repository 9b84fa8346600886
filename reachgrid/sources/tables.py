"""Point, matrix, observation, log and vote tables: readers and the shapes written out."""

from __future__ import annotations

import json
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from reachgrid.functions.scale import row_index
from reachgrid.functions.values import number_or_zero, require_columns

BAD_ID = r'[,"\n\r]'


# --- points --------------------------------------------------------------------------------

def points(table: DataFrame, *, id_field: str | None, lon: str = "lon", lat: str = "lat",
           extras: Sequence[str] = (), label: str = "points", order: Sequence[str] = ()) -> DataFrame:
    """(id, lon, lat, extras): rows without a position are left out, extras are numbers (blank 0).

    Without ``id_field`` the id is the zero-padded position along ``order``.
    """
    require_columns(table, [*([id_field] if id_field else []), *extras], label)
    placed = table.where(F.col(lon).isNotNull() & F.col(lat).isNotNull())
    values = [F.round(F.col(lon).cast("double"), 6).alias("lon"), F.round(F.col(lat).cast("double"), 6).alias("lat"),
              *[number_or_zero(F.col(e)).alias(e) for e in extras]]
    if id_field:
        return placed.select(F.col(id_field).cast("string").alias("id"), *values)
    keyed = row_index(placed, *order)
    last = keyed.agg(F.coalesce(F.max("idx"), F.lit(0)).alias("m")).scalar()
    return keyed.withColumn("_w", F.length(last.cast("string"))).select(
        F.lpad(F.col("idx").cast("string"), F.col("_w"), F.lit("0")).alias("id"), *values)


def skipped_points(table: DataFrame, lon: str = "lon", lat: str = "lat") -> DataFrame:
    return table.agg(F.count_if(F.col(lon).isNull() | F.col(lat).isNull()).alias("skipped"))


def id_problems(ids: DataFrame) -> DataFrame:
    """Ids that are not unique or hold a comma, quote or line break."""
    n = ids.groupBy("id").agg(F.count("*").alias("n"))
    problem = F.when(F.col("n") > 1, "duplicate").when(F.col("id").rlike(BAD_ID), "unsafe character")
    return n.withColumn("problem", problem).where("problem is not null")


def read_points(spark: SparkSession, path: str, extras: Sequence[str] = ()) -> DataFrame:
    """A points CSV back as (id, lon, lat, extras)."""
    raw = spark.read.csv(path, header=True)
    require_columns(raw, ["id", "lon", "lat", *extras], path)
    return raw.select("id", F.col("lon").cast("double").alias("lon"), F.col("lat").cast("double").alias("lat"),
                      *[number_or_zero(F.col(e)).alias(e) for e in extras])


# --- matrices ------------------------------------------------------------------------------

def read_batches(spark: SparkSession, pattern: str) -> DataFrame:
    """Matrix batches of one run as one table; missing files and empty batches add nothing."""
    return spark.read.option("ignoreMissingFiles", "true").csv(pattern, header=True, enforceSchema=False)


def merge_batches(batches: Sequence[DataFrame]) -> DataFrame:
    """Batch tables of one run under each other; every batch must have the same columns."""
    first, *rest = batches
    for other in rest:
        if set(other.columns) != set(first.columns):
            raise ValueError(f"batch columns differ: {first.columns} and {other.columns}")
        first = first.unionByName(other)
    return first


def od_lines(pairs: DataFrame, origins: DataFrame, destinations: DataFrame, fields: Sequence[str],
             method: Mapping[str, str] | None = None) -> DataFrame:
    """Straight lines between the ends of each pair as WKT; a pair with an unknown end is left out."""
    a = origins.select(F.col("id").alias("from_id"), F.col("lon").alias("_lon1"), F.col("lat").alias("_lat1"))
    b = destinations.select(F.col("id").alias("to_id"), F.col("lon").alias("_lon2"), F.col("lat").alias("_lat2"))
    text = lambda c: F.col(c).cast("string")
    line = F.concat(F.lit("LINESTRING("), text("_lon1"), F.lit(" "), text("_lat1"), F.lit(", "), text("_lon2"), F.lit(" "), text("_lat2"), F.lit(")"))
    return pairs.join(a, "from_id").join(b, "to_id").select(
        "from_id", "to_id", *fields, *[F.lit(v).alias(k) for k, v in (method or {}).items()], line.alias("wkt"))


def service_lines(minutes: DataFrame, origins: DataFrame, destinations: DataFrame, cutoffs: Sequence[int]) -> DataFrame:
    """OD lines with service minutes per cutoff, 0 where missing."""
    cols = [f"svc_min_c{c}" for c in cutoffs]
    return od_lines(minutes.fillna(0, subset=cols), origins, destinations, cols)


def write_accessibility(long: DataFrame, folder: str, method: Mapping[str, object]) -> None:
    """Long accessibility as Parquet with the run's settings beside it."""
    long.write.mode("overwrite").parquet(folder)
    spark = long.sparkSession
    text = spark.createDataFrame([(json.dumps(dict(method), sort_keys=True),)], "value string")
    text.coalesce(1).write.mode("overwrite").text(folder.rstrip("/") + ".meta.json")


def with_method(df: DataFrame, method: Mapping[str, object]) -> DataFrame:
    """The run's settings as constant columns."""
    return df.select("*", *[F.lit(v).alias(k) for k, v in method.items()])


def drop_suffix(df: DataFrame, suffix: str) -> DataFrame:
    return df.drop(*[c for c in df.columns if c.endswith(suffix)])


# --- exports -------------------------------------------------------------------------------

def ordered_arrays(counts: DataFrame, keys: Sequence[str], order: str = "hex_id", value: str = "n",
                   chunk: int = 50_000) -> DataFrame:
    """(keys, part, values): JSON arrays of ``value`` in cell order, ``chunk`` cell ids to a part.

    Parts follow each other, so a viewer appends them; no array grows with the grid.
    """
    items = F.sort_array(F.collect_list(F.struct(order, value)))
    part = F.floor(F.col(order) / chunk).alias("part")
    return counts.groupBy(*keys, part).agg(F.to_json(F.transform(items, lambda v: v[value])).alias("values"))


def features(df: DataFrame, properties: Sequence[str], geometry: Column, kind: str = "Point") -> DataFrame:
    """One GeoJSON feature per row as text; missing properties are written as null."""
    feature = F.struct(F.lit("Feature").alias("type"), F.struct(*properties).alias("properties"),
                       F.struct(F.lit(kind).alias("type"), geometry.alias("coordinates")).alias("geometry"))
    return df.select(F.to_json(feature, {"ignoreNullFields": "false"}).alias("value"))


def web_order(cube: DataFrame, keys: Sequence[str] = ("month", "meta", "hour", "hex_id")) -> DataFrame:
    """Cube rows in the order the viewer reads them, sorted inside range partitions."""
    return cube.repartitionByRange(*keys).sortWithinPartitions(*keys)


# --- observations and logs -------------------------------------------------------------------

def usable_observations(raw: DataFrame, routes: DataFrame, *, max_speed: float = 90.0) -> DataFrame:
    """(a, b, secs, minute, day) of plausible segment times on the given (bus) routes."""
    ok = ((F.col("seg_status") == "ok") & F.col("seg_time_s").isNotNull() & (F.col("seg_time_s") > 0)
          & (F.col("seg_speed_kmh") <= max_speed))
    clock = F.substring("obs_local", 12, 5)
    minute = F.substring(clock, 1, 2).cast("int") * 60 + F.substring(clock, 4, 2).cast("int")
    return raw.where(ok).join(routes.select("route_id").distinct(), "route_id", "left_semi").select(
        F.col("from_stop_id").alias("a"), F.col("stop_id").alias("b"), F.col("seg_time_s").alias("secs"),
        minute.alias("minute"), F.substring("obs_local", 1, 10).alias("day"))


def _step(value: Column) -> Column:
    """struct(total, secs) of a line "[done/total] hour -> count features in seconds s", NULL for any other line.

    The line is taken apart at its blanks and each word must be what its place asks for.
    """
    def whole(c: Column) -> Column:
        return F.when(F.translate(c, "0123456789", "") == "", c).try_cast("int")
    counter = F.split(F.substring_index(F.substring(value, 2, 1 << 20), "]", 1), "/")
    words = F.split(F.ltrim(F.substring(value, F.instr(value, "]") + 1, F.length(value))), " ")
    word = lambda i: F.coalesce(F.get(words, F.lit(i)), F.lit(""))
    done, total = whole(F.ltrim(F.get(counter, F.lit(0)))), whole(F.get(counter, F.lit(1)))
    hour = (F.length(word(0)) == 5) & word(0).endswith(":00") & whole(F.substring(word(0), 1, 2)).isNotNull()
    secs = F.when(F.translate(word(5), "0123456789.", "") == "", word(5)).try_cast("double")
    fits = (value.startswith("[") & (F.size(counter) == 2) & done.isNotNull() & total.isNotNull() & hour & (word(1) == "->") & whole(word(2)).isNotNull()
            & (word(3) == "features") & (word(4) == "in") & secs.isNotNull() & word(6).startswith("s"))
    return F.when(fits, F.struct(total.alias("total"), secs.alias("secs")))


# Fixed value: the line that tells the number of origins.
ORIGIN_COUNT = r"^origins:\s*(\d+)"


def run_costs(lines: DataFrame) -> DataFrame:
    """Per log file: steps done, seconds, cost per origin and hour, estimated rest. lines: (file, value)."""
    origins = F.nullif(F.regexp_extract("value", ORIGIN_COUNT, 1), F.lit(""))
    parsed = lines.select("file", origins.cast("bigint").alias("origins"), _step(F.col("value")).alias("s")).select(
        "file", "origins", F.col("s.total").alias("steps"), F.col("s.secs").alias("secs"))
    out = parsed.groupBy("file").agg(F.max("origins").alias("origins"), F.count("secs").alias("steps_done"),
                                     F.max("steps").alias("steps_total"), F.sum("secs").alias("elapsed_s"))
    out = out.where("origins is not null and steps_done > 0")
    rest = F.col("steps_total") - F.col("steps_done")
    return out.select("*", (F.col("elapsed_s") / (F.col("origins") * F.col("steps_done"))).alias("s_per_origin_hour"),
                      (rest * F.col("elapsed_s") / F.col("steps_done")).alias("eta_s"), (rest <= 0).alias("complete"))


def read_logs(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path).select(F.element_at(F.split(F.input_file_name(), "/"), -1).alias("file"), "value")


def read_votes(spark: SparkSession, path: str, *, precinct: int, valid: int, committees: Mapping[int, str]) -> DataFrame:
    """(precinct, valid_votes, committee, votes) of a semicolon CSV addressed by column position."""
    raw = spark.read.csv(path, sep=";", header=True, quote='"')
    return vote_rows(raw, precinct=precinct, valid=valid, committees=committees)


def vote_rows(raw: DataFrame, *, precinct: int, valid: int, committees: Mapping[int, str]) -> DataFrame:
    names = raw.columns
    rows = F.array(*[F.struct(F.lit(label).alias("committee"), F.coalesce(F.trim(F.col(f"`{names[i]}`")).try_cast("int"), F.lit(0)).alias("votes"))
                     for i, label in committees.items()])
    out = raw.select(F.col(f"`{names[precinct]}`").alias("precinct"), F.col(f"`{names[valid]}`").try_cast("int").alias("valid_votes"), F.inline(rows))
    return out.where("precinct is not null and precinct <> '' and valid_votes > 0")


# --- sampling and tags ---------------------------------------------------------------------

def evenly_spread(idx: Column, n: Column, k: int) -> Column:
    """Whether position ``idx`` of 0..n-1 is one of k evenly spread ones, both ends included (halves round to even)."""
    if k <= 1:
        return idx == 0
    nearest = F.round(idx * (k - 1) / F.greatest(n - 1, F.lit(1)))
    here, last, after = (i.between(0, k - 1) & (F.bround(i * (n - 1) / (k - 1)) == idx) for i in (nearest, nearest - 1, nearest + 1))
    return (n <= k) | here | last | after


def systematic_sample(df: DataFrame, order: Sequence[str], k: int = 15) -> DataFrame:
    """k rows spread evenly along ``order``, both ends included."""
    placed = row_index(df, *order)
    return placed.where(evenly_spread(F.col("idx"), placed.agg(F.count("*")).scalar(), k))


def tag_categories(items: DataFrame, rules: DataFrame) -> DataFrame:
    """(items, category): items with any of a category's key=value tags, once per category.

    items: key columns and ``tags`` map. rules: (category, key, value).
    """
    keys = [c for c in items.columns if c != "tags"]
    tagged = items.select(*keys, F.explode("tags").alias("key", "value"))
    return tagged.join(rules, ["key", "value"]).select(*keys, "category").distinct()
