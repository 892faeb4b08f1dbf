"""Synthetic laps and drivers, made by Spark and the same for a seed and a number of rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

TEAMS, NATIONS, DRIVERS = 9, 7, 20


def _draw(low: float, high: float, seed: int, salt: int):
    return F.round(F.lit(low) + F.rand(seed * 31 + salt) * (high - low), 2)


def drivers(spark: SparkSession) -> DataFrame:
    i = F.col("id")
    return spark.range(1, DRIVERS + 1).select(
        i.alias("driver_id"), F.concat(F.lit("Driver_"), i).alias("name"), F.concat(F.lit("Nation_"), i % NATIONS).alias("nationality"), _team(i), (19 + (i * 11) % 23).alias("age")
    )


def _team(driver: Column) -> Column:
    return F.concat(F.lit("Team_"), driver % TEAMS).alias("team")


def laps(spark: SparkSession, rows: int, seed: int = 0, by_season: bool = True) -> DataFrame:
    """``rows`` laps; sorted by season unless told otherwise. A lap's team is its driver's."""
    one = F.lit(1)
    out = spark.range(1, rows + 1).select(
        F.col("id").alias("lap_id"), (one + F.floor(F.rand(seed) * DRIVERS)).cast("bigint").alias("driver_id"), _draw(280, 345, seed, 1).alias("speed"),
        _draw(25, 40, seed, 2).alias("sector_1"), _draw(30, 45, seed, 3).alias("sector_2"), _draw(20, 35, seed, 4).alias("sector_3"),
        (F.lit(2022) + F.floor(F.rand(seed * 31 + 5) * 4)).cast("bigint").alias("season"), (one + F.floor(F.rand(seed * 31 + 6) * 24)).cast("bigint").alias("round"),
    )
    out = out.select("lap_id", "driver_id", _team(F.col("driver_id")), "speed", "sector_1", "sector_2", "sector_3", "season", "round")
    return out.orderBy("season", "lap_id") if by_season else out
