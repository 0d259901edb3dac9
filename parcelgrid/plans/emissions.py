"""Fleet emission rates from an emission inventory."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.semantics import sum_strict
from ..functions.units import LB_PER_TON

POLLUTANTS = ("n_ox_totex", "pm2_5_totex", "pm2_5_total", "co2_totex")
REFUSE_TRUCK = "SWCV"


def per_vehicle_rates(inventory: DataFrame, *, dropped: str | None = "MDV") -> DataFrame:
    """One row per vehicle row and pollutant with tons and pounds per mile, refuse trucks left out."""
    rows = inventory if dropped is None else inventory.where(F.col("vehicle_category") != dropped)
    kept = [c for c in ("vehicle_category", "calendar_year", "fuel", "trips", "total_vmt") if c in rows.columns]
    long = rows.where(~F.col("vehicle_category").contains(REFUSE_TRUCK)).unpivot(
        kept, list(POLLUTANTS), "emissions_type", "tons_day"
    )
    return long.withColumn("tons_mile", F.try_divide("tons_day", "total_vmt")).withColumn(
        "pounds_mile", F.col("tons_mile") * LB_PER_TON
    )


def fleet_rates(inventory: DataFrame, *, dropped: str | None = "MDV") -> DataFrame:
    """Mileage-weighted rate per pollutant: sum of tons over sum of miles."""
    totals = per_vehicle_rates(inventory, dropped=dropped).groupBy("emissions_type").agg(
        sum_strict(F.col("total_vmt")).alias("sum_vmt"), sum_strict(F.col("tons_day")).alias("sum_tons")
    )
    return totals.withColumn("tons_mile", F.try_divide("sum_tons", "sum_vmt")).withColumn(
        "pounds_mile", F.col("tons_mile") * LB_PER_TON
    )


def linear_fit(inventory: DataFrame, x: str = "trips", y: str = "total_vmt") -> DataFrame:
    """Least-squares line y ~ x over all rows: slope, intercept, r2."""
    return inventory.agg(
        F.regr_slope(y, x).alias("slope"),
        F.regr_intercept(y, x).alias("intercept"),
        F.regr_r2(y, x).alias("r2"),
    )
