"""Static catalogues: regions, variables, dimension encodings, archive request table."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


class Region(NamedTuple):
    """A named box on the globe; its four limits are themselves cell centres, so cells on them belong to it."""

    name: str
    latmax: float
    lonmin: float
    latmin: float
    lonmax: float

    def contains(self, lat: str = "lat", lon: str = "lon") -> Column:
        """Inclusive box predicate; plain comparisons, so it reaches the parquet scan."""
        return F.col(lat).between(self.latmin, self.latmax) & F.col(lon).between(self.lonmin, self.lonmax)


# The named boxes (name, north, west, south, east) in degrees.
REGIONS = {
    r.name: r
    for r in (
        Region("europe", 75, -30, 30, 40),
        Region("nhplus", 90, -180, -40, 180),
        Region("nhnorm", 90, -180, -20, 180),
        Region("nhmin", 90, -180, 30, 180),
        Region("nhblock", 90, -130, 0, 100),
        Region("natlantic", 60, -60, 30, 0),
        Region("euratl", 80, -90, 20, 30),
    )
}

# Grid spacing in degrees, storage type and scale factor per variable.
VARIABLES = [
    ("z500", 0.25, "short", 10.0),
    ("z300", 0.25, "short", 10.0),
    ("u300", 0.25, "short", 0.005),
    ("v300", 0.25, "short", 0.005),
    ("t850", 0.25, "short", 0.02),
    ("siconc", 0.25, "byte", 0.01),
    ("sst", 0.25, "short", 0.01),
    ("t2m", 0.25, "short", 0.02),
    ("transp", 0.1, "short", 0.000005),
    ("snowc", 0.1, "byte", None),
    ("swvl1", 0.1, "byte", 0.01),
    ("swvl2", 0.1, "byte", 0.01),
    ("swvl3", 0.1, "byte", 0.01),
    ("swvl4", 0.1, "byte", 0.01),
    ("swvl13", 0.1, "byte", 0.01),
    ("tcc", 0.25, "byte", 0.01),
    ("clustid", None, "int", None),
    ("correlation", None, "short", 0.0001),
]

# Archive name, pressure level and collection per downloadable variable.
ARCHIVE = [
    ("z500", "geopotential", 500, "reanalysis-era5-pressure-levels"),
    ("z300", "geopotential", 300, "reanalysis-era5-pressure-levels"),
    ("u300", "u_component_of_wind", 300, "reanalysis-era5-pressure-levels"),
    ("v300", "v_component_of_wind", 300, "reanalysis-era5-pressure-levels"),
    ("t850", "temperature", 850, "reanalysis-era5-pressure-levels"),
    ("siconc", "sea_ice_cover", None, "reanalysis-era5-single-levels"),
    ("sst", "sea_surface_temperature", None, "reanalysis-era5-single-levels"),
    ("t2m", "2m_temperature", None, "reanalysis-era5-single-levels"),
    ("transp", "evaporation_from_bare_soil", None, "reanalysis-era5-land"),
    ("snowc", "snow_cover", None, "reanalysis-era5-land"),
    ("swvl1", "volumetric_soil_water_layer_1", None, "reanalysis-era5-land"),
    ("swvl2", "volumetric_soil_water_layer_2", None, "reanalysis-era5-land"),
    ("swvl3", "volumetric_soil_water_layer_3", None, "reanalysis-era5-land"),
    ("swvl4", "volumetric_soil_water_layer_4", None, "reanalysis-era5-land"),
    ("tcc", "total_cloud_cover", None, "reanalysis-era5-single-levels"),
]

# Variables whose daily value is stamped 00:00 of the next day.
NEXT_DAY_VARIABLES = ("transp", "snowc")

# Units and Spark type of each standard dimension.
DIMENSIONS = {
    "time": ("days since 1900-01-01 00:00:00", "date"),
    "latitude": ("degrees_north", "float"),
    "longitude": ("degrees_east", "float"),
    "doy": ("dayofyear", "int"),
    "nclusters": ("", "int"),
    "dissim_threshold": ("", "float"),
    "clustid": ("", "int"),
    "lag": ("days", "int"),
    "fold": ("", "int"),
    "quantile": ("", "float"),
}

# Parameter domains of the study.
TIMEAGGS = (1, 3, 5, 7, 11, 15, 21, 31)
SEPARATIONS = (0, -1, -3, -5, -7, -11, -15, -21, -31)
SOIL_LAYER_WEIGHTS = {"swvl1": 7, "swvl2": 21, "swvl3": 72}


def variable_formats(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(VARIABLES, "varname string, spacing double, datatype string, scale_factor double")


def archive_formats(spark: SparkSession) -> DataFrame:
    """Archive catalogue left-joined with the variable formats (15 rows, a literal table)."""
    archive = spark.createDataFrame(ARCHIVE, "varname string, variable string, pressure_level int, setname string")
    return archive.join(F.broadcast(variable_formats(spark)), "varname", "left")


def grid(spark: SparkSession, region: Region, spacing: float) -> DataFrame:
    """Cell midpoints ``(lat, lon)`` of a region; longitudes of 180 and above wrap away.

    Both axes are generated on the executors from one ``range``.
    """
    n_lat = int(round((region.latmax - region.latmin) / spacing)) + 1
    n_lon = int(round((region.lonmax - region.lonmin) / spacing)) + 1
    cells = spark.range(n_lat * n_lon)
    lat = F.round(F.lit(float(region.latmin)) + F.floor(F.col("id") / n_lon) * spacing, 2)
    lon = F.round(F.lit(float(region.lonmin)) + (F.col("id") % n_lon) * spacing, 2)
    return cells.select(F.col("id").alias("cell"), lat.alias("lat"), lon.alias("lon")).where(F.col("lon") < 180)


def schema_for(varname: str, dimensions: tuple[str, ...] = ("time", "latitude", "longitude")) -> str:
    """DDL of a stored variable: its dimensions plus a nullable value column."""
    columns = [f"{d} {DIMENSIONS[d][1]}" for d in dimensions]
    if varname not in {v[0] for v in VARIABLES}:
        raise KeyError(f"unknown variable {varname}")
    return ", ".join([*columns, "value double"])
