"""The example catalogue: region, strata and normal columns of known data sets (the tables themselves are the user's)."""

from __future__ import annotations

import math
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

from seamark.sources.grids import read_observations

ALL = [("All_areas", (-math.inf, math.inf))]
#: Ids of the strata that make up Georges Bank, and of those of southern New England (fixed values).
GEORGES_BANK = [1130, 1140, 1150, 1160, 1170, 1180, 1190, 1200, 1210, 1220, 1230, 1240, 1250, 1290, 1300]
YELLOWTAIL = [1130, 1140, 1150, 1160, 1170, 1180, 1190, 1200, 1210]


@dataclass(frozen=True)
class Example:
    """columns: SQL for the normal columns; none where the table has them.  strata: (label, bounds) or (label, ids)."""

    region: str
    columns: dict[str, str] = field(default_factory=dict)
    strata: list[tuple] = field(default_factory=lambda: ALL)


def _columns(catch: str, year: str, area: str, lat: str, lon: str, **more: str) -> dict[str, str]:
    return {"Catch_KG": catch, "Year": year, "AreaSwept_km2": area, "Lat": lat, "Lon": lon} | more


_HADDOCK = _columns("CATCH_WT_CAL", "YEAR", "0.0112D * pow(1.852D, 2)", "LATITUDE", "LONGITUDE")
_PROJECT_YEAR = "CAST(get(split(PROJECT_CYCLE, ' '), 1) AS DOUBLE)"
#: By name in small letters (fixed values: regions, columns and units of the data sets).
EXAMPLES = {
    "aleutian_islands_pop": Example("aleutian_islands", _columns("`cpue..kg.km.2.`", "year", "1.0D", "`start.latitude`", "`start.longitude`")),
    "bc_pacific_cod": Example("british_columbia", _columns("PCOD_WEIGHT", "Year", "`TOW.LENGTH..KM.` / 100", "LAT", "LON")),
    "chatham_rise_hake": Example("new_zealand", _columns("Hake_kg_per_km2", "Year", "1.0D", "Lat", "Lon", Vessel="'1'")),
    "condition_and_density": Example("eastern_bering_sea"),
    "covariate_example": Example("gulf_of_alaska"),
    "ebs_pollock": Example("eastern_bering_sea", _columns("catch", "year", "0.01D", "lat", "long")),
    "five_species_ordination": Example("eastern_bering_sea"),
    "gb_fall_haddock": Example("northwest_atlantic", _HADDOCK, [("Georges_Bank", GEORGES_BANK)]),
    "gb_spring_haddock": Example("northwest_atlantic", _HADDOCK, [("Georges_Bank", GEORGES_BANK)]),
    "goa_arrowtooth_condition_and_density": Example("gulf_of_alaska"),
    "goa_mice_example": Example("gulf_of_alaska"),
    "goa_pcod": Example("gulf_of_alaska", _columns("catch", "year", "0.01D", "lat", "lon")),
    "goa_pcod_covariate_example": Example("gulf_of_alaska"),
    "goa_pollock": Example("gulf_of_alaska", _columns("catch", "year", "0.01D", "lat", "lon")),
    "gsl_american_plaice": Example("gulf_of_st_lawrence", _columns("biomass * vstd", "year", "swept", "latitude", "longitude")),
    "iceland_cod": Example("other", _columns("Catch_b", "year", "towlength", "lat1", "lon1", Vessel="'1'")),
    "lingcod_comp_expansion": Example("california_current", strata=[("ORWA", (42.0, 49.0))]),
    "multimodal_red_snapper": Example("gulf_of_mexico"),
    "nwa_yellowtail_seasons": Example("northwest_atlantic", strata=[("1", YELLOWTAIL)]),
    "ordination": Example("eastern_bering_sea"),
    "pesc_example_red_grouper": Example("user"),
    "sawc_jacopever": Example("south_africa", _columns("HELDAC", "Year", "area_swept_nm2 * pow(1.852D, 2)", "cen_lat", "cen_long")),
    "wcgbts_canary": Example("california_current", _columns("HAUL_WT_KG", _PROJECT_YEAR, "AREA_SWEPT_HA / 1e2", "BEST_LAT_DD", "BEST_LON_DD", Vessel=f"concat_ws('_', VESSEL, CAST(CAST({_PROJECT_YEAR} AS INT) AS STRING))", Pass="PASS - 1.5D")),
}


def example(name: str) -> Example:
    """Names are compared without regard to case; unknown ones have region other and normal columns."""
    return EXAMPLES.get(name.lower(), Example("other"))


def load_example(spark: SparkSession, name: str, path: str) -> tuple[DataFrame, str, list[tuple]]:
    """(samples, region, strata) of a data set whose table is at path; vessels and passes that it lacks are missing and 0."""
    known = example(name)
    rows = read_observations(spark, path, known.columns) if known.columns else spark.read.parquet(path)
    return rows, known.region, known.strata
