"""Registered queries, each with the SQL that checks it."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parcelgrid.functions import geometry as geo
from parcelgrid.functions import projection
from parcelgrid.functions.semantics import clean_names, half_even, parse_date, year_of
from parcelgrid.operators import relational as rel
from parcelgrid.operators import spatial as sp
from parcelgrid.operators import stored
from parcelgrid.plans import addresses, compliance, emissions, impact, parcels, places, planned
from parcelgrid.sources import geojson, tables

from . import inputs_sql as sql
from . import standins as fx

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def register(name: str, oracle: str | None):
    def keep(query: Query) -> Query:
        QUERIES[name] = query
        if oracle is not None:
            ORACLES[name] = sql.with_tables(oracle)
        return query

    return keep


def _bounds(df: DataFrame, *columns: str, geometry: str = "geometry") -> DataFrame:
    return df.select(*columns, *[F.col(f"{geometry}.{b}").alias(b) for b in geo.BOX])


# ------------------------------------------------------------- pieces in common

def _combined(spark, d):
    """Kept and small parcels from four county tables with uneven columns."""
    typed = fx.typed_parcels(spark, d).select("apn", "shape_area", "class", "type", "year_built", "county", "geometry")
    parts = [typed.where(F.col("county") == name) for name in planned.COUNTIES]
    parts[1] = parts[1].withColumn("year_built", F.col("year_built").cast("double"))
    return parcels.combine_parcels(parts, fx.ids(spark, d, 17))


def _planned(spark, d):
    return planned.planned_projects(fx.projects(spark, d))


_EXCEPTIONS = {"less_than_half": sql.LESS_THAN_HALF, "off_centre": sql.OFF_CENTRE}


def _counties(spark):
    return places.select_counties(fx.counties(spark))


def _jurisdictions(spark, d):
    return rel.bind_rows(
        fx.places(spark, d), _counties(spark).select(F.col("county").alias("name"), "geometry")
    )


def _kept(spark, d):
    """The kept parcels as a written table, which later steps read several times."""
    return tables.materialise(_combined(spark, d)[0])


def serving_table(spark, d):
    kept = _kept(spark, d)
    open_projects = tables.materialise(planned.planned_not_built(kept, _planned(spark, d), **_EXCEPTIONS))
    future = planned.finish_planned(open_projects)
    return planned.build_serving(kept, future, _counties(spark), _jurisdictions(spark, d))


# --------------------------------------------------------------------- impact

def _impact_sql(source: str, where: str, *, far="0.55e0", vacancy="5.7e0", rate="0.67e0", miles="38e0", jobs="8e0") -> str:
    return f"""
SELECT category, warehouses, acreage, floor_sq_ft, truck_trips,
  round_even({miles}*truck_trips*0.0000364e0,1) AS dpm_lb, round_even({miles}*truck_trips*0.0041e0,0) AS nox_lb,
  round_even({miles}*truck_trips*2.44e0*0.000453592e0,1) AS co2_t,
  CASE WHEN category<>'Vacant' THEN round_even({jobs}*acreage,0) END AS jobs
FROM (SELECT *, CASE WHEN category<>'Vacant' THEN round_even({rate}*0.001e0*floor_sq_ft,-3) END AS truck_trips FROM (
  SELECT category, warehouses, acreage, floor_sq_ft FROM step WHERE category<>'Existing'
  UNION ALL SELECT 'Existing', round_even((100e0-{vacancy})*warehouses/100e0,0), round_even((100e0-{vacancy})*acreage/100e0,0),
    round_even((100e0-{vacancy})*floor_sq_ft/100e0,0) FROM step WHERE category='Existing'
  UNION ALL SELECT 'Vacant', round_even({vacancy}*warehouses/100e0,0), round_even({vacancy}*acreage/100e0,0),
    round_even({vacancy}*floor_sq_ft/100e0,0) FROM step WHERE category='Existing') u) v""".replace(
        "step",
        f"(SELECT category, CAST(count(*) AS DOUBLE) AS warehouses, round_even(sum(acreage),0) AS acreage,"
        f" round_even(sum(acreage*{far}*43560e0),-5) AS floor_sq_ft FROM (SELECT *, round_even(round_even(shape_area,0)/43560e0,0) AS acreage"
        f" FROM {source} WHERE {where}) a GROUP BY category)",
    )


@register("impact_summary", _impact_sql("serving_fx", "year_built<=2030 AND (place_name='Riverside County' OR county='Riverside County')"))
def impact_summary(spark, d):
    return impact.answer(fx.serving(spark, d), impact.Params(places=("Riverside County",)))


@register(
    "impact_summary_parameters",
    _impact_sql(
        "serving_fx", "year_built<=2010 AND NOT unknown AND (place_name IN ('PLACE_2','PLACE_3') OR county IN ('PLACE_2','PLACE_3'))",
        far="0.4e0", vacancy="8.25e0", rate="0.9e0", miles="21.5e0", jobs="11e0",
    ),
)
def impact_summary_parameters(spark, d):
    question = impact.Params(
        places=("PLACE_2", "PLACE_3"), year=2010, include_unknown=False, far=0.4, vacancy_percent=8.25,
        trips_per_1000_sq_ft=0.9, miles_per_trip=21.5, jobs_per_acre=11.0,
    )
    return impact.answer(fx.serving(spark, d), question)


_LIST_SQL = """SELECT category, apn AS parcel_number, class, year_built, round_even(shape_area/43560e0,0) AS acreage,
  round_even(shape_area*0.55e0,-3) AS sq_ft FROM serving_fx"""


@register("parcel_list", _LIST_SQL)
def parcel_list(spark, d):
    return impact.largest_first(impact.parcel_list(fx.serving(spark, d)))


@register("parcel_top10", _LIST_SQL + " ORDER BY sq_ft DESC NULLS LAST, parcel_number LIMIT 10")
def parcel_top10(spark, d):
    return impact.first_page(impact.parcel_list(fx.serving(spark, d)))


@register(
    "filter_parcels",
    "SELECT apn, shape_area, category, year_built, county, place_name FROM serving_fx WHERE year_built<=2015 AND NOT unknown"
    " AND (place_name IN ('PLACE_1','Orange County') OR county IN ('PLACE_1','Orange County'))",
)
def filter_parcels(spark, d):
    question = impact.Params(places=("PLACE_1", "Orange County"), year=2015, include_unknown=False)
    return impact.filter_parcels(fx.serving(spark, d), question).select(
        "apn", "shape_area", "category", "year_built", "county", "place_name"
    )


_DISTRICTS_SQL = """
SELECT 'AD '||name AS district_label, xmin,ymin,xmax,ymax FROM lower_fx l WHERE EXISTS (SELECT 1 FROM counties_fx c
  WHERE l.xmin<=c.xmax AND l.xmax>=c.xmin AND l.ymin<=c.ymax AND l.ymax>=c.ymin)
UNION ALL SELECT 'SD '||name, xmin,ymin,xmax,ymax FROM upper_fx l WHERE EXISTS (SELECT 1 FROM counties_fx c
  WHERE l.xmin<=c.xmax AND l.xmax>=c.xmin AND l.ymin<=c.ymax AND l.ymax>=c.ymin)"""


def _districts(spark, d):
    return places.build_districts(
        fx.district_layer(spark, d, "lower"), fx.district_layer(spark, d, "upper"), _counties(spark)
    )


@register(
    "filter_by_district",
    f"""SELECT apn, category, shape_area FROM serving_fx s WHERE year_built<=2030 AND EXISTS (SELECT 1 FROM ({_DISTRICTS_SQL}) t
  WHERE district_label IN ('AD 1','AD 6','SD 4') AND s.xmin<=t.xmax AND s.xmax>=t.xmin AND s.ymin<=t.ymax AND s.ymax>=t.ymin)""",
)
def filter_by_district(spark, d):
    question = impact.Params(districts=("AD 1", "AD 6", "SD 4"))
    return impact.filter_parcels(fx.serving(spark, d), question, _districts(spark, d)).select("apn", "category", "shape_area")


@register("choice_list", "SELECT DISTINCT place_name FROM serving_fx WHERE place_name IS NOT NULL ORDER BY 1")
def choice_list(spark, d):
    return impact.choice_list(fx.serving(spark, d), "place_name")


def _trends_sql(by: str, where: str) -> str:
    return f"""SELECT CASE WHEN year_built=1980 THEN '1980' WHEN year_built BETWEEN 1981 AND 1990 THEN '1990'
  WHEN year_built BETWEEN 1991 AND 2000 THEN '2000' WHEN year_built BETWEEN 2001 AND 2010 THEN '2010'
  WHEN year_built BETWEEN 2011 AND 2020 THEN '2020' WHEN year_built>=2021 THEN '2030 - Planned' END AS decade,
  {by}, sum(shape_area) AS sum_footprint, count(*) AS count FROM serving_fx WHERE {where} GROUP BY ALL"""


@register("trends_county", _trends_sql("county", "true"))
def trends_county(spark, d):
    return impact.trends(fx.serving(spark, d))


@register("trends_place", _trends_sql("place_name", "place_name IN ('PLACE_0','PLACE_5')"))
def trends_place(spark, d):
    return impact.trends(fx.serving(spark, d), "place_name", ("PLACE_0", "PLACE_5"))


@register("other_parcels", "SELECT apn, class, year_built FROM kept_fx WHERE floor_sq_ft>28000 AND type='other'")
def other_parcels(spark, d):
    return impact.other_parcels(_combined(spark, d)[0]).select(
        "apn", "class", F.col("year_built").alias("year_built")
    )


# ----------------------------------------------------------------- compliance

@register(
    "isr_summary",
    """SELECT CASE WHEN s>=250000 THEN 'PhaseI' WHEN s>=150000 THEN 'PhaseII' ELSE 'PhaseIII' END AS isr_category, count(*) AS count,
  round(avg(s),6) AS avg_sq_ft, median(s) AS median_sq_ft, sum(s) AS total_area_sq_ft
FROM (SELECT shape_area*0.5e0 AS s FROM serving_fx WHERE category='Existing') q WHERE s>100000 GROUP BY 1""",
)
def isr_summary(spark, d):
    return compliance.isr_summary(fx.serving(spark, d)).withColumn("avg_sq_ft", F.round("avg_sq_ft", 6))


@register(
    "notice_points",
    "SELECT company, address, city, zip, notice_count, lng AS xmin, lat AS ymin, lng AS xmax, lat AS ymax FROM notice_points_fx",
)
def notice_points(spark, d):
    points = compliance.notice_points(fx.notices(spark, d), fx.geocoded(spark, d))
    return _bounds(points, "company", "address", "city", "zip", "notice_count")


def _near_sql(feet: str) -> str:
    """Parcels within a radius of a notice: exact distance to the four projected edges."""
    corners = [("s.xmin", "s.ymin"), ("s.xmax", "s.ymin"), ("s.xmax", "s.ymax"), ("s.xmin", "s.ymax")]
    projected = ", ".join(
        f"{x} AS x{i}, {y} AS y{i}" for i, (x, y) in enumerate(sql.plane(a, b) for a, b in corners)
    )
    px, py = sql.plane("n.lng", "n.lat")

    def edge(i: int) -> str:
        j = (i + 1) % 4
        dx, dy = f"(x{j}-x{i})", f"(y{j}-y{i})"
        t = f"least(greatest(((px-x{i})*{dx}+(py-y{i})*{dy})/({dx}*{dx}+{dy}*{dy}),0e0),1e0)"
        return f"pow(px-x{i}-{dx}*{t},2)+pow(py-y{i}-{dy}*{t},2)<=pow({feet},2)"

    inside = " AND ".join(f"(x{(i + 1) % 4}-x{i})*(py-y{i})-(px-x{i})*(y{(i + 1) % 4}-y{i})>=0" for i in range(4))
    return f"""SELECT DISTINCT apn, shape_area FROM (
  SELECT s.apn, s.shape_area, {px} AS px, {py} AS py, {projected}
  FROM serving_fx s JOIN notice_points_fx n ON s.category='Existing' AND s.shape_area>80000
   AND n.lng BETWEEN s.xmin-0.01e0 AND s.xmax+0.01e0 AND n.lat BETWEEN s.ymin-0.01e0 AND s.ymax+0.01e0) q
WHERE ({inside}) OR {" OR ".join(edge(i) for i in range(4))}"""


@register("flag_notices", _near_sql("70e0"))
def flag_notices(spark, d):
    points = compliance.notice_points(fx.notices(spark, d), fx.geocoded(spark, d))
    return compliance.flag_notices(fx.serving(spark, d), points).select("apn", "shape_area")


@register("flag_notices_metres", _near_sql("(250e0*3937e0/1200e0)"))
def flag_notices_metres(spark, d):
    points = compliance.notice_points(fx.notices(spark, d), fx.geocoded(spark, d))
    return compliance.flag_notices(fx.serving(spark, d), points, radius=250.0, unit="m").select("apn", "shape_area")


@register("flag_notices_touching", _near_sql("0e0"))
def flag_notices_touching(spark, d):
    points = compliance.notice_points(fx.notices(spark, d), fx.geocoded(spark, d))
    return compliance.flag_notices(fx.serving(spark, d), points, radius=0.0).select("apn", "shape_area")


@register("flag_notices_70m", _near_sql("(70e0*3937e0/1200e0)"))
def flag_notices_70m(spark, d):
    points = compliance.notice_points(fx.notices(spark, d), fx.geocoded(spark, d))
    return compliance.flag_notices(fx.serving(spark, d), points, radius=70.0, unit="m").select("apn", "shape_area")


# ------------------------------------------------------------------ emissions

_LONG_SQL = """SELECT vehicle_category, calendar_year, fuel, trips, total_vmt, emissions_type, tons_day FROM emis_fx
  UNPIVOT INCLUDE NULLS (tons_day FOR emissions_type IN (n_ox_totex, pm2_5_totex, pm2_5_total, co2_totex))"""


def _rates_sql(where: str) -> str:
    return f"""SELECT emissions_type, round(sum_vmt,3) AS sum_vmt, round(sum_tons,6) AS sum_tons, round(sum_tons/sum_vmt*1e6,6) AS tons_mile_e6,
  round(sum_tons/sum_vmt*2000e0*1e3,6) AS pounds_mile_e3
FROM (SELECT emissions_type, sum(total_vmt) AS sum_vmt, sum(tons_day) AS sum_tons FROM ({_LONG_SQL}) l
  WHERE vehicle_category NOT LIKE '%SWCV%' AND {where} GROUP BY 1) s"""


def _rounded_rates(rates: DataFrame) -> DataFrame:
    return rates.select(
        "emissions_type",
        F.round("sum_vmt", 3).alias("sum_vmt"),
        F.round("sum_tons", 6).alias("sum_tons"),
        F.round(F.col("tons_mile") * 1e6, 6).alias("tons_mile_e6"),
        F.round(F.col("pounds_mile") * 1e3, 6).alias("pounds_mile_e3"),
    )


@register("fleet_rates", _rates_sql("vehicle_category<>'MDV'"))
def fleet_rates(spark, d):
    return _rounded_rates(emissions.fleet_rates(fx.emissions(spark, d)))


@register("fleet_rates_heavy", _rates_sql("true"))
def fleet_rates_heavy(spark, d):
    return _rounded_rates(emissions.fleet_rates(fx.emissions(spark, d), dropped=None))


@register(
    "vehicle_rates",
    f"""SELECT vehicle_category, calendar_year, fuel, trips, total_vmt, emissions_type, tons_day, tons_day/total_vmt AS tons_mile,
  tons_day/total_vmt*2000e0 AS pounds_mile FROM ({_LONG_SQL}) l WHERE vehicle_category<>'MDV' AND vehicle_category NOT LIKE '%SWCV%'""",
)
def vehicle_rates(spark, d):
    return emissions.per_vehicle_rates(fx.emissions(spark, d))


@register(
    "linear_fit",
    "SELECT round(regr_slope(total_vmt,n_ox_totex),6) AS slope, round(regr_intercept(total_vmt,n_ox_totex),4) AS intercept,"
    " round(regr_r2(total_vmt,n_ox_totex),9) AS r2 FROM emis_fx",
)
def linear_fit(spark, d):
    fit = emissions.linear_fit(fx.emissions(spark, d), "n_ox_totex", "total_vmt")
    return fit.select(F.round("slope", 6).alias("slope"), F.round("intercept", 4).alias("intercept"), F.round("r2", 9).alias("r2"))


# -------------------------------------------------------------------- parcels

@register("reconcile_years", "SELECT * FROM years_fx")
def reconcile_years(spark, d):
    return parcels.reconcile_years(fx.properties(spark, d))


@register(
    "classify_text",
    """SELECT p.apn, p.shape_area, p.class, CASE WHEN p.class LIKE '%warehouse%' THEN 'warehouse' WHEN p.class IS NOT NULL THEN 'other' END AS type,
  coalesce(y.year_built,1776) AS year_built, 'Riverside' AS county, p.xmin,p.ymin,p.xmax,p.ymax
FROM parcels_fx p LEFT JOIN years_fx y ON p.apn=y.pin
WHERE (p.class LIKE '%warehouse%' OR (p.class LIKE '%light industrial%' AND p.shape_area>150000) OR p.apn IN (SELECT apn FROM ids13))
  AND p.apn NOT IN (SELECT apn FROM ids17)""",
)
def classify_text(spark, d):
    raw = fx.parcels(spark, d).select("apn", F.upper("class").alias("class_code"), "shape_area", "geometry")
    years = parcels.reconcile_years(fx.properties(spark, d))
    out = parcels.classify_by_text(raw, years, fx.ids(spark, d, 13), fx.ids(spark, d, 17))
    return _bounds(out, "apn", "shape_area", "class", "type", "year_built", "county")


_CODED_SQL = """SELECT p.apn, p.shape_area, c.class, c.type FROM (SELECT *, CAST(id%60 AS DOUBLE) AS code FROM parcels_fx) p
  JOIN codes_fx c ON p.code=c.use_code WHERE c.type='warehouse' OR p.shape_area>150000"""


@register("classify_code", _CODED_SQL)
def classify_code(spark, d):
    codes = parcels.code_table(fx.use_codes(spark, d))
    return parcels.classify_by_code(fx.coded_parcels(spark, d), codes).select("apn", "shape_area", "class", "type")


@register(
    "add_partials",
    _CODED_SQL + """ UNION ALL SELECT p.apn, p.shape_area, c.class, c.type FROM parcels_fx p LEFT JOIN codes_fx c ON p.id%60=c.use_code
  WHERE p.apn IN (SELECT apn FROM ids13)""",
)
def add_partials(spark, d):
    raw, codes = fx.coded_parcels(spark, d), parcels.code_table(fx.use_codes(spark, d))
    both = parcels.add_partials(
        parcels.classify_by_code(raw, codes), parcels.partial_parcels(raw, codes, fx.ids(spark, d, 13))
    )
    return both.select("apn", "shape_area", "class", "type")


@register(
    "classify_land_use",
    """SELECT p.apn, p.shape_area, v.class, v.type FROM (SELECT *, CASE id%6 WHEN 0 THEN '1231' WHEN 1 THEN '1323' WHEN 2 THEN '1340'
  WHEN 3 THEN '1310' WHEN 4 THEN '1100' END AS lu FROM parcels_fx) p
JOIN (VALUES ('1231','commercial storage','other'),('1323','open storage','other'),('1340','wholesaling and warehousing','warehouse'),
  ('1310','light industrial','other')) v(code,class,type) ON p.lu=v.code WHERE v.type='warehouse' OR p.shape_area>150000""",
)
def classify_land_use(spark, d):
    out = parcels.classify_by_code(fx.land_use_parcels(spark, d), parcels.land_use_table(spark), code="lu16")
    return out.select("apn", "shape_area", "class", "type")


@register(
    "classify_prefix",
    """SELECT apn, CASE WHEN year_built IS NULL OR year_built<1911 THEN 1910e0 ELSE CAST(year_built AS DOUBLE) END AS year_built,
  code AS use_code, 'Warehousing, Distribution, Storage' AS class, shape_area, 'warehouse' AS type FROM (SELECT *, CASE id%7 WHEN 0 THEN '3340'
  WHEN 1 THEN '3351' WHEN 2 THEN '33T0' WHEN 3 THEN NULL ELSE '3310' END AS code FROM parcels_fx) p
WHERE id%13<>0 AND coalesce(substr(code,1,3),'') NOT IN ('334','335','33T')""",
)
def classify_prefix(spark, d):
    return parcels.classify_by_prefix(fx.prefix_parcels(spark, d)).drop("geometry")


@register(
    "year_fallback",
    """SELECT apn, CASE WHEN c>1900 THEN c WHEN b>1900 THEN b WHEN e>1900 THEN e ELSE 1980e0 END AS year_built FROM (
  SELECT apn, CASE WHEN id%4=0 THEN NULL WHEN id%4=1 THEN 0e0 ELSE CAST(year_built AS DOUBLE) END AS c,
    CASE WHEN id%3=0 THEN CAST(year_built+5 AS DOUBLE) WHEN id%3=1 THEN 0e0 END AS b,
    CASE WHEN id%5=0 THEN NULL ELSE CAST(year_built+9 AS DOUBLE) END AS e FROM parcels_fx) q""",
)
def year_fallback(spark, d):
    return parcels.year_fallback(fx.year_texts(spark, d)).select("apn", "year_built")


@register(
    "override_years",
    """SELECT p.apn, p.county, CAST(coalesce(x.y,p.year_built) AS DOUBLE) AS year_built, CAST(x.y-p.year_built AS DOUBLE) AS diff_yr
FROM parcels_fx p LEFT JOIN (SELECT DISTINCT lpad(CAST(l_orderkey AS VARCHAR),9,'0') AS apn, 1840+l_suppkey%180 AS y FROM lineitem
  WHERE l_linenumber%3=2 AND 1840+l_suppkey%180>1850) x ON x.apn=p.apn""",
)
def override_years(spark, d):
    base = fx.parcels(spark, d).select("apn", "county", "year_built")
    return parcels.override_years(base, fx.external_years(spark, d))


@register(
    "append_site",
    "SELECT apn, class, year_built FROM parcels_fx UNION ALL SELECT name, 'aviation warehouse', 2020 FROM towns_fx",
)
def append_site(spark, d):
    site = fx.towns(spark, d).select("name", "geometry")
    base = fx.parcels(spark, d).select("apn", "class", "year_built", "geometry")
    return parcels.append_site(base, site, {"class": "aviation warehouse", "year_built": 2020}).select("apn", "class", "year_built")


@register(
    "dedupe_geometry",
    """SELECT min(apn) AS apn, shape_area, class, type, CASE WHEN count(*)=count(year_built) THEN min(year_built) END AS year_built,
  xmin,ymin,xmax,ymax FROM typed_fx GROUP BY shape_area, class, type, xmin,ymin,xmax,ymax""",
)
def dedupe_geometry(spark, d):
    return _bounds(parcels.dedupe_by_geometry(fx.typed_parcels(spark, d)), "apn", "shape_area", "class", "type", "year_built")


@register("distinct_geometries", "SELECT DISTINCT xmin,ymin,xmax,ymax FROM parcels_fx")
def distinct_geometries(spark, d):
    return _bounds(sp.distinct_geometries(fx.parcels(spark, d)))


@register(
    "keep_first_geometry",
    "SELECT apn, class, xmin,ymin,xmax,ymax FROM (SELECT *, row_number() OVER (PARTITION BY xmin,ymin,xmax,ymax ORDER BY apn) AS r FROM parcels_fx) q WHERE r=1",
)
def keep_first_geometry(spark, d):
    return _bounds(parcels.keep_first_geometry(fx.parcels(spark, d), ["apn"]), "apn", "class")


@register(
    "orphan_geometries",
    """SELECT o.sch_number AS shape_id, p.apn FROM projects_fx o LEFT JOIN parcels_fx p
 ON p.xmin>=o.xmin AND p.xmax<=o.xmax AND p.ymin>=o.ymin AND p.ymax<=o.ymax""",
)
def orphan_geometries(spark, d):
    every = fx.parcels(spark, d)
    shapes = rel.bind_rows(
        every.select(F.col("apn").alias("shape_id"), "geometry"),
        fx.projects(spark, d).select(F.col("sch_number").alias("shape_id"), "geometry"),
    )
    return parcels.orphan_geometries(shapes, every.select("apn", "geometry")).select("shape_id", "apn")


@register("parse_addresses", "SELECT text, zip, county FROM addresses_fx")
def parse_addresses(spark, d):
    zips = addresses.zip_counties(fx.zip_rows(spark, d))
    return addresses.parse_addresses(fx.address_lines(spark, d).select("line"), zips)


@register(
    "addresses_to_geocode",
    "SELECT regexp_replace(text,' CA',', CA') AS address, zip, county FROM addresses_fx WHERE county='Orange County'",
)
def addresses_to_geocode(spark, d):
    return addresses.addresses_to_geocode(parse_addresses(spark, d))


@register(
    "page_slice",
    """SELECT page, line_no, line FROM (SELECT *, row_number() OVER (PARTITION BY page ORDER BY line_no, line) AS r FROM (
  SELECT CASE WHEN l_orderkey%3=0 THEN 0 ELSE l_suppkey END AS page, l_orderkey*10+l_linenumber AS line_no,
    CAST(l_partkey AS VARCHAR)||' '||l_returnflag AS line FROM lineitem) q) s WHERE r BETWEEN 6 AND 66""",
)
def page_slice(spark, d):
    return addresses.page_slice(fx.report_pages(spark, d))


@register(
    "concat_pages",
    """SELECT l_orderkey AS company, l_linenumber AS address, l_returnflag AS city, l_linestatus AS zip FROM lineitem
  UNION ALL SELECT o_orderkey, 0, o_orderstatus, o_orderpriority FROM orders""",
)
def concat_pages(spark, d):
    pages = [
        fx.table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_returnflag", "l_linestatus"),
        fx.table(spark, d, "orders").select("o_orderkey", F.lit(0), "o_orderstatus", "o_orderpriority"),
    ]
    return rel.concat_pages(pages, ["company", "address", "city", "zip"])


def _box_in_plane():
    """The four corners in state-plane feet; more vertices would bend with the projection."""
    return geo.map_coordinates(geo.box(*geo.BOX), projection.state_plane)


def _plane_area_sql() -> str:
    xy = [sql.plane(a, b) for a, b in (("xmin", "ymin"), ("xmax", "ymin"), ("xmax", "ymax"), ("xmin", "ymax"))]
    columns = ", ".join(f"{x} AS x{i}, {y} AS y{i}" for i, (x, y) in enumerate(xy))
    ring = "+".join(f"(x{i}-x0)*(y{(i + 1) % 4}-y0)-(x{(i + 1) % 4}-x0)*(y{i}-y0)" for i in range(4))
    return f"SELECT apn, xmin,ymin,xmax,ymax, abs({ring})/2 AS size FROM (SELECT *, {columns} FROM parcels_fx) c"


@register(
    "attach_points",
    f"""SELECT g.address, g.zip, p.apn, round(p.size,0) AS size FROM (SELECT * FROM geocoded_fx WHERE accuracy_type='rooftop' AND address<>'3 Main St') g
LEFT JOIN (SELECT * FROM ({_plane_area_sql()}) a WHERE size>100000) p ON g.long BETWEEN p.xmin AND p.xmax AND g.lat BETWEEN p.ymin AND p.ymax""",
)
def attach_points(spark, d):
    stored = fx.parcels(spark, d).select("apn", F.expr(_box_in_plane()).alias("geometry"))
    out = parcels.attach_points(
        stored, fx.geocoded(spark, d), projection.state_plane_inverse, excluded=("3 Main St",)
    )
    return out.select("address", "zip", "apn", F.round("size", 0).alias("size"))


@register(
    "merge_sources",
    """SELECT *, 'Orange' AS county, 'warehouse' AS class, 'warehouse' AS type, 1910e0 AS year_built FROM (
  SELECT DISTINCT sch_number AS apn, parcel_area AS shape_area, xmin,ymin,xmax,ymax FROM projects_fx
  UNION ALL SELECT apn, shape_area, xmin,ymin,xmax,ymax FROM parcels_fx b WHERE NOT EXISTS (SELECT 1 FROM projects_fx a
    WHERE a.xmin<=b.xmax AND a.xmax>=b.xmin AND a.ymin<=b.ymax AND a.ymax>=b.ymin)) m""",
)
def merge_sources(spark, d):
    first = fx.projects(spark, d).select(
        F.col("sch_number").alias("apn"), F.col("parcel_area").alias("shape_area"), "geometry"
    )
    second = fx.parcels(spark, d).select("apn", "shape_area", "geometry")
    return _bounds(parcels.merge_sources(first, second), "apn", "shape_area", "county", "class", "type", "year_built")


@register(
    "combine_parcels",
    "SELECT apn, class, type, year_chr, year_built, floor_sq_ft, county, shape_area2 FROM kept_fx WHERE floor_sq_ft>28000",
)
def combine_parcels(spark, d):
    return _combined(spark, d)[0].select(
        "apn", "class", "type", "year_chr", "year_built", "floor_sq_ft", "county", "shape_area2"
    )


@register(
    "small_sites",
    "SELECT apn, class, type, year_chr, year_built, floor_sq_ft, short_county AS county, shape_area2 FROM kept_fx WHERE floor_sq_ft<=28000",
)
def small_sites(spark, d):
    return _combined(spark, d)[1].select(
        "apn", "class", "type", "year_chr", "year_built", "floor_sq_ft", "county", "shape_area2"
    )


# -------------------------------------------------------------------- planned

@register("planned", "SELECT project, sch_number, county, category, parcel_area FROM planned_fx")
def planned_query(spark, d):
    return _planned(spark, d).select("project", "sch_number", "county", "category", "parcel_area")


@register("built_projects", "SELECT * FROM built_fx")
def built_projects(spark, d):
    return planned.built_projects(_kept(spark, d), _planned(spark, d), **_EXCEPTIONS)


@register(
    "polygon_only_pairs",
    "SELECT DISTINCT * FROM pairs_outline WHERE sch_number NOT IN (SELECT sch_number FROM pairs_centroid)",
)
def polygon_only_pairs(spark, d):
    return planned.polygon_only_pairs(_kept(spark, d), _planned(spark, d))


@register("planned_not_built", "SELECT project, sch_number, ceqa_url, category FROM not_built_fx")
def planned_not_built(spark, d):
    return planned.planned_not_built(_kept(spark, d), _planned(spark, d), **_EXCEPTIONS).select(
        "project", "sch_number", "ceqa_url", "category"
    )


@register("planned_finish", "SELECT name, category, shape_area, class, county, floor_sq_ft, year_built FROM finished_fx")
def planned_finish(spark, d):
    left = planned.planned_not_built(_kept(spark, d), _planned(spark, d), **_EXCEPTIONS)
    return planned.finish_planned(left).select(
        "name", "category", "shape_area", "class", "county", "floor_sq_ft", "year_built"
    )


@register("serving", "SELECT apn, shape_area, category, year_built, class, county, unknown, place_name, xmin,ymin,xmax,ymax FROM served_fx")
def serving(spark, d):
    return _bounds(
        serving_table(spark, d), "apn", "shape_area", "category", "year_built", "class", "county", "unknown", "place_name"
    )


@register("serving_impact", _impact_sql("served_fx", "year_built<=2030 AND (place_name IN ('NATION_7','Orange County') OR county IN ('NATION_7','Orange County'))"))
def serving_impact(spark, d):
    return impact.answer(serving_table(spark, d), impact.Params(places=("NATION_7", "Orange County")))


# --------------------------------------------------------------------- places

@register(
    "jurisdictions",
    """SELECT name, xmin,ymin,xmax,ymax FROM towns_fx t WHERE EXISTS (SELECT 1 FROM counties_fx c WHERE t.xmin<=c.xmax AND t.xmax>=c.xmin
  AND t.ymin<=c.ymax AND t.ymax>=c.ymin) UNION ALL SELECT name||' County', xmin,ymin,xmax,ymax FROM counties_fx""",
)
def jurisdictions(spark, d):
    return _bounds(places.build_jurisdictions(fx.towns(spark, d), _counties(spark)), "name")


@register("districts", _DISTRICTS_SQL)
def districts(spark, d):
    return _bounds(_districts(spark, d), "district_label")


_UNINCORPORATED_SQL = """SELECT *, CASE WHEN CAST(name AS INT)%2=0 THEN 'Unincorporated' ELSE 'City '||name END AS city, CASE CAST(name AS INT)%10
  WHEN 0 THEN 'Riverside' WHEN 2 THEN 'Imperial' WHEN 4 THEN 'Ventura' WHEN 6 THEN 'Orange' ELSE 'Los Angeles' END AS county FROM lower_fx"""


@register(
    "places_by_county",
    f"""SELECT name, lsad, false AS carved, xmin,ymin,xmax,ymax FROM (SELECT *, row_number() OVER (PARTITION BY xmin,ymin,xmax,ymax ORDER BY name) AS r
  FROM towns_fx t WHERE lsad='25' AND EXISTS (SELECT 1 FROM counties_fx c WHERE t.xmin<=c.xmax AND t.xmax>=c.xmin AND t.ymin<=c.ymax AND t.ymax>=c.ymin)) q WHERE r=1
UNION ALL SELECT 'March JPA', 'JPA', false, xmin,ymin,xmax,ymax FROM places_fx
UNION ALL SELECT city||' '||county, '26', county='Riverside', xmin,ymin,xmax,ymax FROM ({_UNINCORPORATED_SQL}) u
  WHERE city='Unincorporated' AND county NOT IN ('Imperial','Ventura')""",
)
def places_by_county(spark, d):
    return _bounds(_place_list(spark, d), "name", "lsad", "carved")


def _place_list(spark, d):
    return places.build_places(
        _counties(spark), fx.towns(spark, d), fx.unincorporated(spark, d), fx.places(spark, d)
    )


def _margin_sql(margin_m: str) -> str:
    """Points of the carved area by distance to the authority's box or L-shape edges, in feet."""
    px, py = sql.plane("p.x", "p.y")

    def corner(x: str, y: str, i: int) -> str:
        a, b = sql.plane(x, y)
        return f"{a} AS ax{i}, {b} AS ay{i}"

    shape = [("xmin", "ymin"), ("xmax", "ymin"), ("xmax", "if(l_shape,(ymin+ymax)/2,ymax)"),
             ("if(l_shape,(xmin+xmax)/2,xmax)", "if(l_shape,(ymin+ymax)/2,ymax)"),
             ("if(l_shape,(xmin+xmax)/2,xmax)", "ymax"), ("xmin", "ymax")]
    corners = ", ".join(corner(x, y, i) for i, (x, y) in enumerate(shape))

    def edge(i: int) -> str:
        j = (i + 1) % 6
        dx, dy = f"(q.ax{j}-q.ax{i})", f"(q.ay{j}-q.ay{i})"
        t = f"least(greatest(coalesce(((px-q.ax{i})*{dx}+(py-q.ay{i})*{dy})/nullif({dx}*{dx}+{dy}*{dy},0e0),0e0),0e0),1e0)"
        return f"pow(px-q.ax{i}-{dx}*{t},2)+pow(py-q.ay{i}-{dy}*{t},2)<=pow({margin_m}*3937e0/1200e0,2)"

    inside = sql.IN_PLACE.format(x="pt.x", y="pt.y", p="q")
    return f"""SELECT apn FROM (SELECT apn, x, y, {px} AS px, {py} AS py FROM (SELECT apn, (xmin+xmax)/2 AS x, (ymin+ymax)/2 AS y FROM parcels_fx) p) pt
WHERE EXISTS (SELECT 1 FROM ({_UNINCORPORATED_SQL}) u WHERE city='Unincorporated' AND county='Riverside' AND x BETWEEN u.xmin AND u.xmax AND y BETWEEN u.ymin AND u.ymax)
AND NOT EXISTS (SELECT 1 FROM (SELECT *, {corners} FROM places_fx) q WHERE ({inside}) OR {" OR ".join(edge(i) for i in range(6))})"""


@register("region_difference", _margin_sql("2500e0"))
def region_difference(spark, d):
    points = fx.parcels(spark, d).select("apn", F.expr(geo.centroid("geometry")).alias("geometry"))
    return places.members_of_carved(points, _place_list(spark, d), margin_m=2500.0).select("apn")


_PLACE_LAYER_SQL = """SELECT *, CASE id%100 WHEN 3 THEN 'Malibu' WHEN 53 THEN 'Newport Beach' ELSE name END AS label FROM towns_fx"""


@register(
    "places_by_centroid",
    f"""SELECT county_name, name, namelsad, aland, aland_unit FROM (
SELECT c.name AS county_name, t.label AS name, t.name||' city' AS namelsad, CAST(t.id*1000 AS DOUBLE) AS aland, 'm2' AS aland_unit
FROM ({_PLACE_LAYER_SQL}) t JOIN counties_fx c ON c.name<>'Orange' AND (t.xmin+t.xmax)/2>c.xmin AND (t.xmin+t.xmax)/2<c.xmax AND (t.ymin+t.ymax)/2>c.ymin AND (t.ymin+t.ymax)/2<c.ymax
UNION ALL SELECT c.name, t.label, t.name||' city', CAST(t.id*1000 AS DOUBLE), 'm2' FROM ({_PLACE_LAYER_SQL}) t JOIN counties_fx c
 ON t.label IN ('Malibu','Newport Beach') AND c.name='Los Angeles' AND t.xmin<=c.xmax AND t.xmax>=c.xmin AND t.ymin<=c.ymax AND t.ymax>=c.ymin
UNION ALL SELECT name, name||' County', name||' County', round({sql.box_area_m2('xmin', 'ymin', 'xmax', 'ymax')}*10.7639e0/1e6,3), 'sq_ft' FROM counties_fx WHERE name<>'Orange') z""",
)
def places_by_centroid(spark, d):
    out = places.build_places_centroid(fx.county_layer(spark, d), fx.place_layer(spark, d))
    area = F.when(F.col("aland_unit") == "sq_ft", F.round(F.col("aland") / 1e6, 3)).otherwise(F.col("aland"))
    return out.select("county_name", "name", "namelsad", area.alias("aland"), "aland_unit")


@register(
    "tract_layer",
    """SELECT tract, county, ciscorep, tot_pop19, 5-(CAST(ciscorep>=q[1] AS INT)+CAST(ciscorep>=q[2] AS INT)+CAST(ciscorep>=q[3] AS INT)+CAST(ciscorep>=q[4] AS INT)) AS quantile_class,
  'Tract '||tract||' ;  Score '||CAST(CAST(round_even(ciscorep,0) AS INT) AS VARCHAR)||' ; population  '||coalesce(CAST(tot_pop19 AS VARCHAR),'NA') AS label
FROM (SELECT * FROM tracts_fx WHERE county<>'Kern' AND ciscorep>=0) t,
 (SELECT quantile_cont(ciscorep,[0.2,0.4,0.6,0.8]) AS q FROM tracts_fx WHERE county<>'Kern' AND ciscorep>=0) e""",
)
def tract_layer(spark, d):
    return places.tract_layer(fx.tracts(spark, d))


@register(
    "quantile_edges",
    """SELECT l_returnflag, round(q[1],6) AS q0, round(q[2],6) AS q20, round(q[3],6) AS q50, round(q[4],6) AS q99, round(q[5],6) AS q100
FROM (SELECT l_returnflag, quantile_cont(l_extendedprice,[0.0,0.2,0.5,0.99,1.0]) AS q FROM lineitem GROUP BY 1) t""",
)
def quantile_edges(spark, d):
    out = rel.exact_quantiles(fx.table(spark, d, "lineitem"), ["l_returnflag"], "l_extendedprice", [0.0, 0.2, 0.5, 0.99, 1.0])
    names = ["q0", "q20", "q50", "q99", "q100"]
    return out.select("l_returnflag", *[F.round(F.col("quantiles")[i], 6).alias(n) for i, n in enumerate(names)])


_PARTS = (0.05, 0.25, 0.5, 0.75, 0.95, 0.99)


@register(
    "quantile_sketches",
    f"""SELECT l_returnflag, p, n, TRUE AS within_bound FROM (SELECT l_returnflag, count(*) AS n FROM lineitem GROUP BY 1) g,
  (SELECT unnest([{', '.join(f'{p}e0' for p in _PARTS)}]) AS p) q""",
)
def quantile_sketches(spark, d):
    """Sketches kept per flag and supplier share, merged per flag, against the exact ranks of what they answer."""
    rows = fx.table(spark, d, "lineitem").select("l_returnflag", F.pmod("l_suppkey", F.lit(20)).alias("share"), "l_extendedprice")
    kept = tables.materialise(rel.quantile_sketches(rows, ["l_returnflag", "share"], "l_extendedprice"))
    asked = rel.merged_quantiles(kept, ["l_returnflag"], _PARTS)
    wanted = F.arrays_zip("quantiles", F.array(*[F.lit(p) for p in _PARTS]).alias("p"))
    asked = asked.select(F.col("l_returnflag"), F.explode(wanted).alias("z")).select("l_returnflag", F.col("z.p").alias("p"), F.col("z.quantiles").alias("q"))
    ranks = rows.join(asked, "l_returnflag").groupBy("l_returnflag", "p").agg(
        F.count("*").alias("n"), F.sum((F.col("l_extendedprice") < F.col("q")).cast("long")).alias("less"),
        F.sum((F.col("l_extendedprice") <= F.col("q")).cast("long")).alias("most"),
    )
    off = F.greatest(F.col("less") / F.col("n") - F.col("p"), F.col("p") - F.col("most") / F.col("n"))
    return ranks.select("l_returnflag", F.col("p").cast("double").alias("p"), "n", (off <= 0.02).alias("within_bound"))


_BOX_DEGREES = "SELECT c_custkey, c_custkey%50-125 AS x0, (c_custkey*7)%120-60 AS y0 FROM customer"


@register(
    "sphere_measures",
    f"""SELECT c_custkey, round(6371.010e0*6371.010e0*2*abs(atan(tan(d)*sin(p2))-atan(tan(d)*sin(p1))),6) AS sq_km, round(x0+0.5e0,8) AS lon,
  round(degrees(atan2(2*sin(d)*cos(d)*(k1*cos(p1)*cos(p1)-k2*cos(p2)*cos(p2)),
    2*(p2-p1)*sin(d)+2*sin(d)*(k2*sin(p2)*cos(p2)-k1*sin(p1)*cos(p1)))),8) AS lat
FROM (SELECT *, 2*asin(cos(p1)*sin(d))/sin(2*asin(cos(p1)*sin(d))) AS k1, 2*asin(cos(p2)*sin(d))/sin(2*asin(cos(p2)*sin(d))) AS k2
 FROM (SELECT c_custkey, x0, radians(0.5e0) AS d, radians(y0::DOUBLE) AS p1, radians(y0+1e0) AS p2 FROM ({_BOX_DEGREES}) b) r) s""",
)
def sphere_measures(spark, d):
    """Area and centroid on the sphere of boxes of one degree."""
    boxes = fx.table(spark, d, "customer").selectExpr("c_custkey", "c_custkey % 50 - 125 AS x0", "(c_custkey * 7) % 120 - 60 AS y0")
    shapes = boxes.select("c_custkey", F.expr(geo.box("x0", "y0", "x0 + 1", "y0 + 1")).alias("g"))
    centre = shapes.select("c_custkey", F.expr(geo.area_spherical("g")).alias("area"), F.expr(geo.centroid_spherical("g")).alias("c"))
    return centre.select(
        "c_custkey", F.round(F.col("area") / 1e6, 6).alias("sq_km"), F.round("c.xmin", 8).alias("lon"), F.round("c.ymin", 8).alias("lat")
    )


@register("geojson_collections", "SELECT apn, class, shape_area, xmin,ymin,xmax,ymax FROM serving_fx")
def geojson_collections(spark, d):
    """Files that are each a whole collection, written over an older set, and read back."""
    path = _new_folder(spark)
    rows = fx.serving(spark, d).select("apn", "class", "shape_area", "geometry")
    geojson.write_collections(rows.limit(10), path)
    geojson.write_collections(rows, path)
    return _bounds(geojson.read_geojson(spark, path, "apn string, class string, shape_area double"), "apn", "class", "shape_area")


# -------------------------------------------------------------- spatial joins

_OVERLAP = "{a}.xmin<={b}.xmax AND {a}.xmax>={b}.xmin AND {a}.ymin<={b}.ymax AND {a}.ymax>={b}.ymin"


def _touches_place(a: str, p: str) -> str:
    return (
        f"{_OVERLAP.format(a=a, b=p)} AND NOT ({p}.l_shape AND {a}.xmin>({p}.xmin+{p}.xmax)/2 AND {a}.ymin>({p}.ymin+{p}.ymax)/2)"
    )


@register(
    "spatial_left",
    f"SELECT c.apn, p.name FROM (SELECT apn, (xmin+xmax)/2 AS x, (ymin+ymax)/2 AS y FROM parcels_fx) c LEFT JOIN places_fx p ON {sql.IN_PLACE.format(x='c.x', y='c.y', p='p')}",
)
def spatial_left(spark, d):
    points = fx.parcels(spark, d).select("apn", F.expr(geo.centroid("geometry")).alias("geometry"))
    return sp.spatial_join(points, fx.places(spark, d), cell=0.1, left_points=True).select("apn", "name")


@register(
    "spatial_poly_poly",
    f"SELECT a.apn, p.name FROM parcels_fx a JOIN places_fx p ON {_touches_place('a', 'p')}",
)
def spatial_poly_poly(spark, d):
    return sp.spatial_join(
        fx.parcels(spark, d).select("apn", "geometry"), fx.places(spark, d), "intersects", "inner", cell=0.1
    ).select("apn", "name")


_POLY_POLY = f"SELECT a.apn, p.name FROM parcels_fx a JOIN places_fx p ON {_touches_place('a', 'p')}"


@register("bucketed_join", _POLY_POLY)
def bucketed_join(spark, d):
    """Parcels stored by grid cell, dense cells in parts; the join reads their buckets."""
    path = _new_folder(spark)
    parcels = fx.parcels(spark, d).select("apn", "geometry")
    stored.save_bucketed(parcels, path, cell=0.1, buckets=16, crowd=2000)
    return stored.load_bucketed(spark, path).join(fx.places(spark, d), "intersects", "inner").select("apn", "name")


@register("crowded_join", _POLY_POLY)
def crowded_join(spark, d):
    """Coarse cells that hold many parcels each, split as they are counted."""
    parcels = fx.parcels(spark, d).select("apn", "geometry")
    return sp.spatial_join(parcels, fx.places(spark, d), "intersects", "inner", cell=0.4, crowd=1000).select("apn", "name")


@register(
    "spatial_overlay_pairs",
    f"SELECT a.apn, t.sch_number FROM parcels_fx a JOIN projects_fx t ON {_OVERLAP.format(a='a', b='t')}",
)
def spatial_overlay_pairs(spark, d):
    return sp.spatial_join(
        fx.parcels(spark, d).select("apn", "geometry"), fx.projects(spark, d).select("sch_number", "geometry"),
        "intersects", "inner", cell=0.01,
    ).select("apn", "sch_number")


_INSIDE_PLACE = (
    "a.xmin>=p.xmin AND a.xmax<=p.xmax AND a.ymin>=p.ymin AND a.ymax<=p.ymax AND NOT (p.l_shape AND a.xmax>(p.xmin+p.xmax)/2 AND a.ymax>(p.ymin+p.ymax)/2)"
)


@register("contains_join", f"SELECT p.name, a.apn FROM places_fx p LEFT JOIN parcels_fx a ON {_INSIDE_PLACE}")
def contains_join(spark, d):
    return sp.container_join(
        fx.places(spark, d), fx.parcels(spark, d).select("apn", "geometry"), "contains", "left", key="name", cell=0.1
    ).select("name", "apn")


@register(
    "contains_points",
    "SELECT c.name AS county, t.name FROM counties_fx c LEFT JOIN towns_fx t ON (t.xmin+t.xmax)/2>c.xmin AND (t.xmin+t.xmax)/2<c.xmax"
    " AND (t.ymin+t.ymax)/2>c.ymin AND (t.ymin+t.ymax)/2<c.ymax",
)
def contains_points(spark, d):
    centres = fx.towns(spark, d).select("name", F.expr(geo.centroid("geometry")).alias("geometry"))
    named = fx.counties(spark).withColumnRenamed("name", "county")
    return sp.container_join(named, centres, "contains", "left", key="county", cell=0.25, member_points=True).select("county", "name")


@register("spatial_semi", f"SELECT a.apn, a.class FROM parcels_fx a WHERE EXISTS (SELECT 1 FROM places_fx p WHERE {_touches_place('a', 'p')})")
def spatial_semi(spark, d):
    return sp.spatial_semi(fx.parcels(spark, d), fx.places(spark, d), cell=0.1).select("apn", "class")


@register("spatial_anti", f"SELECT a.apn, a.class FROM parcels_fx a WHERE NOT EXISTS (SELECT 1 FROM places_fx p WHERE {_touches_place('a', 'p')})")
def spatial_anti(spark, d):
    return sp.spatial_anti(fx.parcels(spark, d), fx.places(spark, d), cell=0.1).select("apn", "class")


def _corners_inside(cx: str, cy: str, r: str) -> str:
    return " AND ".join(
        f"pow({sql.merc_x(x)}-{cx},2)+pow({sql.merc_y(y)}-{cy},2)<=pow({r},2)"
        for x in ("a.xmin", "a.xmax") for y in ("a.ymin", "a.ymax")
    )


@register(
    "in_circle",
    f"SELECT apn, category, shape_area FROM serving_fx a WHERE year_built<=2030 AND {_corners_inside(sql.merc_x('-117.4321e0'), sql.merc_y('34.0321e0'), '20000e0')}",
)
def in_circle(spark, d):
    question = impact.Params(circle=(-117.4321, 34.0321), radius_km=20.0)
    return impact.filter_parcels(fx.serving(spark, d), question).select("apn", "category", "shape_area")


@register(
    "in_circles",
    f"""SELECT g.address, a.apn FROM (SELECT address, {sql.merc_x('long')} AS cx, {sql.merc_y('lat')} AS cy, (1+id%5)*1000e0 AS r, long, lat FROM geocoded_fx) g
JOIN serving_fx a ON a.xmin>=g.long-0.05e0 AND a.xmax<=g.long+0.05e0 AND a.ymin>=g.lat-0.05e0 AND a.ymax<=g.lat+0.05e0 AND {_corners_inside('g.cx', 'g.cy', 'g.r')}""",
)
def in_circles(spark, d):
    customers = fx.table(spark, d, "customer").selectExpr("concat(CAST(c_custkey AS STRING), ' Main St') AS address", "CAST(1 + c_custkey % 5 AS DOUBLE) AS radius_km")
    circles = fx.geocoded(spark, d).join(customers, "address").selectExpr("address", "long AS lon", "lat", "radius_km")
    return sp.in_circles(fx.serving(spark, d).select("apn", "geometry"), circles, cell=0.02).select("address", "apn")


# ------------------------------------------------------------ relational steps

_LEFT_SQL = "SELECT id, class, CASE WHEN id%3=0 THEN county END AS county FROM parcels_fx"
_RIGHT_SQL = """SELECT DISTINCT CASE WHEN c_custkey%4=0 THEN NULL WHEN c_custkey%4=1 THEN 'flex' ELSE 'warehouse' END AS class,
  CASE WHEN c_nationkey%3=0 THEN 'Orange' WHEN c_nationkey%3=1 THEN 'Riverside' END AS county, c_nationkey AS code FROM customer"""


def _left(spark, d):
    return fx.parcels(spark, d).selectExpr("id", "class", "CASE WHEN id % 3 = 0 THEN county END AS county")


def _right(spark, d):
    return fx.table(spark, d, "customer").selectExpr(
        "CASE WHEN c_custkey % 4 = 0 THEN NULL WHEN c_custkey % 4 = 1 THEN 'flex' ELSE 'warehouse' END AS class",
        "CASE WHEN c_nationkey % 3 = 0 THEN 'Orange' WHEN c_nationkey % 3 = 1 THEN 'Riverside' END AS county",
        "c_nationkey AS code",
    ).distinct()


@register(
    "natural_left",
    f"SELECT l.id, l.class, l.county, r.code FROM ({_LEFT_SQL}) l LEFT JOIN ({_RIGHT_SQL}) r ON l.class IS NOT DISTINCT FROM r.class AND l.county IS NOT DISTINCT FROM r.county",
)
def natural_left(spark, d):
    return rel.natural_join(_left(spark, d), _right(spark, d), "left")


@register(
    "natural_anti",
    f"SELECT l.id, l.class, l.county FROM ({_LEFT_SQL}) l WHERE NOT EXISTS (SELECT 1 FROM ({_RIGHT_SQL}) r WHERE l.class IS NOT DISTINCT FROM r.class AND l.county IS NOT DISTINCT FROM r.county)",
)
def natural_anti(spark, d):
    return rel.natural_join(_left(spark, d), _right(spark, d), "left_anti")


@register("not_in_keeps_null", "SELECT id, class FROM parcels_fx WHERE class IS NULL OR class NOT IN (SELECT CASE WHEN p_size%2=0 THEN 'flex' ELSE 'warehouse' END FROM part)")
def not_in_keeps_null(spark, d):
    listed = fx.table(spark, d, "part").selectExpr("CASE WHEN p_size % 2 = 0 THEN 'flex' ELSE 'warehouse' END AS class")
    return rel.not_in(fx.parcels(spark, d).select("id", "class"), "class", listed)


@register("bind_rows", "SELECT apn, class, NULL::VARCHAR AS project FROM parcels_fx UNION ALL SELECT NULL, NULL, project FROM projects_fx")
def bind_rows(spark, d):
    return rel.bind_rows(fx.parcels(spark, d).select("apn", "class"), fx.projects(spark, d).select("project"))


# -------------------------------------------------------------------- geometry

@register(
    "area",
    f"SELECT apn, round({sql.box_area_m2('xmin', 'ymin', 'xmax', 'ymax')},0) AS geodesic_m2, round((xmax-xmin)*(ymax-ymin)*1e9,4) AS planar_e9 FROM parcels_fx",
)
def area(spark, d):
    return fx.parcels(spark, d).select(
        "apn",
        F.round(F.expr(geo.area_geodesic("geometry")), 0).alias("geodesic_m2"),
        F.round(F.expr(geo.area_planar("geometry")) * 1e9, 4).alias("planar_e9"),
    )


@register("area_state_plane", f"SELECT apn, round(size,0) AS sq_ft FROM ({_plane_area_sql()}) q")
def area_state_plane(spark, d):
    return fx.parcels(spark, d).select("apn", F.round(F.expr(geo.area_planar(_box_in_plane())), 0).alias("sq_ft"))


@register(
    "centroid",
    """SELECT name, round(CASE WHEN l_shape THEN (xmin+xmax)/2-(xmax-xmin)/12 ELSE (xmin+xmax)/2 END,9) AS x,
  round(CASE WHEN l_shape THEN (ymin+ymax)/2-(ymax-ymin)/12 ELSE (ymin+ymax)/2 END,9) AS y FROM places_fx
UNION ALL SELECT apn, round((xmin+xmax)/2,9), round((ymin+ymax)/2,9) FROM parcels_fx""",
)
def centroid(spark, d):
    every = rel.bind_rows(fx.places(spark, d), fx.parcels(spark, d).select(F.col("apn").alias("name"), "geometry"))
    centres = every.select("name", F.expr(geo.centroid("geometry")).alias("c"))
    return centres.select("name", F.round("c.xmin", 9).alias("x"), F.round("c.ymin", 9).alias("y"))


def _corner_points_sql(transform) -> str:
    corners = [("xmin", "ymin"), ("xmax", "ymax")]
    parts = []
    for i, (a, b) in enumerate(corners):
        x, y = transform(a, b)
        parts.append(f"SELECT apn, {i} AS corner, round({x},3) AS x, round({y},3) AS y FROM parcels_fx")
    return " UNION ALL ".join(parts)


def _corner_points(df: DataFrame, mapping) -> DataFrame:
    def corner(i: int, x: str, y: str) -> str:
        mx, my = mapping(x, y)
        return f"named_struct('corner', {i}, 'x', round({mx}, 3), 'y', round({my}, 3))"

    return df.select("apn", F.expr(f"inline(array({corner(0, 'xmin', 'ymin')}, {corner(1, 'xmax', 'ymax')}))"))


@register("project_mercator", _corner_points_sql(lambda a, b: (sql.merc_x(a), sql.merc_y(b))))
def project_mercator(spark, d):
    return _corner_points(fx.parcels(spark, d), projection.mercator)


@register("project_state_plane", _corner_points_sql(sql.plane))
def project_state_plane(spark, d):
    return _corner_points(fx.parcels(spark, d), projection.state_plane)


@register("unproject", "SELECT apn, round(xmin,7) AS x, round(ymin,7) AS y, round(xmax,7) AS x2, round(ymax,7) AS y2 FROM parcels_fx")
def unproject(spark, d):
    x, y = projection.state_plane_inverse(*projection.state_plane("xmin", "ymin"))
    x2, y2 = projection.mercator_inverse(*projection.mercator("xmax", "ymax"))
    named = {"x": x, "y": y, "x2": x2, "y2": y2}
    return fx.parcels(spark, d).selectExpr("apn", *[f"round({v}, 7) AS {n}" for n, v in named.items()])


@register("geometry_validity", "SELECT apn, id%7<>0 AND id%5<>0 AS valid FROM parcels_fx")
def geometry_validity(spark, d):
    """Every seventh ring is left open and every fifth is flat."""
    flat = geo.box("xmin", "ymin", "xmax", "ymin")
    opened = geo.ring_polygon(f"slice({geo.vertices('geometry')}, 1, 4)")
    shape = f"CASE WHEN id % 7 = 0 THEN {opened} WHEN id % 5 = 0 THEN {flat} ELSE geometry END"
    return fx.parcels(spark, d).selectExpr("apn", f"{geo.is_valid(shape)} AS valid")


@register(
    "explode_parts",
    """SELECT a.apn, a.xmin,a.ymin,a.xmax,a.ymax FROM parcels_fx a
UNION ALL SELECT apn, xmin+5e-1,ymin,xmax+5e-1,ymax FROM parcels_fx WHERE id%2=0""",
)
def explode_parts(spark, d):
    """Even parcels get a second part half a degree to the east."""
    shifted = geo.map_coordinates("geometry", lambda x, y: (f"{x} + 0.5D", y))
    two = geo.polygon(f"concat(geometry.rings, {shifted}.rings)")
    multi = fx.parcels(spark, d).withColumn("geometry", F.expr(f"CASE WHEN id % 2 = 0 THEN {two} ELSE geometry END"))
    return _bounds(sp.explode_parts(multi.select("apn", "geometry")), "apn")


_RING_SQL = """SELECT apn, pos, CASE id%2 WHEN 0 THEN CASE WHEN pos IN (2,3) THEN xmax ELSE xmin END
   ELSE CASE pos WHEN 1 THEN xmax WHEN 2 THEN xmax WHEN 3 THEN (xmin+xmax)/2 WHEN 6 THEN xmax ELSE xmin END END AS x,
  CASE id%2 WHEN 0 THEN CASE WHEN pos IN (3,4) THEN ymax ELSE ymin END
   ELSE CASE pos WHEN 2 THEN ymin WHEN 3 THEN ymin WHEN 4 THEN ymin ELSE ymax END END AS y
FROM parcels_fx, (VALUES (1),(2),(3),(4),(5),(6)) v(pos) WHERE pos<=5 OR id%2=1"""


@register(
    "vertex_patch",
    f"""SELECT apn, pos, CASE WHEN pos BETWEEN 4 AND 6 THEN -117e0 ELSE x END AS x,
  CASE WHEN pos BETWEEN 2 AND 4 THEN 34.5e0 WHEN pos BETWEEN 4 AND 5 THEN 34.25e0 ELSE y END AS y FROM ({_RING_SQL}) r""",
)
def vertex_patch(spark, d):
    overrides = [("y", 4, 5, 34.25), ("x", 4, 6, -117.0), ("y", 2, 4, 34.5)]
    patched = sp.patch_vertices(fx.parcels(spark, d).select("apn", "geometry"), overrides)
    return sp.vertices_table(patched, ["apn"])


@register("ring_from_points", "SELECT apn, round((xmax-xmin)*(ymax-ymin)*1e9,4) AS planar_e9, xmin,ymin,xmax,ymax FROM parcels_fx")
def ring_from_points(spark, d):
    points = sp.vertices_table(fx.parcels(spark, d), ["apn"])
    rings = sp.ring_from_points(points, ["apn"], "pos", "x", "y")
    return _bounds(
        rings.withColumn("planar_e9", F.round(F.expr(geo.area_planar("geometry")) * 1e9, 4)), "apn", "planar_e9"
    )


# --------------------------------------------------------------------- sources

@register("geojson_round_trip", "SELECT apn, class, year_built, shape_area, xmin,ymin,xmax,ymax FROM serving_fx")
def geojson_round_trip(spark, d):
    """Feature lines as the sink writes them, parsed as the source reads them."""
    lines = geojson.feature_lines(fx.serving(spark, d).select("apn", "class", "year_built", "shape_area", "geometry"))
    back = geojson.parse_features(lines, "apn string, class string, year_built double, shape_area double")
    return _bounds(back, "apn", "class", "year_built", "shape_area")


def _new_folder(spark) -> str:
    return f"{tables.scratch_folder(spark).rstrip('/')}/check-{uuid.uuid4().hex}"


#: Rows in one written file of the source queries, so that files grow in number with the table.
_FILE_ROWS = 2000
_LAYOUTS = (
    # the head, what is between features, the tail; a feature's own text as SQL
    ('{\n"type": "FeatureCollection", "name": "a ] } b",\n"features": [\n', ",\n", "\n]\n}", "value"),
    ('{"type":"FeatureCollection","features":[', ",\n", "]}", "value"),
    ('{"type":"FeatureCollection","features":[', ", ", '], "bbox": [1, 2]}', "value"),
    ('{ "type" : "FeatureCollection" , "features" : [\n', ",\n", "\n] }", """replace(replace(value, '"type":"Feature",', '\n"type": "Feature",\n'), '"properties":', '\n"properties":\n')"""),
    ("", "\n", "", "value"),
)


def _write_groups(lines: DataFrame, path: str) -> None:
    """One text file for each row of (file, value)."""
    lines.repartition("file").write.partitionBy("file").text(path)


@register("geojson_files", "SELECT apn, class, year_built, shape_area, xmin,ymin,xmax,ymax FROM serving_fx")
def geojson_files(spark, d):
    """Files in five layouts, among them features that share lines with each other, with the
    collection's head and tail, and features spread over lines."""
    rows = fx.serving(spark, d).select("apn", "class", "year_built", "shape_area", "geometry")
    file = F.expr(f"CAST(CAST(regexp_replace(apn, '[^0-9]', '') AS BIGINT) / {_FILE_ROWS} AS BIGINT)")
    lines = geojson.feature_lines(rows.withColumn("file", file))
    keyed = lines.withColumn("file", F.get_json_object("value", "$.properties.file").cast("long"))
    kind = F.pmod("file", F.lit(len(_LAYOUTS)))
    text = F.lit(None).cast("string")
    for k, (head, between, tail, own) in enumerate(_LAYOUTS):
        joined = F.array_join(F.collect_list(F.expr(own)), between)
        text = F.when(F.first(kind) == k, F.concat(F.lit(head), joined, F.lit(tail))).otherwise(text)
    path = _new_folder(spark)
    _write_groups(keyed.groupBy("file").agg(text.alias("value")), path)
    schema = "apn string, class string, year_built double, shape_area double"
    return _bounds(geojson.read_geojson(spark, path, schema, "auto"), "apn", "class", "year_built", "shape_area")


@register("export_selection", "SELECT apn, class, shape_area, xmin,ymin,xmax,ymax FROM serving_fx WHERE year_built<=2000")
def export_selection(spark, d):
    path = _new_folder(spark)
    rows = fx.serving(spark, d).where("year_built <= 2000").select("apn", "class", "shape_area", "geometry")
    impact.export_selection(rows, path)
    return _bounds(geojson.read_geojson(spark, path, "apn string, class string, shape_area double"), "apn", "class", "shape_area")


_TOWNS_SQL = "SELECT name, xmin,ymin,xmax,ymax, round((xmax-xmin)*(ymax-ymin),9) AS planar FROM towns_fx"


def _planar(shapes: DataFrame) -> DataFrame:
    return _bounds(shapes.withColumn("planar", F.round(F.expr(geo.area_planar("geometry")), 9)), "name", "planar")


@register("wkt_layer", _TOWNS_SQL)
def wkt_layer(spark, d):
    pairs = geo.each(geo.vertices("geometry"), lambda v: f"concat_ws(' ', CAST({v}.x AS STRING), CAST({v}.y AS STRING))")
    layer = fx.towns(spark, d).selectExpr("name", f"concat('POLYGON ((', array_join({pairs}, ', '), '))') AS wkt")
    path = _new_folder(spark)
    layer.write.parquet(path)
    return _planar(tables.read_layer(spark, path))


@register("geojson_layer", _TOWNS_SQL)
def geojson_layer(spark, d):
    layer = fx.towns(spark, d).select("name", geojson.geometry_to_json(F.col("geometry")).alias("shape"))
    path = _new_folder(spark)
    layer.write.parquet(path)
    return _planar(tables.read_layer(spark, path, "shape", "geojson"))


@register("wkb_layer", _TOWNS_SQL)
def wkb_layer(spark, d):
    """Binary shapes in both byte orders, with and without heights, as polygons and as multipolygons."""
    path = _new_folder(spark)
    fx.as_wkb(fx.towns(spark, d).select("name", "geometry"), "shape").write.parquet(path)
    return _planar(tables.read_layer(spark, path, "shape", "wkb"))


@register("geojson_spread", "SELECT apn, class, year_built, shape_area, xmin,ymin,xmax,ymax FROM serving_fx")
def geojson_spread(spark, d):
    """Collections whose features spread over lines, with braces and quotes in their texts, cut by blocks."""
    rows = fx.serving(spark, d).select("apn", "class", "year_built", "shape_area", "geometry", F.lit('a } "b" ] {').alias("note"))
    file = F.expr(f"CAST(CAST(regexp_replace(apn, '[^0-9]', '') AS BIGINT) / {_FILE_ROWS} AS BIGINT)")
    lines = geojson.feature_lines(rows.withColumn("file", file))
    spread = F.regexp_replace(F.regexp_replace("value", ',"properties"', ',\n "properties"'), '"type":"Feature"', '"type":\n  "Feature"')
    keyed = lines.select(F.get_json_object("value", "$.properties.file").cast("long").alias("file"), spread.alias("value"))
    head, tail = '{"type": "FeatureCollection",\n"crs": {"properties": {"name": "x"}},\n"features": [\n', "\n],\n\"links\": [{}]\n}\n"
    text = F.concat(F.lit(head), F.array_join(F.collect_list("value"), ",\n"), F.lit(tail))
    path = _new_folder(spark)
    _write_groups(keyed.groupBy("file").agg(text.alias("value")), path)
    read = geojson.read_geojson(spark, path, "apn string, class string, year_built double, shape_area double", "auto")
    return _bounds(read, "apn", "class", "year_built", "shape_area")


@register("csv_files", "SELECT fuel, trips, total_vmt, n_ox_totex FROM emis_fx")
def csv_files(spark, d):
    """Several inventory files, each with a preamble of its own that holds lines equal to data rows."""
    rows = fx.emissions(spark, d).select("fuel", "trips", "total_vmt", "n_ox_totex")
    lines = rows.select(F.to_csv(F.struct("*")).alias("value"))
    keyed = lines.withColumn("file", F.pmod(F.xxhash64("value"), F.lit(8)))
    head = F.concat(F.lit("Model: "), F.col("file").cast("string"), F.lit("\n"), F.first("value"), F.lit("\n"), F.max("value"))
    header = '\nFuel,Trips,"Total VMT",NOx_TOTEX\n'
    text = F.concat(head, F.lit(header), F.array_join(F.collect_list("value"), "\n"))
    path = _new_folder(spark)
    _write_groups(keyed.groupBy("file").agg(text.alias("value")), path)
    return tables.read_csv_skip(spark, path, 3, {"fuel": "string"})


@register("csv_sink", "SELECT apn, class, county FROM serving_fx")
def csv_sink(spark, d):
    path = f"{_new_folder(spark)}.csv"
    tables.write_csv(fx.serving(spark, d).select("apn", "class", "county"), path)
    return tables.read_table(spark, path)


@register("parcels_by_county", "SELECT apn, shape_area, county FROM serving_fx WHERE county='Orange County'")
def parcels_by_county(spark, d):
    path = _new_folder(spark)
    tables.write_parcels(fx.serving(spark, d), path)
    return spark.read.parquet(path).where("county = 'Orange County'").select("apn", "shape_area", "county")


@register("serving_snapshot", "SELECT apn, xmin,ymin,xmax,ymax FROM serving_fx WHERE xmin>=-118 AND xmax<=-117 AND ymax<=34.5")
def serving_snapshot(spark, d):
    path = _new_folder(spark)
    tables.save_serving({"parcels": fx.serving(spark, d)}, path)
    stored = tables.load_serving(spark, path, ["parcels"])["parcels"]
    boxed = stored.where("geometry.xmin >= -118 AND geometry.xmax <= -117 AND geometry.ymax <= 34.5")
    return _bounds(boxed, "apn")


@register("row_ids", "SELECT l_orderkey, l_linenumber, row_number() OVER (ORDER BY l_orderkey, l_linenumber) AS row_id FROM lineitem")
def row_ids(spark, d):
    return rel.row_ids(fx.table(spark, d, "lineitem").select("l_orderkey", "l_linenumber"), ["l_orderkey", "l_linenumber"])


@register(
    "parse_dates",
    """SELECT o_orderkey, CASE WHEN o_orderkey%11=0 THEN NULL ELSE CAST(o_orderdate AS DATE) END AS received,
  CASE WHEN o_orderkey%11=0 THEN NULL ELSE CAST(year(CAST(o_orderdate AS DATE)) AS DOUBLE) END AS year_built FROM orders""",
)
def parse_dates(spark, d):
    """Month/day/year text without leading zeros, and some text that is no date."""
    text = "CASE WHEN o_orderkey % 11 = 0 THEN '13/45/x' ELSE date_format(o_orderdate, ' M/d/yyyy ') END"
    dates = fx.table(spark, d, "orders").select("o_orderkey", parse_date(F.expr(text)).alias("received"))
    return dates.withColumn("year_built", year_of(F.col("received")))


@register(
    "quarantine",
    """SELECT apn, CASE WHEN id%11=0 THEN 'missing' WHEN id%7=0 THEN 'open ring' WHEN id%5=0 THEN 'no area' END AS reason FROM parcels_fx""",
)
def quarantine(spark, d):
    """Good rows and, with the reason, the others: shapes missing, left open and flat."""
    flat = geo.box("xmin", "ymin", "xmax", "ymin")
    opened = geo.ring_polygon(f"slice({geo.vertices('geometry')}, 1, 4)")
    shape = f"CASE WHEN id % 11 = 0 THEN NULL WHEN id % 7 = 0 THEN {opened} WHEN id % 5 = 0 THEN {flat} ELSE geometry END"
    good, bad = sp.split_valid(fx.parcels(spark, d).select("apn", F.expr(shape).alias("geometry")))
    return good.select("apn", F.lit(None).cast("string").alias("reason")).unionByName(bad.select("apn", "reason"))


@register(
    "invalid_rings",
    """SELECT apn, id%2 AS table_no, CASE WHEN id%9=0 THEN 'crossing rings' WHEN id%7=0 THEN 'hole outside its shell'
  WHEN id%5=0 THEN 'overlapping parts' END AS reason FROM parcels_fx""",
)
def invalid_rings(spark, d):
    """Two tables of parcels with rings that cross, holes beside their shell and parts in parts, split before the job."""
    def ring(*at: tuple[float, float]) -> str:
        corners = [geo.vertex(f"xmin + {x} * (xmax - xmin)", f"ymin + {y} * (ymax - ymin)") for x, y in (*at, at[0])]
        return f"array({', '.join(corners)})"

    whole, bow = ring((0, 0), (1, 0), (1, 1), (0, 1)), ring((0, 0), (1, 1), (1, 0), (0, 0.75))
    beside, inner = ring((2, 0), (3, 0), (3, 1), (2, 1)), ring((0.25, 0.25), (0.75, 0.25), (0.75, 0.75), (0.25, 0.75))
    shape = (
        f"CASE WHEN id % 9 = 0 THEN {geo.ring_polygon(bow)} WHEN id % 7 = 0 THEN {geo.polygon(f'array(array({whole}, {beside}))')}"
        f" WHEN id % 5 = 0 THEN {geo.polygon(f'array(array({whole}), array({inner}))')} ELSE geometry END"
    )
    every = fx.parcels(spark, d).select("apn", "id", F.expr(shape).alias("geometry"))
    good, refused = parcels.refuse_invalid([every.where(f"id % 2 = {k}") for k in (0, 1)])
    kept = [t.select("apn", F.lit(k).alias("table_no"), F.lit(None).cast("string").alias("reason")) for k, t in enumerate(good)]
    return rel.bind_rows(*kept, refused.select("apn", "table_no", "reason"))


@register(
    "point_discs",
    "SELECT company, 121 AS n_vertices, round(cos(pi()/120),3) AS narrowest FROM (SELECT c_name AS company, 500e0 AS radius FROM customer) q",
)
def point_discs(spark, d):
    """Circles around notices as drawn polygons: closed, and flat edges at cos(pi / edges) of the radius."""
    shapes = fx.geocoded(spark, d).select("company", "long", "lat", F.expr(geo.disc("`long`", "lat", "500D")).alias("g"))
    x0, y0 = projection.mercator("`long`", "lat")
    mid = geo.each(
        geo.edges("g"),
        lambda e: "sqrt(pow(({0}) - ({2}), 2) + pow(({1}) - ({3}), 2))".format(
            *[f"({projection.mercator(f'{e}.ax', f'{e}.ay')[k]} + {projection.mercator(f'{e}.bx', f'{e}.by')[k]}) / 2" for k in (0, 1)], x0, y0
        ),
    )
    return shapes.select(
        "company", F.size(F.expr(geo.vertices("g"))).alias("n_vertices"), F.round(F.array_min(F.expr(mid)) / 500, 3).alias("narrowest")
    )


@register(
    "page_lines",
    """SELECT c_custkey AS page, unnest([1,2,3]) AS line_no, unnest([c_name, '', c_mktsegment]) AS line FROM customer""",
)
def page_lines(spark, d):
    pages = fx.table(spark, d, "customer").selectExpr("c_custkey AS page", "concat(c_name, '\n\n', c_mktsegment) AS text")
    return addresses.page_lines(pages)


@register(
    "external_without_year",
    """SELECT substring(k,1,4)||'-'||substring(k,5,3)||'-'||substring(k,8,2)||'-0000' AS apn_formatted, y AS year_built FROM (
  SELECT lpad(CAST(l_orderkey AS VARCHAR),9,'0') AS k, CASE WHEN l_linenumber%3=0 THEN NULL WHEN l_linenumber%3=1 THEN 0
    ELSE CAST(1840+l_suppkey%180 AS INT) END AS y FROM lineitem) q WHERE y IS NULL OR y=0""",
)
def external_without_year(spark, d):
    return parcels.without_year(fx.external_years(spark, d))


@register("count_rows", "SELECT count(*) AS n FROM serving_fx")
def count_rows(spark, d):
    return fx.serving(spark, d).agg(F.count(F.lit(1)).alias("n"))


@register(
    "place_choices",
    "SELECT place_name FROM (SELECT DISTINCT coalesce(place_name,'unincorporated') AS place_name FROM serving_fx) q ORDER BY place_name='unincorporated', place_name",
)
def place_choices(spark, d):
    named = fx.serving(spark, d).withColumn("place_name", F.coalesce("place_name", F.lit("unincorporated")))
    return impact.place_choices(named)


@register("clean_names", "SELECT o_orderkey, o_orderstatus, o_totalprice AS n_ox_totex FROM orders")
def clean_names_query(spark, d):
    raw = fx.table(spark, d, "orders").selectExpr("o_orderkey AS `O OrderKey`", "o_orderstatus AS `O_OrderStatus`", "o_totalprice AS `NOx_TOTEX`")
    return clean_names(raw).withColumnsRenamed({"o_order_key": "o_orderkey", "o_order_status": "o_orderstatus"})


@register(
    "half_even",
    "SELECT l_orderkey, l_linenumber, l_partkey, round_even(l_quantity*50e0,-2) AS hundreds, round_even(l_quantity*500e0,-3) AS thousands, round_even(l_extendedprice,0) AS whole FROM lineitem",
)
def half_even_query(spark, d):
    q = F.col("l_quantity")
    return fx.table(spark, d, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey",
        half_even(q * 50.0, -2).alias("hundreds"), half_even(q * 500.0, -3).alias("thousands"),
        half_even(F.col("l_extendedprice"), 0).alias("whole"),
    )
