"""The stand-in inputs once more, as DuckDB SQL over bounds only."""

from __future__ import annotations

import math

# -------------------------------------------------- projections as SQL text
_A = 6378137.0


def n(x: float) -> str:
    """A double literal: without an exponent DuckDB would read a decimal."""
    return repr(x) if "e" in repr(x) else f"{x!r}e0"


def _e(inverse_flattening: float) -> float:
    f = 1 / inverse_flattening
    return math.sqrt(f * (2 - f))


def area_y(lat: str) -> str:
    e = _e(298.257223563)
    s = f"sin(radians({lat}))"
    return (
        f"({n(_A * _A / 2)}*{n(1 - e * e)}*({s}/(1e0-{n(e * e)}*{s}*{s})"
        f"-ln((1e0-{n(e)}*{s})/(1e0+{n(e)}*{s}))/{n(2 * e)}))"
    )


def box_area_m2(x0: str, y0: str, x1: str, y1: str) -> str:
    return f"(radians({x1}-({x0}))*({area_y(y1)}-{area_y(y0)}))"


def merc_x(lon: str) -> str:
    return f"({n(_A)}*radians({lon}))"


def merc_y(lat: str) -> str:
    return f"({n(_A)}*ln(tan(pi()/4+radians({lat})/2)))"


def _cone():
    e = _e(298.257222101)
    rad = math.radians
    p1, p2, p0 = rad(33 + 53 / 60), rad(32 + 47 / 60), rad(32 + 10 / 60)

    def m(p):
        return math.cos(p) / math.sqrt(1 - e * e * math.sin(p) ** 2)

    def t(p):
        return math.tan(math.pi / 4 - p / 2) / ((1 - e * math.sin(p)) / (1 + e * math.sin(p))) ** (e / 2)

    cone = math.log(m(p1) / m(p2)) / math.log(t(p1) / t(p2))
    f = m(p1) / (cone * t(p1) ** cone)
    return e, cone, _A * f, _A * f * t(p0) ** cone


def plane(lon: str, lat: str) -> tuple[str, str]:
    """State-plane zone 6 easting and northing in US survey feet."""
    e, cone, af, r0 = _cone()
    t = (
        f"(tan(pi()/4-radians({lat})/2)/pow((1e0-{n(e)}*sin(radians({lat})))/(1e0+{n(e)}*sin(radians({lat}))),{n(e / 2)}))"
    )
    rho = f"({n(af)}*pow({t},{n(cone)}))"
    th = f"({n(cone)}*radians(({lon})+116.25e0))"
    k = 3937 / 1200
    return (
        f"({n(k)}*(2000000e0+{rho}*sin({th})))",
        f"({n(k)}*(500000e0+{n(r0)}-{rho}*cos({th})))",
    )


# ------------------------------------------------------------------- tables
_PLACE = """ -119e0+(({k}*7919)%100000)/1e5*4e0 AS lon, 33.4e0+(({k}*104729)%100000)/1e5*1.6e0 AS lat"""

TABLES: dict[str, str] = {}

TABLES["parcels_fx"] = f"""
SELECT o_orderkey AS id, lpad(CAST(o_orderkey AS VARCHAR),9,'0') AS apn, CAST(side*side AS DOUBLE) AS shape_area,
  CASE o_orderpriority WHEN '1-URGENT' THEN 'warehouse' WHEN '2-HIGH' THEN 'light industrial' WHEN '3-MEDIUM' THEN 'flex'
    WHEN '4-NOT SPECIFIED' THEN 'mini-storage warehouse' END AS class,
  CASE WHEN o_orderkey%97=0 THEN NULL WHEN o_orderkey%89=0 THEN 1776 ELSE CAST(1900+(o_orderkey*31)%128 AS INT) END AS year_built,
  CASE (CASE WHEN o_orderkey%40=0 THEN c_nationkey%4 ELSE CAST(floor(kx/25000e0) AS INT) END)
    WHEN 0 THEN 'Los Angeles' WHEN 1 THEN 'Orange' WHEN 2 THEN 'Riverside' ELSE 'San Bernardino' END AS county,
  lon-side/604000e0 AS xmin, lat-side/728000e0 AS ymin, lon+side/604000e0 AS xmax, lat+side/728000e0 AS ymax
FROM (SELECT *, (gk*7919)%100000 AS kx, {_PLACE.format(k='gk')}, 100+gk%900 AS side
      FROM (SELECT *, CASE WHEN o_orderkey%50=1 THEN o_orderkey-1 ELSE o_orderkey END AS gk FROM orders) g
      JOIN customer ON o_custkey=c_custkey) p"""

TABLES["typed_fx"] = """
SELECT *, CASE WHEN class LIKE '%warehouse%' THEN 'warehouse' WHEN class IS NOT NULL THEN 'other' END AS type FROM parcels_fx"""

TABLES["serving_fx"] = """
SELECT id, apn, shape_area,
  CASE WHEN class IN ('warehouse','light industrial') THEN 'Existing' WHEN class IS NULL THEN 'Approved' ELSE 'CEQA Review' END AS category,
  CAST(CASE WHEN year_built<=1980 THEN 1980 ELSE year_built END AS DOUBLE) AS year_built, class,
  county || ' County' AS county, coalesce(year_built<=1910, true) AS unknown,
  CASE WHEN id%11=0 THEN NULL ELSE 'PLACE_' || CAST(id%7 AS VARCHAR) END AS place_name, xmin, ymin, xmax, ymax
FROM parcels_fx"""

TABLES["counties_fx"] = """
SELECT name, -118.9999929e0+i AS xmin, 33.3000017e0 AS ymin, -117.9999929e0+i AS xmax, 35.1000017e0 AS ymax
FROM (VALUES ('Los Angeles',0),('Orange',1),('Riverside',2),('San Bernardino',3)) v(name,i)"""

TABLES["places_fx"] = """
SELECT n_name AS name, n_nationkey%2=0 AS l_shape,
  -118.9999929e0+(n_nationkey%5)*0.8e0 AS xmin, 33.4000031e0+floor(n_nationkey/5e0)*0.32e0 AS ymin,
  -118.9999929e0+(n_nationkey%5)*0.8e0+CASE WHEN n_nationkey=7 THEN 0.85e0 ELSE 0.7e0 END AS xmax,
  33.4000031e0+floor(n_nationkey/5e0)*0.32e0+0.28e0 AS ymax FROM nation"""

TABLES["towns_fx"] = """
SELECT id, name, CASE WHEN id%10=1 THEN '25' ELSE lsad END AS lsad, gk,
  -120.2000011e0+((gk*6007)%10000)/1e4*6e0 AS xmin, 32.9000013e0+((gk*3001)%10000)/1e4*2.4e0 AS ymin,
  -120.2000011e0+((gk*6007)%10000)/1e4*6e0+0.03e0+(gk%7)*0.01e0 AS xmax,
  32.9000013e0+((gk*3001)%10000)/1e4*2.4e0+0.02e0+(gk%5)*0.01e0 AS ymax
FROM (SELECT c_custkey AS id, c_name AS name, CASE WHEN c_custkey%10=1 THEN c_custkey-1 ELSE c_custkey END AS gk,
        CASE c_custkey%3 WHEN 0 THEN '25' WHEN 1 THEN 'JPA' ELSE '57' END AS lsad FROM customer) t"""


def _district(width: str, height: str) -> str:
    x = "-120.7000019e0+(s_suppkey*37%100)/1e2*6.5e0"
    y = "32.7000023e0+(s_suppkey*61%100)/1e2*2.6e0"
    return (
        f"SELECT CAST(s_suppkey AS VARCHAR) AS name, {x} AS xmin, {y} AS ymin, {x}+{width} AS xmax, {y}+{height} AS ymax"
        " FROM supplier"
    )


TABLES["lower_fx"] = _district("0.6e0", "0.4e0")
TABLES["upper_fx"] = _district("1e0", "0.7e0")

TABLES["projects_fx"] = f"""
SELECT concat(p_name,' ',CAST(p_partkey AS VARCHAR)) AS project, CAST(2020000000+p_partkey AS VARCHAR) AS sch_number,
  concat('https://example.org/',CAST(2020000000+p_partkey AS VARCHAR)) AS ceqa_url,
  CASE p_type WHEN 'PROMO' THEN 'Approved' WHEN 'STANDARD' THEN NULL ELSE 'EIR' END AS stage_pending_approved,
  CASE WHEN p_size=50 THEN NULL WHEN p_type IN ('PROMO','ECONOMY') THEN 'Approved' ELSE 'EIR' END AS document_type_bins,
  CASE WHEN p_size%10=0 THEN 'withdrawn' END AS status,
  DATE '2021-01-01' + CAST(p_partkey%1000 AS INT) AS recvd_date,
  CAST((100+gk%900)*(100+gk%900) AS DOUBLE) AS parcel_area,
  CASE WHEN p_partkey%29=0 THEN 'Kern' ELSE CASE CAST(floor(lon+119e0) AS INT) WHEN 0 THEN 'Los Angeles' WHEN 1 THEN 'Orange'
    WHEN 2 THEN 'Riverside' ELSE 'San Bernardino' END END AS county,
  lon+(p_partkey%3)*4e-4-1e-3 AS xmin, lat-1e-3 AS ymin, lon+(p_partkey%3)*4e-4+1e-3 AS xmax, lat+1e-3 AS ymax
FROM (SELECT *, p_partkey*5 AS gk, {_PLACE.format(k='(p_partkey*5)')} FROM part) p"""

TABLES["planned_fx"] = """
SELECT *, CASE WHEN stage_pending_approved<>'Approved' THEN 'CEQA Review' WHEN stage_pending_approved='Approved' THEN 'Approved' END AS category
FROM projects_fx WHERE county IN ('Los Angeles','Orange','Riverside','San Bernardino') AND status IS NULL"""

TABLES["geocoded_fx"] = """
SELECT c_custkey AS id, c_name AS company, CAST(c_custkey AS VARCHAR)||' Main St' AS address, c_mktsegment AS city, 90000+c_custkey%700 AS zip,
  33.4e0+((c_custkey*10*104729)%100000)/1e5*1.6e0+CASE WHEN c_custkey%5=0 THEN (100+c_custkey*10%900)/728000e0+((c_custkey%10)*30+7)/364000e0 ELSE 0e0 END AS lat, -119e0+((c_custkey*10*7919)%100000)/1e5*4e0+(100+c_custkey*10%900)/604000e0+((c_custkey%18)*25-12)/302000e0 AS long,
  (c_custkey%100)/1e2 AS accuracy, CASE WHEN c_custkey%3=0 THEN 'rooftop' ELSE 'range' END AS accuracy_type FROM customer"""

TABLES["notices_fx"] = """
SELECT c_name AS company, CAST(c_custkey AS VARCHAR)||' Main St' AS address, c_mktsegment AS city,
  CASE WHEN c_custkey%41=0 THEN 0 ELSE 90000+c_custkey%700 END AS zip,
  CASE WHEN c_custkey%7=0 THEN 33.4e0+((c_custkey*10*104729)%100000)/1e5*1.6e0+CASE WHEN c_custkey%5=0 THEN (100+c_custkey*10%900)/728000e0+((c_custkey%10)*30+7)/364000e0 ELSE 0e0 END END AS lat,
  CASE WHEN c_custkey%7=0 THEN -119e0+((c_custkey*10*7919)%100000)/1e5*4e0+(100+c_custkey*10%900)/604000e0+((c_custkey%18)*25-12)/302000e0 END AS lng
FROM customer, (VALUES (1),(2)) v(copy) WHERE copy=1 OR c_custkey%5=0"""

TABLES["notice_points_fx"] = """
SELECT p.*, n.notice_count FROM (
  SELECT c.company, c.address, c.city, c.zip, g.long AS lng, g.lat
  FROM (SELECT DISTINCT company,address,city,zip FROM notices_fx WHERE zip>0) c JOIN geocoded_fx g USING (company,address,city,zip)
  WHERE g.accuracy>0.8e0 AND NOT EXISTS (SELECT 1 FROM notices_fx f WHERE f.lat>0 AND f.zip>0 AND f.company=c.company AND f.address=c.address
    AND f.city=c.city AND f.zip=c.zip)
  UNION ALL SELECT company,address,city,zip,lng,lat FROM notices_fx WHERE zip>0 AND lat>0) p
JOIN (SELECT company,address,city,zip,count(*) AS notice_count FROM notices_fx WHERE zip>0 GROUP BY ALL) n USING (company,address,city,zip)"""

TABLES["props_fx"] = """
SELECT lpad(CAST(l_orderkey AS VARCHAR),9,'0') AS pin,
  CASE WHEN l_linenumber=7 THEN NULL WHEN l_partkey%11=0 THEN 0 ELSE CAST(1880+l_partkey%150 AS INT) END AS year_built FROM lineitem"""

TABLES["years_fx"] = """
SELECT pin, CASE WHEN n=1 THEN only_year ELSE least_year END AS year_built FROM (
  SELECT pin, count(*) AS n, min(year_built) AS only_year, min(CASE WHEN year_built>=1911 THEN year_built END) AS least_year
  FROM (SELECT DISTINCT pin, year_built FROM props_fx) d GROUP BY pin) s"""

TABLES["ids13"] = "SELECT lpad(CAST(s_suppkey*13 AS VARCHAR),9,'0') AS apn FROM supplier"
TABLES["ids17"] = "SELECT lpad(CAST(s_suppkey*17 AS VARCHAR),9,'0') AS apn FROM supplier"

TABLES["codes_fx"] = """
SELECT CAST(use_code AS DOUBLE) AS use_code, lower(description) AS class,
  CASE WHEN lower(description) LIKE '%warehouse%' THEN 'warehouse' WHEN lower(description) LIKE '%light industrial%' THEN 'other'
    WHEN lower(description) LIKE '%flex%' THEN 'other' WHEN lower(description) LIKE '%storage%' THEN 'other'
    WHEN lower(description) LIKE '%associated%' THEN 'other' END AS type
FROM (SELECT DISTINCT p_size AS use_code, CASE p_size%9 WHEN 0 THEN 'Warehouse' WHEN 1 THEN 'Retail Warehouse' WHEN 2 THEN 'Light Industrial'
  WHEN 3 THEN 'Flex Space' WHEN 4 THEN 'Cold Storage' WHEN 5 THEN 'Grain Storage' WHEN 6 THEN 'Associated Yard' WHEN 7 THEN 'Office'
  ELSE 'Storage, Warehouse' END AS description FROM part) c
WHERE p_selected(description)"""
TABLES["codes_fx"] = TABLES["codes_fx"].replace(
    "p_selected(description)",
    "lower(description) NOT IN ('retail warehouse','grain storage') AND lower(description)<>'office'",
)

TABLES["emis_fx"] = """
SELECT CASE WHEN p_type='SMALL' THEN 'MDV' WHEN p_size%9=0 THEN concat(p_type,' SWCV') ELSE p_type END AS vehicle_category,
  2022 AS calendar_year, l_returnflag AS fuel, l_quantity AS trips, l_quantity*1e3 AS total_vmt, l_extendedprice/1e5 AS n_ox_totex,
  l_discount AS pm2_5_totex, l_tax AS pm2_5_total, l_extendedprice/1e3 AS co2_totex FROM lineitem JOIN part ON l_partkey=p_partkey"""

TABLES["kept_fx"] = f"""
SELECT id, apn, class, type, CASE WHEN year_built<=1910 THEN 'unknown' ELSE CAST(year_built AS VARCHAR) END AS year_chr,
  CAST(CASE WHEN year_built<=1980 THEN 1980 ELSE year_built END AS DOUBLE) AS year_built,
  round_even(shape_area*0.55e0,0) AS floor_sq_ft, county AS short_county, county||' County' AS county,
  round_even({box_area_m2('xmin', 'ymin', 'xmax', 'ymax')}*10.76391e0,-2) AS shape_area2, xmin, ymin, xmax, ymax
FROM typed_fx WHERE apn NOT IN (SELECT apn FROM ids17)"""

TABLES["pairs_centroid"] = """
SELECT p.project, k.apn, p.sch_number, p.ceqa_url FROM kept_fx k JOIN planned_fx p
 ON k.floor_sq_ft>28000 AND k.year_built>2016 AND p.recvd_date<=DATE '2023-01-01'
 AND (p.xmin+p.xmax)/2 BETWEEN k.xmin AND k.xmax AND (p.ymin+p.ymax)/2 BETWEEN k.ymin AND k.ymax"""
TABLES["pairs_outline"] = """
SELECT p.project, k.apn, p.sch_number, p.ceqa_url FROM kept_fx k JOIN planned_fx p
 ON k.floor_sq_ft>28000 AND k.year_built>2016 AND p.recvd_date<=DATE '2023-01-01'
 AND p.xmin<=k.xmax AND p.xmax>=k.xmin AND p.ymin<=k.ymax AND p.ymax>=k.ymin"""

LESS_THAN_HALF = ("2020000033", "2020000066")
OFF_CENTRE = ("2020000071",)
TABLES["built_fx"] = f"""
SELECT * FROM pairs_centroid WHERE sch_number NOT IN {LESS_THAN_HALF!r}
UNION ALL SELECT * FROM pairs_outline WHERE sch_number IN ('{OFF_CENTRE[0]}')"""
TABLES["not_built_fx"] = """
SELECT * FROM planned_fx p WHERE NOT EXISTS (SELECT 1 FROM built_fx b WHERE b.project=p.project AND b.sch_number=p.sch_number AND b.ceqa_url=p.ceqa_url)"""
TABLES["finished_fx"] = """
SELECT project AS name, sch_number, ceqa_url, document_type_bins, category, round_even(parcel_area,-3) AS shape_area,
  stage_pending_approved AS class, county||' County' AS county, round_even(parcel_area,-3)*0.55e0 AS floor_sq_ft,
  CASE WHEN document_type_bins='Approved' THEN 2027e0 WHEN document_type_bins<>'Approved' THEN 2030e0 END AS year_built,
  xmin,ymin,xmax,ymax FROM not_built_fx"""
TABLES["combined_fx"] = """
SELECT apn, shape_area2 AS shape_area, 'Existing' AS category, year_built, class, county, year_chr='unknown' AS unknown, xmin,ymin,xmax,ymax
FROM kept_fx WHERE floor_sq_ft>28000
UNION ALL SELECT name, shape_area, category, year_built, ceqa_url, county, true, xmin,ymin,xmax,ymax FROM finished_fx"""
TABLES["in_place"] = """SELECT 1"""

IN_PLACE = (
    "{x} BETWEEN {p}.xmin AND {p}.xmax AND {y} BETWEEN {p}.ymin AND {p}.ymax AND NOT ({p}.l_shape"
    " AND {x}>({p}.xmin+{p}.xmax)/2 AND {y}>({p}.ymin+{p}.ymax)/2)"
)
TABLES["located_fx"] = f"""
SELECT DISTINCT c.apn, c.shape_area, c.category, c.year_built, c.class, k.name||' County' AS county, c.unknown,
  coalesce(p.name,'unincorporated') AS place_name
FROM (SELECT *, (xmin+xmax)/2 AS x, (ymin+ymax)/2 AS y FROM combined_fx) c
LEFT JOIN counties_fx k ON c.x BETWEEN k.xmin AND k.xmax AND c.y BETWEEN k.ymin AND k.ymax
LEFT JOIN places_fx p ON {IN_PLACE.format(x='c.x', y='c.y', p='p')}"""
TABLES["served_fx"] = """
SELECT c.*, l.place_name FROM (SELECT DISTINCT * FROM combined_fx) c LEFT JOIN located_fx l
 ON c.apn IS NOT DISTINCT FROM l.apn AND c.shape_area IS NOT DISTINCT FROM l.shape_area AND c.category IS NOT DISTINCT FROM l.category
 AND c.year_built IS NOT DISTINCT FROM l.year_built AND c.class IS NOT DISTINCT FROM l.class AND c.county IS NOT DISTINCT FROM l.county
 AND c.unknown IS NOT DISTINCT FROM l.unknown"""
del TABLES["in_place"]

TABLES["lines_fx"] = """
SELECT c_custkey AS page, CASE WHEN c_custkey%17=0 THEN 'Page header' ELSE concat('~ ',CAST(c_custkey AS VARCHAR),'  Main St Anaheim CA ',
  CAST(92800+c_custkey%50 AS VARCHAR),' = ',CAST(c_custkey+1 AS VARCHAR),' Oak St  Fontana CA ',CAST(92330+c_custkey%10 AS VARCHAR)) END AS line
FROM customer"""
TABLES["zips_fx"] = """
SELECT DISTINCT CAST(zip AS DOUBLE) AS zip, CASE WHEN zip>=92800 THEN 'Orange County' ELSE 'San Bernardino County' END AS county
FROM (SELECT 92800+c_custkey%50 AS zip FROM customer UNION ALL SELECT 92330+c_custkey%10 FROM customer) z"""
TABLES["addresses_fx"] = """
SELECT a.text, a.zip, z.county FROM (
  SELECT text, TRY_CAST(substr(text, greatest(length(text)-5,1), length(text)) AS DOUBLE) AS zip FROM (
    SELECT replace_first(trim(regexp_replace(half,'\\s+',' ','g'))) AS text FROM (
      SELECT CASE WHEN e>0 THEN substr(line,1,e+8) END AS half FROM (SELECT line, instr(line,' CA ') AS e FROM lines_fx) q
      UNION ALL SELECT CASE WHEN e>0 THEN substr(line,e+9) END FROM (SELECT line, instr(line,' CA ') AS e FROM lines_fx) q) h) t
  WHERE text IS NOT NULL) a LEFT JOIN zips_fx z ON a.zip=z.zip"""
# DuckDB's regexp_replace without a flag replaces the first match only
_marks = "trim(regexp_replace(half,'\\s+',' ','g'))"
for _m in ("— ", "~~ ", "~ ", "~", "= "):
    _marks = f"regexp_replace({_marks},'{_m}','')"
TABLES["addresses_fx"] = TABLES["addresses_fx"].replace(
    "replace_first(trim(regexp_replace(half,'\\s+',' ','g')))", _marks
)

TABLES["tracts_fx"] = """
SELECT CAST(c_custkey AS VARCHAR) AS tract, CASE c_nationkey%5 WHEN 0 THEN 'Los Angeles' WHEN 1 THEN 'Orange' WHEN 2 THEN 'Riverside'
  WHEN 3 THEN 'San Bernardino' ELSE 'Kern' END AS county, CASE WHEN c_custkey%13=0 THEN NULL ELSE c_acctbal/100e0 END AS ciscorep,
  CASE WHEN c_custkey%19=0 THEN NULL ELSE c_custkey*3 END AS tot_pop19 FROM customer"""


def with_tables(sql: str) -> str:
    """Prefix the stand-ins a statement uses, and those they use in turn."""
    import re

    order = list(TABLES)
    needed: set[str] = set()

    def visit(text: str) -> None:
        for name in order:
            if name not in needed and re.search(rf"\b{name}\b", text):
                needed.add(name)
                visit(TABLES[name])

    visit(sql)
    ctes = ",\n".join(f"{n} AS ({TABLES[n].strip()})" for n in order if n in needed)
    return f"WITH {ctes}\n{sql.strip()}" if ctes else sql.strip()
