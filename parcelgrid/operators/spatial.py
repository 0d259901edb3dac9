"""Spatial joins as plain Spark equi-joins on grid cells.

One side drives: each of its rows gets exactly one key, the cell that holds the lower left
corner of its box, on the grid level whose cells are at least as large as the box. The other
side is indexed: each row is repeated for the cells it can meet, on the levels the driving
side uses. So every pair of overlapping boxes meets exactly once, there is nothing to
deduplicate afterwards, and inner, left, semi and anti joins are Spark's own join types with
the exact test in the join condition.

The indexed side carries no whole rings. Cells wholly outside a polygon are dropped, cells
wholly inside are marked and match without any test, and cells on the boundary carry only the
segments that can matter there. A county with ten thousand vertices then costs most parcels
nothing and those at its border a few dozen segment tests.

A cell that is hot on the driving side is an ordinary skewed key: with the indexed side
broadcast there is no shuffle at all, and otherwise adaptive execution splits the hot
partition of the driving side. Where that cannot work (the driving side is read by buckets, or
what follows needs the rows where they are), cells of over ``crowd`` driving rows are split: their
rows are dealt to as many parts as it takes, and the indexed rows of such a cell go to all of them.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import geometry as geo
from ..functions import projection
from ..functions.units import US_FT_PER_M
from ..sources.tables import materialise
from .relational import natural_join

LEVELS = 12          # cell sizes cell * 4**k; the level after the last is one cell for everything
_BROADCAST_BYTES = 16 * 1024 * 1024  # of Parquet, which unfolds to a few times that
_SMALL_BYTES = 256 * 1024  # of an indexed side as the planner guesses it, before it is unfolded


@dataclass(frozen=True)
class Side:
    """SQL names of what an exact test may use of one side of a candidate pair."""

    prefix: str
    edges: str
    heads: str = ""

    def box(self, bound: str) -> str:
        return f"{self.prefix}{bound}"

    @property
    def bounds(self) -> tuple[str, ...]:
        return tuple(self.box(b) for b in geo.BOX)

    @property
    def rect(self) -> str:
        """True of a polygon that is its own box."""
        return f"{self.prefix}rect"

    @property
    def x(self) -> str:
        return self.box("xmin")

    @property
    def y(self) -> str:
        return self.box("ymin")


# an exact test takes the driving and the indexed side and gives SQL text
Test = Callable[[Side, Side], str]
DRIVER = Side("_d_", "_d_edges", "_d_heads")
INDEX = Side("_i_", "_i_near")
# true in cells that lie wholly inside the indexed polygon
INSIDE = "_i_in"


def indexed(column: str) -> str:
    """Name, inside an exact test, of an own column of the indexed side."""
    return f"_i_{column}_"


# ----------------------------------------------------------------- grid keys

def one_row(df: DataFrame, fields: list[Column]) -> DataFrame:
    """Add computed columns through a one-element ``inline``.

    The join infers "is not null" filters on its keys and boxes. Pushed down through a plain
    projection they would repeat the whole geometry expression once per filter; a generator
    ends the push-down, so every field is computed once per row.
    """
    return df.select("*", F.inline(F.array(F.struct(*fields))))


def _boxed(df: DataFrame, geometry: str, prefix: str) -> DataFrame:
    g = F.col(geometry)
    return one_row(df, [g[n].alias(prefix + n) for n in geo.BOX])


def _level_sql(cell: float) -> str:
    """The least grid level whose cells are at least as large as the driving row's box."""
    extent = "greatest(_d_xmax - _d_xmin, _d_ymax - _d_ymin)"
    fits = " ".join(f"WHEN {extent} <= {0.999 * cell * 4**k!r}D THEN {k}" for k in range(LEVELS))
    return f"CASE {fits} WHEN {extent} IS NOT NULL THEN {LEVELS} END"


def _keyed_driver(df: DataFrame, geometry: str, cell: float, points: bool) -> DataFrame:
    """Driving rows with their box and the one cell they are looked up in; NULL without a box."""
    boxed = _boxed(df, geometry, "_d_")
    if points:
        boxed = boxed.withColumn("_d_k", F.lit(0))
    else:
        boxed = one_row(boxed, [F.expr(_level_sql(cell)).alias("_d_k")])

    def number(corner: str) -> Column:
        at = f"floor({corner} / (pow(4D, _d_k) * {cell!r}D))"
        return F.expr(f"CAST(CASE WHEN _d_k < {LEVELS} THEN {at} WHEN _d_k = {LEVELS} THEN 0 END AS BIGINT)")

    return one_row(boxed, [number("_d_xmin").alias("_d_cx"), number("_d_ymin").alias("_d_cy")])


#: Grid key columns of a table that is stored by them, in the order of the buckets.
KEYS = ("cell_k", "cell_cx", "cell_cy", "cell_part")
_DRIVER_KEYS = ("_d_k", "_d_cx", "_d_cy", "_d_part")


def dense_cells(keyed: DataFrame, crowd: int) -> DataFrame:
    """(k, cx, cy, parts) of the cells with over ``crowd`` driving rows; at most a ``crowd``-th as many as rows."""
    cells = keyed.groupBy(*[F.col(d).alias(n) for d, n in zip(_DRIVER_KEYS, ("k", "cx", "cy"))])
    counts = cells.agg(F.count("*").alias("n")).where(F.col("n") > crowd)
    return counts.select("k", "cx", "cy", F.ceil(F.col("n") / crowd).cast("int").alias("parts"))


def _dealt(keyed: DataFrame, dense: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Driving rows with their part of a dense cell, by a hash of the row; 0 elsewhere."""
    cell = dense.select(*[F.col(c).alias(f"_c_{c}") for c in dense.columns])
    here = [F.col(d).eqNullSafe(F.col(f"_c_{c}")) for d, c in zip(_DRIVER_KEYS, ("k", "cx", "cy"))]
    part = F.pmod(F.xxhash64(*[F.col(f"`{c}`") for c in columns]), F.col("_c_parts"))
    held = keyed.join(cell, here[0] & here[1] & here[2], "left")
    return held.withColumn("_d_part", F.coalesce(part, F.lit(0)).cast("int")).drop(*cell.columns)


def keyed_rows(df: DataFrame, *, cell: float, crowd: int, geometry: str = "geometry", points: bool = False) -> tuple[DataFrame, DataFrame]:
    """The rows with their grid keys (KEYS) as columns, and the dense cells."""
    keyed = _keyed_driver(df, geometry, cell, points)
    dense = materialise(dense_cells(keyed, crowd))
    rows = _dealt(keyed, dense, df.columns)
    return rows.select(*[F.col(f"`{c}`") for c in df.columns], *[F.col(d).alias(n) for d, n in zip(_DRIVER_KEYS, KEYS)]), dense


def _cells_sql(cell: float, reach: int) -> str:
    """array<struct(k, cx, cy)> of every cell of level ``_i_k`` that a driving row which meets
    the box may be keyed by. A driving polygon may start one cell lower in each direction
    (``reach`` 1); a point may not.
    """
    size = f"(pow(4D, _i_k) * {cell!r}D)"

    def span(axis: str) -> str:
        return (
            f"sequence(floor((_i_{axis}min - _i_pad) / {size}) - {reach},"
            f" floor((_i_{axis}max + _i_pad) / {size}))"
        )

    def key(x: str, y: str) -> str:
        return f"named_struct('k', _i_k, 'cx', CAST({x} AS BIGINT), 'cy', CAST({y} AS BIGINT))"

    grid = f"flatten(transform({span('x')}, u -> transform({span('y')}, v -> {key('u', 'v')})))"
    return f"CASE WHEN _i_k < {LEVELS} THEN {grid} ELSE array({key('0', '0')}) END"


def _window_sql(cell: float, reach: int, pad: str) -> dict[str, str]:
    """Bounds and middle of the square in which every driving box of an index cell lies."""
    size = f"(pow(4D, _i_cell.k) * {cell!r}D)"
    slack = f"({size} * 1e-6D + {pad})"
    return {
        "xmin": f"(_i_cell.cx * {size} - {slack})",
        "ymin": f"(_i_cell.cy * {size} - {slack})",
        "xmax": f"((_i_cell.cx + {1 + reach}) * {size} + {slack})",
        "ymax": f"((_i_cell.cy + {1 + reach}) * {size} + {slack})",
        "x": f"((_i_cell.cx + {(1 + reach) / 2}D) * {size})",
        "y": f"((_i_cell.cy + {(1 + reach) / 2}D) * {size})",
    }


def _settle_cells(cells: DataFrame, cell: float, reach: int) -> DataFrame:
    """Decide each index cell once instead of once per driving row.

    If no boundary segment meets the cell's window, the whole window is inside or outside: an
    outside cell is dropped, an inside one (``_i_in``) needs no segments any more. A cell that
    the boundary crosses keeps the segments in its horizontal band and not to its left, which
    is all a ray towards growing x needs.
    """
    w = _window_sql(cell, reach, "_i_pad")
    # of a box its own sides tell, for one more comparison instead of a look at every segment
    within = f"(_i_xmin < {w['xmin']} AND _i_xmax > {w['xmax']} AND _i_ymin < {w['ymin']} AND _i_ymax > {w['ymax']})"
    overlaps = f"(_i_xmin <= {w['xmax']} AND _i_xmax >= {w['xmin']} AND _i_ymin <= {w['ymax']} AND _i_ymax >= {w['ymin']})"
    meets = (
        f"CASE WHEN _i_rect THEN {overlaps} AND NOT {within} ELSE exists(_i_edges, e ->"
        f" greatest(e.ax, e.bx) >= {w['xmin']} AND least(e.ax, e.bx) <= {w['xmax']}"
        f" AND greatest(e.ay, e.by) >= {w['ymin']} AND least(e.ay, e.by) <= {w['ymax']}) END"
    )
    near = (
        f"filter(_i_edges, e -> greatest(e.ax, e.bx) >= {w['xmin']}"
        f" AND greatest(e.ay, e.by) >= {w['ymin']} AND least(e.ay, e.by) <= {w['ymax']})"
    )
    middle = f"CASE WHEN _i_rect THEN {within} ELSE {geo.contains_point('_i_edges', w['x'], w['y'])} END"
    # a polygon wholly in the window is on its boundary there; it keeps all its few segments
    whole = (
        f"(_i_cell.k = {LEVELS} OR (_i_xmin >= {w['xmin']} AND _i_xmax <= {w['xmax']}"
        f" AND _i_ymin >= {w['ymin']} AND _i_ymax <= {w['ymax']}))"
    )
    crossed = f"{whole} OR {meets}"
    decided = one_row(cells, [F.expr(crossed).alias("_i_crossed")])
    decided = one_row(
        decided,
        [
            F.expr(f"NOT _i_crossed AND {middle}").alias("_i_in"),
            F.expr(
                f"CASE WHEN {whole} OR (_i_rect AND _i_crossed) THEN _i_edges WHEN _i_crossed THEN {near}"
                " ELSE slice(_i_edges, 1, 0) END"
            ).alias("_i_near"),
        ],
    )
    return decided.where("_i_crossed OR _i_in")


# ---------------------------------------------------------- broadcast decision

def _boundary_cells(cells: DataFrame) -> DataFrame:
    """The cells of a boundary table, written once and broadcast if what was written is small.

    The written columns hold everything the join carries, segments and own columns included, so
    their size is the true one; above the bound the planner chooses. Boundaries are prepared
    once and not again for every task or every use.
    """
    written = materialise(cells)
    size = int(str(written._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return F.broadcast(written) if size <= _BROADCAST_BYTES else written


def _unfolds(index: DataFrame) -> bool:
    """Whether the planner would broadcast an indexed side that is too large for it.

    Its guess comes from the compressed files and does not know of the rows by cell with their
    segments, all of which the driver would hold. What it guesses to be larger is exchanged anyway.
    """
    guess = int(str(index._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return _SMALL_BYTES < guess <= index.sparkSession._jsparkSession.sessionState().conf().autoBroadcastJoinThreshold()


# ---------------------------------------------------------------- the core join

def grid_join(
    driver: DataFrame,
    index: DataFrame,
    test: Test,
    how: str = "inner",
    *,
    cell: float,
    driver_geometry: str = "geometry",
    index_geometry: str = "geometry",
    driver_points: bool = False,
    pad: Column | float = 0.0,
    index_edges: bool = True,
    driver_edges: bool = True,
    keep_index_geometry: bool = False,
    boundary: bool = False,
    crowd: int | None = None,
    dense: DataFrame | None = None,
    contained: bool = False,
) -> DataFrame:
    """Join rows whose boxes (the indexed one padded) overlap and that pass ``test``.

    ``how`` is inner, left, left_semi or left_anti, seen from the driving side. Columns of the
    indexed side whose name is taken get the suffix ``_right``. ``cell`` is the smallest cell
    size in coordinate units: near the usual size of the larger side's boxes is right.

    ``boundary`` says that the indexed side is a table of boundaries (counties, places): it is
    written while the query is built, and broadcast if that proves small. Without it no job
    runs until the result is asked for and the planner chooses from what it knows by then.

    ``crowd`` splits cells of more driving rows, which are counted first. A driving side that is
    stored by its grid keys (columns KEYS, of the same cell size) comes with its ``dense`` cells;
    its keys are then used as they are, so buckets by them need no exchange.

    ``contained`` says that the test holds only for driving boxes inside the indexed one: then their
    lower left corner is inside, too, and cells beyond the box need no index row.
    """
    pad = pad if isinstance(pad, Column) else F.lit(float(pad))
    reach = 0 if driver_points else 1

    stored = dense is not None
    columns = [c for c in driver.columns if not (stored and c in KEYS)]
    if stored:
        left = _boxed(driver, driver_geometry, "_d_").withColumns(dict(zip(_DRIVER_KEYS, map(F.col, KEYS))))
    else:
        left = _keyed_driver(driver, driver_geometry, cell, driver_points)
    if crowd and not stored:
        dense = materialise(dense_cells(left, crowd))
        left = _dealt(left, dense, driver.columns)
    if driver_edges and not driver_points:
        left = left.withColumns(
            {
                "_d_edges": F.expr(geo.edges(f"`{driver_geometry}`")),
                "_d_heads": F.expr(geo.heads(f"`{driver_geometry}`")),
                "_d_rect": F.expr(geo.is_box(f"`{driver_geometry}`")),
            }
        )
    levels = F.array(F.lit(0))
    if not driver_points and stored:
        levels = driver.select(F.expr("collect_set(cell_k)")).scalar()
    elif not driver_points:
        in_use = _boxed(driver.select(driver_geometry), driver_geometry, "_d_")
        levels = in_use.select(F.expr(f"collect_set({_level_sql(cell)})")).scalar()

    own = [c for c in index.columns if c != index_geometry or keep_index_geometry]
    wanted = [] if how in ("left_semi", "left_anti") else own
    out_names = {c: f"{c}_right" if c in columns else c for c in wanted}
    shapes = index.withColumn("_i_pad", pad).withColumn("_i_levels", levels)
    if index_edges:
        shapes = shapes.withColumns(
            {
                "_i_edges": F.expr(f"coalesce({geo.edges(f'`{index_geometry}`')}, array())"),
                "_i_rect": F.expr(geo.is_box(f"`{index_geometry}`")),
            }
        )
    shapes = _boxed(shapes, index_geometry, "_i_").where("_i_xmin IS NOT NULL")
    cells = shapes.withColumn("_i_k", F.explode("_i_levels")).withColumn(
        "_i_cell", F.explode(F.expr(_cells_sql(cell, 0 if contained else reach)))
    )
    kept = [F.col(c).alias(indexed(c)) for c in own]
    if index_edges:
        cells = _settle_cells(cells, cell, reach)
        kept += [F.col("_i_near"), F.col("_i_in"), F.col("_i_rect")]
    right = cells.select("_i_cell", "_i_pad", *[f"_i_{n}" for n in geo.BOX], *kept)
    if dense is not None:
        spread = dense.select(F.struct("k", "cx", "cy").alias("_c_cell"), F.col("parts").alias("_c_parts"))
        right = right.join(spread, F.col("_i_cell") == F.col("_c_cell"), "left")
        every = F.sequence(F.lit(0), F.coalesce("_c_parts", F.lit(1)) - 1)
        right = right.withColumn("_i_part", F.explode(every)).drop("_c_cell", "_c_parts")
    if boundary:
        right = _boundary_cells(right)
    elif _unfolds(right):
        right = right.hint("merge")

    condition = (
        "_d_k = _i_cell.k AND _d_cx = _i_cell.cx AND _d_cy = _i_cell.cy"
        " AND _d_xmin <= _i_xmax + _i_pad AND _d_xmax >= _i_xmin - _i_pad"
        " AND _d_ymin <= _i_ymax + _i_pad AND _d_ymax >= _i_ymin - _i_pad"
        f" AND {test(DRIVER, INDEX)}"
    )
    if dense is not None:
        condition = f"_d_part = _i_part AND {condition}"
    joined = left.join(right, F.expr(condition), how)
    return joined.select(
        *[F.col(f"`{c}`") for c in columns],
        *[F.col(indexed(c)).alias(name) for c, name in out_names.items()],
    )


# ------------------------------------------------------------- named predicates

def _pair_test(predicate: str, driver_points: bool, index_points: bool) -> Test:
    """Exact test for driver <predicate> index; two polygons that are their boxes are decided by these."""
    if driver_points and not index_points:
        if predicate == "intersects":
            return lambda a, b: f"({INSIDE} OR {geo.covers_point(b.edges, a.x, a.y)})"
        if predicate == "within":
            return lambda a, b: f"({INSIDE} OR {geo.contains_point(b.edges, a.x, a.y)})"
    if index_points and not driver_points:
        if predicate == "intersects":
            return lambda a, b: geo.covers_point(a.edges, b.x, b.y)
        if predicate == "contains":
            return lambda a, b: geo.contains_point(a.edges, b.x, b.y)
    if not driver_points and not index_points:
        if predicate == "intersects":
            return lambda a, b: (
                f"({INSIDE} OR ({a.rect} AND {b.rect}) OR {geo.polygons_intersect(a.edges, a.heads, b.edges, a.bounds)})"
            )
        if predicate == "contains":
            return lambda a, b: (
                f"{_box_inside(b, a)} AND (({a.rect} AND {b.rect}) OR {geo.polygon_contains(a.edges, b.edges, b.bounds)})"
            )
        if predicate == "within":
            return lambda a, b: (
                f"{_box_inside(a, b)} AND ({INSIDE} OR ({a.rect} AND {b.rect}) OR {geo.polygon_contains(b.edges, a.edges, a.bounds)})"
            )
    raise ValueError(f"no test for {predicate!r} on these geometry kinds")


def _box_inside(inner: Side, outer: Side) -> str:
    return " AND ".join(
        f"{inner.box(b)} {sign} {outer.box(b)}" for b, sign in zip(geo.BOX, (">=", ">=", "<=", "<="))
    )


def spatial_join(
    left: DataFrame,
    right: DataFrame,
    predicate: str = "intersects",
    how: str = "left",
    *,
    cell: float,
    left_points: bool = False,
    right_points: bool = False,
    keep_right_geometry: bool = False,
    left_geometry: str = "geometry",
    right_geometry: str = "geometry",
    boundary: bool = False,
    crowd: int | None = None,
    dense: DataFrame | None = None,
) -> DataFrame:
    """``left <predicate> right`` for intersects, contains or within; many matches, many rows.

    The left side drives. Use :func:`container_join` when the left side is a small table of
    large polygons and the right one is large.
    """
    return grid_join(
        left,
        right,
        _pair_test(predicate, left_points, right_points),
        how,
        cell=cell,
        driver_geometry=left_geometry,
        index_geometry=right_geometry,
        driver_points=left_points,
        index_edges=not right_points,
        keep_index_geometry=keep_right_geometry,
        boundary=boundary,
        crowd=crowd,
        dense=dense,
        contained=predicate == "within",
    )


def container_join(
    containers: DataFrame,
    members: DataFrame,
    predicate: str = "contains",
    how: str = "left",
    *,
    key: str,
    cell: float,
    member_points: bool = False,
) -> DataFrame:
    """Left join from a boundary table to the many rows in it, driven by the many.

    Every member is keyed by one cell and the boundaries are indexed, so the work spreads over
    the members' cells instead of one key per boundary. ``key`` names a unique column of the
    boundaries; boundaries without a member come back with NULLs when ``how`` is left, for
    which the pairs are found once more: they may be far more than the rows of both sides, so they
    are not written, and only the keys of that second run are kept.
    """
    inverse = {"contains": "within", "intersects": "intersects"}[predicate]
    pairs = grid_join(
        members,
        containers,
        _pair_test(inverse, member_points, False),
        "inner",
        cell=cell,
        driver_points=member_points,
        boundary=True,
        contained=inverse == "within",
    )
    # containers' own columns first, members' clashing ones with the suffix
    taken = [c for c in containers.columns if c != "geometry"]
    member_columns = [c for c in members.columns if c != "geometry"]
    out = pairs.select(
        *[F.col(f"{c}_right" if c in member_columns else c).alias(c) for c in taken],
        *[F.col(c).alias(f"{c}_right" if c in taken else c) for c in member_columns],
        "geometry",
    )
    if how == "inner":
        return out
    empty = natural_join(containers.drop("geometry"), out.select(key).distinct(), "left_anti", on=[key])
    return out.unionByName(empty, allowMissingColumns=True)


def spatial_semi(left: DataFrame, right: DataFrame, predicate: str = "intersects", **options) -> DataFrame:
    """Left rows that match any right row, each once."""
    return _existence(left, right, predicate, "left_semi", options)


def spatial_anti(left: DataFrame, right: DataFrame, predicate: str = "intersects", **options) -> DataFrame:
    """Left rows that match no right row: disjoint from the union of the right side."""
    return _existence(left, right, predicate, "left_anti", options)


def _existence(left, right, predicate, how, options) -> DataFrame:
    shapes = right.select(options.get("right_geometry", "geometry"))
    return spatial_join(left, shapes, predicate, how, **options)


# -------------------------------------------------------------------- distances

_FEET = {"us_ft": 1.0, "m": US_FT_PER_M}


def in_state_plane(df: DataFrame, column: str = "geometry", out: str = "_plane") -> DataFrame:
    return df.withColumn(out, F.expr(geo.map_coordinates(column, projection.state_plane)))


def within_distance(
    left: DataFrame,
    right_points: DataFrame,
    radius: float,
    unit: str = "us_ft",
    how: str = "left_semi",
    *,
    cell_ft: float = 2000.0,
    left_points: bool = False,
) -> DataFrame:
    """Left polygons (or points) within ``radius`` of a right point, measured in zone 6 feet."""
    feet = radius * _FEET[unit]
    a = in_state_plane(left)
    b = in_state_plane(right_points).drop("geometry")
    if how in ("left_semi", "left_anti"):
        b = b.select("_plane")

    def test(d: Side, i: Side) -> str:
        if left_points:
            return f"pow({d.x} - {i.x}, 2D) + pow({d.y} - {i.y}, 2D) <= {feet**2!r}D"
        return geo.within_distance(d.edges, i.x, i.y, feet)

    return grid_join(
        a, b, test, how, cell=cell_ft, driver_geometry="_plane", index_geometry="_plane",
        driver_points=left_points, index_edges=False, pad=feet,
    ).drop("_plane")


def points_near_polygons(
    points: DataFrame,
    polygons: DataFrame,
    margin: float,
    unit: str = "m",
    how: str = "left_semi",
    *,
    cell_ft: float = 5000.0,
    boundary: bool = False,
) -> DataFrame:
    """Points inside, or within ``margin`` of, any polygon (or, with left_anti, of none)."""
    feet = margin * _FEET[unit]
    a = in_state_plane(points)
    b = in_state_plane(polygons).select("_plane")
    return grid_join(
        a,
        b,
        lambda d, i: f"({INSIDE} OR {geo.within_distance(i.edges, d.x, d.y, feet)})",
        how,
        cell=cell_ft,
        driver_geometry="_plane",
        index_geometry="_plane",
        driver_points=True,
        pad=feet,
        boundary=boundary,
    ).drop("_plane")


def region_difference(
    points: DataFrame, region: DataFrame, minus: DataFrame, margin: float, unit: str = "m", *, cell: float
) -> DataFrame:
    """Points in any polygon of ``region`` and farther than ``margin`` from all of ``minus``."""
    inside = spatial_semi(points, region, cell=cell, left_points=True, boundary=True)
    return points_near_polygons(inside, minus, margin, unit, "left_anti", boundary=True)


# ---------------------------------------------------------------------- circles

def _circle_box(lon: str, lat: str, radius: str, mode: str) -> tuple[str, ...]:
    """A box around the circle: exact on the map, with some room for a radius on the ground."""
    reach = radius if mode == "mercator" else f"({radius} / cos(radians({lat})) * 1.1D + 1D)"
    x, y = projection.mercator(lon, lat)
    return (
        *projection.mercator_inverse(f"{x} - {reach}", f"{y} - {reach}"),
        *projection.mercator_inverse(f"{x} + {reach}", f"{y} + {reach}"),
    )


def _in_circle_sql(x: str, y: str, lon: str, lat: str, radius: str, mode: str) -> str:
    """Position (x, y) no farther than ``radius`` metres from (lon, lat)."""
    r = f"{projection.EARTH_RADIUS!r}D"
    if mode == "mercator":
        def north(at: str) -> str:
            return f"ln(tan(pi() / 4 + radians({at}) / 2))"

        return (
            f"(pow({r} * radians({x} - {lon}), 2D) + pow({r} * ({north(y)} - {north(lat)}), 2D)"
            f" <= pow({radius}, 2D))"
        )
    if mode == "ground":
        half = (
            f"pow(sin(radians({y} - {lat}) / 2), 2D)"
            f" + cos(radians({lat})) * cos(radians({y})) * pow(sin(radians({x} - {lon}) / 2), 2D)"
        )
        return f"(2 * {r} * asin(sqrt({half})) <= {radius})"
    raise ValueError(f"unknown circle mode {mode!r}")


def in_circle(
    df: DataFrame, lon: float, lat: float, radius_km: float, mode: str = "mercator"
) -> DataFrame:
    """Rows wholly inside a circle around a clicked position.

    ``mercator`` measures the radius on the map, as the dashboard does; ``ground`` on the
    sphere. The box test is on stored columns, so it reaches the Parquet scan.
    """
    lon, lat, metres = round(lon, 8), round(lat, 8), radius_km * 1000.0
    circle = (f"{float(lon)!r}D", f"{float(lat)!r}D", f"{metres!r}D", mode)
    xmin, ymin, xmax, ymax = _circle_box(*circle)
    inside = F.expr(
        f"CASE WHEN geometry.kind = 'point' THEN {_in_circle_sql('geometry.xmin', 'geometry.ymin', *circle)}"
        f" ELSE forall(flatten(flatten(geometry.rings)), v -> {_in_circle_sql('v.x', 'v.y', *circle)}) END"
    )
    boxed = df.where(
        f"geometry.xmin >= {xmin} AND geometry.xmax <= {xmax}"
        f" AND geometry.ymin >= {ymin} AND geometry.ymax <= {ymax}"
    )
    return boxed.where(inside)


#: The driving row's box on the map.
_MAP = ("_m_xmin", "_m_ymin", "_m_xmax", "_m_ymax")


def _by_map_box(d: Side, each: str) -> str:
    """The test of every vertex, put off until the box of the shape on the map does not decide.

    All vertices lie in the box, so a circle with its farthest corner holds the shape; each side of the
    box has a vertex, so one without the nearest point of a side does not. Both leave room for rounding.
    """
    x0, y0, x1, y1 = _MAP
    cx, cy, radius = indexed("_cx"), indexed("_cy"), f"({indexed('radius_km')} * 1000D)"
    left, right, low, high = f"({cx} - {x0})", f"({x1} - {cx})", f"({cy} - {y0})", f"({y1} - {cy})"
    across, up = f"greatest({left}, {right})", f"greatest({low}, {high})"
    aside, above = f"greatest(-{left}, -{right}, 0D)", f"greatest(-{low}, -{high}, 0D)"
    room = f"({radius} * {radius} * 1e-9D + {radius} * 1e-6D + 1e-12D)"
    far = f"({across} * {across} + {up} * {up})"
    side = f"greatest({across} * {across} + {above} * {above}, {up} * {up} + {aside} * {aside})"
    holds = f"({d.edges} IS NOT NULL AND {far} <= {radius} * {radius} - {room})"
    return f"{side} <= {radius} * {radius} + {room} AND ({holds} OR {each})"


def in_circles(
    df: DataFrame, circles: DataFrame, how: str = "inner", *, cell: float, mode: str = "mercator"
) -> DataFrame:
    """Batch form: ``circles`` has lon, lat, radius_km and own columns; one row per containment."""
    bounds = _circle_box("lon", "lat", "(radius_km * 1000D)", mode)
    boxed = circles.withColumn("_circle", F.expr(geo.box(*bounds)))
    circle = (indexed("lon"), indexed("lat"), f"{indexed('radius_km')} * 1000D", mode)

    def test(d: Side, i: Side) -> str:
        each = f"forall({d.edges}, e -> {_in_circle_sql('e.ax', 'e.ay', *circle)})"
        if mode == "mercator":
            each = _by_map_box(d, each)
        return f"{_box_inside(d, i)} AND {each}"

    options = dict(cell=cell, index_geometry="_circle", index_edges=False, contained=True)
    if mode != "mercator":
        return grid_join(df, boxed, test, how, **options)
    corners = {"xmin": 0, "ymin": 1, "xmax": 0, "ymax": 1}
    g = "`geometry`"
    on_map = {c: projection.mercator(f"{g}.{c}", f"{g}.{c}")[axis] for c, axis in corners.items()}
    middle = projection.mercator("lon", "lat")
    boxed = boxed.withColumns({"_cx": F.expr(middle[0]), "_cy": F.expr(middle[1])})
    mapped = one_row(df, [F.expr(on_map[c]).alias(m) for c, m in zip(geo.BOX, _MAP)])
    return grid_join(mapped, boxed, test, how, **options).drop(*_MAP, "_cx", "_cy")


# -------------------------------------------------------------------- equality

#: Segments of a shape that are compared all with all in its row; larger shapes go to a grid of their own.
FEW_SEGMENTS = 64


def crossing_shapes(shapes: DataFrame, key: str, column: str = "geometry") -> DataFrame:
    """(key) of the shapes with segments that cross, for shapes of any size.

    Every shape has a grid of its own with about as many cells as segments; only segments of one
    shape that lie in one cell are compared, so the work follows the segments.
    """
    g = F.col(column)
    edges = shapes.select(
        F.col(key), F.expr(f"size({geo.edges(column)})").alias("n"), g["xmin"].alias("x0"), g["ymin"].alias("y0"),
        F.greatest(g["xmax"] - g["xmin"], g["ymax"] - g["ymin"]).alias("extent"), F.posexplode(F.expr(geo.edges(column))).alias("at", "e"),
    )
    size = F.greatest(F.col("extent") / F.ceil(F.sqrt("n")), F.lit(1e-12))

    def cells(axis: str) -> Column:
        low, high = (f(F.col(f"e.a{axis}"), F.col(f"e.b{axis}")) for f in (F.least, F.greatest))
        return F.sequence(F.floor((low - F.col(f"{axis}0")) / size), F.floor((high - F.col(f"{axis}0")) / size))

    spread = edges.select(key, "at", "e", F.explode(cells("x")).alias("cx"), cells("y").alias("cys")).select(key, "at", "e", "cx", F.explode("cys").alias("cy"))
    left, right = (spread.select(F.col(key).alias(f"key_{k}"), "cx", "cy", F.col("at").alias(f"at_{k}"), F.col("e").alias(f"e_{k}")) for k in "ab")
    met = left.join(right, (left["key_a"] == right["key_b"]) & (left["cx"] == right["cx"]) & (left["cy"] == right["cy"]) & (left["at_a"] < right["at_b"]) & F.expr(geo.segments_cross("e_a", "e_b")))
    return met.select(F.col("key_a").alias(key)).distinct()


def invalid_shapes(df: DataFrame, column: str = "geometry") -> DataFrame:
    """The rows with the ``reason`` why their geometry is not valid, NULL if it is.

    Rings that are open, too short, not finite or without area; rings that cross themselves or each
    other; holes outside their shell; parts that overlap.
    """
    own = df.withColumn("reason", F.expr(geo.invalid_reason(f"`{column}`")))
    many = F.coalesce(F.expr(f"size({geo.edges(f'`{column}`')})"), F.lit(0)) > FEW_SEGMENTS
    few = own.where(F.col("reason").isNotNull() | ~many)
    crossed = F.when(F.expr(geo.crossing(f"`{column}`")), F.lit("crossing rings"))
    placed = F.expr(geo.misplaced(f"`{column}`"))
    few = few.withColumn("reason", F.coalesce("reason", crossed, placed))
    large = own.where(F.col("reason").isNull() & many).drop("reason").withColumn("_shape_id", F.monotonically_increasing_id())
    large = materialise(large)
    found = crossing_shapes(large, "_shape_id", column).select(F.col("_shape_id").alias("_crossed"))
    large = large.join(found, F.col("_shape_id") == F.col("_crossed"), "left")
    crossed = F.when(F.col("_crossed").isNotNull(), F.lit("crossing rings"))
    return few.unionByName(large.withColumn("reason", F.coalesce(crossed, placed)).drop("_shape_id", "_crossed"))


def split_valid(df: DataFrame, column: str = "geometry") -> tuple[DataFrame, DataFrame]:
    """(rows with a valid geometry, the others with the reason), to put ahead of the jobs."""
    checked = materialise(invalid_shapes(df, column))
    return checked.where(F.col("reason").isNull()).drop("reason"), checked.where(F.col("reason").isNotNull())


def distinct_geometries(df: DataFrame, column: str = "geometry") -> DataFrame:
    """One row per polygon as a point set; the canonical geometry is its own identity."""
    return df.select(F.expr(geo.canonical(column)).alias(column)).distinct()


def explode_parts(df: DataFrame, column: str = "geometry") -> DataFrame:
    """One row per part of a multipolygon, attributes repeated; points pass through."""
    parts = F.expr(
        f"CASE WHEN {column}.kind = 'point' THEN array({column})"
        f" ELSE {geo.each(f'{column}.rings', lambda part: geo.polygon(f'array({part})'))} END"
    )
    names = [c for c in df.columns if c != column]
    return df.select(*names, F.explode(parts).alias(column))


def ring_from_points(df: DataFrame, by: Sequence[str], order: str, x: str, y: str) -> DataFrame:
    """Numbered vertex rows back to one polygon per group; an open ring is closed."""
    listed = F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(x).alias("x"), F.col(y).alias("y"))))
    rows = df.groupBy(*by).agg(listed.alias("_ring"))
    ring = geo.each("_ring", lambda s: geo.vertex(f"{s}.x", f"{s}.y"))
    closed = geo.let(
        ring, lambda r: f"CASE WHEN {r}[0] = element_at({r}, -1) THEN {r} ELSE concat({r}, slice({r}, 1, 1)) END"
    )
    return rows.select(*by, F.expr(geo.ring_polygon(closed)).alias("geometry"))


def vertices_table(df: DataFrame, columns: Sequence[str], geometry: str = "geometry") -> DataFrame:
    """One row per vertex with its 1-based position in the whole geometry."""
    return df.select(*columns, F.posexplode(F.expr(geo.vertices(geometry))).alias("_pos", "_v")).select(
        *columns, (F.col("_pos") + 1).alias("pos"), F.col("_v.x").alias("x"), F.col("_v.y").alias("y")
    )


def patch_vertices(
    df: DataFrame, overrides: Sequence[tuple[str, int, int, float]], column: str = "geometry"
) -> DataFrame:
    """Override x or y for positional ranges of a one-ring polygon; later overrides win.

    Each override is (axis, first, last, value), positions 1-based and inclusive. The patch is
    a map over the ring, so no row leaves its task.
    """
    values = {"x": "v.x", "y": "v.y"}
    for axis, first, last, value in overrides:
        here = f"i + 1 BETWEEN {int(first)} AND {int(last)}"
        values[axis] = f"CASE WHEN {here} THEN {float(value)!r}D ELSE {values[axis]} END"
    ring = f"transform({column}.rings[0][0], (v, i) -> {geo.vertex(values['x'], values['y'])})"
    return df.withColumn(column, F.expr(geo.ring_polygon(ring)))
