"""Geometry as SQL expressions over one struct type.

A geometry is ``struct<kind, rings, xmin, ymin, xmax, ymax>``: ``rings`` is
polygons -> rings -> vertices, every ring closed, the first ring of a polygon its outer
one; a point has no rings and its position in the bounding box. Stored tables hold
longitude/latitude; projected coordinates live only inside a job.

All functions take SQL text, mostly a column name, and give SQL text for ``F.expr``: they
nest deeply, and text costs one call to the JVM where a Column costs one per operation.
Nothing leaves the JVM. Ring work is ``transform``/``aggregate``/``exists`` over one row's
vertices, so it is narrow; box tests come first so that few rows reach it.
"""

from __future__ import annotations

from collections.abc import Callable
from itertools import count

from . import projection

RINGS_DDL = "array<array<array<struct<x:double,y:double>>>>"
GEOMETRY_DDL = (
    f"struct<kind:string,rings:{RINGS_DDL},xmin:double,ymin:double,xmax:double,ymax:double>"
)
BOX = ("xmin", "ymin", "xmax", "ymax")

Mapping = Callable[[str, str], tuple[str, str]]
_numbers = count()


def _name() -> str:
    """A lambda variable no enclosing lambda uses."""
    return f"v{next(_numbers)}_"


def let(value: str, body: Callable[[str], str]) -> str:
    """Name a per-row value so that the body evaluates it once."""
    v = _name()
    return f"transform(array({value}), {v} -> {body(v)})[0]"


def each(array: str, body: Callable[[str], str]) -> str:
    v = _name()
    return f"transform({array}, {v} -> {body(v)})"


# ---------------------------------------------------------------- construction

def vertex(x: str, y: str) -> str:
    return f"named_struct('x', CAST({x} AS DOUBLE), 'y', CAST({y} AS DOUBLE))"


def _geometry(kind: str, rings: str, *box: str) -> str:
    bounds = ", ".join(f"'{n}', CAST({v} AS DOUBLE)" for n, v in zip(BOX, box))
    return f"named_struct('kind', '{kind}', 'rings', CAST({rings} AS {RINGS_DDL}), {bounds})"


def point(x: str, y: str) -> str:
    """Point from two coordinates; NULL if either is missing."""
    whole = _geometry("point", "NULL", x, y, x, y)
    return f"CASE WHEN {x} IS NOT NULL AND {y} IS NOT NULL THEN {whole} END"


def polygon(rings: str) -> str:
    """Polygon or multipolygon from polygons -> rings -> vertices, with its bounding box."""
    def build(r: str) -> str:
        xs, ys = (each(f"flatten(flatten({r}))", lambda v, a=a: f"{v}.{a}") for a in "xy")
        bounds = (f"array_min({xs})", f"array_min({ys})", f"array_max({xs})", f"array_max({ys})")
        return f"CASE WHEN {r} IS NOT NULL THEN {_geometry('polygon', r, *bounds)} END"

    return let(rings, build)


def ring_polygon(ring: str) -> str:
    """Polygon from one closed ring."""
    return polygon(f"array(array({ring}))")


def box(xmin: str, ymin: str, xmax: str, ymax: str) -> str:
    """Axis-parallel rectangle."""
    corners = ((xmin, ymin), (xmax, ymin), (xmax, ymax), (xmin, ymax), (xmin, ymin))
    ring = ", ".join(vertex(x, y) for x, y in corners)
    return _geometry("polygon", f"array(array(array({ring})))", xmin, ymin, xmax, ymax)


def disc(lon: str, lat: str, radius_m: str, quarter: int = 30) -> str:
    """Polygon of a Web Mercator circle: ``4 * quarter`` segments, as a map layer would draw it."""
    cx, cy = projection.mercator(lon, lat)
    steps = 4 * quarter

    def at(i: str) -> str:
        turn = f"({i} * {2 * 3.141592653589793 / steps!r}D)"
        x, y = f"{cx} + {radius_m} * cos({turn})", f"{cy} + {radius_m} * sin({turn})"
        return vertex(*projection.mercator_inverse(x, y))

    ring = each(f"sequence(0, {steps - 1})", at)
    return let(ring, lambda r: ring_polygon(f"concat({r}, slice({r}, 1, 1))"))


# -------------------------------------------------------------------- elements

def vertices(g: str) -> str:
    return f"flatten(flatten({g}.rings))"


def _ring_edges(ring: str) -> str:
    last = f"greatest(size({ring}) - 1, 0)"
    return (
        f"zip_with(slice({ring}, 1, {last}), slice({ring}, 2, {last}),"
        " (a, b) -> named_struct('ax', a.x, 'ay', a.y, 'bx', b.x, 'by', b.y))"
    )


def edges(g: str) -> str:
    """All boundary segments as ``array<struct<ax,ay,bx,by>>``."""
    return f"flatten({each(f'flatten({g}.rings)', _ring_edges)})"


def heads(g: str) -> str:
    """First vertex of every ring."""
    return each(f"flatten({g}.rings)", lambda r: f"{r}[0]")


def map_coordinates(g: str, mapping: Mapping) -> str:
    """Apply a coordinate mapping to every vertex and rebuild the box."""
    def move(v: str) -> str:
        return vertex(*mapping(f"{v}.x", f"{v}.y"))

    def whole(v: str) -> str:
        rings = each(f"{v}.rings", lambda part: each(part, lambda ring: each(ring, move)))
        moved = let(vertex(*mapping(f"{v}.xmin", f"{v}.ymin")), lambda q: point(f"{q}.x", f"{q}.y"))
        return f"CASE WHEN {v}.kind = 'point' THEN {moved} ELSE {polygon(rings)} END"

    return let(g, whole)


def is_box(g: str) -> str:
    """Whether a polygon is its bounding box: one closed ring along the sides that meets every corner once."""
    def on_sides(v: str, ring: str) -> str:
        at = {c: f"w.{c} IN ({v}.{c}min, {v}.{c}max)" for c in "xy"}
        corners = f"filter(slice({ring}, 2, size({ring})), w -> {at['x']} AND {at['y']})"
        named = f"transform({corners}, w -> if(w.x = {v}.xmin, 0, 1) + if(w.y = {v}.ymin, 0, 2))"
        along = " OR ".join(f"(e.a{c} = e.b{c} AND e.a{c} IN ({v}.{c}min, {v}.{c}max))" for c in "xy")
        return (
            f"size({ring}) >= 5 AND {ring}[0] = element_at({ring}, -1)"
            f" AND array_sort({named}) = array(0, 1, 2, 3) AND forall({_ring_edges(ring)}, e -> {along})"
        )

    def whole(v: str) -> str:
        sized = " AND ".join(f"{v}.{c}min < {v}.{c}max AND {v}.{c}max < double('Infinity')" for c in "xy")
        one = f"size({v}.rings) = 1 AND size(get({v}.rings, 0)) = 1 AND {sized}"
        return f"CASE WHEN {one} THEN {let(f'{v}.rings[0][0]', lambda r: on_sides(v, r))} ELSE false END"

    return f"coalesce({let(g, whole)}, false)"


# -------------------------------------------------------------------- measures

def _ring_sums(ring: str, origin: str) -> str:
    """Twice the signed area and first moments of a ring, relative to ``origin``.

    Measuring from a nearby vertex keeps small parcels far from the origin exact.
    """
    ax, ay, bx, by = (f"(e.{c} - {origin}.{c[1]})" for c in ("ax", "ay", "bx", "by"))
    cross = f"({ax} * {by} - {bx} * {ay})"
    step = (
        f"named_struct('s', t.s + {cross}, 'mx', t.mx + ({ax} + {bx}) * {cross},"
        f" 'my', t.my + ({ay} + {by}) * {cross})"
    )
    zero = "named_struct('s', 0D, 'mx', 0D, 'my', 0D)"
    return f"aggregate({_ring_edges(ring)}, {zero}, (t, e) -> {step})"


def _first_vertex(rings: str) -> str:
    return f"{rings}[0][0][0]"


def _oriented_sums(rings: str, origin: str) -> str:
    """Per ring sums with outer rings counted positive and holes negative."""
    def orient(t: str, index: str) -> str:
        sign = f"(signum({t}.s) * if({index} = 0, 1D, -1D))"
        return f"named_struct('s', {t}.s * {sign}, 'mx', {t}.mx * {sign}, 'my', {t}.my * {sign})"

    def of_part(part: str) -> str:
        ring, index = _name(), _name()
        return f"transform({part}, ({ring}, {index}) -> {let(_ring_sums(ring, origin), lambda t: orient(t, index))})"

    return f"flatten({each(rings, of_part)})"


def _total(sums: str, name: str) -> str:
    return f"aggregate({sums}, 0D, (acc, t) -> acc + t.{name})"


def area_planar(g: str) -> str:
    """Area in squared coordinate units; holes are subtracted. 0 for a point."""
    def measured(v: str) -> str:
        sums = let(_first_vertex(f"{v}.rings"), lambda o: _total(_oriented_sums(f"{v}.rings", o), "s"))
        return f"CASE WHEN {v}.kind = 'point' THEN 0D ELSE {sums} / 2 END"

    return let(g, measured)


def area_geodesic(g: str) -> str:
    """Area in m^2 on the WGS84 ellipsoid of a longitude/latitude geometry.

    Exact for edges that are straight in the equal-area projection; against geodesic edges
    the difference grows with edge length and is far below 1e-6 for parcels.
    """
    return area_planar(map_coordinates(g, projection.authalic))


def centroid(g: str) -> str:
    """Area-weighted planar centroid as a point geometry; may lie outside a concave polygon."""
    def place(sums: str, o: str) -> str:
        def mean(axis: str) -> str:
            return f"{o}.{axis} + try_divide({_total(sums, 'm' + axis)}, {_total(sums, 's')} * 3)"

        return vertex(mean("x"), mean("y"))

    def centre(rings: str) -> str:
        return let(
            _first_vertex(rings), lambda o: let(_oriented_sums(rings, o), lambda sums: place(sums, o))
        )

    def whole(v: str) -> str:
        middle = let(centre(f"{v}.rings"), lambda c: point(f"{c}.x", f"{c}.y"))
        return f"CASE WHEN {v}.kind = 'point' THEN {v} ELSE {middle} END"

    return let(g, whole)


#: Metres; the radius that spherical geometry libraries use.
SPHERE_RADIUS = 6371010.0


def _sphere_ring(ring: str) -> str:
    """Spherical excess (negative if counter-clockwise) and twice the vector area of a ring, edges as great circles."""
    def on_sphere(lon: str, lat: str) -> str:
        return (
            f"named_struct('l', radians({lon}), 't', tan(radians({lat}) / 2), 'x', cos(radians({lat})) * cos(radians({lon})),"
            f" 'y', cos(radians({lat})) * sin(radians({lon})), 'z', sin(radians({lat})))"
        )

    def step(sums: str, e: str) -> str:
        def with_ends(a: str, b: str) -> str:
            excess = f"2 * atan2(tan(({b}.l - {a}.l) / 2) * ({a}.t + {b}.t), 1 + {a}.t * {b}.t)"
            # a x b as a x (b - a): exact enough for the short edges of a parcel
            gap = {c: f"({b}.{c} - {a}.{c})" for c in "xyz"}
            across = [f"{a}.{p} * {gap[q]} - {a}.{q} * {gap[p]}" for p, q in ("yz", "zx", "xy")]
            normal = f"named_struct('x', {across[0]}, 'y', {across[1]}, 'z', {across[2]})"

            def with_normal(n: str) -> str:
                length = f"sqrt({n}.x * {n}.x + {n}.y * {n}.y + {n}.z * {n}.z)"
                angle = f"atan2({length}, {a}.x * {b}.x + {a}.y * {b}.y + {a}.z * {b}.z)"
                return let(
                    f"coalesce(try_divide({angle}, {length}), 0D)",
                    lambda k: f"named_struct('s', {sums}.s + {excess}, "
                    + ", ".join(f"'{c}', {sums}.{c} + {k} * {n}.{c}" for c in "xyz") + ")",
                )

            return let(normal, with_normal)

        return let(on_sphere(f"{e}.ax", f"{e}.ay"), lambda a: let(on_sphere(f"{e}.bx", f"{e}.by"), lambda b: with_ends(a, b)))

    t, e = _name(), _name()
    zero = "named_struct('s', 0D, 'x', 0D, 'y', 0D, 'z', 0D)"
    return f"aggregate({_ring_edges(ring)}, {zero}, ({t}, {e}) -> {step(t, e)})"


def _sphere_sums(rings: str) -> str:
    """Area on the unit sphere and outward vector area, holes subtracted."""
    r, i, t, v = _name(), _name(), _name(), _name()
    oriented = let(
        _sphere_ring(r),
        lambda q: f"named_struct('s', IF({i} = 0, 1, -1) * abs({q}.s), "
        + ", ".join(f"'{c}', IF({i} = 0, -1, 1) * sign({q}.s) * {q}.{c}" for c in "xyz") + ")",
    )
    every = f"flatten({each(rings, lambda part: f'transform({part}, ({r}, {i}) -> {oriented})')})"
    zero = "named_struct('s', 0D, 'x', 0D, 'y', 0D, 'z', 0D)"
    total = "named_struct(" + ", ".join(f"'{c}', {t}.{c} + {v}.{c}" for c in "sxyz") + ")"
    return f"aggregate({every}, {zero}, ({t}, {v}) -> {total})"


def area_spherical(g: str, radius: float = SPHERE_RADIUS) -> str:
    """Area in m^2 of a longitude/latitude geometry on a sphere, edges as great circles; 0 for a point."""
    def measured(v: str) -> str:
        return f"CASE WHEN {v}.kind = 'point' THEN 0D ELSE {_sphere_sums(f'{v}.rings')}.s * {radius * radius!r}D END"

    return let(g, measured)


def centroid_spherical(g: str) -> str:
    """The point under the mean position vector of a longitude/latitude geometry on the sphere."""
    def centre(s: str) -> str:
        return point(f"degrees(atan2({s}.y, {s}.x))", f"degrees(atan2({s}.z, sqrt({s}.x * {s}.x + {s}.y * {s}.y)))")

    def whole(v: str) -> str:
        return f"CASE WHEN {v}.kind = 'point' THEN {v} ELSE {let(_sphere_sums(f'{v}.rings'), centre)} END"

    return let(g, whole)


def is_valid(g: str) -> str:
    """Every ring closed, of four or more finite vertices, and of non-zero area."""
    def finite(x: str, y: str) -> str:
        return f"(abs({x}) < double('Infinity') AND abs({y}) < double('Infinity'))"

    def ring_ok(r: str) -> str:
        area = let(f"{r}[0]", lambda o: f"{_ring_sums(r, o)}.s")
        return (
            f"size({r}) >= 4 AND {r}[0] = element_at({r}, -1)"
            f" AND forall({r}, w -> coalesce({finite('w.x', 'w.y')}, false)) AND {area} <> 0"
        )

    def check(v: str) -> str:
        box_ok = f"{finite(f'{v}.xmin', f'{v}.ymin')} AND {finite(f'{v}.xmax', f'{v}.ymax')}"
        r = _name()
        rings = f"size(flatten({v}.rings)) > 0 AND forall(flatten({v}.rings), {r} -> {ring_ok(r)})"
        return f"CASE WHEN {v}.kind = 'point' THEN {box_ok} ELSE {box_ok} AND {rings} END"

    return f"coalesce({let(g, check)}, false)"


def invalid_reason(g: str) -> str:
    """Why a geometry is not valid, NULL if it is."""
    def reason(v: str) -> str:
        rings = f"flatten({v}.rings)"
        r = _name()
        return (
            f"CASE WHEN {v} IS NULL THEN 'missing'"
            f" WHEN {is_valid(v)} THEN NULL"
            f" WHEN {v}.kind = 'point' THEN 'not finite'"
            f" WHEN coalesce(size({rings}), 0) <= 0 THEN 'no ring'"
            f" WHEN exists({rings}, {r} -> {r}[0] <> element_at({r}, -1)) THEN 'open ring'"
            f" WHEN exists({rings}, {r} -> size({r}) < 4) THEN 'too few vertices'"
            f" WHEN exists({rings}, {r} -> exists({r}, w -> NOT coalesce(abs(w.x) < double('Infinity') AND abs(w.y) < double('Infinity'), false))) THEN 'not finite'"
            f" ELSE 'no area' END"
        )

    return let(g, reason)


def segments_cross(e: str, f: str) -> str:
    """Whether two segments cross inside both, or share more than a point of one line."""
    def span(axis: str) -> tuple[str, str]:
        low = f"greatest(least({e}.a{axis}, {e}.b{axis}), least({f}.a{axis}, {f}.b{axis}))"
        high = f"least(greatest({e}.a{axis}, {e}.b{axis}), greatest({f}.a{axis}, {f}.b{axis}))"
        return low, high

    (x0, x1), (y0, y1) = span("x"), span("y")

    def side(a: str, b: str, end: str) -> str:
        return f"sign({_cross(a, f'{b}.{end}x', f'{b}.{end}y')})"

    proper = f"{side(e, f, 'a')} * {side(e, f, 'b')} < 0 AND {side(f, e, 'a')} * {side(f, e, 'b')} < 0"
    one_line = f"{side(e, f, 'a')} = 0 AND {side(e, f, 'b')} = 0 AND ({x0} < {x1} OR {y0} < {y1})"
    return f"({x0} <= {x1} AND {y0} <= {y1} AND (({proper}) OR ({one_line})))"


def crossing(g: str) -> str:
    """Whether any two boundary segments cross; compares all of them, so for shapes of few."""
    def pairs(es: str) -> str:
        i, f = _name(), _name()
        later = f"slice({es}, {i} + 1, size({es}))"
        here = let(f"{es}[{i} - 1]", lambda e: f"exists({later}, {f} -> {segments_cross(e, f)})")
        return f"CASE WHEN size({es}) > 1 THEN exists(sequence(1, size({es}) - 1), {i} -> {here}) ELSE false END"

    return f"coalesce({let(edges(g), pairs)}, false)"


def misplaced(g: str) -> str:
    """Why the rings of a shape without crossings do not make one: a hole or a part in the wrong place; else NULL."""
    def ring_edges(r: str) -> str:
        return _ring_edges(r)

    def hole_out(part: str) -> str:
        h = _name()
        shell = let(ring_edges(f"{part}[0]"), lambda es: f"exists(slice({part}, 2, size({part})), {h} -> NOT exists({h}, w -> {contains_point(es, 'w.x', 'w.y')}))")
        return f"(size({part}) > 1 AND {shell})"

    def parts(rings: str) -> str:
        p, q, i, j = _name(), _name(), _name(), _name()
        within = let(ring_edges(f"{p}[0]"), lambda es: f"exists({q}[0], w -> {contains_point(es, 'w.x', 'w.y')})")
        holes = let(
            f"flatten(transform(slice({p}, 2, size({p})), r -> {ring_edges('r')}))",
            lambda es: f"(size({p}) > 1 AND forall({q}[0], w -> {covers_point(es, 'w.x', 'w.y')}))",
        )
        inner = f"exists(transform({rings}, ({q}, {j}) -> {i} <> {j} AND {within} AND NOT {holes}), b -> b)"
        overlap = f"(size({rings}) > 1 AND exists(transform({rings}, ({p}, {i}) -> {inner}), b -> b))"
        h = _name()
        return f"CASE WHEN exists({rings}, {h} -> {hole_out(h)}) THEN 'hole outside its shell' WHEN {overlap} THEN 'overlapping parts' END"

    return f"CASE WHEN {g}.kind <> 'point' THEN {let(f'{g}.rings', parts)} END"


# ------------------------------------------------------------------- canonical

def _canonical_ring(ring: str) -> str:
    """Same point set, one spelling: no repeated or collinear vertex, least vertex first,
    fixed direction, closed."""
    def neighbour(p: str, i: str, step: int) -> str:
        return f"get({p}, ({i} + size({p}) + {step}) % size({p}))"

    def keep(p: str, wanted: Callable[[str, str], str]) -> str:
        v, i = _name(), _name()
        return f"filter({p}, ({v}, {i}) -> {wanted(v, i)})"

    def distinct(p: str) -> str:
        return keep(p, lambda v, i: f"{v} <> {neighbour(p, i, -1)}")

    def corners(p: str) -> str:
        def turns(v: str, i: str) -> str:
            a, b = neighbour(p, i, -1), neighbour(p, i, 1)
            return f"({v}.x - {a}.x) * ({b}.y - {a}.y) <> ({b}.x - {a}.x) * ({v}.y - {a}.y)"

        return keep(p, turns)

    def rotate(p: str) -> str:
        least = f"CAST(array_position({p}, array_min({p})) AS INT)"
        turned = let(least, lambda k: f"concat(slice({p}, {k}, size({p})), slice({p}, 1, {k} - 1))")
        return f"CASE WHEN size({p}) > 0 THEN {turned} ELSE {p} END"

    def direct(p: str) -> str:
        turned = f"concat(slice({p}, 1, 1), reverse(slice({p}, 2, size({p}))))"
        return f"CASE WHEN size({p}) > 2 AND {p}[1] > {p}[size({p}) - 1] THEN {turned} ELSE {p} END"

    out = f"slice({ring}, 1, greatest(size({ring}) - 1, 0))"
    for step in (distinct, corners, rotate, direct):
        out = let(out, step)
    return let(out, lambda p: f"concat({p}, slice({p}, 1, 1))")


def canonical(g: str) -> str:
    """Geometry whose rings are spelled one way, so equal polygons are equal values."""
    def part(rings: str) -> str:
        holes = "array_sort(slice({r}, 2, greatest(size({r}) - 1, 0)))"
        return let(
            each(rings, _canonical_ring), lambda r: f"concat(slice({r}, 1, 1), {holes.format(r=r)})"
        )

    def whole(v: str) -> str:
        rings = f"array_sort({each(f'{v}.rings', part)})"
        bounds = ", ".join(f"'{n}', {v}.{n}" for n in BOX)
        spelled = f"named_struct('kind', {v}.kind, 'rings', {rings}, {bounds})"
        return f"CASE WHEN {v}.kind = 'point' THEN {v} ELSE {spelled} END"

    return let(g, whole)


# ------------------------------------------------------------------ predicates

def _cross(e: str, px: str, py: str) -> str:
    return f"(({e}.bx - {e}.ax) * ({py} - {e}.ay) - ({px} - {e}.ax) * ({e}.by - {e}.ay))"


def _on_edge(e: str, px: str, py: str) -> str:
    return (
        f"({py} >= least({e}.ay, {e}.by) AND {py} <= greatest({e}.ay, {e}.by)"
        f" AND {px} >= least({e}.ax, {e}.bx) AND {px} <= greatest({e}.ax, {e}.bx)"
        f" AND {_cross(e, px, py)} = 0)"
    )


def on_boundary(segments: str, px: str, py: str) -> str:
    return f"exists({segments}, s -> {_on_edge('s', px, py)})"


def _odd_crossings(segments: str, px: str, py: str) -> str:
    """Even-odd rule for a ray towards growing x, without any division."""
    hit = (
        f"(s.ay > {py}) <> (s.by > {py})"
        f" AND {_cross('s', px, py)} * if(s.by > s.ay, 1D, -1D) > 0"
    )
    return f"aggregate({segments}, false, (odd, s) -> odd <> ({hit}))"


def covers_point(segments: str, px: str, py: str) -> str:
    """Point inside or on the boundary."""
    return f"({on_boundary(segments, px, py)} OR {_odd_crossings(segments, px, py)})"


def contains_point(segments: str, px: str, py: str) -> str:
    """Point strictly inside."""
    return f"(NOT {on_boundary(segments, px, py)} AND {_odd_crossings(segments, px, py)})"


def _straddle(e: str, f: str) -> str:
    """Product of the sides of e on which the ends of f lie."""
    return f"signum({_cross(e, f'{f}.ax', f'{f}.ay')}) * signum({_cross(e, f'{f}.bx', f'{f}.by')})"


def _segments_touch(e: str, f: str) -> str:
    """Closed segments share a point: overlapping boxes and mutual straddling."""
    return (
        f"(greatest({e}.ax, {e}.bx) >= least({f}.ax, {f}.bx) AND greatest({f}.ax, {f}.bx) >= least({e}.ax, {e}.bx)"
        f" AND greatest({e}.ay, {e}.by) >= least({f}.ay, {f}.by) AND greatest({f}.ay, {f}.by) >= least({e}.ay, {e}.by)"
        f" AND {_straddle(e, f)} <= 0 AND {_straddle(f, e)} <= 0)"
    )


def _near_box(segments: str, bounds: tuple[str, str, str, str]) -> str:
    """Segments whose own box meets the bounds (xmin, ymin, xmax, ymax)."""
    xmin, ymin, xmax, ymax = bounds
    return (
        f"filter({segments}, s -> greatest(s.ax, s.bx) >= {xmin} AND least(s.ax, s.bx) <= {xmax}"
        f" AND greatest(s.ay, s.by) >= {ymin} AND least(s.ay, s.by) <= {ymax})"
    )


def polygons_intersect(
    a_edges: str, a_heads: str, b_edges: str, a_box: tuple[str, str, str, str]
) -> str:
    """Polygons share a point.

    Without an edge of b in the box of a, all of a is on one side of b and one vertex decides.
    Else, if no boundaries meet, one ring lies wholly inside the other polygon, so one vertex
    of each ring decides; the starts of b's edges stand for its vertices.
    """
    def near(local: str) -> str:
        return (
            f"CASE WHEN size({local}) = 0 THEN {covers_point(b_edges, f'{a_heads}[0].x', f'{a_heads}[0].y')}"
            f" ELSE exists({a_edges}, e -> exists({local}, f -> {_segments_touch('e', 'f')}))"
            f" OR exists({a_heads}, v -> {covers_point(b_edges, 'v.x', 'v.y')})"
            f" OR exists({local}, f -> {covers_point(a_edges, 'f.ax', 'f.ay')}) END"
        )

    return let(_near_box(b_edges, a_box), near)


def _middles(e: str, others: str) -> str:
    """Middles of the pieces into which the vertices of ``others`` cut segment e."""
    dx, dy = f"({e}.bx - {e}.ax)", f"({e}.by - {e}.ay)"
    stops = (
        f"transform(filter({others}, w -> {_on_edge(e, 'w.ax', 'w.ay')}),"
        f" w -> try_divide((w.ax - {e}.ax) * {dx} + (w.ay - {e}.ay) * {dy}, {dx} * {dx} + {dy} * {dy}))"
    )
    return (
        f"transform(array(array_sort(concat(array(0D, 1D), {stops}))), c ->"
        " zip_with(slice(c, 1, size(c) - 1), slice(c, 2, size(c) - 1), (p, q) -> named_struct("
        f"'x', {e}.ax + {dx} * (p + q) / 2, 'y', {e}.ay + {dy} * (p + q) / 2)))[0]"
    )


def _inner_points(segments: str) -> str:
    """One inner point per horizontal band and piece: between two neighbouring vertex heights
    every second gap between the crossings is inside."""
    heights = f"array_sort(array_distinct(transform({segments}, s -> s.ay)))"
    bands = f"transform(array({heights}), h -> zip_with(slice(h, 1, size(h) - 1), slice(h, 2, size(h) - 1), (p, q) -> (p + q) / 2))[0]"
    at = "s.ax + (s.bx - s.ax) * try_divide(y - s.ay, s.by - s.ay)"
    crossings = f"array_sort(transform(filter({segments}, s -> (s.ay > y) <> (s.by > y)), s -> {at}))"
    gaps = (
        f"transform(array({crossings}), c -> filter(zip_with(slice(c, 1, size(c) - 1), slice(c, 2, size(c) - 1),"
        " (p, q) -> named_struct('x', (p + q) / 2, 'y', y)), (g, i) -> i % 2 = 0))[0]"
    )
    return f"flatten(transform({bands}, y -> {gaps}))"


def polygon_contains(a_edges: str, b_edges: str, b_box: tuple[str, str, str, str]) -> str:
    """b lies in a and they share inner points; a common boundary is allowed.

    Without an edge of a in the box of b, all of b is on one side of a and one vertex decides.
    Else the test is exact for concave containers and holes: the boundary of b stays in a (its
    vertices do, no edges cross, and every piece of its edges between touching vertices does)
    and the boundary of a does not enter b. Then every piece of b's inside is wholly in or
    out, and one inner point of each decides.
    """
    crossing = f"{_straddle('e', 'f')} < 0 AND {_straddle('f', 'e')} < 0"

    def near(local: str) -> str:
        exact = (
            f"forall({b_edges}, f -> {covers_point(a_edges, 'f.ax', 'f.ay')})"
            f" AND NOT exists({b_edges}, f -> exists({local}, e -> {crossing}))"
            f" AND forall({b_edges}, f -> forall({_middles('f', local)}, m -> {covers_point(a_edges, 'm.x', 'm.y')}))"
            f" AND NOT exists({local}, e -> exists({_middles('e', b_edges)}, m -> {contains_point(b_edges, 'm.x', 'm.y')}))"
            f" AND forall({_inner_points(b_edges)}, m -> {covers_point(a_edges, 'm.x', 'm.y')})"
        )
        one = covers_point(a_edges, f"{b_edges}[0].ax", f"{b_edges}[0].ay")
        return f"CASE WHEN size({local}) = 0 THEN {one} ELSE {exact} END"

    return let(_near_box(a_edges, b_box), near)


def _distance2(e: str, px: str, py: str) -> str:
    dx, dy = f"({e}.bx - {e}.ax)", f"({e}.by - {e}.ay)"
    along = f"(({px} - {e}.ax) * {dx} + ({py} - {e}.ay) * {dy})"
    t = f"least(greatest(coalesce(try_divide({along}, {dx} * {dx} + {dy} * {dy}), 0D), 0D), 1D)"
    return (
        f"transform(array({t}), t -> pow({px} - {e}.ax - {dx} * t, 2D) + pow({py} - {e}.ay - {dy} * t, 2D))[0]"
    )


def within_distance(segments: str, px: str, py: str, radius: float) -> str:
    """Point inside, or no farther than ``radius`` from the boundary."""
    limit = f"{float(radius) ** 2!r}D"
    return (
        f"(exists({segments}, s -> {_distance2('s', px, py)} <= {limit})"
        f" OR {_odd_crossings(segments, px, py)})"
    )
