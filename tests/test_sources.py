import pytest
from pyspark.sql import functions as F

from parcelgrid.functions import geometry as geo
from parcelgrid.plans import impact
from parcelgrid.sources import geojson, json_blocks, tables


def test_geojson_files(spark, tmp_path):
    lines = [
        '{', '"type": "FeatureCollection",', '"features": [',
        '{ "type": "Feature", "properties": { "apn": "0012", "area": 4.5 }, "geometry": { "type": "Polygon", "coordinates": [ [ [ 0, 0, 7 ], [ 2, 0, 7 ], [ 2, 2, 7 ], [ 0, 0, 7 ] ] ] } },',
        '{ "type": "Feature", "properties": { "apn": "0013", "area": null }, "geometry": { "type": "MultiPolygon", "coordinates": [ [ [ [ 0, 0 ], [ 1, 0 ], [ 1, 1 ], [ 0, 0 ] ] ], [ [ [ 5, 5 ], [ 6, 5 ], [ 6, 6 ], [ 5, 5 ] ] ] ] } },',
        '{ "type": "Feature", "properties": { "apn": "0014", "area": 1 }, "geometry": { "type": "Point", "coordinates": [ -118.5, 34.25 ] } }',
        ']', '}',
    ]
    path = tmp_path / "in.geojson"
    path.write_text("\n".join(lines))
    for layout in ("lines", "document"):
        df = geojson.read_geojson(spark, str(path), "apn string, area double", layout)
        rows = {r.apn: r for r in df.select("*", F.expr(geo.area_planar("geometry")).alias("a")).collect()}
        assert rows["0012"].a == 2.0 and rows["0012"].area == 4.5
        assert rows["0013"].a == 1.0 and rows["0013"].area is None and len(rows["0013"].geometry.rings) == 2
        assert rows["0014"].geometry.xmin == -118.5 and rows["0014"].geometry.kind == "point"
    out = str(tmp_path / "out")
    impact.export_selection(df, out)
    geojson.write_geojson(df, out)  # overwrites
    back = geojson.read_geojson(spark, out, "apn string, area double")
    assert sorted(map(str, back.collect())) == sorted(map(str, df.collect()))


def test_wkt(spark):
    texts = [
        "POINT (1.5 -2)", "POINT Z (1 2 3)", "POLYGON ((0 0, 2 0, 2 2, 0 0))",
        "POLYGON Z ((0 0 1,2 0 1,2 2 1,0 0 1),(1 0.5 1, 1.5 0.5 1, 1.5 0.75 1, 1 0.5 1))",
        "MULTIPOLYGON (((0 0, 1 0, 1 1, 0 0)), ((5e0 5, 6 5, 6 6, 5 5)))",
    ]
    df = spark.createDataFrame([(t,) for t in texts], "wkt string")
    got = [r for r in df.select(F.expr(tables.geometry_from_wkt("wkt")).alias("g"), "wkt").collect()]
    assert (got[0].g.xmin, got[0].g.ymin, got[1].g.ymin) == (1.5, -2.0, 2.0)
    areas = df.select(F.expr(geo.area_planar(tables.geometry_from_wkt("wkt"))).alias("a")).collect()
    assert [r.a for r in areas] == [0.0, 0.0, 2.0, 2.0 - 0.0625, 1.0]


def test_csv_with_preamble(spark, tmp_path):
    path = tmp_path / "inventory.csv"
    path.write_text(
        "Model: x\nRegion: y\n\nUnits: miles\nVehicle Category,Total VMT,NOx_TOTEX,PM2.5_Total\nMDV,10.5,1,2\nT7, 3,,4\n"
    )
    df = tables.read_csv_skip(spark, str(path), 4, {"vehicle_category": "string"})
    assert df.columns == ["vehicle_category", "total_vmt", "n_ox_totex", "pm2_5_total"]
    assert [tuple(r) for r in df.collect()] == [("MDV", 10.5, 1.0, 2.0), ("T7", 3.0, None, 4.0)]
    tables.write_csv(df, str(tmp_path / "out.csv"))
    assert tables.read_table(spark, str(tmp_path / "out.csv")).count() == 2


def test_serving_snapshot_prunes_columns_and_boxes(spark, tmp_path):
    rows = spark.range(2000).selectExpr("CAST(id AS STRING) AS apn", "'Orange County' AS county", "id / 100D AS x", "id % 50 / 100D AS y")
    table = rows.select("apn", "county", F.expr(geo.box("x", "y", "x + 0.01D", "y + 0.01D")).alias("geometry"))
    tables.save_serving({"parcels": table, "names": rows.select("apn")}, str(tmp_path))
    tables.write_parcels(table, str(tmp_path / "by_county"))
    assert spark.read.parquet(str(tmp_path / "by_county")).count() == 2000
    back = tables.load_serving(spark, str(tmp_path), ["parcels", "names"])["parcels"]
    assert back.count() == 2000
    boxed = back.where("geometry.xmin >= 3 AND geometry.xmax <= 4").select("apn")
    plan = boxed._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(geometry.xmin,3.0)" in plan
    assert "rings" not in plan.split("ReadSchema")[1]


def test_materialise_uses_the_shared_folder(spark):
    folder = tables.scratch_folder(spark)
    out = tables.materialise(spark.range(5).selectExpr("id", "id * 2 AS twice"))
    assert out.count() == 5
    if spark.conf.get("spark.checkpoint.dir", None):
        assert folder in out.inputFiles()[0]


FEATURES = [
    '{"type":"Feature","properties":{"apn":"%d","note":"] } , {"},"geometry":{"type":"Point","coordinates":[%d,2]}}' % (i, i)
    for i in range(3)
]


def _layouts():
    one, two, three = FEATURES
    head, tail = '{"type":"FeatureCollection","name":"a","features":[', "]}"
    spread = ",\n".join(f.replace(',"geometry"', ',\n"geometry"').replace('"type":"Feature",', '\n "type": "Feature",\n') for f in FEATURES)
    return {
        "one_line": f"{head}{one},{two},{three}{tail}",
        "first_on_head": f"{head}{one},\n{two},\n{three}{tail}",
        "two_on_a_line": f"{head}\n{one},{two},\n{three}\n{tail}",
        "one_spread_feature": f"{head}{spread}{tail}",
    }


def test_geojson_layouts_lose_nothing(spark, tmp_path):
    for name, text in _layouts().items():
        path = tmp_path / f"{name}.geojson"
        path.write_text(text)
        for layout in ("auto", "document") + (("lines",) if name != "one_spread_feature" else ()):
            rows = geojson.read_geojson(spark, str(path), "apn string", layout).collect()
            assert sorted(r.apn for r in rows) == ["0", "1", "2"], (name, layout)
    assert geojson.read_geojson(spark, str(tmp_path), "apn string", "auto").count() == 12


def test_geojson_refuses_what_it_cannot_read(spark, tmp_path):
    path = tmp_path / "spread.geojson"
    path.write_text(_layouts()["one_spread_feature"])
    with pytest.raises(Exception, match="spreads over lines"):
        geojson.read_geojson(spark, str(path), "apn string").count()
    (tmp_path / "cut.geojson").write_text(_layouts()["one_spread_feature"][:-20])
    with pytest.raises(Exception, match="could not be read"):
        geojson.read_geojson(spark, str(tmp_path / "cut.geojson"), "apn string", "document").collect()


def test_csv_preamble_is_dropped_by_position_in_each_file(spark, tmp_path):
    (tmp_path / "a.csv").write_text('Model: A\nMDV,1,2\n"Vehicle, Category",Trips,VMT\nMDV,1,2\nT7,3,4\n')
    (tmp_path / "b.csv").write_text('Model: B longer preamble\nT7,3,4\n"Vehicle, Category",Trips,VMT\nModel: A,5,6\n')
    df = tables.read_csv_skip(spark, str(tmp_path), 2, {"vehicle_category": "string"})
    assert df.columns == ["vehicle_category", "trips", "vmt"]
    assert sorted(map(tuple, df.collect())) == [("MDV", 1.0, 2.0), ("Model: A", 5.0, 6.0), ("T7", 3.0, 4.0)]
    (tmp_path / "c.csv").write_text("x\ny\nOther,Header,Here\n1,2,3\n")
    with pytest.raises(ValueError, match="share one header"):
        tables.read_csv_skip(spark, str(tmp_path), 2)


def test_layer_of_other_shapes_is_an_error(spark, tmp_path):
    path = str(tmp_path / "layer")
    spark.createDataFrame([("POINT (1 2)",), ("LINESTRING (0 0, 1 1)",), (None,)], "wkt string").write.parquet(path)
    with pytest.raises(Exception, match="could not be read"):
        tables.read_layer(spark, path).collect()
    assert tables.read_layer(spark, path, unreadable="null").where("geometry IS NULL").count() == 2


def _pretty(features, indent=1):
    import json

    collection = {
        "type": "FeatureCollection", "name": 'a } "quoted\\" ] name',
        "crs": {"type": "name", "properties": {"name": "urn:ogc:def:crs:OGC:1.3:CRS84"}},
        "features": features, "links": [{"href": "x"}, {"href": "y"}],
    }
    return json.dumps(collection, indent=indent)


def _feature(i):
    return {
        "type": "Feature",
        "properties": {"apn": str(i), "note": '{ "}\\" [' + "\\" * (i % 3), "more": {"deep": {"er": [[i], {"x": i}]}}},
        "geometry": {"type": "Polygon", "coordinates": [[[i, 0], [i + 1, 0], [i + 1, 1], [i, 0]]]},
    }


def test_spread_documents_are_cut_by_many_tasks(spark, tmp_path):
    """Pretty-printed, on one line, newline-delimited and spread single features, over many small blocks."""
    import json

    features = [_feature(i) for i in range(100)]
    texts = {
        "pretty": _pretty(features), "wide": _pretty(features, 7), "one_line": _pretty(features, None),
        "delimited": "\n".join(json.dumps(f) for f in features) + "\n", "single_objects": "\n".join(json.dumps(f, indent=2) for f in features),
        "no_features": _pretty([]), "record_separated": "".join("\x1e" + json.dumps(f) + "\n" for f in features),
    }
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    cost = spark.conf.get("spark.sql.files.openCostInBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "6000")
    spark.conf.set("spark.sql.files.openCostInBytes", "100")
    try:
        for name, text in texts.items():
            path = tmp_path / f"{name}.geojson"
            path.write_text(text)
            want = [] if name == "no_features" else [str(i) for i in range(100)]
            for layout in ("document", "auto") if name in ("pretty", "delimited") else ("auto",):
                read = geojson.read_geojson(spark, str(path), "apn string, note string", layout)
                rows = {r.apn: r for r in read.collect()}
                assert sorted(rows, key=int) == want, (name, layout)
                assert all(r.geometry.xmin == int(k) and r.note.startswith('{ "}') for k, r in rows.items())
        blocks = json_blocks.raw_pieces(spark, str(tmp_path / "pretty.geojson"))
        assert blocks.select("start").distinct().count() > 5 and blocks.rdd.getNumPartitions() > 5
        every = geojson.read_geojson(spark, str(tmp_path), "apn string", "auto")
        assert every.count() == 6 * 100
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
        spark.conf.set("spark.sql.files.openCostInBytes", cost)


@pytest.mark.parametrize("cut", [1, 2, 3, 40, 200])
def test_a_cut_document_is_an_error(spark, tmp_path, cut):
    path = tmp_path / "cut.geojson"
    path.write_text(_pretty([_feature(i) for i in range(5)])[:-cut])
    with pytest.raises(Exception, match="could not be read"):
        geojson.read_geojson(spark, str(path), "apn string", "document").collect()


def test_type_and_feature_on_two_lines(spark, tmp_path):
    path = tmp_path / "a.geojson"
    path.write_text('{ "type":\n "Feature", "properties": {"apn": "1"},\n "geometry": {"type": "Point", "coordinates": [1, 2]}}')
    assert [r.apn for r in geojson.read_geojson(spark, str(path), "apn string", "auto").collect()] == ["1"]
    with pytest.raises(ValueError, match="spreads over lines"):
        geojson.read_geojson(spark, str(path), "apn string", "lines")


@pytest.mark.parametrize(
    ("properties", "shape"),
    [
        ('{"n": 1}', '{"type": "LineString", "coordinates": [[0, 0], [1, 1]]}'),
        ('{"n": 1}', '{"type": "GeometryCollection", "geometries": []}'),
        ('{"n": 1}', '{"type": "Polygon", "coordinates": [[[0, 0], [1, 0], [1, "x"], [0, 0]]]}'),
        ('{"n": "zz"}', '{"type": "Point", "coordinates": [1, 2]}'),
    ],
)
def test_features_that_would_lose_something_are_errors(spark, tmp_path, properties, shape):
    path = tmp_path / "a.geojson"
    good = '{"type":"Feature","properties":{"n":7},"geometry":null}'
    path.write_text(f'{good}\n{{"type":"Feature","properties":{properties},"geometry":{shape}}}\n')
    for layout in ("lines", "document"):
        with pytest.raises(Exception, match="could not be read|FAILFAST|MALFORMED"):
            geojson.read_geojson(spark, str(path), "n int", layout).collect()
        rows = geojson.read_geojson(spark, str(path), "n int", layout, unreadable="null").collect()
        assert len(rows) == 2 and [r.n for r in rows if r.n == 7] == [7]


def test_a_position_that_is_no_number_is_an_error(spark, tmp_path):
    path = str(tmp_path / "layer")
    spark.createDataFrame([("POLYGON((0 0,1 0,1 x,0 0))",), ("POINT (1 2)",)], "wkt string").write.parquet(path)
    with pytest.raises(Exception, match="could not be read"):
        tables.read_layer(spark, path).collect()
    assert [r.geometry is None for r in tables.read_layer(spark, path, unreadable="null").orderBy("geometry").collect()] == [True, False]


def test_csv_rows_that_do_not_fit_are_told(spark, tmp_path):
    path = tmp_path / "in.csv"
    path.write_text("A,B\n1,2\nq,4\n5\n6,7,8\n,9\n")
    with pytest.raises(Exception, match="does not fit its header"):
        tables.read_csv_skip(spark, str(path), 0).collect()
    rows = tables.read_csv_skip(spark, str(path), 0, unreadable="keep")
    assert sorted(r._corrupt_record for r in rows.where("_corrupt_record IS NOT NULL").collect()) == ["5", "6,7,8", "q,4"]
    assert sorted((str(r.a), r.b) for r in rows.where("_corrupt_record IS NULL").collect()) == [("1.0", 2.0), ("None", 9.0)]


def _wkb(shape, order="<", size=2, style="iso", srid=None):
    import struct

    kind = {"POINT": 1, "LINESTRING": 2, "POLYGON": 3, "MULTIPOINT": 4, "MULTIPOLYGON": 6, "COLLECTION": 7}[shape[0]]
    code = kind + ({2: 0, 3: 1000, 4: 3000}[size] if style == "iso" else {2: 0, 3: 0x80000000, 4: 0xC0000000}[size])
    out = struct.pack("B", order == "<") + struct.pack(f"{order}I", code | (0x20000000 if srid else 0))
    out += struct.pack(f"{order}I", srid) if srid else b""
    positions = lambda ps: b"".join(struct.pack(f"{order}{size}d", *p, *[9.0] * (size - 2)) for p in ps)
    if shape[0] == "POINT":
        return out + positions([shape[1]])
    out += struct.pack(f"{order}I", len(shape[1]))
    if shape[0] == "LINESTRING":
        return out + positions(shape[1])
    if shape[0] == "POLYGON":
        return out + b"".join(struct.pack(f"{order}I", len(r)) + positions(r) for r in shape[1])
    return out + b"".join(_wkb(s, order, size, style) for s in shape[1])


SQUARE = [[(0, 0), (2, 0), (2, 2), (0, 2), (0, 0)], [(0.5, 0.5), (1, 0.5), (1, 1), (0.5, 0.5)]]
FAR = [[(5, 5), (6, 5), (6, 6), (5, 5)]]


def test_wkb_in_every_spelling(spark, tmp_path):
    rows = []
    for order in "<>":
        for size in (2, 3, 4):
            for style in ("iso", "flags"):
                for srid in (None, 4326) if style == "flags" else (None,):
                    how = (order, size, style, srid)
                    rows.append(("point", bytearray(_wkb(("POINT", (1.5, -2)), *how))))
                    rows.append(("square", bytearray(_wkb(("POLYGON", SQUARE), *how))))
                    rows.append(("both", bytearray(_wkb(("MULTIPOLYGON", [("POLYGON", SQUARE), ("POLYGON", FAR)]), *how))))
    rows += [("none", None), ("both", bytearray(_wkb(("COLLECTION", [("MULTIPOLYGON", [("POLYGON", SQUARE)]), ("POLYGON", FAR)])))), ("point", bytearray(_wkb(("MULTIPOINT", [("POINT", (1.5, -2))]))))]
    path = str(tmp_path / "layer")
    spark.createDataFrame(rows, "wkb_x string, shape binary").repartition(3).write.parquet(path)
    read = tables.read_layer(spark, path, "shape", "wkb")
    assert read.columns == ["wkb_x", "geometry"]
    want = {
        "point": ("point", 1.5, -2.0, 1.5, -2.0, None, 0.0), "none": (None,) * 7,
        "square": ("polygon", 0.0, 0.0, 2.0, 2.0, [[5, 4]], 3.875), "both": ("polygon", 0.0, 0.0, 6.0, 6.0, [[5, 4], [4]], 4.375),
    }
    got = read.withColumn("area", F.expr(geo.area_planar("geometry"))).collect()
    assert len(got) == len(rows)
    for r in got:
        g = r.geometry
        sizes = None if g is None or g.rings is None else [[len(ring) for ring in p] for p in g.rings]
        own = (None,) * 7 if g is None else (g.kind, g.xmin, g.ymin, g.xmax, g.ymax, sizes, r.area)
        assert own == want[r.wkb_x]
        if r.wkb_x in ("square", "both"):
            assert [[(v.x, v.y) for v in ring] for ring in g.rings[0]] == SQUARE


@pytest.mark.parametrize(
    "data",
    [
        _wkb(("LINESTRING", [(0, 0), (1, 1)])), _wkb(("POLYGON", SQUARE))[:-3], _wkb(("POLYGON", SQUARE)) + b"\0", _wkb(("POINT", (1, float("nan")))),
        _wkb(("MULTIPOINT", [("POINT", (1, 2)), ("POINT", (3, 4))])), _wkb(("COLLECTION", [("POINT", (1, 2)), ("POLYGON", SQUARE)])), b"", b"\x02" * 30,
        b"\x01\x03\x00\x00\x00\x01\x00\x00\x00\xff\xff\xff\xff",
    ],
)
def test_wkb_of_another_kind_is_an_error(spark, tmp_path, data):
    path = str(tmp_path / "layer")
    spark.createDataFrame([(1, bytearray(data)), (2, bytearray(_wkb(("POINT", (1, 2)))))], "n int, shape binary").coalesce(1).write.parquet(path)
    with pytest.raises(Exception, match="could not be read"):
        tables.read_layer(spark, path, "shape", "wkb").collect()
    got = {r.n: r.geometry for r in tables.read_layer(spark, path, "shape", "wkb", unreadable="null").collect()}
    assert got[1] is None and got[2].ymax == 2.0


def test_collections_are_valid_files_put_in_place_whole(spark, tmp_path):
    import json

    path = str(tmp_path / "out")
    rows = spark.range(50).repartition(3).select("id", F.expr(geo.box("id", "0", "id + 1", "1")).alias("geometry"))
    geojson.write_collections(rows, path)
    files = sorted((tmp_path / "out").glob("part-*"))
    held = [json.loads(f.read_text()) for f in files]
    assert len(files) == 3 and all(h["type"] == "FeatureCollection" for h in held)
    assert sorted(f["properties"]["id"] for h in held for f in h["features"]) == list(range(50))
    for layout in ("lines", "document"):
        assert sorted(r.id for r in geojson.read_geojson(spark, path, "id long", layout).collect()) == list(range(50))
    with pytest.raises(Exception, match="no luck"):
        geojson.write_collections(rows.withColumn("id", F.expr("IF(id = 7, raise_error('no luck'), id)")), path)
    assert sorted(f.name for f in (tmp_path / "out").glob("part-*")) == [f.name for f in files]
    geojson.write_collections(rows.limit(0), path)
    (only,) = (tmp_path / "out").glob("part-*")
    assert json.loads(only.read_text())["features"] == []
    assert geojson.read_geojson(spark, path, "id long", "auto").count() == 0


def test_parts_of_features_are_not_tried(spark, monkeypatch):
    """Only lines that begin with a brace and close one are parsed; other parts of features are told by their brackets."""
    lines = ['{"type":', ' "Feature","geometry":{"type":"Point","coordinates":[1,2]},', ' "properties":{"a":1}},', '\t{"type":"Feature","geometry":null,"properties":{}},']
    df = spark.createDataFrame([(i, v) for i, v in enumerate(lines)], "i int, value string")
    parsed = geojson._line_features("value").split(" THEN ", 1)
    assert "RLIKE" in parsed[0]
    tried = df.where(F.expr(parsed[0].removeprefix("CASE WHEN "))).collect()
    assert [r["i"] for r in tried] == [3]
    whole = df.select("i", F.expr(geojson._line_features("value")).alias("f")).where("f IS NOT NULL").collect()
    assert [(r["i"], len(r["f"])) for r in whole] == [(3, 1)]


def test_features_are_parsed_once(spark, tmp_path):
    """A filter pushed below the parsing would repeat it; texts are cleaned in one place of the plan."""
    (tmp_path / "a.json").write_text('{"type": "FeatureCollection",\n"features": [\n{"type":\n "Feature", "geometry": {"type": "Point", "coordinates": [1, 2]},\n "properties": {"note": "a } \\" ] {"}}\n]\n}\n')
    read = geojson.read_geojson(spark, str(tmp_path), "note string", "document")
    plan = read._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("holds features that could not be read") == 1
    assert [(r["note"], r["geometry"]["xmin"]) for r in read.collect()] == [('a } " ] {', 1.0)]
