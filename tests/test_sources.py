import zlib

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F
from shapes import box, frame, icosphere

from granula import sources
from granula.operators import meshes
from granula.sources import npy, reports, slices, stl, vtu
from granula.streaming import coverage


@pytest.fixture(autouse=True)
def _registered(spark):
    sources.register(spark)


def test_binary_stl_is_split_and_welded(spark, tmp_path, monkeypatch):
    (tmp_path / "a.stl").write_bytes(stl.encode(box((0, 0, 0), (1, 2, 3)), "box") + b"trailing bytes")
    monkeypatch.setattr(stl, "SPLIT_RECORDS", 5)
    rows = spark.read.format("stl").option("path", str(tmp_path)).load()
    assert sorted(r["fid"] for r in rows.collect()) == list(range(12))
    m = meshes.metrics(stl.indexed(rows)).first()
    assert m["reason"] is None and m["volume"] == pytest.approx(6)


def test_ascii_stl(spark, tmp_path):
    text = "solid t\n" + "".join("facet normal 0 0 0\nouter loop\n" + "".join(f"  vertex {x} {y} {z}\n" for x, y, z in t) + "endloop\nendfacet\n" for t in icosphere(0)) + "endsolid\n"
    (tmp_path / "b.STL").write_text(text)
    rows = spark.read.format("stl").option("path", str(tmp_path)).load()
    assert rows.count() == 20


def test_truncated_stl_is_an_error(spark, tmp_path):
    (tmp_path / "c.stl").write_bytes(stl.encode(icosphere(0))[:-1])
    with pytest.raises(Exception, match="truncated"):
        spark.read.format("stl").option("path", str(tmp_path / "c.stl")).load().count()


@pytest.mark.parametrize("bits,signed,order", [(8, False, "little"), (16, True, "big"), (32, False, "little"), (32, True, "big")])
def test_raw_slices(spark, tmp_path, bits, signed, order):
    dt = slices.dtype_of(bits, signed, order)
    for z in range(4):
        (tmp_path / f"s{z:03d}.raw").write_bytes((np.arange(6).reshape(2, 3) + 10 * z).astype(dt).tobytes())
    r = spark.read.format("raw_slices").options(path=str(tmp_path), width="3", height="2", bits=str(bits), signed=str(signed).lower(), byte_order=order, slice_start="1", slice_end="2").load()
    got = r.toPandas().sort_values(["z", "y", "x"])
    assert got.v.tolist() == [*range(10, 16), *range(20, 26)] and got.z.max() == 1


def test_slice_range_refusals():
    assert slices.slice_range(5, -1, -1) == (0, 4)
    for bad in ((3, 2), (0, 5)):
        with pytest.raises(ValueError):
            slices.slice_range(5, *bad)


def test_tiff_round_trip_and_deflate(spark, tmp_path):
    d = spark.range(24).select(F.lit("v").alias("vol"), (F.col("id") % 3).alias("x"), (F.floor(F.col("id") / 3) % 4).alias("y"), F.floor(F.col("id") / 12).alias("z"), (F.col("id") * 7).alias("v"), F.lit(3).alias("nx"), F.lit(4).alias("ny"))
    assert slices.write_slices(d, str(tmp_path), bits=16).count() == 2
    back = spark.read.format("tiff_slices").option("path", str(tmp_path / "v")).load()
    assert back.select("x", "y", "z", "v").exceptAll(d.select("x", "y", "z", "v")).count() == 0 and back.count() == 24
    with pytest.raises(Exception, match="do not fit"):
        slices.write_slices(d.withColumn("v", F.lit(70000)), str(tmp_path / "bad"), bits=16).count()
    page = slices.tiff_pages(slices.tiff_bytes(np.arange(4, dtype="u1").reshape(2, 2)))[0]
    packed = zlib.compress(bytes([1, 2, 3, 4]))
    page = {**page, slices.TAGS["compression"]: (8,), slices.TAGS["strips"]: (0,), slices.TAGS["counts"]: (len(packed),)}
    assert slices.tiff_image(packed, page).tolist() == [[1, 2], [3, 4]]


def test_npy_round_trip(spark, tmp_path):
    a = np.random.default_rng(0).normal(size=(50, 3))
    np.save(tmp_path / "a.npy", a)
    r = spark.read.format("npy").option("path", str(tmp_path / "a.npy")).load().orderBy("row")
    assert np.allclose([x["values"] for x in r.collect()], a)
    df = spark.createDataFrame(pd.DataFrame(a, columns=list("xyz"))).withColumn("row", F.monotonically_increasing_id())
    df = spark.createDataFrame(pd.DataFrame(a, columns=list("xyz")).assign(row=np.arange(50))).repartition(5)
    npy.write_npy(df, "row", list("xyz"), str(tmp_path / "b.npy"))
    assert np.array_equal(np.load(tmp_path / "b.npy"), a)
    with pytest.raises(Exception, match="cannot be read"):
        spark.read.format("npy").options(path=str(tmp_path / "a.npy"), view="index").load().count()


def test_vtu_tables_and_validation(spark, tmp_path):
    pts = np.array([[0, 0, 0], [1, 0, 0], [0, 1, 0], [0, 0, 1]], float)
    text = vtu.document(pts, [[0, 1, 2, 3], [0, 1, 2]], [10, 5], {"t": np.arange(4.0)}, {"region_key": np.array([3, -1])}, {"Counts": np.array([4, 2])})
    (tmp_path / "g.vtu").write_text(text)
    read = lambda t: spark.read.format("vtu").options(path=str(tmp_path / "g.vtu"), table=t).load()
    cells = read("cells").orderBy("id").collect()
    assert [(c["vtk_type"], list(c["nodes"]), (c["attrs"].get("region_key") or c["ints"]["region_key"])[0]) for c in cells] == [(10, [0, 1, 2, 3], 3.0), (5, [0, 1, 2], -1.0)]
    assert read("points").agg(F.sum(F.coalesce(F.col("attrs")["t"][0], F.col("ints")["t"][0].cast("double")))).first()[0] == 6 and read("field").first()["values"] == [4.0, 2.0]
    with pytest.raises(ValueError, match="outside the point list"):
        (tmp_path / "bad.vtu").write_text(vtu.document(pts, [[0, 1, 2, 9]], [10]))
        vtu.load(str(tmp_path / "bad.vtu"))


def test_histogram_csv_rules(spark, tmp_path):
    good = tmp_path / "h.csv"
    good.write_text("bin,right,frequency\n0,,0.25\n1,2,0.25\n2,,0.5\n")
    rows = reports.read_histogram(spark, str(good)).orderBy("bin").collect()
    assert [(r["bin"], r["right"]) for r in rows] == [(0, 1), (1, 2), (2, 3)]
    for text in ("bin,right,frequency\n0,1,0.5\n1,2,0.4\n", "bin,right,frequency\n0,3,0.5\n1,2,0.5\n", "bin,right,frequency\n0,,1\n"):
        good.write_text(text)
        with pytest.raises(ValueError):
            reports.read_histogram(spark, str(good))


def test_png_file(spark, tmp_path):
    lines = spark.createDataFrame([(0, bytearray([255, 0, 0, 255] * 2)), (1, bytearray([0, 0, 255, 255] * 2))], "py int, line binary")
    reports.write_png(lines, str(tmp_path / "i.png"), 2, 2)
    data = (tmp_path / "i.png").read_bytes()
    assert data[:8] == b"\x89PNG\r\n\x1a\n" and data[-8:-4] == b"IEND"
    with pytest.raises(ValueError):
        reports.write_png(lines, str(tmp_path / "i.jpg"), 2, 2)


def test_streamed_coverage_equals_batch_and_resumes(spark, tmp_path):
    first = spark.createDataFrame([(1, 0, 0, 0), (2, 0, 0, 0), (2, 1, 0, 0)], "particle long, ix long, iy long, iz long")
    second = spark.createDataFrame([(1, 0, 0, 0), (2, 1, 0, 0), (2, 2, 0, 0)], first.schema)
    src, out, ck = (str(tmp_path / n) for n in ("moves", "table", "ck"))
    coverage.moves(first.limit(0), first).write.parquet(src)
    coverage.start_to_table(coverage.read_moves(spark, src), out, ck).awaitTermination()
    coverage.moves(first, second).write.mode("append").parquet(src)
    coverage.start_to_table(coverage.read_moves(spark, src), out, ck).awaitTermination()
    got = {(r["ix"], r["cover"]) for r in coverage.current(spark.read.parquet(out)).collect()}
    assert got == {(0, 1), (1, 1), (2, 1)}
    assert frame({1: box((0, 0, 0), (1, 1, 1))}).shape[0] == 12


def _page(packing, predictor, body, w=4, h=1, bits=8):
    tags = slices.TAGS
    return {"endian": "<", tags["width"]: (w,), tags["height"]: (h,), tags["bits"]: (bits,), tags["compression"]: (packing,), tags["predictor"]: (predictor,), tags["strips"]: (0,), tags["counts"]: (len(body),)}


def test_tiff_packings_and_predictor():
    import zlib

    body = zlib.compress(bytes([0, 5, 5, 251]))
    assert slices.tiff_image(body, _page(8, 2, body)).tolist() == [[0, 5, 10, 5]]
    with pytest.raises(ValueError):
        slices.tiff_image(body, _page(8, 3, body))
    body = bytes([254, 7, 0, 9])  # three sevens, one literal nine
    assert slices.tiff_image(body, _page(32773, 1, body)).tolist() == [[7, 7, 7, 9]]
    # Codes: clear, 7, 258 (7 7), 7, end
    bits = "".join(f"{c:09b}" for c in (256, 7, 258, 7, 257))
    body = int(bits.ljust(-(-len(bits) // 8) * 8, "0"), 2).to_bytes(-(-len(bits) // 8), "big")
    assert slices.tiff_image(body, _page(5, 1, body)).tolist() == [[7, 7, 7, 7]]


def test_vtu_keeps_components_and_whole_numbers(spark, tmp_path):
    from granula.sources import vtu

    big = 2 ** 53 + 1
    (tmp_path / "v.vtu").write_text(vtu.document(np.zeros((3, 3)), [[0, 1, 2]], [5], {"u": np.arange(9.0).reshape(3, 3), "id": np.array([1, 2, big])}))
    rows = spark.read.format("vtu").options(path=str(tmp_path / "v.vtu"), table="points").load().orderBy("id").collect()
    assert [r["attrs"]["u"] for r in rows] == [[0.0, 1.0, 2.0], [3.0, 4.0, 5.0], [6.0, 7.0, 8.0]]
    assert rows[2]["ints"]["id"] == [big]


def test_tiff_lzw_round_trip():
    rng = np.random.default_rng(0)
    data = bytes(rng.integers(0, 6, 60_000, np.uint8)) + bytes(rng.integers(0, 256, 20_000, np.uint8))
    start = {bytes([i]): i for i in range(256)}
    table, width, bits, held = None, 9, [f"{256:09b}"], b""
    table = {**start, b"clear": 256, b"the end": 257}
    for c in data:
        grown = held + bytes([c])
        if grown in table and grown not in (b"clear", b"the end"):
            held = grown
            continue
        bits.append(f"{table[held]:0{width}b}")
        table[grown], held = len(table), bytes([c])
        if len(table) > 2 ** width - 1:
            width += 1
        if len(table) == 4_094:
            bits.append(f"{256:0{width}b}")
            table, width = {**start, b"clear": 256, b"the end": 257}, 9
    bits += [f"{table[held]:0{width}b}"]
    if len(table) + 1 > 2 ** width - 1:
        width += 1
    bits.append(f"{257:0{width}b}")
    joined = "".join(bits)
    packed = int(joined.ljust(-(-len(joined) // 8) * 8, "0"), 2).to_bytes(-(-len(joined) // 8), "big")
    assert slices.unpack_lzw(packed) == data


def test_particle_records_round_trip(spark, tmp_path):
    rows = [(f"p{i}", i, i + 3, 0, 1, 0.5 * i, (1.0, 0.0, 0.25, -0.5), [1.0, 2.0, 3.5 * i], 2.0, 4.25) for i in range(5)]
    df = spark.createDataFrame(rows, "entity_id string, acceptance_index bigint, particle bigint, attempt int, shape int, scale double, quaternion struct<w:double,x:double,y:double,z:double>, translation array<double>, equivalent_diameter double, volume double")
    reports.write_records(df, str(tmp_path / "r"))
    assert sorted(map(tuple, reports.read_records(spark, str(tmp_path / "r")).collect())) == sorted(map(tuple, df.collect()))


def _text(faces, end="\n"):
    return "solid t" + end + "".join("facet normal 0 0 0" + end + "outer loop" + end + "".join(f"  vertex {x!r} {y!r} {z!r}{end}" for x, y, z in t) + "endloop" + end + "endfacet" + end for t in faces.tolist()) + "endsolid" + end


@pytest.mark.parametrize("step,end", [(37, "\n"), (256, "\r\n"), (1 << 20, "\n")])
def test_text_stl_cut_anywhere(spark, tmp_path, monkeypatch, step, end):
    """Pieces end inside facets, lines and numbers; ids and faces are those of the whole file."""
    faces = icosphere(0).reshape(-1, 3, 3)
    odd = "vertex 1 2\nvertex 1 2 3 4\nvertex a b c\n  vertex 9 9 9\n"  # three lines that do not count, one vertex too many
    (tmp_path / "a.stl").write_text(_text(faces, end) + odd, newline="")
    (tmp_path / "b.stl").write_bytes(stl.encode(box((0, 0, 0), (1, 2, 3))))
    monkeypatch.setattr(stl, "SPLIT_BYTES", step)
    monkeypatch.setattr(stl, "SPLIT_RECORDS", 5)
    got = stl.load(spark, str(tmp_path)).toPandas().sort_values(["path", "fid"])
    a = got[got.path.str.endswith("a.stl")]
    assert a.fid.tolist() == list(range(20)) and np.array_equal(a[stl.COLUMNS].to_numpy(), faces.reshape(-1, 9))
    assert got[got.path.str.endswith("b.stl")].fid.tolist() == list(range(12))


def test_pieces_of_text_add_up_for_every_length(tmp_path):
    """Without Spark: cuts of every length from 1 to 120 bytes give the same faces."""
    faces = icosphere(0).reshape(-1, 3, 3)[:4]
    path = tmp_path / "a.stl"
    path.write_text(_text(faces))
    size = path.stat().st_size
    for step in range(1, 121):
        before, parts = 0, []
        for s in range(0, size, step):
            parts.append(stl.faces_of(str(path), s, min(s + step, size), before))
            with open(path, "rb") as h:
                before += len(stl.vertices(stl.lines_of(h, s, min(s + step, size))))
        assert np.array_equal(np.concatenate(parts), faces), step


def test_text_that_is_binary_after_all(spark, tmp_path):
    """A binary file whose header looks like text has no vertex lines and is read as binary; a short one is an error."""
    data = bytearray(stl.encode(box((0, 0, 0), (1, 1, 1)), "solid facet vertex"))
    (tmp_path / "a.stl").write_bytes(data)
    assert stl.load(spark, str(tmp_path / "a.stl")).count() == 12
    assert spark.read.format("stl").option("path", str(tmp_path / "a.stl")).load().count() == 12
    (tmp_path / "b.stl").write_text("solid facet vertex\n")
    with pytest.raises(Exception, match="too short"):
        stl.load(spark, str(tmp_path / "b.stl")).count()


@pytest.mark.parametrize("text", [False, True])
def test_one_file_from_many_tasks(spark, tmp_path, text):
    faces = np.concatenate([icosphere(0).reshape(-1, 9), box((0, 0, 0), (1, 2, 3)).reshape(-1, 9)])
    pdf = pd.DataFrame(faces, columns=stl.COLUMNS).assign(fid=np.arange(32) * 3, path=[str(tmp_path / "d" / ("a.stl" if i < 20 else "b.stl")) for i in range(32)])
    files = stl.write_files(spark.createDataFrame(pdf).repartition(5), text=text)
    assert {r["path"][-5:] for r in files.collect()} == {"a.stl", "b.stl"}
    assert sorted(p.name for p in (tmp_path / "d").iterdir()) == ["a.stl", "b.stl"]
    back = stl.load(spark, str(tmp_path / "d")).toPandas().sort_values(["path", "fid"])
    want = faces if text else faces.astype("f4").astype(float)
    assert np.array_equal(back[stl.COLUMNS].to_numpy(), want) and back.fid.tolist() == [*range(20), *range(12)]


def test_writing_nothing_and_nulls(spark, tmp_path):
    pdf = pd.DataFrame(np.zeros((1, 9)), columns=stl.COLUMNS).assign(fid=0, path=str(tmp_path / "a.stl"))
    one = spark.createDataFrame(pdf)
    assert stl.write_files(one.filter("false")).count() == 0 and not list(tmp_path.iterdir())
    with pytest.raises(Exception, match="null"):
        stl.write_files(one.withColumn("by", F.lit(None).cast("double")))


def _volume(spark, vol="a", nx=3, ny=4, nz=3):
    d = spark.range(nx * ny * nz).withColumn("vol", F.lit(vol)).withColumn("v", F.col("id") * 7 - 20)
    return d.select("vol", (F.col("id") % nx).alias("x"), (F.floor(F.col("id") / nx) % ny).alias("y"), F.floor(F.col("id") / (nx * ny)).alias("z"), "v", F.lit(nx).alias("nx"), F.lit(ny).alias("ny"), F.lit(nz).alias("nz"))


@pytest.mark.parametrize("big", [False, True])
def test_stack_of_pages(spark, tmp_path, monkeypatch, big):
    """Files of several pages come back the same, in both forms, whatever the bands; the other reader agrees."""
    monkeypatch.setattr(slices, "BAND", 6)
    if big:
        monkeypatch.setattr(slices, "CLASSIC_BYTES", 10)
    d = _volume(spark).unionByName(_volume(spark, "b"))
    files = slices.write_stacks(d.repartition(5), F.concat(F.lit(str(tmp_path) + "/"), F.col("vol"), F.lit(".tif")), bits=32, signed=True)
    assert files.count() == 2 and sorted(p.name for p in tmp_path.iterdir()) == ["a.tif", "b.tif"]
    data = (tmp_path / "a.tif").read_bytes()
    assert data[2] == (43 if big else 42) and len(slices.tiff_pages(data)) == 3
    want = {(z + 3 * f, y, x): (x + 3 * y + 12 * z) * 7 - 20 for f in range(2) for z in range(3) for y in range(4) for x in range(3)}
    both = slices.load_tiff(spark, str(tmp_path)), spark.read.format("tiff_slices").option("path", str(tmp_path)).load()
    for back in both:
        assert {(r["z"], r["y"], r["x"]): r["v"] for r in back.collect()} == want
    part = slices.load_tiff(spark, str(tmp_path), 2, 3).collect()
    assert {(r["z"] + 2, r["y"], r["x"]): r["v"] for r in part} == {k: v for k, v in want.items() if k[0] in (2, 3)}


def test_stack_gaps_repeats_and_refusals(spark, tmp_path):
    to = lambda n: F.lit(str(tmp_path / n))
    d = _volume(spark).filter("v > 0")
    few = d.filter("z = 1 AND y = 2").withColumn("v", F.when(F.col("x") > 0, F.col("v")))
    assert slices.write_stacks(few.unionByName(few.withColumn("v", F.lit(1))), to("few.tiff"), bits=16).count() == 1
    got = {(r["z"], r["y"], r["x"]): r["v"] for r in slices.load_tiff(spark, str(tmp_path / "few.tiff")).collect() if r["v"]}
    assert got == {(1, 2, x): (x + 18) * 7 - 20 if x else 1 for x in range(3)}
    assert slices.write_stacks(d.filter("false"), to("none.tiff")).count() == 0
    with pytest.raises(Exception, match="do not fit"):
        slices.write_stacks(_volume(spark), to("bad.tiff"), bits=8)
    for bad in (d.withColumn("nz", F.lit(2)), d.withColumn("nx", F.col("x") + 3), d.withColumn("x", F.lit(None).cast("bigint"))):
        with pytest.raises(ValueError, match="outside"):
            slices.write_stacks(bad, to("bad.tiff"), bits=16)
    with pytest.raises(ValueError, match="does not fit"):
        slices.load_tiff(spark, str(tmp_path / "few.tiff"), 1, 3)
    slices.write_stacks(_volume(spark, nx=2), to("other.tiff"), bits=16, signed=True)
    with pytest.raises(ValueError, match="another shape"):
        slices.load_tiff(spark, str(tmp_path))


def _grid(spark, far=5):
    xyz = [(i, i / 3, -0.0, 1e300, {"u": [i * 1.5, float("nan"), 0.1]}, {"id": [(1 << 62) + i]}) for i in range(far)]
    points = spark.createDataFrame(xyz, "id long, x double, y double, z double, attrs map<string,array<double>>, ints map<string,array<bigint>>")
    cells = spark.createDataFrame([(0, 10, [0, 1, 2, 3], {"t": [0.5]}), (1, 5, [4, 2, 0], {"t": [1.5]}), (2, 10, [1, 2, 3, 4], {"t": [2.5]})], "id long, vtk_type int, nodes array<bigint>, attrs map<string,array<double>>")
    return points, cells


def test_appended_vtu_round_trip(spark, tmp_path, monkeypatch):
    """Vectors and 64-bit whole numbers come back bit-equal, rows are written in any order and read in ranges."""
    points, cells = _grid(spark)
    path = str(tmp_path / "out" / "g.vtu")
    assert vtu.write_vtu(points.orderBy(F.desc("id")).repartition(3), cells.orderBy(F.desc("id")), path, {"Counts": np.array([4, 2])}).count() == 1
    monkeypatch.setattr(vtu, "SPLIT_ROWS", 2)
    read = lambda t: spark.read.format("vtu").options(path=path, table=t).load()
    back = read("points").orderBy("id").collect()
    for r, want in zip(back, points.orderBy("id").collect(), strict=True):
        assert repr([r[k] for k in ("id", "x", "y", "z", "attrs", "ints")]) == repr([want[k] for k in ("id", "x", "y", "z", "attrs", "ints")])
    got = [(r["id"], r["vtk_type"], r["nodes"], r["attrs"], r["ints"]) for r in read("cells").orderBy("id").collect()]
    assert got == [(r["id"], r["vtk_type"], r["nodes"], r["attrs"], {}) for r in cells.orderBy("id").collect()]
    assert read("field").first()["values"] == [4.0, 2.0]
    doc = vtu.load(path)
    assert doc["Cells"]["offsets"][1].tolist() == [4, 7, 11] and doc["PointData"]["u"][0] == 3


def test_range_plan_of_appended_vtu(spark, tmp_path, monkeypatch):
    points, cells = _grid(spark)
    path = str(tmp_path / "g.vtu")
    vtu.write_vtu(points, cells, path)
    monkeypatch.setattr(vtu, "SPLIT_ROWS", 2)
    reader = vtu.VtuReader({"path": path, "table": "cells"})
    pieces = reader.partitions()
    assert [(p.start, p.stop) for p in pieces] == [(0, 2), (2, 3)]
    assert [b.column(0).to_pylist() and b.column(3).to_pylist() for p in pieces for b in reader.read(p)] == [[[0, 1, 2, 3], [4, 2, 0]], [[1, 2, 3, 4]]]
    data = (tmp_path / "g.vtu").read_bytes()
    last = data.rfind(np.array([1, 2, 3, 4]).astype("<i8").tobytes()) + 24
    (tmp_path / "g.vtu").write_bytes(data[:last] + np.int64(9).tobytes() + data[last + 8:])
    assert len(list(reader.read(pieces[0]))) == 1
    with pytest.raises(ValueError, match="outside"):
        list(reader.read(pieces[1]))


def test_vtu_sink_edges(spark, tmp_path):
    points, cells = _grid(spark)
    path = str(tmp_path / "g.vtu")
    vtu.write_vtu(points.filter("false"), cells.filter("false"), path)
    assert spark.read.format("vtu").options(path=path, table="points").load().count() == 0
    assert spark.read.format("vtu").options(path=path, table="cells").load().count() == 0
    with pytest.raises(ValueError, match="out of range"):
        vtu.write_vtu(points.filter("id < 4"), cells, path)
    with pytest.raises(ValueError, match="ids"):
        vtu.write_vtu(points.filter("id <> 2"), cells.filter("false"), path)
    with pytest.raises(ValueError, match="array u"):
        vtu.write_vtu(points.withColumn("attrs", F.when(F.col("id") > 0, F.col("attrs"))), cells, path)
    with pytest.raises(Exception, match="twice"):
        vtu.write_vtu(points.withColumn("id", F.when(F.col("id") == 2, 3).otherwise(F.col("id"))), cells.filter("false"), path)


def test_large_unsigned_numbers_are_refused(spark, tmp_path):
    text = vtu.document(np.zeros((3, 3)), [[0, 1, 2]], [5], {"id": np.array([1, 2, 7])}).replace('type="Int64" Name="id"', 'type="UInt64" Name="id"')
    (tmp_path / "u.vtu").write_text(text)
    rows = spark.read.format("vtu").options(path=str(tmp_path / "u.vtu"), table="points").load()
    assert sorted(r["ints"]["id"][0] for r in rows.collect()) == [1, 2, 7]
    (tmp_path / "u.vtu").write_text(text.replace("1 2 7", f"1 2 {1 << 63}"))
    with pytest.raises(Exception, match="bigint"):
        rows.collect()
