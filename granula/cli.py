"""Command line: ``python -m granula.cli <command> --config file.yaml`` (or through spark-submit)."""

from __future__ import annotations

import argparse
import json
import platform
from pathlib import Path

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from . import __version__, sources
from .functions import stats
from .operators import locate, meshes, nearest, scene
from .operators.ordered import numbered
from .plans import jobs
from .session import cut
from .sources import npy, reports, slices, stl

COMMANDS = ("measure", "split-filter", "scale", "forge", "crop", "render", "mesh-render", "closest", "state-map", "pack", "version")


class ConfigError(ValueError):
    """A configuration that cannot be run."""


def load_config(path: str, block: str) -> dict:
    """One block of a YAML file; relative paths in it start at the file's folder."""
    import yaml

    doc = yaml.safe_load(Path(path).read_text())
    if not isinstance(doc, dict) or block not in doc:
        raise ConfigError(f"{path}: missing block {block!r}")
    return {**doc[block], "_dir": str(Path(path).resolve().parent)}


def resolve(cfg: dict, written: str) -> str:
    return str(Path(written) if Path(written).is_absolute() else Path(cfg["_dir"]) / written)


def number(value) -> float:
    """Numbers may be written as text with underscores."""
    return float(value.replace("_", "")) if isinstance(value, str) else float(value)


def box_of(values) -> tuple[list[float], list[float]]:
    """Three numbers are a size from the origin, six are two corners."""
    v = [number(x) for x in values]
    if len(v) == 3:
        return [0.0, 0.0, 0.0], v
    if len(v) == 6:
        return v[:3], v[3:]
    raise ConfigError(f"a box needs 3 or 6 numbers, not {len(v)}")


def read_mesh(spark, path: str):
    """A file, or all files of a folder as one mesh, welded."""
    rows = stl.load(spark, path)
    whole = numbered(rows, [], ["path", "fid"], "n").withColumn("fid", F.col("n").cast("bigint") - 1).withColumn("mesh", F.lit(0))
    return cut(stl.indexed(whole, "mesh"))


def write_mesh(tri, path: str) -> None:
    tri.select(*stl.COLUMNS).write.format("stl").mode("append").option("path", path).save()


def extent(tri) -> tuple[list[float], list[float]]:
    b = meshes.bbox(tri, []).first()
    return [b[k + "0"] for k in "xyz"], [b[k + "1"] for k in "xyz"]


def measure(spark, cfg):
    """Volume fraction and S2 curves of a mesh as a text file: exact, Monte Carlo or both."""
    tri = read_mesh(spark, resolve(cfg, cfg["stl_path"]))
    given = cfg.get("bounding_box") or cfg.get("stl_bounding_box")
    lo, hi = box_of(given) if given else extent(tri)
    asked = str(cfg.get("mc_method", "exact")).strip().lower()
    method = asked if asked in ("exact", "both") else "monte_carlo"
    try:
        got = jobs.measurement(tri, lo, hi, int(number(cfg["r_max"])), number(cfg["voxel_pitch"]), method, int(number(cfg.get("mc_samples") or 10_000)), int(cfg.get("seed", 0)))
    except ValueError as wrong:
        raise ConfigError(str(wrong)) from None
    fraction = got.volume_fraction.first()[0]
    path = Path(resolve(cfg, cfg["output_path"]))
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(reports.measurement_text(fraction, got.curves, got.l2.first()[0] if got.l2 is not None else None))
    return {"particles": got.particles, "volume_fraction": fraction, "method": method}


def split_filter(spark, cfg):
    f = cfg.get("filter") or {}
    f = f if f.get("enabled", True) else {}
    v = f.get("volume") or {}
    mode = v.get("mode", "none")
    if mode not in ("none", "range", "lognormal_rebalance"):
        raise ConfigError(f"unknown volume mode {mode!r}")
    tri = read_mesh(spark, resolve(cfg, cfg["input"]["path"]))
    kept, report = jobs.split_filter(
        tri, f.get("max_aspect_ratio"), f.get("max_sharpness_ratio"), (v.get("min", -1), v.get("max", -1)) if mode == "range" else None,
        {"bins": v.get("bins", 12), "over_factor": v.get("over_factor", 1.25), "seed": int(v.get("seed", 0))} if mode == "lognormal_rebalance" else None)
    lab = tri.join(meshes.face_shells(tri, ["mesh_id"]), ["mesh_id", "fid"]).join(kept.select("mesh_id", "shell"), ["mesh_id", "shell"], "left_semi")
    write_mesh(lab, resolve(cfg, cfg["output"]["folder"]))
    reports.write_json(resolve(cfg, cfg["output"].get("report_path", "split_filter_report.json")), [r.asDict() for r in report.orderBy("step").collect()])


def scale(spark, cfg):
    tri = read_mesh(spark, resolve(cfg, cfg["input_path"]))
    write_mesh(jobs.scale(tri, cfg["type"], number(cfg["value"])), resolve(cfg, cfg["output_path"]))


def forge(spark, cfg):
    tri = read_mesh(spark, resolve(cfg, cfg["input_stl_path"]))
    tri = cut(tri.join(meshes.face_shells(tri, ["mesh_id"]), ["mesh_id", "fid"]).withColumnRenamed("shell", "part"))
    lo, hi = box_of(cfg["roi_bounding_box"]) if cfg.get("roi_bounding_box") else extent(tri)
    out, before, after = jobs.forge(tri, number(cfg.get("compression_ratio", 0.2)), number(cfg.get("bulge_factor", 0.5)), lo, hi)
    write_mesh(out, resolve(cfg, cfg.get("output_stl_path", "forged_mesh")))
    return {"volume_fraction_before": before, "volume_fraction_after": after}


def crop(spark, cfg):
    i, o = cfg["input"], cfg["output"]
    raw = {k: str(v).lower() if isinstance(v, bool) else str(v) for k, v in (i.get("raw") or {}).items()}
    opts = {"path": resolve(cfg, i["path"]), "slice_start": str(i.get("slice_start", -1)), "slice_end": str(i.get("slice_end", -1)), **raw}
    rows = (spark.read.format("raw_slices").options(**opts).load() if i["type"] == "raw" else
            slices.load_tiff(spark, opts["path"], int(opts["slice_start"]), int(opts["slice_end"])))
    out = jobs.crop(cut(slices.volume_rows(rows)), cfg.get("interpolation", "trilinear"), int(cfg.get("edge_trim", 0)))
    from .operators.volumes import dims

    out = cut(out)
    out, target = out.join(dims(out), "vol"), resolve(cfg, o["path"])
    kept = {"bits": int(raw.get("bits", 16)), "signed": raw.get("signed") == "true"}
    if target.lower().endswith((".tif", ".tiff")):
        return {"files": slices.write_stacks(out, F.lit(target), **kept).count()}
    return {"files": slices.write_slices(out, target, prefix=o.get("folder_prefix", "slice"), **kept).count()}


def render(spark, cfg):
    tri = read_mesh(spark, resolve(cfg, cfg["stl_path"]))
    lo, hi = extent(tri)
    w, h = int(cfg.get("width", 1024)), int(cfg.get("height", 1024))
    cam = scene.camera(lo, hi, cfg["view_direction"], cfg.get("up_vector"), w, h, cfg.get("projection", "orthographic"), cfg.get("perspective_fov_degrees", 45.0),
                       cfg.get("fit_padding", 0.05), cfg.get("camera_distance"), cfg.get("focus_point"))
    near = scene.nearest_hit(scene.ray_hits(tri, cam, w, h, []), [])
    light = scene.shade(F.col("cosine"), 0.25)
    rgb = stats.categorical_color(F.lit(0))
    px = near.select("px", "py", *(F.round(rgb[i] * light).cast("int").alias(c) for i, c in enumerate("rgb")))
    reports.write_png(scene.image(px, w, h, ["r", "g", "b"], (255, 255, 255, 255)), resolve(cfg, cfg.get("output_path", "rendered.png")), w, h)


def _view(spec):
    """(name, what render_view takes, focus) of a view given by name or by vectors."""
    if isinstance(spec, str):
        if spec.strip().lower() not in scene.VIEWS:
            raise ConfigError(f"unknown views: {spec}")
        return spec.strip().lower(), spec.strip().lower(), None
    if unknown := sorted(set(spec) - {"name", "view_direction", "focus_point", "up_vector"}):
        raise ConfigError(f"view has unknown keys: {', '.join(unknown)}")
    three = {k: [number(v) for v in spec[k]] for k in ("view_direction", "focus_point", "up_vector") if spec.get(k) is not None}
    if any(len(v) != 3 for v in three.values()) or "name" not in spec or "view_direction" not in three:
        raise ConfigError("a view of its own needs a name and vectors of three numbers")
    return spec["name"], (three["view_direction"], three.get("up_vector")), three.get("focus_point")


def _colour(cfg, key, sizes=(3,)):
    if (got := cfg.get(key)) is None:
        return None
    if len(got) not in sizes or any(not 0 <= int(v) <= 255 for v in got):
        raise ConfigError(f"{key} needs {' or '.join(map(str, sizes))} numbers from 0 to 255")
    return [int(v) for v in got]


def _share(value):
    return min(max(number(value), 0.0), 1.0)


def mesh_render(spark, cfg):
    """VTU document to one PNG per view: filters, colours, opacities, wireframe, highlighted points, cameras."""
    path = resolve(cfg, cfg["input_path"])
    views = [_view(v) for v in cfg.get("views") or list(scene.VIEWS)]
    background = ((_colour(cfg, "background", (3, 4)) or [255, 255, 255]) + [255])[:4]
    cells, points = (cut(spark.read.format("vtu").options(path=path, table=t).load()) for t in ("cells", "points"))
    filters = [(f["kind"], {k: v for k, v in f.items() if k != "kind"}) for f in cfg.get("filters") or []]
    uniform = _colour(cfg, "uniform_color")
    by = cfg.get("color_by")
    if isinstance(by, str) and by.lower() == "uniform":
        by, uniform = None, uniform or [140, 160, 190]
    opacity = _share(cfg.get("volume_opacity", cfg.get("opacity", 1.0)))
    limits = tuple(None if cfg.get(k) is None else number(cfg[k]) for k in ("scalar_min", "scalar_max"))
    try:
        overrides = {int(k): _share(v) for k, v in (cfg.get("opacity_overrides") or {}).items()}
    except ValueError:
        raise ConfigError("keys of opacity_overrides are whole numbers of regions") from None
    try:
        tri = cut(jobs.scene_triangles(cells, points, filters, by, cfg.get("color_mode", "categorical") == "scalar", opacity, _share(cfg.get("face_opacity", opacity)),
                                       overrides, uniform if by is None else None, limits, bool(cfg.get("show_faces", True))))
    except ValueError as wrong:
        raise ConfigError(str(wrong)) from None
    segments = cut(jobs.wire_segments(cells, points, filters, cfg.get("max_wireframe_edges"))) if cfg.get("wireframe") else None
    marks = [[number(v) for v in p] for p in cfg.get("highlight_points") or []]
    if any(len(p) != 3 for p in marks):
        raise ConfigError("highlight_points are lists of three numbers")
    markers = spark.createDataFrame([(i, *p, 220, 20, 20) for i, p in enumerate(marks)], "sid long, x double, y double, z double, r int, g int, b int") if marks else None
    frame_box = cfg.get("frame_box")
    box = ([number(v) for v in frame_box["min"]], [number(v) for v in frame_box["max"]]) if frame_box else jobs.extent(points)
    lens = {"projection": cfg.get("projection", "orthographic"), "fov_degrees": number(cfg.get("perspective_fov_degrees", 45.0)), "padding": number(cfg.get("fit_padding", 0.05)),
            "distance": None if cfg.get("camera_distance") is None else number(cfg["camera_distance"])}
    w, h = int(cfg.get("width", 1024)), int(cfg.get("height", 1024))
    out = Path(resolve(cfg, cfg["output_dir"]))
    for name, view, focus in views:
        lines = jobs.render_view(tri, view, w, h, background, number(cfg.get("ambient", 0.25)), box, segments, markers, focus=focus, **lens)
        reports.write_png(lines, str(out / f"{name}.png"), w, h)
    return {"triangles": tri.count(), "views": [name for name, *_ in views], **({"segments": segments.count()} if segments is not None else {})}


def _array(spark, cfg, key, view="float"):
    return spark.read.format("npy").options(path=resolve(cfg, cfg[key]), view=view).load()


def _points(spark, cfg, key):
    return _array(spark, cfg, key).select(F.col("row").alias("qid"), *(F.col("values")[i].alias(k) for i, k in enumerate("xyz")))


def _corners(spark, cfg, cells, points, names, id_name):
    """Wide rows with corner coordinates from index and vertex arrays."""
    out = _array(spark, cfg, cells, "index").select(F.col("row").alias(id_name), *(F.col("values")[i].alias("i" + p) for i, p in enumerate(names)))
    size = _array(spark, cfg, points).agg(F.count("*").alias("n"), F.count_if(F.exists("values", lambda x: F.isnan(x) | (F.abs(x) == float("inf")))).alias("bad")).first()
    if size["bad"]:
        raise ConfigError(f"{points}: {size['bad']} rows hold a coordinate that is not finite")
    wrong = out.filter(F.greatest(*("i" + p for p in names)) >= size["n"]).unionByName(out.filter(F.least(*("i" + p for p in names)) < 0)).count()
    if wrong:
        raise ConfigError(f"{cells}: {wrong} rows name a vertex outside {points}")
    for p in names:
        v = _points(spark, cfg, points).select(F.col("qid").alias("i" + p), *(F.col(k).alias(p + k) for k in "xyz"))
        out = out.join(v, "i" + p)
    return out


def closest(spark, cfg):
    if bool(cfg.get("triangles")) == bool(cfg.get("segments")):
        raise ConfigError("give triangles or segments, not both")
    kind, names = ("triangle", "abc") if cfg.get("triangles") else ("segment", "ab")
    prims = _corners(spark, cfg, "triangles" if kind == "triangle" else "segments", "vertices", names, "pid")
    prims, queries = cut(prims), _points(spark, cfg, "queries")
    got = nearest.nearest(queries, prims, kind=kind)
    got = cut(nearest.closest_points(got, queries, prims, kind=kind))
    out = Path(resolve(cfg, cfg["output_dir"]))
    npy.write_npy(got, "qid", ["cx", "cy", "cz"], str(out / "closest.npy"))
    npy.write_npy(got, "qid", ["primitive"], str(out / "primitive.npy"), integer=True)
    npy.write_npy(got, "qid", ["distance"], str(out / "distance.npy"))
    far = got.agg(F.count("*").alias("queries"), F.max("distance").alias("max_distance"), F.avg("distance").alias("mean_distance")).first().asDict()
    reports.write_json(str(out / "report.json"), {"kind": kind, **far})
    return far


def state_map(spark, cfg):
    tets = _corners(spark, cfg, "source_cells", "source_points", "abcd", "tid")
    got = cut(locate.locate(_points(spark, cfg, "query_points"), tets, bound=number(cfg["fallback_distance"])))
    out = Path(resolve(cfg, cfg["output_dir"]))
    npy.write_npy(got, "qid", ["donor"], str(out / "donors.npy"), integer=True)
    npy.write_npy(got, "qid", ["distance"], str(out / "distances.npy"))
    report = locate.counts(got).first().asDict()
    reports.write_json(str(out / "report.json"), report)
    return report


def pack(spark, cfg):
    """Sizes are truncated-lognormal quantiles of counter-based draws, largest first."""
    from .functions.rng import u01

    tri = read_mesh(spark, resolve(cfg, cfg["shapes"]))
    tri = tri.join(meshes.face_shells(tri, ["mesh_id"]), ["mesh_id", "fid"]).withColumnRenamed("shell", "part")
    shapes, shape_tri = jobs.shape_library(tri)
    lo, hi = box_of(cfg["domain"])
    d = cfg["size"]
    x = stats.inverse_normal_cdf(u01(cfg["seed"], "size", F.col("id")))
    size = F.greatest(F.least(F.exp(x * d["sigma"]) * d["median"], F.lit(float(d["max"]))), F.lit(float(d["min"])))
    sizes = numbered(spark.range(int(cfg["particles"])).select("id", size.alias("diameter")), [], [F.col("diameter").desc(), F.col("id")], "particle").select("particle", "diameter")
    rec = cut(jobs.pack(shapes, shape_tri, sizes, lo, hi, cfg["seed"], int(cfg.get("attempts", 4)), number(cfg.get("gap", 0.0)), cfg.get("volume_fraction")))
    out = Path(resolve(cfg, cfg["output_dir"]))
    reports.write_records(rec, str(out / "particles"))
    write_mesh(jobs.rebuild(rec, shape_tri), str(out / "particles_stl"))
    return {"accepted": rec.count()}


def version() -> dict:
    return {"name": "granula", "version": __version__, "python": platform.python_version(), "host": platform.machine(), "commit": None}


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="granula")
    p.add_argument("command", choices=COMMANDS)
    p.add_argument("--config")
    a = p.parse_args(argv)
    if a.command == "version":
        print(json.dumps(version()))
        return 0
    if not a.config:
        p.error("--config is required")
    spark = SparkSession.builder.appName(f"granula {a.command}").getOrCreate()
    sources.register(spark)
    block = a.command.replace("-", "_")
    result = {c.replace("-", "_"): globals()[c.replace("-", "_")] for c in COMMANDS}[block](spark, load_config(a.config, block))
    if result:
        print(json.dumps(result))
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
