"""Project documents: one JSON file as relations, and back."""

from __future__ import annotations

import json
import os
import time
from dataclasses import asdict, dataclass, field, fields

from pyspark.sql import DataFrame, SparkSession

from pyspark.sql import types as T

from panolith import schema
from panolith.schema import Layout, Settings

_EMPTY = {"images": schema.IMAGES, "params": schema.PARAMS, "lenses": schema.LENSES, "control_points": schema.CONTROL_POINTS, "photometric": schema.PHOTOMETRIC, "vignetting": schema.VIGNETTING}


@dataclass
class Project:
    name: str = "untitled"
    tables: dict[str, DataFrame] = field(default_factory=dict)
    layout: Layout | None = None
    settings: Settings = field(default_factory=Settings)
    anchor: int | None = None
    optimized: bool = False
    last_rms: float = 0.0
    created: float = field(default_factory=time.time)


def _struct(ddl: str) -> T.StructType:
    return T._parse_datatype_string(ddl)


def _rows(values: dict | list, ddl: str, key: str, drop: tuple = (), strict: bool = True) -> list[tuple]:
    """Tuples in the order of the DDL; ids come from the keys; an unknown key is an error if strict."""
    names = [f.name for f in _struct(ddl)]
    items = enumerate(values) if isinstance(values, list) else ((int(k), v) for k, v in values.items())
    out = []
    for i, v in items:
        v = {k: x for k, x in v.items() if k not in ("id", *drop)} | {key: i}
        if strict and (extra := set(v) - set(names)):
            raise TypeError(f"unknown keys: {sorted(extra)}")
        out.append({n: v.get(n) for n in names})
    return out


def load(spark: SparkSession, path: str) -> Project:
    """A project document. Its size is that of a hand-made album, so it is read as one value.

    Unknown keys of lenses and settings are left out, of other entities they are an error; missing
    sections are empty; a seam method that isn't known becomes the default.
    """
    doc = json.loads(spark.read.text(path, wholetext=True).first()[0])
    return from_dict(spark, doc)


def from_dict(spark: SparkSession, doc: dict) -> Project:
    names = {f.name for f in fields(Layout)}
    light = {}
    for key, column in (("exposure_ev", "exposure_ev"), ("photo_exposure", "photo_exposure"), ("photo_flare", "photo_flare")):
        for i, v in (doc.get(key) or {}).items():
            light.setdefault(i, {})[column] = float(v)
    tables = {
        "images": _rows(doc.get("images") or {}, schema.IMAGES, "image_id", drop=("name", "is_raw")),
        "params": _rows(doc.get("params") or {}, schema.PARAMS, "image_id"),
        "lenses": _rows(doc.get("lenses") or {}, schema.LENSES, "lens_id", strict=False),
        "control_points": _rows(doc.get("control_points") or [], schema.CONTROL_POINTS, "cp_index"),
        "photometric": _rows(light, schema.PHOTOMETRIC, "image_id"),
        "vignetting": _rows(doc.get("vignetting") or {}, schema.VIGNETTING, "lens_id"),
    }
    frames = {k: spark.createDataFrame([_typed(r, _struct(_EMPTY[k])) for r in rows], _struct(_EMPTY[k])) for k, rows in tables.items()}
    frames["lenses"] = frames["lenses"].fillna(0.0, ["a", "b", "c", "cx", "cy", "shear_x", "shear_y"])
    frames["control_points"] = frames["control_points"].fillna({"kind": "auto", "weight": 1.0, "enabled": True, "error": 0.0})
    lay = doc.get("layout")
    if lay and (extra := set(lay) - names):
        raise TypeError(f"unknown keys: {sorted(extra)}")
    return Project(
        doc.get("name", "untitled"), frames, Layout(**lay) if lay else None, Settings.read(doc.get("settings") or {}), doc.get("anchor"),
        bool(doc.get("optimized")), float(doc.get("last_rms") or 0), float(doc.get("created") or time.time()),
    )


def _typed(row: dict, struct: T.StructType) -> tuple:
    def one(v, kind):
        if v is None:
            return None
        if isinstance(kind, T.DoubleType):
            return float(v)
        if isinstance(kind, T.StructType):
            return tuple(one(v.get(f.name), f.dataType) for f in kind)
        if isinstance(kind, T.ArrayType):
            return [one(x, kind.elementType) for x in v]
        return v

    return tuple(one(row[f.name], f.dataType) for f in struct)


def to_dict(project: Project) -> dict:
    def keyed(table: str, key: str) -> dict:
        rows = [r.asDict(recursive=True) for r in project.tables[table].orderBy(key).collect()]
        return {str(r.pop(key)): {k: v for k, v in r.items() if v is not None} for r in rows}

    light = keyed("photometric", "image_id")
    points = [r.asDict() for r in project.tables["control_points"].orderBy("cp_index").drop("cp_index").collect()]
    return {
        "name": project.name,
        **{k: keyed(k, key) for k, key in (("images", "image_id"), ("params", "image_id"), ("lenses", "lens_id"), ("vignetting", "lens_id"))},
        "control_points": points,
        **{k: {i: v[k] for i, v in light.items() if k in v} for k in ("exposure_ev", "photo_exposure", "photo_flare")},
        "layout": asdict(project.layout) if project.layout else None,
        "settings": asdict(project.settings),
        "anchor": project.anchor,
        "optimized": project.optimized,
        "last_rms": project.last_rms,
        "created": project.created,
        "modified": time.time(),
    }


def save(project: Project, path: str) -> None:
    """Writes the document beside its place, then moves it there."""
    with open(f"{path}.tmp", "w", encoding="utf-8") as out:
        json.dump(to_dict(project), out, ensure_ascii=False, indent=1)
    os.replace(f"{path}.tmp", path)


def fingerprint(project: Project) -> str:
    """A digest of what the drawn panorama depends on, whatever the order of rows; the angles of view aren't part of it."""
    doc = to_dict(project)
    keep = {k: doc[k] for k in ("images", "params", "lenses", "vignetting", "photo_exposure", "photo_flare", "exposure_ev")}
    keep["settings"] = {k: v for k, v in doc["settings"].items() if k not in ("hfov", "vfov", "out_width", "quality", "format", "scale_percent")}
    import hashlib

    return hashlib.sha1(json.dumps(keep, sort_keys=True).encode()).hexdigest()


def patch_settings(project: Project, **values) -> Project:
    """New settings; another projection drops the canvas and, unless given too, the angles of view."""
    from dataclasses import replace

    from panolith.functions.geometry import FOV_MAX

    old = project.settings
    new = Settings.read(asdict(old) | values)
    if new.projection != old.projection:
        project.layout = None
        if "hfov" not in values and "vfov" not in values:
            new = replace(new, hfov=0.0, vfov=0.0)
    if "hfov" in values or "vfov" in values:
        hm, vm = FOV_MAX.get(new.projection, (360.0, 180.0))
        new = replace(new, hfov=min(max(new.hfov, 1.0), hm) if new.hfov else 0.0, vfov=min(max(new.vfov, 1.0), vm) if new.vfov else 0.0)
    project.settings = new
    return project
