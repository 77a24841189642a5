"""Relations of a panorama project as Spark DDL, their enumerations and settings."""

from __future__ import annotations

from dataclasses import dataclass, fields

# Names of the enumerations.
LENS_PROJECTIONS = ("rectilinear", "fisheye", "equirect", "stereographic", "orthographic")
PANO_PROJECTIONS = ("equirect", "cylindrical", "rectilinear", "mercator", "stereographic", "fisheye")
POINT_KINDS = ("auto", "manual", "vertical", "horizontal")
PAIR_KINDS, LINE_KINDS = ("auto", "manual"), ("vertical", "horizontal")

EXIF = (
    "struct<focal_length:double,focal_35:double,fnumber:double,iso:double,exposure_time:double,make:string,model:string,"
    "lens:string,datetime:string,orientation:int,fp_x_res:double,fp_unit:double,exif_w:double>"
)
IMAGES = f"image_id int, path string, width int, height int, proxy_width int, proxy_height int, exif {EXIF}, fov_hint double, fov_source string, enabled boolean"
PARAMS = "image_id int, yaw double, pitch double, roll double, lens_id int, exposure double, white_balance array<double>"
LENSES = "lens_id int, fov double, projection string, a double, b double, c double, cx double, cy double, shear_x double, shear_y double"
CONTROL_POINTS = "cp_index long, img_a int, img_b int, xa double, ya double, xb double, yb double, kind string, weight double, enabled boolean, error double"
PHOTOMETRIC = "image_id int, exposure_ev double, photo_exposure double, photo_flare double"
VIGNETTING = "lens_id int, a double, b double, c double"
PIXELS = "image_id int, x int, y int, b int, g int, r int"
PATCHES = "image_id int, x0 int, y0 int, w int, h int, bgr binary, mask binary"


@dataclass(frozen=True)
class Settings:
    """Output settings of a project."""

    projection: str = "equirect"
    hfov: float = 0.0
    vfov: float = 0.0
    blender: str = "multiband"
    num_bands: int = 0
    seam: str = "dp_color_grad"
    exposure: str = "none"
    per_channel: bool = False
    vignetting: bool = False
    low_freq: float = 0.0
    scale_percent: float = 100.0
    out_width: int = 0
    gpano: bool = True
    patch_nadir: bool = False
    fill_gaps: bool = False
    max_dim: int = 0
    format: str = "jpg"
    quality: int = 94
    interpolation: str = "cubic"

    @classmethod
    def read(cls, values: dict) -> Settings:
        """Unknown keys are left out; a seam method that isn't known becomes the default one."""
        known = {f.name for f in fields(cls)}
        out = {k: v for k, v in values.items() if k in known}
        if out.get("seam") not in (None, "none", "distance", "dp_color_grad", "graphcut"):
            out["seam"] = "dp_color_grad"
        return cls(**out)


@dataclass(frozen=True)
class Layout:
    """A virtual canvas of full_w x full_h that spans hfov degrees, and the part of it that is drawn."""

    projection: str = "equirect"
    full_w: int = 0
    full_h: int = 0
    hfov: float = 360.0
    center_yaw: float = 0.0
    center_pitch: float = 0.0
    center_roll: float = 0.0
    x0: int = 0
    y0: int = 0
    w: int = 0
    h: int = 0
