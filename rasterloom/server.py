"""A small HTTP front: ``GET /health``, ``POST /mask`` and ``POST /generate`` with JSON bodies."""

from __future__ import annotations

import base64
import json
import math
import os
from dataclasses import replace
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

import numpy as np
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from rasterloom.functions import sheet
from rasterloom.operators.kernels import mask_overlay
from rasterloom.plans.config import Config
from rasterloom.plans.sheets import sheets, stats
from rasterloom.session import materialize, scratch_scope, write_bytes
from rasterloom.sources import images, zones
from rasterloom.sources.sinks import png

MOST_BODY = 64 * 1024 * 1024
MOST_IMAGE = 40 * 1024 * 1024
#: Uploaded masks are read up to this side before they are brought to the image's size.
MOST_MASK_SIDE = 4096


class RequestError(ValueError):
    def __init__(self, message: str, status: int = 400):
        super().__init__(message)
        self.status = status


def decode_url(value: object) -> bytes:
    try:
        head, data = str(value).split(",", 1)
        raw = base64.b64decode(data, validate=True)
    except ValueError as error:
        raise RequestError("not a data URL") from error
    if not head.startswith("data:") or len(raw) > MOST_IMAGE:
        raise RequestError("not an image, or too large", 413 if len(raw) > MOST_IMAGE else 400)
    return raw


def config_of(body: dict) -> Config:
    """A request's parameters over its complexity preset; values out of range are drawn in or left at their default."""
    values = dict(zip(sheet.PRESET_FIELDS, sheet.PRESETS.get(body.get("complexity"), sheet.PRESETS["default"])))
    number = lambda key, low, high, default: min(high, max(low, float(body[key]))) if isinstance(body.get(key), (int, float)) and math.isfinite(body[key]) else default
    values |= {
        "colors": int(number("colors", 2, 40, 24)), "palette_merge_delta_e": number("paletteMergeDeltaE", 0, 12, 4.0), "contour_simplify_mm": number("contourSimplifyMm", 0, 0.5, 0.1),
        "line_art_detail": number("lineArtDetail", 0, 1, 0.65), "line_art_enabled": str(body.get("lineArtEnabled", True)).strip().lower() not in ("0", "false", "non", "off"),
        "page_format": "a3" if str(body.get("format")).lower() == "a3" else "a4", "orientation": "landscape" if str(body.get("orientation")).lower() in ("paysage", "landscape") else "portrait",
        "palette_layout": "inline" if str(body.get("paletteLayout")).lower() == "inline" else "separate", "title": str(body.get("title") or Config.title), "max_side": int(number("maxSide", 256, 2400, 1200)),
    }
    return Config.from_mapping(values).checked()


def _pixels(spark: SparkSession, raw: bytes, max_side: int):
    """The pixels of an uploaded image; the upload stays in the shared folder, so lost executors can read it again."""
    rows = images.read_pixels(spark, write_bytes(spark, "upload.png", raw), max_side)
    if rows.isEmpty():
        raise RequestError("the image cannot be read")
    return rows


def _url(kind: str, data: bytes) -> str:
    return f"data:{kind};base64," + base64.b64encode(bytes(data)).decode()


def _detail(spark: SparkSession, body: dict, width: int, height: int):
    """The pixels of the request's detail zones."""
    asked = zones.parse_zones(spark.createDataFrame([(json.dumps(body),)], "body string"), "body")
    if error := asked.first()["error"]:
        raise RequestError(error)
    each = asked.select(F.explode("zones").alias("z")).select("z.mode", F.transform("z.points", lambda p: F.struct((p["x"] * width).alias("x"), (p["y"] * height).alias("y"))).alias("points"), (zones.brush_width(F.col("z.radius"), width, height) / 2).alias("radius"))
    return zones.fill_polygon(each.where("mode = 'outline'"), width, height).unionByName(zones.rasterize(each.where("mode <> 'outline' or size(points) < 3"), width, height)).distinct()


def _subject(spark: SparkSession, raw: bytes, width: int, height: int, threshold: int):
    """The pixels of an uploaded mask in the image's size; masks of almost nothing or almost everything are refused."""
    found = materialize(images.sized_mask(_pixels(spark, raw, MOST_MASK_SIDE), width, height, threshold), "subject")
    cover = images.coverage(found.withColumnRenamed("subject", "mask")).first()
    if not cover["accepted"]:
        raise RequestError(f"the mask covers {cover['coverage']:.1f} % of the image")
    return found.select("x", "y", "subject")


def generate(spark: SparkSession, body: dict) -> dict:
    config = config_of(body)
    pixels = materialize(_pixels(spark, decode_url((body.get("image") or {}).get("dataUrl")), config.max_side), "pixels")
    size = pixels.select("width", "height").first()
    if body.get("subjectMaskImage"):
        mask = _subject(spark, decode_url(body["subjectMaskImage"]), size["width"], size["height"], config.mask_threshold)
        pixels = pixels.join(mask, ["x", "y"], "left").na.fill(False, ["subject"])
        config = replace(config, subject_mode="manual").checked()
    if body.get("detailZones"):
        inside = materialize(_detail(spark, body, size["width"], size["height"]), "detail")
        cover = 100.0 * inside.count() / (size["width"] * size["height"])
        if not images.DETAIL_COVERAGE[0] < cover <= images.DETAIL_COVERAGE[1]:
            raise RequestError(f"the detail zones cover {cover:.1f} % of the image")
        pixels = pixels.join(inside.withColumn("detail", F.lit(True)), ["x", "y"], "left").na.fill(False, ["detail"])
    made = materialize(sheets(pixels, config), "sheets")
    sheet, report = made.first(), stats(made, config).select(F.to_json(F.struct("*"))).first()[0]
    palette = [{"number": c["palette_index"] + 1, "hex": c["hex"], "rgb": [int(c["hex"][i : i + 2], 16) for i in (1, 3, 5)]} for c in sheet["palette"]]
    shown = lambda name: _url("image/png", sheet["images"][name]) if name in sheet["images"] else None
    return {
        "ok": True, "stats": json.loads(report), "actualColors": len(palette), "regionsAfter": len(sheet["regions"]), "palette": palette, "coloringPreviewImage": shown("coloring"), "modelPreviewImage": shown("model"), "palettePageImage": shown("palette_page"),
        "pdfDocument": _url("application/pdf", sheet["pdf"]), "maskControlImage": shown("subject_overlay"), "detailMaskImage": shown("detail_mask"), "svg": sheet["svg"],
    }


def _side(asked: object) -> int:
    """The longer side that a request asks for, within bounds."""
    return int(min(2400, max(256, asked))) if isinstance(asked, (int, float)) and math.isfinite(asked) else 1200


def mask(spark: SparkSession, body: dict) -> dict:
    """The subject mask, its control image and its coverage; one out of range falls back to the whole image."""
    pixels = materialize(_pixels(spark, decode_url((body.get("image") or {}).get("dataUrl")), _side(body.get("maxSide"))), "pixels")
    masks = images.mask_of(pixels)
    found = images.coverage(masks).first()
    rgb = (pixels.select("image_id", "x", "y", "r", "g", "b").join(masks, ["image_id", "x", "y"])).toPandas()
    shape = (int(rgb["y"].max()) + 1, int(rgb["x"].max()) + 1)
    image, own = np.zeros((*shape, 3)), np.zeros(shape, bool)
    image[rgb["y"], rgb["x"]], own[rgb["y"], rgb["x"]] = rgb[["r", "g", "b"]], rgb["mask"] | (not found["accepted"])
    return {
        "ok": True, "source": {"width": shape[1], "height": shape[0]}, "subject": {"mode": "manual" if found["accepted"] else "global", "coverage_percent": found["coverage"]},
        "subjectMaskImage": _url("image/png", png(own * 255)), "maskControlImage": _url("image/png", png(mask_overlay(image, own))),
    }


def handler(spark: SparkSession) -> type[BaseHTTPRequestHandler]:
    class Handler(BaseHTTPRequestHandler):
        def log_message(self, *_):
            pass

        def _reply(self, status: int, payload: dict) -> None:
            data = json.dumps(payload).encode()
            self.send_response(status)
            for name, value in (("Content-Type", "application/json"), ("Content-Length", str(len(data))), ("Access-Control-Allow-Origin", "*"), ("Access-Control-Allow-Headers", "Content-Type")):
                self.send_header(name, value)
            self.end_headers()
            self.wfile.write(data)

        def do_OPTIONS(self):
            self._reply(200, {"ok": True})

        def do_GET(self):
            self._reply(200, {"ok": True}) if self.path == "/health" else self._reply(404, {"ok": False})

        def do_POST(self):
            routes = {"/generate": generate, "/mask": mask}
            try:
                size = int(self.headers.get("Content-Length") or 0)
                if self.path not in routes:
                    raise RequestError("not found", 404)
                if not 0 < size <= MOST_BODY:
                    raise RequestError("the body is empty or too large", 413)
                body = json.loads(self.rfile.read(size))
                if not isinstance(body, dict):
                    raise RequestError("the body is not an object")
                with scratch_scope():  # uploads and tables of this request go with it
                    answer = routes[self.path](spark, body)
                self._reply(200, answer)
            except RequestError as error:
                self._reply(error.status, {"ok": False, "error": str(error)})
            except ValueError as error:
                self._reply(400, {"ok": False, "error": str(error)})

    return Handler


def serve(spark: SparkSession, host: str = "127.0.0.1", port: int = 8765) -> ThreadingHTTPServer:
    return ThreadingHTTPServer((host, port), handler(spark))


def main() -> None:
    from rasterloom.session import build_session

    with serve(build_session("rasterloom-server"), os.environ.get("RASTERLOOM_HOST", "127.0.0.1"), int(os.environ.get("RASTERLOOM_PORT", "8765"))) as server:
        server.serve_forever()


if __name__ == "__main__":
    main()
