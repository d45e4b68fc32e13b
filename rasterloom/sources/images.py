"""Images, masks and requests as tables.

Spark's image source decodes the files; one row of the pixel table is one
pixel.  Images are turned as their orientation tag asks for, and colours under a
matrix profile become sRGB; other profiles count as sRGB.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rasterloom.operators.resample import resize, resized
from rasterloom.operators.tiles import cleaned
from rasterloom.session import materialize
from rasterloom.sources.tags import file_key, read_tags, to_srgb, upright

PIXEL = "image_id string, x int, y int, r int, g int, b int, alpha int, width int, height int"
COVERAGE = (0.5, 98.5)
DETAIL_COVERAGE = (0.0, 95.0)


def scaled_size(width: int, height: int, max_side: int) -> tuple[int, int]:
    """The size that fits the longer side; small images keep theirs."""
    scale = min(1.0, max_side / max(width, height))
    return max(1, round(width * scale)), max(1, round(height * scale))


def decode_rows(rows: pd.DataFrame, max_side: int) -> Iterator[pd.DataFrame]:
    """Pixels of decoded images (Spark's image struct, blue first), upright, as sRGB, transparent parts over white."""
    for image, turn, profile in zip(rows["image"], rows["orientation"], rows["profile"]):
        data = np.frombuffer(image["data"], np.uint8).reshape(image["height"], image["width"], image["nChannels"]).astype(float)
        alpha = data[..., 3:4] if data.shape[-1] == 4 else np.full((*data.shape[:2], 1), 255.0)
        rgb = data[..., :3][..., ::-1] if data.shape[-1] >= 3 else np.repeat(data[..., :1], 3, axis=-1)
        if profile is not None:
            rgb = to_srgb(rgb, profile["matrix"], profile["curves"])
        rgb = rgb * (alpha / 255.0) + 255.0 * (1 - alpha / 255.0)
        rgb, alpha = upright(rgb, turn), upright(alpha, turn)
        width, height = scaled_size(rgb.shape[1], rgb.shape[0], max_side)
        both = resize(np.rint(np.concatenate([rgb, alpha], axis=-1)), width, height, "lanczos").astype(int)
        yy, xx = np.mgrid[:height, :width]
        yield pd.DataFrame({"image_id": image["origin"], "x": xx.ravel(), "y": yy.ravel(), "r": both[..., 0].ravel(), "g": both[..., 1].ravel(), "b": both[..., 2].ravel(), "alpha": both[..., 3].ravel(), "width": width, "height": height})


def read_pixels(spark: SparkSession, path: str, max_side: int = 1200) -> DataFrame:
    """The pixel table of all images below ``path``.

    Orientation and profile come from the files' bytes; only files that have any are joined to the decoded images.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            yield from decode_rows(rows, max_side)

    images = spark.read.format("image").option("dropInvalid", True).load(path).withColumn("_file", file_key("image.origin"))
    tagged = read_tags(spark, path).select(file_key("origin").alias("_file"), "orientation", "profile")
    both = images.join(tagged, "_file", "left").select("image", F.coalesce("orientation", F.lit(1)).alias("orientation"), "profile")
    return both.mapInPandas(run, PIXEL)


def mask_values(pixels: DataFrame, alpha_always: bool = False) -> DataFrame:
    """image_id, x, y and value: alpha where an image has any transparency (or always), else brightness."""
    gray = F.floor((F.col("r") * 299 + F.col("g") * 587 + F.col("b") * 114) / 1000)
    clear = pixels.groupBy("image_id").agg((F.min("alpha") < 255).alias("clear"))
    use_alpha = F.lit(True) if alpha_always else F.col("clear")
    return pixels.join(clear, "image_id").select("image_id", "x", "y", F.when(use_alpha, F.col("alpha")).otherwise(gray).alias("value"))


def mask_of(pixels: DataFrame, threshold: int = 128, alpha_always: bool = False) -> DataFrame:
    """A mask per image: the values of at least ``threshold``."""
    return mask_values(pixels, alpha_always).select("image_id", "x", "y", (F.col("value") >= threshold).alias("mask"))


def sized_mask(pixels: DataFrame, width: int, height: int, threshold: int = 128) -> DataFrame:
    """Masks in another size: values resized by linear weights, cut at ``threshold``, closed, filled and without small components."""
    sized = resized(mask_values(pixels), "value", width, height, "triangle")
    return cleaned(materialize(sized.select("image_id", "x", "y", (F.floor(F.col("value") + 0.5) >= threshold).alias("mask")), "sized-mask"), "mask", "subject")


def coverage(masks: DataFrame, limits: tuple[float, float] = COVERAGE) -> DataFrame:
    """Each mask's share of set pixels in percent, and whether it is within the limits."""
    share = 100.0 * F.count_if("mask") / F.count(F.lit(1))
    return masks.groupBy("image_id").agg(share.alias("coverage"), share.between(*limits).alias("accepted"))


def decode_data_url(url):
    """The bytes behind a data URL's first comma; null where there is none."""
    return F.when(url.startswith("data:") & url.contains(";base64,"), F.try_to_binary(F.element_at(F.split(url, ",", 2), 2), F.lit("base64")))


def parse_requests(requests: DataFrame, column: str, most_bytes: int = 40 * 1024 * 1024) -> DataFrame:
    """Requests with their image's bytes, name and an ``error`` for missing, oversized or unsupported images."""
    field = lambda path: F.get_json_object(column, path)
    data = decode_data_url(field("$.image.dataUrl"))
    suffix = F.lower(F.regexp_extract(F.coalesce(field("$.image.name"), F.lit("")), r"[.]([^.]+)$", 1))
    error = F.when(data.isNull(), "missing image").when(F.octet_length(data) > most_bytes, "image too large").when(~suffix.isin("png", "jpg", "jpeg", ""), "unsupported format")
    return requests.select("*", data.alias("image_data"), field("$.title").alias("title"), error.alias("error"))


def mask_source(pixels: DataFrame, model, schema: str = "image_id string, x int, y int, mask boolean") -> DataFrame:
    """Masks from a model, loaded once per task: ``model()`` gives a function from an image array to a mask array.

    No model is shipped; callers bring their own.
    """
    loaded: list = []

    def run(group: pd.DataFrame) -> pd.DataFrame:
        image = np.zeros((int(group["y"].max()) + 1, int(group["x"].max()) + 1, 3), np.uint8)
        image[group["y"], group["x"]] = group[["r", "g", "b"]]
        if not loaded:
            loaded.append(model())
        return group[["image_id", "x", "y"]].assign(mask=loaded[0](image)[group["y"], group["x"]])

    return pixels.groupBy("image_id").applyInPandas(run, schema)
