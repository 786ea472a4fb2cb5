"""Pixels before detection: opaque, square, without noise, upright, black and white; and lines drawn on them.

A row is an image: width, height, channels and `pixels`, a byte for each channel of each pixel, row by row. Decoders give
such rows; each image is worked on by itself, in Arrow batches, so nothing is shuffled.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from papyra.operators.detection import homography
from papyra.operators.inference import _own
from papyra.options import PreprocessingOptions

# fixed values: brightness above which content counts as light, resolutions' difference that matters, skew that is looked for and that is undone
LIGHT, SQUARE_TOLERANCE, MOST_SKEW, LEAST_SKEW = 160.0, 0.15, 15.0, 0.1
#: The blur's deviation, the threshold's share of the mean around a pixel, and that surrounding's share of the width.
SIGMA, BELOW_MEAN, WINDOW_SHARE = 0.6, 0.85, 8
_GREY = np.array([0.299, 0.587, 0.114])


def luminance(image: np.ndarray) -> np.ndarray:
    if image.ndim == 2:
        return image.astype(float)
    return image[..., :3] @ _GREY if image.shape[2] > 2 else image[..., 0].astype(float)


def flatten_alpha(image: np.ndarray) -> np.ndarray:
    """An image with an alpha channel on a background that its visible content stands out from: black under light content, else white."""
    if image.shape[2] != 4:
        return image
    alpha = image[..., 3].astype(np.int64)
    colour = image[..., :3].astype(np.int64)
    total = alpha.sum()
    ground = 0 if total and (luminance(colour) * alpha).sum() / total > LIGHT else 255
    a = alpha[..., None]
    return ((colour * a + ground * (255 - a) + 127) // 255).astype(np.uint8)


def square_scale(x_resolution: float, y_resolution: float) -> tuple[float, float]:
    """How far each axis is stretched so that pixels are square; not at all if resolutions are unknown or alike."""
    if not (0 < x_resolution < math.inf and 0 < y_resolution < math.inf) or abs(x_resolution / y_resolution - 1) <= SQUARE_TOLERANCE:
        return 1.0, 1.0
    top = max(x_resolution, y_resolution)
    return top / x_resolution, top / y_resolution


def resize(image: np.ndarray, width: int, height: int) -> np.ndarray:
    """Bilinear, pixel centres on pixel centres, edges repeated."""
    out = image.astype(float)
    for axis, size in ((0, height), (1, width)):
        n = out.shape[axis]
        at = np.clip((np.arange(size) + 0.5) * n / size - 0.5, 0, n - 1)
        low = np.floor(at).astype(int)
        share = (at - low).reshape([-1 if k == axis else 1 for k in range(out.ndim)])
        out = np.take(out, low, axis) * (1 - share) + np.take(out, np.minimum(low + 1, n - 1), axis) * share
    return np.rint(out).clip(0, 255).astype(np.uint8)


def blur(image: np.ndarray, sigma: float = SIGMA) -> np.ndarray:
    """Gaussian, axis by axis, edges repeated."""
    radius = max(1, math.ceil(3 * sigma))
    kernel = np.exp(-0.5 * (np.arange(-radius, radius + 1) / sigma) ** 2)
    kernel /= kernel.sum()
    out = image.astype(float)
    for axis in (0, 1):
        n = out.shape[axis]
        out = sum(k * np.take(out, np.clip(np.arange(n) + i - radius, 0, n - 1), axis) for i, k in enumerate(kernel))
    return np.rint(out).clip(0, 255).astype(np.uint8)


def binarize(image: np.ndarray, below: float = BELOW_MEAN) -> np.ndarray:
    """White where a pixel is not darker than a share of the mean of the square around it, by sums over rectangles."""
    grey = luminance(image)
    h, w = grey.shape
    half = max(1, w // WINDOW_SHARE // 2)
    sums = np.pad(grey, ((1, 0), (1, 0))).cumsum(0).cumsum(1)
    y0, y1 = np.maximum(np.arange(h) - half, 0), np.minimum(np.arange(h) + half + 1, h)
    x0, x1 = np.maximum(np.arange(w) - half, 0), np.minimum(np.arange(w) + half + 1, w)
    area = (y1 - y0)[:, None] * (x1 - x0)
    mean = (sums[y1][:, x1] - sums[y0][:, x1] - sums[y1][:, x0] + sums[y0][:, x0]) / area
    out = np.where(grey >= mean * below, 255, 0).astype(np.uint8)
    return out if image.ndim == 2 else np.repeat(out[..., None], image.shape[2], 2)


def estimate_skew(image: np.ndarray, most: float = MOST_SKEW) -> float:
    """Degrees clockwise that make dark pixels fall into the sharpest rows: the sum of squares of rows' counts is largest; 0 without dark pixels."""
    grey = luminance(image)
    y, x = np.nonzero(grey < grey.mean() * 0.75)
    if len(y) < 2:
        return 0.0
    x, y = x - grey.shape[1] / 2, y - grey.shape[0] / 2
    reach = math.hypot(*grey.shape)

    def sharpness(angle: float) -> float:
        t = math.radians(angle)
        rows = np.bincount((x * math.sin(t) + y * math.cos(t) + reach).astype(int))
        return float((rows.astype(float) ** 2).sum())

    best, step = 0.0, 1.0
    angles = np.arange(-most, most + 0.5, step)
    while True:
        best = max(angles, key=lambda a: (sharpness(a), -abs(a)))
        if step <= 0.05:
            return float(best) if abs(best) >= LEAST_SKEW else 0.0
        angles, step = np.clip(best + np.arange(-4, 5) * step / 4, -most, most), step / 4


def rotate(image: np.ndarray, degrees: float) -> np.ndarray:
    """Turned clockwise on a canvas that holds all of it, white around, bilinear."""
    if not degrees:
        return image
    t = math.radians(degrees)
    h, w = image.shape[:2]
    c, s = math.cos(t), math.sin(t)
    width, height = math.ceil(round(abs(w * c) + abs(h * s), 6)), math.ceil(round(abs(w * s) + abs(h * c), 6))
    gx, gy = np.meshgrid(np.arange(width) + 0.5 - width / 2, np.arange(height) + 0.5 - height / 2)
    x, y = gx * c + gy * s + w / 2 - 0.5, -gx * s + gy * c + h / 2 - 0.5
    pad = np.pad(image.astype(float), ((1, 1), (1, 1)) + ((0, 0),) * (image.ndim - 2), constant_values=255)
    x, y = np.clip(x + 1, 0, w + 1), np.clip(y + 1, 0, h + 1)
    x0, y0 = np.minimum(np.floor(x).astype(int), w), np.minimum(np.floor(y).astype(int), h)
    fx, fy = x - x0, y - y0
    if image.ndim == 3:
        fx, fy = fx[..., None], fy[..., None]
    out = (pad[y0, x0] * (1 - fx) + pad[y0, x0 + 1] * fx) * (1 - fy) + (pad[y0 + 1, x0] * (1 - fx) + pad[y0 + 1, x0 + 1] * fx) * fy
    return np.rint(out).clip(0, 255).astype(np.uint8)


def prepare(image: np.ndarray, options: PreprocessingOptions, x_resolution: float = 0.0, y_resolution: float = 0.0) -> tuple[np.ndarray, float]:
    """(image, degrees it was turned clockwise) after the steps asked for."""
    image, turned = flatten_alpha(image) if image.ndim == 3 else image, 0.0
    if options.correct_non_square_pixels:
        sx, sy = square_scale(x_resolution, y_resolution)
        size = max(1, round(image.shape[1] * sx)), max(1, round(image.shape[0] * sy))
        if size != (image.shape[1], image.shape[0]):
            image = resize(image, *size)
    if options.denoise:
        image = blur(image)
    if options.deskew and (turned := estimate_skew(image)):
        image = rotate(image, turned)
    return binarize(image) if options.binarize else image, turned


def polyline(points: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Pixels of a closed line through the points, each step to one of eight neighbours."""
    out = []
    for (x0, y0), (x1, y1) in zip(points, [*points[1:], *points[:1]]):
        n = max(abs(x1 - x0), abs(y1 - y0), 1)
        out += [(x0 + (2 * i * (x1 - x0) + n) // (2 * n), y0 + (2 * i * (y1 - y0) + n) // (2 * n)) for i in range(n)]
    return list(dict.fromkeys(out))


def draw(image: np.ndarray, polygons: list[list[tuple[float, float]]], colour: tuple[int, ...] = (255, 0, 0), thickness: int = 1) -> np.ndarray:
    """The image with the polygons' outlines; what is beyond its edges isn't drawn."""
    out = image.copy()
    h, w = out.shape[:2]
    for points in polygons:
        for x, y in polyline([(math.floor(x), math.floor(y)) for x, y in points]):
            a, b = x - (thickness - 1) // 2, y - (thickness - 1) // 2
            out[max(0, b) : max(0, min(h, b + thickness)), max(0, a) : max(0, min(w, a + thickness))] = colour[0] if out.ndim == 2 else [*colour, 255][: out.shape[2]]
    return out


def sample(image: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Values at places given in pixel centres, bilinear, edges repeated."""
    h, w = image.shape[:2]
    x, y = np.clip(x, 0, w - 1), np.clip(y, 0, h - 1)
    x0, y0 = np.floor(x).astype(int), np.floor(y).astype(int)
    x1, y1 = np.minimum(x0 + 1, w - 1), np.minimum(y0 + 1, h - 1)
    fx, fy = x - x0, y - y0
    if image.ndim == 3:
        fx, fy = fx[..., None], fy[..., None]
    a = image.astype(float)
    out = (a[y0, x0] * (1 - fx) + a[y0, x1] * fx) * (1 - fy) + (a[y1, x0] * (1 - fx) + a[y1, x1] * fx) * fy
    return np.rint(out).clip(0, 255).astype(np.uint8)


def rectify_quad(image: np.ndarray, quad: np.ndarray, tall: float = 1.5) -> np.ndarray:
    """The part under four corners, from the upper left on clockwise, seen from the front; a part over 1.5 times as high as wide is turned to lie."""
    side = lambda i, j: float(np.linalg.norm(quad[i] - quad[j]))
    width, height = max(1, round(max(side(0, 1), side(2, 3)))), max(1, round(max(side(0, 3), side(1, 2))))
    h = homography(np.array([[0, 0], [width, 0], [width, height], [0, height]], float), quad)
    gx, gy = np.meshgrid(np.arange(width) + 0.5, np.arange(height) + 0.5)
    u, v, w = (h[i, 0] * gx + h[i, 1] * gy + h[i, 2] for i in range(3))
    out = sample(image, u / w - 0.5, v / w - 0.5)
    return np.rot90(out) if height >= width * tall else out


def _along(points: np.ndarray, shares: np.ndarray) -> np.ndarray:
    """Places on a line through points at shares of its length."""
    steps = np.r_[0, np.cumsum(np.linalg.norm(np.diff(points, axis=0), axis=1))]
    return np.c_[[np.interp(shares * steps[-1], steps, points[:, k]) for k in (0, 1)]].T


def rectify_ribbon(image: np.ndarray, points: np.ndarray) -> np.ndarray:
    """Curved text as a straight strip: the first half of the points is its upper edge, the others, from the right back, the lower one.

    Both edges are walked at the same shares of their lengths; a column of the strip lies between the two places.
    """
    half = len(points) // 2
    upper, lower = points[:half], points[half : 2 * half][::-1]
    length = lambda p: float(np.linalg.norm(np.diff(p, axis=0), axis=1).sum())
    width = max(1, round((length(upper) + length(lower)) / 2))
    shares = (np.arange(width) + 0.5) / width
    a, b = _along(upper, shares), _along(lower, shares)
    height = max(1, round(float(np.linalg.norm(b - a, axis=1).mean())))
    t = ((np.arange(height) + 0.5) / height)[:, None]
    return sample(image, a[:, 0] * (1 - t) + b[:, 0] * t - 0.5, a[:, 1] * (1 - t) + b[:, 1] * t - 0.5)


def _image(row: dict) -> np.ndarray:
    data = np.frombuffer(row["pixels"], np.uint8)
    if len(data) != row["width"] * row["height"] * row["channels"]:
        raise ValueError("pixels don't fill the image")
    return data.reshape(row["height"], row["width"], row["channels"])


def _each(images: DataFrame, fn: Callable[[dict], dict], more: dict[str, T.DataType]) -> DataFrame:
    """images with fn's pixels and columns; an image that can't be worked on has no pixels and an error."""
    fields = [f for f in images.schema.fields if f.name not in more and f.name != "error"]
    schema = T.StructType([*fields, *[T.StructField(n, t) for n, t in more.items()], T.StructField("error", T.StringType())])
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                try:
                    if row["pixels"] is None:
                        raise ValueError("no pixels")
                    out = row | {"error": None} | fn(row)
                except ValueError as e:
                    out = row | dict.fromkeys(more) | {"pixels": None, "error": str(e)}
                yield pa.RecordBatch.from_pylist([out], schema=arrow)

    return images.mapInArrow(run, schema)


def preprocess(images: DataFrame, options: PreprocessingOptions = PreprocessingOptions()) -> DataFrame:
    """images after the steps asked for, with `deskew_degrees`; x_resolution and y_resolution are used where there are such columns."""

    def one(row: dict) -> dict:
        out, turned = prepare(_image(row), options, row.get("x_resolution") or 0.0, row.get("y_resolution") or 0.0)
        return {"width": out.shape[1], "height": out.shape[0], "channels": out.shape[2], "pixels": out.tobytes(), "deskew_degrees": turned}

    return _each(images, one, {"deskew_degrees": T.DoubleType()})


def draw_regions(images: DataFrame, polygons: str = "polygons", colour: tuple[int, ...] = (255, 0, 0), thickness: int = 1) -> DataFrame:
    """images with the outlines of their polygons, array<array<struct<x,y>>>."""

    def one(row: dict) -> dict:
        lines = [[(p["x"], p["y"]) for p in points] for points in row[polygons] or [] if points]
        return {"pixels": draw(_image(row), lines, colour, thickness).tobytes()}

    return _each(images, one, {})


def crop_regions(images: DataFrame, polygons: str = "polygons") -> DataFrame:
    """A row for each polygon of an image, array<array<struct<x,y>>>: region_index, and its part of the image made straight.

    Four points are a quad seen at an angle, six or more, in pairs, the edges of curved text; others are left out. An
    image that can't be worked on is one row with an error.
    """
    keep = [f for f in images.schema.fields if f.name not in (polygons, "error", "region_index")]
    schema = T.StructType([*keep, T.StructField("region_index", T.IntegerType()), T.StructField("error", T.StringType())])
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                regions = row.pop(polygons) or []
                row = {k: v for k, v in row.items() if k != "error"}
                try:
                    if row["pixels"] is None:
                        raise ValueError("no pixels")
                    image = _image(row)
                    for i, points in enumerate(regions):
                        n = len(points or [])
                        if n != 4 and (n < 6 or n % 2):
                            continue
                        p = np.array([[q["x"], q["y"]] for q in points], float)
                        out = np.ascontiguousarray(rectify_quad(image, p) if n == 4 else rectify_ribbon(image, p))
                        yield pa.RecordBatch.from_pylist([row | {"region_index": i, "width": out.shape[1], "height": out.shape[0], "pixels": out.tobytes(), "error": None}], schema=arrow)
                except (ValueError, np.linalg.LinAlgError) as e:
                    yield pa.RecordBatch.from_pylist([row | {"region_index": None, "pixels": None, "error": str(e)}], schema=arrow)

    return images.mapInArrow(run, schema)


def orient_pages(images: DataFrame, make: Callable, least: float = 0.9) -> DataFrame:
    """images turned upright by a model, with `orientation`, the degrees they were turned clockwise before.

    The model is a Stage: for each image it gives (degrees of 0, 90, 180 and 270, confidence); below `least` an image
    stays as it is. Quarter turns are exact.
    """
    key = uuid.uuid4().hex

    def one(row: dict) -> dict:
        image = _image(row)
        ((degrees, sure),) = _own(key, make).run([image])
        turned = int(degrees) % 360 if sure >= least else 0
        if turned % 90:
            raise ValueError("orientation is no quarter turn")
        out = np.ascontiguousarray(np.rot90(image, turned // 90))
        return {"width": out.shape[1], "height": out.shape[0], "pixels": out.tobytes(), "orientation": turned}

    return _each(images, one, {"orientation": T.IntegerType()})
