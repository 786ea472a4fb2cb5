"""From detection maps to boxes, tiles of large images, windows of long lines: numpy on one image at a time."""

from __future__ import annotations

import math
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# fixed values: defaults of the detector
PIXEL, BOX, UNCLIP, MIN_SIZE, MOST_BOXES = 0.3, 0.6, 1.5, 3, 1000
TILE_OVERLAP, TILE_TRIGGER, TARGET_HEIGHT, MOST_UPSCALE, MOST_SIDE = 384, 0.75, 24.0, 3.0, 4000


def dilate(bitmap: np.ndarray) -> np.ndarray:
    """A 2 x 2 dilation: a pixel is set if it, the one left, the one above or the one above left is."""
    out = bitmap.copy()
    out[:, 1:] |= bitmap[:, :-1]
    out[1:] |= out[:-1].copy()
    return out


def components(bitmap: np.ndarray) -> tuple[np.ndarray, int]:
    """(labels from 1 on in order of the first pixel, their number) of 8-connected parts; runs of rows are joined by union-find."""
    h, w = bitmap.shape
    padded = np.zeros((h, w + 2), np.int8)
    padded[:, 1:-1] = bitmap
    step = np.diff(padded, axis=1)
    row, start = np.nonzero(step == 1)
    end = np.nonzero(step == -1)[1]
    parent = np.arange(len(row))

    def root(i):
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    first = np.searchsorted(row, np.arange(h + 1))
    for y in range(1, h):
        i, j = first[y - 1], first[y]
        while i < first[y] and j < first[y + 1]:
            if start[i] <= end[j] and start[j] <= end[i]:  # touching at corners, too
                a, b = root(i), root(j)
                parent[max(a, b)] = min(a, b)
            if end[i] < end[j]:
                i += 1
            else:
                j += 1
    roots = np.array([root(i) for i in range(len(row))], int)
    names = np.unique(roots)
    labels = np.zeros((h, w), np.int32)
    for y, a, b, r in zip(row, start, end, np.searchsorted(names, roots) + 1):
        labels[y, a:b] = r
    return labels, len(names)


def convex_hull(points: np.ndarray) -> np.ndarray:
    """Corners counter-clockwise, by two monotone chains."""
    p = np.unique(points, axis=0)
    if len(p) < 3:
        return p

    turn = lambda a, b: a[0] * b[1] - a[1] * b[0]

    def chain(q):
        out: list[np.ndarray] = []
        for x in q:
            while len(out) > 1 and turn(out[-1] - out[-2], x - out[-2]) <= 0:
                out.pop()
            out.append(x)
        return out[:-1]

    return np.array(chain(p) + chain(p[::-1]))


def min_area_rect(points: np.ndarray) -> tuple[np.ndarray, float]:
    """(corners from the upper left on, shorter side) of the smallest rectangle around points; one of its sides lies on the hull."""
    hull = convex_hull(np.asarray(points, float))
    if len(hull) < 3:
        lo, hi = hull.min(axis=0), hull.max(axis=0)
        return np.array([lo, [hi[0], lo[1]], hi, [lo[0], hi[1]]]), float((hi - lo).min())
    edges = np.roll(hull, -1, axis=0) - hull
    best = None
    for angle in np.unique(np.mod(np.arctan2(edges[:, 1], edges[:, 0]), math.pi / 2)):
        c, s = math.cos(angle), math.sin(angle)
        turn = np.array([[c, s], [-s, c]])
        q = hull @ turn.T
        lo, hi = q.min(axis=0), q.max(axis=0)
        area = float(np.prod(hi - lo))
        if best is None or area < best[0] - 1e-9:
            best = area, np.array([lo, [hi[0], lo[1]], hi, [lo[0], hi[1]]]) @ turn, float((hi - lo).min())
    corners = best[1]
    by_x = corners[np.argsort(corners[:, 0], kind="stable")]
    left, right = by_x[:2], by_x[2:]
    left, right = left[np.argsort(left[:, 1], kind="stable")], right[np.argsort(right[:, 1], kind="stable")]
    return np.array([left[0], right[0], right[1], left[1]]), best[2]


def unclip_quad(quad: np.ndarray, ratio: float) -> np.ndarray:
    """A convex quad's sides moved out by area * ratio / perimeter."""
    nxt = np.roll(quad, -1, axis=0)
    area = abs(float(np.sum(quad[:, 0] * nxt[:, 1] - nxt[:, 0] * quad[:, 1]))) / 2
    length = np.linalg.norm(nxt - quad, axis=1)
    d = area * ratio / max(length.sum(), 1e-9)
    side = (nxt - quad) / np.maximum(length, 1e-9)[:, None]
    normal = np.c_[side[:, 1], -side[:, 0]]
    before = np.roll(normal, 1, axis=0)
    mitre = normal + before
    return quad + d * mitre / np.maximum((1 + (normal * before).sum(axis=1))[:, None], 1e-9)


def inside_quad(quad: np.ndarray, xs: np.ndarray, ys: np.ndarray) -> np.ndarray:
    """Which of the points lie in a convex quad."""
    nxt = np.roll(quad, -1, axis=0)
    side = [(b[0] - a[0]) * (ys - a[1]) - (b[1] - a[1]) * (xs - a[0]) for a, b in zip(quad, nxt)]
    return np.all([s >= -1e-6 for s in side], axis=0) | np.all([s <= 1e-6 for s in side], axis=0)


def box_score(prob: np.ndarray, quad: np.ndarray) -> float:
    """Mean probability under the quad."""
    h, w = prob.shape
    x0, y0 = np.clip(np.floor(quad.min(axis=0)).astype(int), 0, [w - 1, h - 1])
    x1, y1 = np.clip(np.ceil(quad.max(axis=0)).astype(int), 0, [w - 1, h - 1])
    ys, xs = np.mgrid[y0 : y1 + 1, x0 : x1 + 1]
    hit = inside_quad(quad, xs, ys)
    return float(prob[y0 : y1 + 1, x0 : x1 + 1][hit].mean()) if hit.any() else 0.0


def boxes_of_map(prob: np.ndarray, pixel: float = PIXEL, box: float = BOX, ratio: float = UNCLIP, min_size: int = MIN_SIZE, use_dilation: bool = False, slow: bool = False) -> list[tuple[list[list[float]], float]]:
    """(quad, score) of each text part of a probability map: parts, smallest rectangles, scores, moved out, and again; at most 1000."""
    bitmap = prob > pixel
    labels, n = components(dilate(bitmap) if use_dilation else bitmap)
    out = []
    ys, xs = np.nonzero(labels)
    order = np.argsort(labels[ys, xs], kind="stable")
    ys, xs = ys[order], xs[order]
    cuts = np.searchsorted(labels[ys, xs], np.arange(1, n + 2))
    for a, b in zip(cuts[:MOST_BOXES], cuts[1 : MOST_BOXES + 1]):
        if b - a < 4:
            continue
        quad, side = min_area_rect(np.c_[xs[a:b], ys[a:b]])
        if side < min_size:
            continue
        score = float(prob[ys[a:b], xs[a:b]].mean()) if slow else box_score(prob, quad)
        if score < box:
            continue
        final, side = min_area_rect(unclip_quad(quad, ratio))
        if side >= min_size + 2:
            out.append((final.tolist(), score))
    return out


def detect_boxes(maps: DataFrame, key: str = "page_id", prob: str = "prob", width: str = "width", polygons: bool = False, **options) -> DataFrame:
    """key, region_index, polygon, score: boxes of each page's map, an array<float> by rows of that width; or polygons that follow the text."""
    kind = dict(maps.dtypes)[key]
    schema = f"{key} {kind}, region_index int, polygon array<struct<x:double,y:double>>, score double"

    find = polygons_of_map if polygons else boxes_of_map

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for k, p, w in zip(*(batch.column(i).to_pylist() for i in range(3))):
                if p and w:
                    for i, (quad, score) in enumerate(find(np.array(p, np.float32).reshape(-1, w), **options)):
                        rows.append((k, i, [{"x": x, "y": y} for x, y in quad], score))
            cols = list(zip(*rows)) or [[], [], [], []]
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], batch.schema.field(0).type), pa.array(cols[1], pa.int32()), pa.array(cols[2], pa.list_(pa.struct([("x", pa.float64()), ("y", pa.float64())]))), pa.array(cols[3], pa.float64())], [key, "region_index", "polygon", "score"])

    return maps.select(key, prob, width).mapInArrow(run, schema)


def simplify(points: np.ndarray, tolerance: float) -> np.ndarray:
    """A polygon's points without those less than the tolerance off the line of what stays."""
    points = np.asarray(points, float)
    keep, work = np.zeros(len(points), bool), [(0, len(points) - 1)]
    keep[[0, -1]] = True
    while work:
        a, b = work.pop()
        if b - a < 2:
            continue
        d = points[b] - points[a]
        rel = points[a + 1 : b] - points[a]
        off = np.abs(d[0] * rel[:, 1] - d[1] * rel[:, 0]) / np.linalg.norm(d) if d.any() else np.linalg.norm(rel, axis=1)
        k = int(off.argmax())
        if off[k] > tolerance:
            keep[a + 1 + k] = True
            work += [(a, a + 1 + k), (a + 1 + k, b)]
    return points[keep]


# fixed values: a contour's tolerance as a share of its length, and its least corners
CONTOUR_TOLERANCE, LEAST_CORNERS = 0.002, 4
_AROUND = [(1, 0), (1, 1), (0, 1), (-1, 1), (-1, 0), (-1, -1), (0, -1), (1, -1)]  # clockwise on the screen


def outer_contour(part: np.ndarray) -> list[tuple[int, int]]:
    """Pixels (x, y) along a part's outer edge, clockwise from the first in reading order: at each, the next is the first of the part around it after where one came from."""
    ys, xs = np.nonzero(part)
    start = (int(xs[0]), int(ys[0]))
    there = lambda x, y: 0 <= y < part.shape[0] and 0 <= x < part.shape[1] and part[y, x]
    out, at, back = [], start, 4
    while True:
        step = next((k for i in range(1, 9) if there(at[0] + _AROUND[k := (back + i) % 8][0], at[1] + _AROUND[k][1])), None)
        if step is None:
            return [start]
        if out and at == start and step == first:
            return out
        if not out:
            first = step
        out.append(at)
        at, back = (at[0] + _AROUND[step][0], at[1] + _AROUND[step][1]), (step + 4) % 8


def _ring_area(p: np.ndarray) -> float:
    n = np.roll(p, -1, axis=0)
    return float((p[:, 0] * n[:, 1] - n[:, 0] * p[:, 1]).sum() / 2)


def _without_loops(p: np.ndarray) -> np.ndarray:
    """A closed line cut where it crosses itself, as often as it does; the part that encloses more stays."""
    for _ in range(len(p)):
        n, hit = len(p), None
        for i in range(n - 2):
            a, r = p[i], p[i + 1] - p[i]
            j = np.arange(i + 2, n - (i == 0))
            if not len(j):
                continue
            q = p[(j + 1) % n] - p[j]
            cross = r[0] * q[:, 1] - r[1] * q[:, 0]
            d = p[j] - a
            with np.errstate(divide="ignore", invalid="ignore"):
                t, u = (d[:, 0] * q[:, 1] - d[:, 1] * q[:, 0]) / cross, (d[:, 0] * r[1] - d[:, 1] * r[0]) / cross
            k = np.flatnonzero((cross != 0) & (t > 1e-9) & (t < 1 - 1e-9) & (u > 1e-9) & (u < 1 - 1e-9))
            if len(k):
                hit = i, int(j[k[0]]), a + r * t[k[0]]
                break
        if hit is None:
            return p
        i, j, x = hit
        inner, outer = np.vstack([x[None], p[i + 1 : j + 1]]), np.vstack([p[: i + 1], x[None], p[j + 1 :]])
        p = inner if abs(_ring_area(inner)) > abs(_ring_area(outer)) else outer
    return p


def offset_polygon(points: np.ndarray, distance: float, arc: float = 0.25) -> np.ndarray:
    """Any simple polygon with its sides moved out by a distance: round at corners that point out, in steps that leave the circle by no more than `arc`."""
    p = np.asarray(points, float)
    p = p if _ring_area(p) > 0 else p[::-1]
    side = np.roll(p, -1, axis=0) - p
    length = np.linalg.norm(side, axis=1)
    p, side = p[length > 1e-9], side[length > 1e-9] / length[length > 1e-9][:, None]
    if len(p) < 3 or distance <= 0:
        return p
    normal = np.c_[side[:, 1], -side[:, 0]]
    step = 2 * math.acos(max(0.0, 1 - min(arc, distance) / distance))
    out = []
    for i in range(len(p)):
        a, b = normal[i - 1], normal[i]
        turn = math.atan2(a[0] * b[1] - a[1] * b[0], float(a @ b))
        if turn > 0:
            n = max(1, math.ceil(turn / step))
            start = math.atan2(a[1], a[0])
            out += [p[i] + distance * np.array([math.cos(start + turn * k / n), math.sin(start + turn * k / n)]) for k in range(n + 1)]
        else:
            out += [p[i] + distance * a, p[i], p[i] + distance * b]  # the loop that this makes goes
    return _without_loops(np.array(out))


def inside_polygon(points: np.ndarray, xs: np.ndarray, ys: np.ndarray) -> np.ndarray:
    """Which of the places lie in a polygon, by crossings of a ray to the right; those on its edges count."""
    inside, edge = np.zeros(xs.shape, bool), np.zeros(xs.shape, bool)
    for (x0, y0), (x1, y1) in zip(points, np.roll(points, -1, axis=0)):
        cross = (x1 - x0) * (ys - y0) - (y1 - y0) * (xs - x0)
        edge |= (np.abs(cross) < 1e-9) & (xs >= min(x0, x1)) & (xs <= max(x0, x1)) & (ys >= min(y0, y1)) & (ys <= max(y0, y1))
        if y0 != y1:
            inside ^= ((y0 > ys) != (y1 > ys)) & (xs < (x1 - x0) * (ys - y0) / (y1 - y0) + x0)
    return inside | edge


def polygons_of_map(prob: np.ndarray, pixel: float = PIXEL, box: float = BOX, ratio: float = UNCLIP, min_size: int = MIN_SIZE, use_dilation: bool = False) -> list[tuple[list[list[float]], float]]:
    """(polygon, score) of each text part of a probability map: outer contours with few corners, scored by the mean inside and moved out; at most 1000."""
    bitmap = prob > pixel
    labels, n = components(dilate(bitmap) if use_dilation else bitmap)
    out = []
    for k in range(1, min(n, MOST_BOXES) + 1):
        contour = outer_contour(labels == k)
        if len(contour) < 2:
            continue
        ring = np.array(contour, float)
        whole = float(np.linalg.norm(np.roll(ring, -1, axis=0) - ring, axis=1).sum())
        far = int(np.linalg.norm(ring - ring[0], axis=1).argmax())  # both halves of the ring, cut at the place farthest from its start
        few = np.concatenate([simplify(ring[: far + 1], CONTOUR_TOLERANCE * whole)[:-1], simplify(np.concatenate([ring[far:], ring[:1]]), CONTOUR_TOLERANCE * whole)[:-1]])
        if len(few) < LEAST_CORNERS or min_area_rect(few)[1] < min_size:
            continue
        (x0, y0), (x1, y1) = np.floor(few.min(axis=0)).astype(int), np.ceil(few.max(axis=0)).astype(int)
        ys, xs = np.mgrid[y0 : y1 + 1, x0 : x1 + 1]
        score = float(prob[y0 : y1 + 1, x0 : x1 + 1][inside_polygon(few, xs, ys)].mean())
        if score < box:
            continue
        final = offset_polygon(few, abs(_ring_area(few)) * ratio / max(float(np.linalg.norm(np.roll(few, -1, axis=0) - few, axis=1).sum()), 1e-9))
        if min_area_rect(final)[1] >= min_size + 2:
            out.append((final.tolist(), score))
    return out


def homography(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """The 3 x 3 map of four points to four others."""
    rows, right = [], []
    for (x, y), (u, v) in zip(source, target):
        rows += [[x, y, 1, 0, 0, 0, -u * x, -u * y], [0, 0, 0, x, y, 1, -v * x, -v * y]]
        right += [u, v]
    return np.append(np.linalg.solve(np.array(rows, float), np.array(right, float)), 1).reshape(3, 3)


def should_tile(width: Column, height: Column, limit: int = 64, most: int = MOST_SIDE) -> Column:
    """Length of tiles for an image whose long side would be scaled below three quarters; 0 for none."""
    long, short = F.greatest(width, height), F.least(width, height)
    policy = F.when(short < limit, F.lit(float(limit)) / short).otherwise(F.lit(1.0))
    whole = long * policy
    tile = F.floor(most / policy)
    return F.when((long > 0) & (whole > most) & (F.lit(float(most)) / whole < TILE_TRIGGER) & (tile > 2 * TILE_OVERLAP), tile).otherwise(F.lit(0)).cast("int")


def tile_plan(long_side: Column, tile: Column, overlap: int = TILE_OVERLAP) -> Column:
    """array<struct<start,length>> of overlapping tiles, the last one flush with the end."""
    step = F.greatest(F.lit(1), tile - overlap)
    n = F.ceil((long_side - tile) / step).cast("int")
    starts = F.transform(F.sequence(F.lit(0), F.greatest(n, F.lit(0))), lambda i: F.struct(F.least(i * step, long_side - tile).cast("int").alias("start"), tile.cast("int").alias("length")))
    return F.when(long_side <= tile, F.array(F.struct(F.lit(0).alias("start"), long_side.cast("int").alias("length")))).otherwise(starts)


def merge_tiles(boxes: DataFrame, keys: list[str], most_iou: float, box_id: str = "region_index") -> DataFrame:
    """Boxes of overlapping tiles, each once: those no tile's edge cuts first, then the larger ones; `touches_cut` tells."""
    from papyra.functions.geometry import box, iou
    from papyra.operators.spatial import greedy_keep

    sized = boxes.withColumns({"_cut": F.col("touches_cut").cast("int"), "_area": box().area})
    return greedy_keep(sized, keys, ["_cut", ("_area", "desc"), box_id], lambda k, x: iou(k, x) > most_iou).drop("_cut", "_area")


def upscale_factor(median_side: Column, least_height: float, long_side: Column, most: int = MOST_SIDE) -> Column:
    """How far a page of small text is enlarged: to 24 points, at most threefold and to the largest side; 1 if hardly."""
    f = F.least(F.lit(max(TARGET_HEIGHT, least_height)) / median_side, F.lit(MOST_UPSCALE), F.lit(float(most)) / long_side)
    return F.when((median_side > 0) & (median_side < least_height) & (long_side > 0) & (f > 1.05), f).otherwise(F.lit(1.0))


def plan_batches(ratios: list[float], size: int, height: int, most_pixels: int = 0, most_width: int = 3200) -> list[tuple[int, int]]:
    """Batches (start, end) of crops sorted by aspect ratio: so many at most, and so many pixels at the widest one's width."""
    out, start = [], 0
    while start < len(ratios):
        end = start
        while end < len(ratios) and end - start < size:
            width = min(most_width, max(height, math.ceil(height * ratios[end])))
            if most_pixels and (end - start + 1) * height * width > most_pixels:
                if end == start:
                    raise ValueError("a crop alone is over the pixel budget")
                break
            end += 1
        out.append((start, end))
        start = end
    return out


def _graphemes(chars: list[dict]) -> Iterator[list[dict]]:
    group: list[dict] = []
    for c in chars:
        if group and not (unicodedata.combining(c["token"][0]) or c["token"][0] == "‍" or group[-1]["token"][-1] == "‍"):
            yield group
            group = []
        group.append(c)
    if group:
        yield group


def stitch(windows: list[tuple[int, int]], readings: list[list[dict]], step_width: float, width: int) -> tuple[str, float]:
    """(text, mean probability) of a line read in overlapping windows: a grapheme is the window's whose half of the overlap has its centre.

    readings: characters of each window with token, probability, first_step, last_step.
    """
    text, probs = "", []
    for i, ((start, length), chars) in enumerate(zip(windows, readings)):
        left = 0.0 if i == 0 else (start + sum(windows[i - 1])) / 2
        right = width if i == len(windows) - 1 else (start + length + windows[i + 1][0]) / 2
        for group in _graphemes(chars):
            centre = start + (group[0]["first_step"] + group[-1]["last_step"] + 1) * step_width / 2
            if left <= centre < right:
                text += "".join(c["token"] for c in group)
                probs.append(sum(c["probability"] for c in group) / len(group))
    return text, sum(probs) / len(probs) if probs else 0.0


def grown_quads(box_height: Column) -> tuple[Column, Column]:
    """How much taller a weak line's crops are on a second reading."""
    return box_height * 0.30, box_height * 0.15
