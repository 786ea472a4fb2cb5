"""Reading order of pages with mixed columns: labels take roles, captions and subtitles go with their parents, the page is cut into bands, each band is
cut recursively, and what lies across columns is put back by distance. A page at a time, in 32-bit floats."""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame

from papyra.functions.paging import by_page

f32 = np.float32
X, Y = 0, 1

# fixed values: labels of each role
ROLES = {
    "header": {"header", "header_image"}, "doc_title": {"doc_title"}, "paragraph_title": {"paragraph_title", "abstract_title", "reference_title", "content_title"},
    "vision": {"image", "table", "chart", "flowchart", "figure"}, "vision_title": {"table_title", "chart_title", "figure_title", "figure_table_chart_title"},
    "footer": {"footer", "footer_image", "footnote"}, "unordered": {"aside_text", "seal", "number", "formula_number"},
}
# fixed values: roles that take no part in cuts; sides' weights (left, right, up, down) of a distance
MASKED = {"header", "unordered", "footer", "vision_footnote", "sub_paragraph_title", "doc_title_text", "vision_title", "sub_region"}
ACROSS = {"cross_layout", "cross_reference", "doc_title", "unordered"}
WEIGHTS = {"doc_title": ((1, 0.1, 0.1, 1), (0.2, 0.1, 1, 1)), "down": (1, 1, 0.1, 1), "up": (1, 1, 1, 0.1)}
DOWN = {"paragraph_title", "table_title", "abstract", "image", "seal", "chart", "figure"}
LONG_TEXT, CHILD_OVERLAP = 8, 0.1


@dataclass(eq=False)
class Block:
    key: int
    label: str
    box: np.ndarray
    role: str | None = None
    axis: int = X
    lines: int = 1
    line_height: float = 1.0
    children: list = field(default_factory=list)
    own_box: np.ndarray | None = None

    def size(self, axis: int) -> float:
        return self.box[axis + 2] - self.box[axis]

    @property
    def area(self) -> float:
        return self.size(X) * self.size(Y)

    @property
    def long(self) -> float:
        return self.size(self.axis)

    @property
    def short(self) -> float:
        return self.size(1 - self.axis)

    @property
    def centre(self) -> np.ndarray:
        return (self.box[:2] + self.box[2:]) / f32(2)

    def adopt(self, child: Block, role: str) -> None:
        """Takes the child and its children; the box covers them until they are given back."""
        child.role = role
        self.own_box = self.box if self.own_box is None else self.own_box
        self.box = np.concatenate([np.minimum(self.box[:2], child.box[:2]), np.maximum(self.box[2:], child.box[2:])])
        self.children += [child, *child.release()]

    def release(self) -> list:
        if self.own_box is not None:
            self.box, self.own_box = self.own_box, None
        out, self.children = self.children, []
        return out


def along(a: np.ndarray, b: np.ndarray, axis: int, of: str = "union") -> float:
    """Overlap on an axis as a share of the union or of the smaller extent."""
    shared = min(a[axis + 2], b[axis + 2]) - max(a[axis], b[axis])
    if shared <= 0:
        return 0.0
    whole = max(a[axis + 2], b[axis + 2]) - min(a[axis], b[axis]) if of == "union" else min(a[axis + 2] - a[axis], b[axis + 2] - b[axis])
    return shared / whole if whole > 0 else 0.0


def overlap(a: np.ndarray, b: np.ndarray, of: str = "union") -> float:
    both = np.prod(np.maximum(0, np.minimum(a[2:], b[2:]) - np.maximum(a[:2], b[:2])))
    areas = [np.prod(np.maximum(0, x[2:] - x[:2])) for x in (a, b)]
    whole = sum(areas) - both if of == "union" else min(areas)
    return float(both / whole) if whole > 0 else 0.0


def edge_distance(a: np.ndarray, b: np.ndarray, weights=(1, 1, 1, 1)) -> float:
    """Weighted gap of the nearest edges: left, right, up or down as b lies; 0 if they overlap on both axes."""
    apart = [along(a, b, axis) == 0 for axis in (X, Y)]
    gap = lambda k: min(abs(a[k] - b[k + 2]), abs(a[k + 2] - b[k])) * (weights[2 * k] if a[k + 2] < b[k] else weights[2 * k + 1])
    return float(sum(gap(k) for k in (X, Y) if apart[k]))


def intervals(boxes: list[np.ndarray], axis: int) -> list[tuple[float, float, int]]:
    """Merged extents on an axis with how many boxes each has; touching ones merge."""
    out: list[list] = []
    for start, end in sorted(((b[axis], b[axis + 2]) for b in boxes), key=lambda p: p[0]):
        if out and start <= out[-1][1]:
            out[-1][1] = max(out[-1][1], end)
            out[-1][2] += 1
        else:
            out.append([start, end, 1])
    return [tuple(x) for x in out]


def profile(boxes: list[np.ndarray], axis: int) -> np.ndarray:
    """How many boxes cover each whole coordinate; mirrored boxes, below 0, count by their distance from 0."""
    ends = np.array([[int(b[axis]), int(b[axis + 2])] for b in boxes])
    size = -ends.min() if ends.min() < 0 else ends.max()
    out = np.zeros(max(int(size), 0) + 1, int)
    for a, b in np.sort(np.abs(ends), axis=1):
        out[a] += a < size
        out[min(b, size)] -= a < size
    return np.cumsum(out)[:-1]


def strips(values: np.ndarray, gap: int = 1) -> list[tuple[int, int]]:
    """Runs of covered coordinates, apart by more than the gap; the last one ends after its last coordinate."""
    at = np.flatnonzero(values > 0)
    if not len(at):
        return []
    cut = np.flatnonzero(np.diff(at) > gap)
    ends = [*at[cut], at[-1] + 1]
    return list(zip([at[0], *at[cut + 1]], ends))


def valleys(values: np.ndarray) -> list[tuple[int, int]]:
    """Flat stretches lower than both neighbours, but the first."""
    edges = np.flatnonzero(np.diff(values)) + 1
    runs = list(zip([0, *edges], [*edges, len(values)]))
    low = [(a, b - 1) for i, (a, b) in enumerate(runs[:-1]) if (i == 0 or values[a - 1] > values[a]) and values[b] > values[a]]
    return low[1:]


def recursive_cut(boxes: list[np.ndarray], first: int) -> list[int]:
    """Indices by cutting an axis's strips, then the other's in each, and again; mirrored strips go from the right."""
    whole = [np.trunc(b) for b in boxes]

    def runs(some: list[int], axis: int) -> list[list[int]]:
        some = sorted(some, key=lambda i: whole[i][axis])
        found = strips(profile([whole[i] for i in some], axis))
        mirrored = axis == X and min(whole[i][X] for i in some) < 0
        place = (lambda i: abs(whole[i][X])) if axis == X else (lambda i: whole[i][Y])
        out = [[i for i in some if a <= place(i) < b] for a, b in found]
        return out[::-1] if mirrored else out

    done: list[int] = []
    work: list[tuple[list[int], bool]] = [(list(range(len(boxes))), False)]  # indices, whether they are in order already
    while work:
        group, settled = work.pop()
        if settled:
            done += group
            continue
        parts: list[tuple[list[int], bool]] = []
        for part in (p for p in runs(group, first) if p):
            inner = [x for x in runs(part, 1 - first) if x]
            parts += [(inner[0], True)] if len(inner) == 1 else [(x, len(x) == 1) for x in inner]
        work += reversed(parts)
    return done


def shrink(blocks: list[Block], axis: int) -> None:
    """Neighbours that overlap a little on an axis, or nearly touch, are cut at the middle, a point apart."""
    for a, b in zip(blocks, blocks[1:]):
        little = along(a.box, b.box, 1 - axis) > 0 and 0 < along(a.box, b.box, axis) < 0.1
        if not little and abs(a.box[axis + 2] - b.box[axis]) > 3:
            continue
        middle = int((max(a.box[axis], b.box[axis]) + min(a.box[axis + 2], b.box[axis + 2])) / 2)
        a.box, b.box = a.box.copy(), b.box.copy()
        before, after = (a, b) if a.box[axis] < b.box[axis] else (b, a)
        before.box[axis + 2], after.box[axis] = middle - 1, middle + 1


class Page:
    def __init__(self, rows: list[dict], width: float, height: float):
        self.size = np.array([0, 0, width, height], f32)
        self.blocks = [Block(i, r["label"] or "", np.array([r["min_x"], r["min_y"], r["max_x"], r["max_y"]], f32)) for i, r in enumerate(rows)]
        for b in self.blocks:
            b.axis = X if b.size(X) >= b.size(Y) else Y
        role_of = {label: role for role, labels in ROLES.items() for label in labels}
        self.group: dict[str, list[Block]] = {role: [] for role in (*ROLES, "text")}
        for b in self.blocks:
            self.group[role_of.get(b.label, "text")].append(b)
        text = self.group["text"]
        self.axis = X if sum(b.axis == X for b in text) >= len(text) * 0.5 else Y
        heights = sorted(b.short for b in text if b.short > 0)
        widths = [b.long for b in text if b.long > 0]
        self.line_height, self.line_width = f32(10), f32(20)
        if heights:
            least = max(f32(4), heights[0])
            near = [h for h in heights if h <= least * f32(1.5)]
            self.line_height = f32(np.mean(near)) if near else least
        if widths:
            self.line_width = f32(np.mean(widths))
        for b in self.blocks:
            b.line_height = self.line_height
            b.lines = max(1, round(float(b.short / max(f32(1), self.line_height))))

    # roles and children

    def neighbours(self, b: Block, others: list[Block], axis: int) -> tuple[list[Block], list[Block]]:
        side = 1 - axis
        near = [o for o in others if o is not b and along(b.box, o.box, axis, "small") > CHILD_OVERLAP]
        before = sorted((o for o in near if o.box[side] <= b.box[side]), key=lambda o: -o.box[side])
        return before, sorted((o for o in near if o.box[side] > b.box[side]), key=lambda o: o.box[side])

    def adopt(self, parent: Block, child: Block, role: str, group: str) -> None:
        parent.adopt(child, role)
        if child in self.group[group]:
            self.group[group].remove(child)

    def give_role(self, b: Block) -> None:
        role = next((r for r in ("header", "doc_title", "paragraph_title", "vision", "footer", "unordered") if b.label in ROLES[r]), "region" if b.label == "region" else "normal_text")
        if role == "paragraph_title" and b.role is not None:
            role = b.role
        b.role = role
        if role == "vision":
            b.lines, b.axis = 1, self.axis
            self.vision_children(b)
        elif role == "doc_title":
            self.title_children(b)
        elif role == "paragraph_title":
            self.subtitles(b)
        elif role == "region":
            for o in self.blocks:
                if o is not b and overlap(b.box, o.box) > 0 and b.area > o.area and o.role != "sub_region":
                    self.adopt(b, o, "sub_region", "text")

    def title_children(self, b: Block) -> None:
        text = list(self.group["text"])
        before, after = self.neighbours(b, text, b.axis)
        for o in before[:1] + after[:1]:
            odd = o.long < b.long or o.long > f32(1.5) * b.long
            if o.axis == b.axis and o.label == "text" and o.short < b.short * f32(0.8) and odd and o.lines < 3 and edge_distance(b.box, o.box) < o.line_height * 2:
                self.adopt(b, o, "doc_title_text", "text")
        for o in text:
            if o.role != "doc_title_text" and o.axis == b.axis and overlap(b.box, o.box, "small") > 0.9:
                self.adopt(b, o, "doc_title_text", "text")

    def subtitles(self, b: Block) -> None:
        for side in self.neighbours(b, self.group["paragraph_title"] + self.group["text"], b.axis):
            for o in side:
                if o.label not in ROLES["paragraph_title"]:
                    break
                h = min(b.line_height, o.line_height)
                if o.axis == b.axis and abs(o.box[o.axis] - b.box[b.axis]) < h * 2 and edge_distance(b.box, o.box) <= h * f32(1.5):
                    self.adopt(b, o, "sub_paragraph_title", "paragraph_title")

    def vision_children(self, b: Block) -> None:
        """Captions on either side within two lines, and one note that is short, centred or flush."""
        others = self.group["text"] + self.group["vision_title"]
        noted = titled = False

        def note(o: Block) -> bool:
            flush = o.lines == 1 and (b.box[0] - o.box[0] < 10 or b.box[2] - o.box[2] < 10)
            centred = o.short < b.short and o.long < f32(0.5) * b.long and abs(b.centre[0] - o.centre[0]) < 10
            return o.axis == b.axis and o.long < b.long and edge_distance(b.box, o.box) <= o.line_height * 2 and (centred or flush)

        for axis in (b.axis, 1 - b.axis):
            before, after = self.neighbours(b, others, axis)
            for side in (before, after):
                for o in side:
                    title = o.label in ROLES["vision_title"]
                    if side is before and not title and o.label != "text" or side is after and noted and o.label == "text":
                        break
                    if title and edge_distance(b.box, o.box) <= o.line_height * 2:
                        titled = True
                        self.adopt(b, o, "vision_title", "vision_title")
                    if o.label == "text":
                        if not noted and note(o):
                            noted = True
                            self.adopt(b, o, "vision_footnote", "text")
                        break
            if titled:
                break
        for o in others:
            if o in self.group["text"] and overlap(b.box, o.box, "small") > 0.9:
                self.adopt(b, o, "vision_footnote", "text")

    # bands

    def free(self, b: Block) -> bool:
        return b.role not in MASKED

    def bands(self) -> list[list[Block]]:
        axis, across = self.axis, 1 - self.axis
        central = []
        for b in self.blocks:
            if self.free(b):
                self.give_role(b)
            slack = np.floor(b.long / f32(5)) if b.axis == X else np.floor(b.short / f32(10))
            if abs((b.box[axis] + b.box[axis + 2]) / 2 - (self.size[axis] + self.size[axis + 2]) / 2) <= slack:
                central.append(b)
        free = [b for b in self.blocks if self.free(b)]
        if not free:
            return []
        parts = intervals([b.box for b in free], across)
        cuts: list[float] = []
        for b in central:  # a centred divider that no other block stands beside
            if self.free(b) and 1 - b.axis == across and (b.box[across], b.box[across + 2], 1) in parts:
                cuts += [b.box[across], b.box[across + 2]]
        region = self.blocks[0].label == "region"
        checked = [b.box for b in free if b.role != "vision"]
        if region or checked and len(intervals(checked, axis)) == 1:
            start = max([parts[0][0], *[c for c in cuts if c < parts[0][1]]])
            for now, nxt in zip(parts, parts[1:]):
                gap = nxt[0] - now[1]
                if region or gap >= self.line_height * 3:
                    cuts.append(now[1])
                elif gap > self.line_height * f32(1.2) and self.columns_change(start, now[1], nxt[1]):
                    start = now[1]
                    cuts.append(now[1])
        out, rest = [], sorted(self.blocks, key=lambda b: b.box[across + 2])
        for cut in [*sorted(set(cuts)), float("inf")]:
            band = [b for b in rest if b.box[across + 2] <= cut]
            rest = rest[len(band) :]
            band = [b for b in band if self.free(b)]
            if band:
                out.append(band)
        return out[::-1] if axis == Y else out

    def columns_change(self, start: float, middle: float, end: float) -> bool:
        """The gaps between columns above and below a line don't lie in line."""
        axis, across = self.axis, 1 - self.axis
        inside = lambda a, b: [x.box for x in self.blocks if x.box[across] >= a and x.box[across + 2] <= b]
        both = [inside(start, middle), inside(middle, end)]
        if not all(both):
            return False
        gaps = [valleys(profile(x, axis)) for x in both]
        most = max(map(len, gaps))
        if not most:
            return False
        boxes = []
        for a, b in gaps[0] + gaps[1]:
            box = np.zeros(4, f32)
            box[axis], box[axis + 2] = a, b
            boxes.append(box)
        return len(intervals(boxes, axis)) != most

    # what lies across columns

    def mark_across(self, band: list[Block]) -> None:
        band.sort(key=lambda b: (b.box[0], b.size(X)))
        settled = lambda b: b.role in ("doc_title", "cross_layout", "cross_reference")
        for b in band:
            for o in band:
                if settled(b):
                    break
                if o is b or settled(o):
                    continue
                share = overlap(b.box, o.box)
                if share > 0 and o.role == "vision":
                    o.role = "cross_layout"
                    break
                if share > 0.1 and b.area < o.area:
                    b.role = "cross_layout"
                    break
                if along(b.box, o.box, self.axis) > 0:
                    self.compare_third(b, o, [x for x in band if x is not b and x is not o], settled)

    def compare_third(self, b: Block, o: Block, rest: list[Block], settled) -> None:
        for p in rest:
            if settled(p):
                continue
            if overlap(b.box, p.box) > 0.1:
                if p.role == "vision":
                    p.role = "cross_layout"
                    return
                if b.role == "vision" or b.area < p.area:
                    b.role = "cross_layout"
                    return
            beside = along(o.box, p.box, self.axis) == 0 and along(o.box, p.box, 1 - self.axis) > 0
            if along(b.box, p.box, self.axis) > 0 and beside:
                texts = all(x.role == "normal_text" and x.long > x.line_height * LONG_TEXT for x in (o, p))
                if b.role in ("vision", "region") or texts:
                    b.role = "cross_reference" if b.label == "reference" else "cross_layout"

    # order

    def grid_key(self, b: Block):
        h, w = max(f32(1), self.line_height), max(f32(1), self.line_width)
        x, y = map(float, b.centre)
        if self.axis == X:
            return np.floor(b.box[1] / h), np.floor(b.box[0] / w), x * x + y * y
        return np.floor(-b.box[2] / w), np.floor(b.box[1] / h), y * y - x * x

    def cut_order(self, band: list[Block]) -> list[Block]:
        axis, across = self.axis, 1 - self.axis
        one = max(b.lines for b in band) == 1 or len(intervals([b.box for b in band], axis)) == 1
        copies = []
        for b in band:
            box = b.box if axis == X else np.array([-b.box[0], b.box[1], -b.box[2], b.box[3]], f32)
            copies.append(Block(b.key, b.label, box))
        major, minor, size = (across, axis, self.line_height) if one else (axis, across, self.line_width)
        bucket = max(f32(1), np.floor(size / f32(2)))
        copies.sort(key=lambda c: (np.floor(c.box[major] / bucket), c.box[minor]))
        shrink(copies, across)
        found = recursive_cut([c.box for c in copies], (across if one else axis))
        found = list(dict.fromkeys([*found, *range(len(copies))]))
        return [self.blocks[copies[i].key] for i in found]

    def put_back(self, done: list[Block], waiting: list[Block]) -> list[Block]:
        for i, b in enumerate(sorted(waiting, key=self.grid_key)):
            role = "region" if b.label == "region" else b.role
            if i == 0 and role == "doc_title":
                at = 0
            elif role in ("cross_layout", "paragraph_title", "doc_title", "vision_title", "vision"):
                at = self.weighted_place(b, done)
            elif role == "cross_reference":
                above = [(k, o) for k, o in enumerate(done) if o.box[3] <= b.box[1]]
                at = 1 + min(above, key=lambda x: -(x[1].box[2] * 10.0 + x[1].box[3]), default=(0, None))[0]
            elif role == "region":
                far = lambda o: float(np.hypot(o.box[0] if self.axis == X else self.size[2] - o.box[2], o.box[1]))
                at = next((k for k, o in enumerate(done) if far(o) > far(b)), len(done))
            else:
                at = 1 + min(range(len(done)), key=lambda k: abs(b.box[0] - done[k].box[0]) + abs(b.box[1] - done[k].box[1]), default=-1)
            done.insert(min(at, len(done)), b)
        return done

    def weighted_place(self, b: Block, done: list[Block]) -> int:
        """Before or after the block nearest by edges first, then by height, then by side; what lies above counts from below."""
        weights = WEIGHTS["doc_title"][b.axis] if b.role == "doc_title" else WEIGHTS["down" if b.role in DOWN else "up"]
        slack = max(2.0, float(self.line_width), 1.0) if b.label == "doc_title" else 2.0
        best, least_up, place = float("inf"), float("inf"), 0
        for k, o in enumerate(done):
            edge = edge_distance(b.box, o.box, weights)
            if b.label == "abstract":
                slack, edge = slack * 2, max(0.1, edge) * 10
            up, left = (float(o.box[1]), float(o.box[0])) if self.axis == X else (-float(o.box[2]), float(o.box[1]))
            below = o.box[3] < b.box[1] if self.axis == X else o.box[0] > b.box[2]
            if below and b.label not in ROLES["unordered"]:
                up, left = -up, -left
            if abs(least_up - up) <= slack:
                up = least_up
            total = edge * 10_000 + up + left * 0.0001
            least_up = min(least_up, up)
            if total < best:
                best, place = total, k + self.after(b, o)
        return place

    def after(self, b: Block, o: Block) -> bool:
        if np.floor(b.box[1] / 2) != np.floor(o.box[1] / 2):
            return bool(b.box[1] > o.box[1])
        if self.axis == X and np.floor(b.box[0] / 2) != np.floor(b.box[2] / 2):
            return bool(b.box[0] > o.box[0])
        if self.axis == Y and b.box[0] != b.box[2]:
            return bool(-b.box[2] > -o.box[2])
        return float((b.centre.astype(float) ** 2).sum()) > float((o.centre.astype(float) ** 2).sum())

    def order(self) -> list[int]:
        done, waiting = [], []
        for band in self.bands():
            if band[0].label != "region" or len(intervals([b.box for b in band], self.axis)) == 1:
                self.mark_across(band)
            plain = [b for b in band if b.role not in ACROSS]
            titles = [b for b in band if b.role in ACROSS and b.label == "doc_title"]
            waiting += [b for b in band if b.role in ACROSS and b.label != "doc_title"]
            some = self.put_back(self.cut_order(plain) if plain else [], titles)
            if waiting and waiting[0].label == "region":
                some, waiting = self.put_back(some, waiting), []
            done += some
        done = self.put_back(done, waiting)
        head, foot, loose = (sorted(self.group[g], key=self.grid_key) for g in ("header", "footer", "unordered"))
        out: list[Block] = []
        for b in [*head, *done, *foot, *loose]:
            family = [*b.release(), b]
            if family[0].axis == X:
                family.sort(key=lambda c: (c.box[1], c.box[0], float((c.centre**2).sum())))
            else:
                family.sort(key=lambda c: (-c.box[2], c.box[1]))
            out += family
        return list(dict.fromkeys([b.key for b in out] + [b.key for b in self.blocks]))


def enhanced_order(rows: list[dict], width: float, height: float) -> list[int]:
    """A permutation of the rows (label and box); boxes count as far as they are on the page."""
    cut = lambda v, top: min(max(v, 0.0), top)
    inside = [r | {"min_x": cut(r["min_x"], width), "min_y": cut(r["min_y"], height), "max_x": cut(r["max_x"], width), "max_y": cut(r["max_y"], height)} for r in rows]
    return list(range(len(rows))) if len(rows) < 2 else Page(inside, width, height).order()


def xy_cut_enhanced(blocks: DataFrame, keys: list[str], width: float, height: float, id_col: str = "block_index") -> DataFrame:
    """`position` by the enhanced order."""
    from papyra.operators.reading_order import _with

    def order(rows: list[dict]):
        for k, i in enumerate(enhanced_order(rows, width, height)):
            yield rows[i] | {"position": k}

    return by_page(blocks, keys, [id_col], order, _with(blocks.schema, "position"))


def reading_strategy(blocks: DataFrame, keys: list[str], strategy: str, width: float, height: float, id_col: str = "block_index") -> DataFrame:
    """`position` by a strategy: XyCut, XyCutEnhanced, Model (falls back to XyCut on pages without a whole order) or Auto (Model, else enhanced)."""
    from pyspark.sql import Window
    from pyspark.sql import functions as F

    from papyra.operators.reading_order import xy_cut

    if strategy == "XyCut":
        return xy_cut(blocks, keys, id_col)
    if strategy == "XyCutEnhanced":
        return xy_cut_enhanced(blocks, keys, width, height, id_col)
    if strategy not in ("Model", "Auto"):
        raise ValueError(f"unknown strategy {strategy}")
    page = Window.partitionBy(*keys)
    marked = blocks.withColumn("_whole", F.count("order_index").over(page) == F.count(F.lit(1)).over(page))
    model = marked.filter("_whole").withColumn("position", (F.row_number().over(page.orderBy("order_index", id_col)) - 1).cast("int"))
    rest = marked.filter("not _whole")
    rest = xy_cut(rest, keys, id_col) if strategy == "Model" else xy_cut_enhanced(rest, keys, width, height, id_col)
    return model.unionByName(rest).drop("_whole")
