"""For queries that SQL can't express: checks of all their rows against slow plain versions. Each takes (spark, folder, rows)."""

import re
import zipfile
from collections import defaultdict
from io import BytesIO
from statistics import median

import numpy as np

from papyra.plans import views as V
from papyra.plans.queries import page_lines, regions


def grouped(rows, *keys):
    out = defaultdict(list)
    for r in rows:
        out[tuple(r[k] for k in keys)].append(r)
    return out


def sorted_boxes(spark, d, rows):
    pages = grouped(regions(spark, d).collect(), "page_id")
    for key, got in grouped(rows, "page_id").items():
        boxes = sorted(pages[key], key=lambda r: (r.min_y, r.min_x))
        want = []
        for r in boxes:  # each box goes left past the ones before it that stand at its height and right of it
            at = len(want)
            while at and abs(r.min_y - want[at - 1].min_y) < 10 and r.min_x < want[at - 1].min_x:
                at -= 1
            want.insert(at, r)
        place = {r.region_index: r.position for r in got}
        assert sorted(place.values()) == list(range(len(want)))
        assert [(r.min_x, r.min_y) for r in sorted(pages[key], key=lambda r: place[r.region_index])] == [(r.min_x, r.min_y) for r in want]


def cut(boxes, axis, tried=False):
    """Indices by recursion, one cut at a time."""
    if len(boxes) < 2:
        return [i for i, _ in boxes]
    ends = sorted(boxes, key=lambda b: b[1][axis])
    top = ends[0][1][axis + 2]
    for n, (_, b) in enumerate(ends):
        if n and b[axis] - top > 1:
            first = {i for i, _ in ends[:n]}
            a, rest = [x for x in boxes if x[0] in first], [x for x in boxes if x[0] not in first]
            return parts(a, rest, axis)
        top = max(top, b[axis + 2])
    if axis == 0 and not tried:
        return cut(boxes, 1, True)
    return [i for i, _ in sorted(boxes, key=lambda b: (b[1][1], b[1][0]))]


def parts(first, rest, axis):
    """The first strip and the others on the same axis, each cut on the other one."""
    out = cut(first, 1 - axis)
    ends = sorted(rest, key=lambda b: b[1][axis])
    top = ends[0][1][axis + 2]
    for n, (_, b) in enumerate(ends):
        if n and b[axis] - top > 1:
            ids = {i for i, _ in ends[:n]}
            return out + parts([x for x in rest if x[0] in ids], [x for x in rest if x[0] not in ids], axis)
        top = max(top, b[axis + 2])
    return out + cut(rest, 1 - axis)


def xy_cut(spark, d, rows):
    pages = grouped(regions(spark, d).orderBy("region_index").collect(), "page_id")
    for key, got in grouped(rows, "page_id").items():
        boxes = [(r.region_index, (r.min_x, r.min_y, r.max_x, r.max_y)) for r in pages[key]]
        assert [r.region_index for r in sorted(got, key=lambda r: r.position)] == cut(boxes, 0), key


def xy_cut_enhanced(spark, d, rows):
    """A permutation of each page; pages of boxes one below the other go down."""
    pages = grouped(regions(spark, d).collect(), "page_id")
    plain = 0
    for key, got in grouped(rows, "page_id").items():
        assert sorted(r.position for r in got) == list(range(len(pages[key]))) and {r.region_index for r in got} == {r.region_index for r in pages[key]}
        boxes = sorted(pages[key], key=lambda r: r.min_y)
        over = all(a.max_y + 20 < b.min_y and min(a.max_x, b.max_x) - max(a.min_x, b.min_x) > 0.7 * max(a.max_x - a.min_x, b.max_x - b.min_x) for a, b in zip(boxes, boxes[1:]))
        if over and {r.label for r in boxes} == {"text"}:
            plain += 1
            assert [r.region_index for r in sorted(got, key=lambda r: r.position)] == [r.region_index for r in boxes]
    assert plain


def page_structure(spark, d, rows):
    """Blocks are the kept regions and the lines outside of them; every line that is in one region alone is in its text."""
    lines = grouped(page_lines(spark, d).collect(), "page_id")
    for key, got in grouped(rows, "page_id").items():
        assert sorted(r.block_order for r in got) == list(range(len(got)))
        texts = [t for r in got if r.text for t in re.findall(r"line \d+", r.text)]
        assert sorted(texts) == sorted(r.text for r in lines[key])
        assert all(r.block_index >= 1 << 32 for r in got if r.orphan) and {r.text for r in got if r.type in ("Figure", "Formula")} <= {None}


def paragraphs(spark, d, rows):
    pages = grouped(V.lines(spark, d).filter("text <> ''").collect(), "doc_id")
    for key, got in grouped(rows, "doc_id").items():
        last, want = {}, {}
        for r in sorted(pages[key], key=lambda r: (r.min_y, r.min_x, r.line_index)):
            for k in range(len(last) + 1):
                a = last.get(k)
                tall = max(a.max_y - a.min_y, r.max_y - r.min_y) if a else 0
                beside = min(a.max_x, r.max_x) - max(a.min_x, r.min_x) if a else 0
                if a is None or -tall <= r.min_y - a.max_y <= tall / 2 and (beside > 0.2 * min(a.max_x - a.min_x, r.max_x - r.min_x) or -beside <= tall):
                    last[k], want[r.line_index] = r, k
                    break
        assert {r.line_index: r.paragraph for r in got} == want


def ctc_words(spark, d, rows):
    names = ["", "a", "b", " ", "d", "日", "f", "g"]
    got = {k: [(r.text, round(r.confidence, 6), r.first_step, r.last_step) for r in v] for k, v in grouped(rows, "crop_id").items()}
    for r in V.probs(spark, d).collect():
        p = np.array(r.probs)
        best, chars, before = p.argmax(1), [], None
        for step, k in enumerate(best):
            if k == before and chars and k:
                chars[-1][3] = step
            elif k:
                chars.append([names[k], p[step, k], step, step])
            before = k
        for a, b in reversed(list(zip(chars, chars[1:]))):
            peak = max((p[s, 3] for s in range(a[3] + 1, b[2])), default=0)
            if peak >= 0.55 and not {a[0], b[0]} & {" ", "日"}:
                chars.insert(chars.index(b), [" ", 0.0, a[3], a[3]])
        words, open_ = [], False
        for c, prob, first, last in chars:
            if c in " 日" or not open_:
                open_ = False
            if c == " ":
                continue
            if open_:
                words[-1][0] += c
                words[-1][1].append(prob)
                words[-1][3] = last
            else:
                words.append([c, [prob], first, last])
            open_ = c != "日"
        assert got.get((r.crop_id,), []) == [(t, round(float(np.mean(x)), 6), a, b) for t, x, a, b in words], r.crop_id


def paired_bootstrap(spark, d, rows):
    """Means are those of plain lists; intervals are close to those of resampled documents, one draw after the other."""
    from papyra.operators.evaluate import score_pairs

    scores = {r.id: r.cer for r in score_pairs(V.pairs(spark, d)).collect()}
    for r in rows:
        diff = np.array([c * 0.9 - c for i, c in sorted(scores.items()) if (i % 2 == 0) == (r.subgroup == "even")])
        assert r.documents == len(diff) and abs(r.mean_difference - diff.mean()) < 1e-9
        rng = np.random.default_rng(1)
        means = [diff[rng.integers(0, len(diff), len(diff))].mean() for _ in range(4000)]
        low, high = np.percentile(means, [2.5, 97.5])
        assert abs(r.low - low) < 0.2 * (high - low) and abs(r.high - high) < 0.2 * (high - low)
        assert r.gate == ("improved" if r.high < 0 else "regressed" if r.low > 0 else "inconclusive")


def find_matches(spark, d, rows):
    """Matches are where they say; e-mail addresses, URLs and percentages are all that plain scans find, and checks hold for cards and IBANs."""
    lines = {(r.doc_id, r.line_index): r for r in V.lines(spark, d).collect()}
    got = defaultdict(set)
    for r in rows:
        line = lines[r.doc_id, r.line_index]
        assert line.text[r.start : r.start + r.length] == r.value and line.min_x - 1e-6 <= r.min_x <= r.max_x <= line.max_x + 1e-6
        got[r.kind].add((r.doc_id, r.line_index, r.start, r.value))
        if r.kind == "PaymentCard":
            digits = [int(c) for c in r.normalized][::-1]
            assert sum(digits[::2]) + sum(sum(divmod(2 * x, 10)) for x in digits[1::2]) and (sum(digits[::2]) + sum(sum(divmod(2 * x, 10)) for x in digits[1::2])) % 10 == 0
        if r.kind == "Iban":
            assert int("".join(str(int(c, 36)) for c in r.normalized[4:] + r.normalized[:4])) % 97 == 1
        if r.kind == "Phone":
            assert re.fullmatch(r"\+?\d{7,15}", r.normalized)
    want = defaultdict(set)
    for key, line in lines.items():
        for m in re.finditer(r"[\w.%+-]+@[\w.-]+\.[A-Za-z]{2,}", line.text):
            want["Email"].add((*key, m.start(), m[0]))
        for m in re.finditer(r"(?:https?://|www\.)\S+", line.text):
            want["Url"].add((*key, m.start(), m[0].rstrip(".,;:!?)]}")))
        for m in re.finditer(r"(?<![\w.,])[-+−]?\d+(?:[.,]\d+)?[  ]?%", line.text):
            want["Percentage"].add((*key, m.start(), m[0]))
    for kind, found in want.items():
        assert got[kind] == found, kind
    assert got["Email"]


def layout_text(spark, d, rows):
    """Texts in order and at columns that differ as their left edges do."""
    pages = grouped(V.lines(spark, d).collect(), "doc_id")
    assert {(r.doc_id,) for r in rows} == set(pages)
    for r in rows:
        seen = [x for x in pages[r.doc_id,] if x.text.strip()]
        pair = lambda x: x.line_index // 2
        shown = [t for t in r.layout_text.split("\n") if t]
        by_row = defaultdict(list)
        for x in sorted(seen, key=lambda x: x.line_index):
            by_row[pair(x)].append(x)
        want = [by_row[k] for k in sorted(by_row)]
        assert len(shown) == len(want)
        cells = [(x.max_x - x.min_x) / len(x.text.strip()) for x in seen if x.max_x > x.min_x]
        cell = median(cells) if cells else 1.0
        origin = min(round(x.min_x / cell) for x in seen) if seen else 0
        for line, row in zip(shown, want):
            at = 0
            for x in row:
                place = max(round(x.min_x / cell) - origin, at)
                t = x.text.strip()
                if t.isascii():
                    assert line[place : place + len(t)] == t or line.find(t, at) >= 0
                at = line.find(t, at) + len(t) + 1


def block_text(spark, d, rows):
    """All words of the lines, in order of rows, hyphens at line ends aside."""
    pages = grouped(V.lines(spark, d).collect(), "doc_id")
    for r in rows:
        letters = "".join(x.text for x in sorted(pages[r.doc_id,], key=lambda x: x.line_index))
        assert sorted(re.sub(r"[\s-]", "", r.text)) == sorted(re.sub(r"[\s-]", "", letters))
        assert re.sub(r"[\s-]", "", r.text) == re.sub(r"[\s-]", "", letters)


def _blocks(spark, d):
    return {k[0]: sorted(v, key=lambda b: (b.page_number, b.block_order)) for k, v in grouped(V.blocks(spark, d).collect(), "doc_id").items()}


def export_markdown(spark, d, rows):
    """Bodies' words in order, without headers; titles are headings."""
    blocks = _blocks(spark, d)
    words = lambda t: re.findall(r"\w+", t)
    assert {r.doc_id for r in rows} == set(blocks)
    for r in rows:
        body = [b for b in blocks[r.doc_id] if b.type != "Header"]
        assert words(r.markdown) == [w for b in body for w in words(b.text)]
        assert sum(x.startswith("#") for x in r.markdown.split("\n")) >= sum(b.type == "Title" and bool(b.text.strip()) for b in body) * (1 if body else 0) - 1


def export_html(spark, d, rows):
    """Every block's escaped text in a tag of its type, in order."""
    pages = grouped(V.blocks(spark, d).collect(), "doc_id", "page_number")
    escape = lambda t: t.replace("&", "&amp;").replace("<", "&lt;").replace(">", "&gt;")
    assert {(r.doc_id, r.page_number) for r in rows} == set(pages)
    for r in rows:
        body = re.search(r"(?s)<body>\n(.*)</body>", r.html)[1]
        want = []
        for b in sorted(pages[r.doc_id, r.page_number], key=lambda b: b.block_order):
            tag = "h2" if b.type == "Title" else "p"
            if b.text.strip():
                want.append(f"<{tag}>{escape(b.text.strip())}</{tag}>")
        plain = lambda t: t.replace("&quot;", '"').replace("&apos;", "'").replace("&#39;", "'")
        assert plain(body) == plain("".join(f"  {x}\n" for x in want))


def _files(rows, spark, d, make, name):
    """The digests are those of files that hold every block's text."""
    from hashlib import sha256

    blocks = V.blocks(spark, d)
    files = {r.doc_id: bytes(r[name]) for r in make(blocks).collect()}
    assert {r.doc_id: (r.bytes, r.sha256) for r in rows} == {k: (len(v), sha256(v).hexdigest()) for k, v in files.items()}
    for doc, own in _blocks(spark, d).items():
        with zipfile.ZipFile(BytesIO(files[doc])) as z:
            text = "".join(re.sub(r"<[^>]*>", "", z.read(n).decode()) for n in z.namelist() if n.endswith(".xml") and ("sheet" in n or "document" in n))
        bare = lambda t: re.sub(r"\s", "", t.replace("&amp;", "&").replace("&lt;", "<").replace("&gt;", ">").replace("&quot;", '"'))
        assert all(bare(b.text) in bare(text) for b in own)


def export_docx(spark, d, rows):
    from papyra.export.office import docx

    _files(rows, spark, d, docx, "docx")


def export_xlsx(spark, d, rows):
    from papyra.export.office import xlsx

    _files(rows, spark, d, xlsx, "xlsx")


def searchable_pdf(spark, d, rows):
    """One file for each page, the same each time; its text is read again by pdf_text_layer."""
    assert len({r.sha256 for r in rows}) == len(rows) == V.read(spark, d, "benchmark").count() and min(r.bytes for r in rows) > 500


def detect_boxes(spark, d, rows):
    """Boxes are where a flood fill finds parts of four pixels or more whose mean is high, and lie around them."""
    got = grouped(rows, "page_id")
    for r in V.read(spark, d, "embeddings").collect():
        p = np.abs(np.array(r.embedding, np.float32)).reshape(8, 8) * 5
        left = {(int(y), int(x)) for y, x in zip(*np.nonzero(p > 0.3))}
        fills = []
        while left:
            work = [left.pop()]
            part = set(work)
            while work:
                y, x = work.pop()
                near = {(y + a, x + b) for a in (-1, 0, 1) for b in (-1, 0, 1)} & left
                left -= near
                part |= near
                work += near
            fills.append(part)
        mine = got.get((r.vec_id,), [])
        assert len(mine) <= sum(len(f) >= 4 for f in fills)
        for b in mine:
            xs, ys = [q["x"] for q in b.polygon], [q["y"] for q in b.polygon]
            inside = lambda f: sum(min(xs) - 1e-3 <= x <= max(xs) + 1e-3 and min(ys) - 1e-3 <= y <= max(ys) + 1e-3 for y, x in f)  # noqa: B023, E731
            assert b.score >= 0.3 and any(len(f) >= 4 and inside(f) == len(f) for f in fills), r.vec_id


PLAIN = {f.__name__: f for f in (
    sorted_boxes, xy_cut, xy_cut_enhanced, page_structure, paragraphs, ctc_words, paired_bootstrap, find_matches, layout_text, block_text, export_markdown, export_html, export_docx, export_xlsx, searchable_pdf, detect_boxes,
)}
