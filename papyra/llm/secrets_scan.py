"""Secret scans of texts and of what is encoded in them, by a worklist of decoded layers."""

from __future__ import annotations

import base64
import binascii
import bz2
import codecs
import hashlib
import lzma
import re
import zlib
from bisect import bisect_right
from collections.abc import Iterator
from itertools import accumulate, chain

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from papyra.llm._shared import kept, pieces, small_batches, text_or_empty

#: Kinds, in the order in which spans with the same start are listed.
KINDS = ("assign", "access", "hex")
#: Characters that may be decoded in a document: no bound, as layers are made one window at a time.
MOST_DECODED = None
#: Bytes unpacked at a time, characters of a window of unpacked text, and those after which a run without an end is cut and the document marked.
PIECE, WINDOW, LONGEST_RUN = 1 << 18, 1 << 20, 1 << 25
#: Bytes up to which an unpacked layer that is packed itself is held as a whole, and larger ones that may be open at a time; at more the document is marked.
HELD, MOST_OPEN = 1 << 22, 64

# fixed values: the patterns of the kinds; "a" keeps letter case to A-Z
_ASSIGN = re.compile(r"""(?ai:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
_ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
_HEX = re.compile(r"[0-9a-f]{24,}")

_PERCENT = re.compile(r"(?:%[0-9A-Fa-f]{2})+")
_ESCAPE = re.compile(r"(?:\\u[0-9A-Fa-f]{4})+|\\u\{[0-9A-Fa-f]{1,6}\}|(?:\\x[0-9A-Fa-f]{2})+|&#[0-9]{1,7};|&#[xX][0-9A-Fa-f]{1,6};")
_BASE64 = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{16,}={0,2}")
_WRAPPED = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{16,}(?:[\x20\t]*\r?\n[\x20\t]*[A-Za-z0-9+/_-]+)+={0,2}")
_LINE = re.compile(r"[A-Za-z0-9+/_=-]+")
#: What no secret, escape or base64 run, wrapped ones too, has inside.
_OUTSIDE = re.compile(r"""[^A-Za-z0-9+/_=%\\&#;{}.:"'\x20\t\r\n-]""")
_HEX_DIGITS = re.compile(r"[0-9A-Fa-f]{4}")


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind's number, end) of each match, ascending."""
    out = []
    if "=" in text or ":" in text:
        out += [(m.start(), 0, m.end()) for m in _ASSIGN.finditer(text) if m.end(1) - m.start(1) >= 6]
    out += [(m.start(), 1, m.end()) for m in _ACCESS.finditer(text)]
    out += [(m.start(), 2, m.end()) for m in _HEX.finditer(text)]
    return sorted(out)


class Layer:
    """A decoded text with where its characters come from in its parent.

    `parts` are (first character, source start, source end, plain): plain ones map character by character, the others
    as a whole.
    """

    def __init__(self, text: str, parent: Layer | None = None, parts: list[tuple[int, int, int, bool]] | None = None):
        self.text, self.parent, self.parts = text, parent, parts
        self.firsts = [p[0] for p in parts or ()]

    def source(self, start: int, end: int) -> tuple[int, int]:
        """The span in the document of a span, not empty, of this layer."""
        layer = self
        while layer.parent is not None:
            first, s, e, plain = layer.parts[bisect_right(layer.firsts, start) - 1]
            a = s + start - first if plain else s
            first, s, e, plain = layer.parts[bisect_right(layer.firsts, end - 1) - 1]
            start, end, layer = a, s + end - first if plain else e, layer.parent
        return start, end


def _replaced(layer: Layer, pattern: re.Pattern, decode) -> Layer | None:
    """The layer's text with all matches decoded; decode gives (text, width) per piece of a match, or None to leave it."""
    out, parts, size, at = [], [], 0, 0

    def add(text, s, e, plain):
        nonlocal size
        if text:
            parts.append((size, s, e, plain))
            out.append(text)
            size += len(text)

    for m in pattern.finditer(layer.text):
        found = decode(m[0])
        if found is None:
            continue
        add(layer.text[at : m.start()], at, m.start(), True)
        at = m.start()
        for text, width in found:
            add(text, at, at + width, False)
            at += width
    if not at or not size:
        return None
    add(layer.text[at:], at, len(layer.text), True)
    return Layer("".join(out), layer, parts)


def _percent(run: str):
    data = bytes.fromhex(run.replace("%", ""))
    if max(data) < 128:
        return [(chr(b), 3) for b in data]
    return [(data.decode("utf-8", "replace"), len(run))]


def _escape(run: str):
    if run[0] == "&" or run[:3] == "\\u{":
        digits = run.strip("\\u{}&#;")
        code = int(digits[1:], 16) if digits[:1] in "xX" else int(digits, 10 if run[0] == "&" else 16)
        return [(chr(code), len(run))] if 0 < code < 0x110000 and not 0xD800 <= code < 0xE000 else None
    if run[:2] == "\\x":
        data = bytes.fromhex(run.replace("\\x", ""))
        return [(chr(b), 4) for b in data] if max(data) < 128 else [(data.decode("utf-8", "replace"), len(run))]
    units = [int(x, 16) for x in _HEX_DIGITS.findall(run)]
    if not any(0xD800 <= u < 0xE000 for u in units):
        return [(chr(u), 6) for u in units]
    return [(b"".join(u.to_bytes(2, "big") for u in units).decode("utf-16-be", "replace"), len(run))]


def _form(head: bytes) -> str | None:
    """The compressed form that the first bytes tell."""
    if head[:2] == b"\x1f\x8b":
        return "gzip"
    if head[:1] == b"\x78" and len(head) > 2 and int.from_bytes(head[:2], "big") % 31 == 0:
        return "zlib"
    return {b"BZh": "bz2", b"\xfd7z": "xz", b"\x28\xb5\x2f": "zstd"}.get(head[:3])


def _start(form: str):
    if form in ("gzip", "zlib"):
        return zlib.decompressobj(31 if form == "gzip" else 15)
    return {"bz2": bz2.BZ2Decompressor, "xz": lzma.LZMADecompressor, "zstd": lambda: zstandard.ZstdDecompressor().decompressobj()}[form]()


def _inflated(chunks: Iterator[bytes]) -> Iterator[bytes]:
    """Unpacked data of all members, piece by piece; up to the first error if it is broken."""
    data, form, d = b"", None, None
    chunks = iter(chunks)
    try:
        while True:
            if d is None:
                while len(data) < 6 and (more := next(chunks, b"")):
                    data += more
                form = _form(data)
                if form is None:
                    return
                d = _start(form)
            if not data:
                data = next(chunks, b"")
                if not data:
                    return
            piece, data = (data[:256], data[256:]) if form == "zstd" else (data, b"")  # a zstd block of few bytes gives up to 128 KB
            if form in ("gzip", "zlib"):
                out = d.decompress(piece, PIECE)
                data = d.unconsumed_tail
                while not d.eof and len(out) == PIECE:
                    yield out
                    out = d.decompress(data, PIECE)
                    data = d.unconsumed_tail
                if out:
                    yield out
            elif form == "zstd":
                if out := d.decompress(piece):
                    yield out
            else:
                if out := d.decompress(piece, PIECE):
                    yield out
                while not d.eof and not d.needs_input:
                    if out := d.decompress(b"", PIECE):
                        yield out
            if d.eof:
                data, d = d.unused_data + data, None
    except (zlib.error, OSError, EOFError, lzma.LZMAError, zstandard.ZstdError, ValueError):
        return


class TooDeep(Exception):
    """Too many large packed layers inside each other."""


def _opened(data: bytes) -> Iterator[bytes] | None:
    """Unpacked data, compressed forms in compressed forms to any depth; None if it has no such form, nothing more where forms hold themselves."""
    seen, chunks, packed, opened = set(), iter([data]), False, 0
    while True:
        head = b""
        while len(head) < 6 and (more := next(chunks, b"")):
            head += more
        if _form(head) is None:
            return chain([head], chunks) if packed else None
        read = [[head]]  # what was taken of the layer, until it has proved to be packed

        def feed(first=head, rest=chunks, read=read):
            yield first
            for c in rest:
                for some in read:
                    some.append(c)
                yield c

        inner, held, size = _inflated(feed()), [], 0
        for piece in inner:
            read.clear()
            held.append(piece)
            size += len(piece)
            if size > HELD:
                break
        if not held:  # only looks packed
            return chain(read[0], chunks) if packed else None
        packed = True
        if size > HELD:
            chunks, opened = chain(held, inner), opened + 1
            if opened > MOST_OPEN:
                raise TooDeep
            continue
        whole = b"".join(held)
        key = hashlib.blake2b(whole, digest_size=16).digest()
        if key in seen:
            return iter(())
        seen.add(key)
        chunks, opened = iter([whole]), 0


#: Starts of compressed forms that are long enough to be looked for inside other bytes.
_MAGIC = re.compile(rb"\x1f\x8b\x08|BZh[1-9]1AY&SY|\xfd7zXZ\x00|\x28\xb5\x2f\xfd")


def _windows(chunks: Iterator[bytes], coding: str = "utf-8") -> Iterator[tuple[str, bool]]:
    """The text in windows that end at a character no secret or coded run has, so none is cut; false if a run is too long for that."""
    decode = codecs.getincrementaldecoder(coding)("replace").decode
    held, size = [], 0
    for chunk in chunks:
        text = decode(chunk)
        held.append(text)
        size += len(text)
        if size < WINDOW:
            continue
        at = max((m.end() for m in _OUTSIDE.finditer(text)), default=0)
        if at or size > LONGEST_RUN:
            at = at or len(text)
            yield "".join([*held[:-1], text[:at]]), size <= LONGEST_RUN
            held, size = [text[at:]], len(text) - at
    if text := "".join([*held, decode(b"", True)]):
        yield text, True


def _runs(text: str) -> Iterator[tuple[list[tuple[int, int]], str]]:
    """(lines' (start, end), joined characters) of base64 runs: each on a line, and those wrapped over lines, whole and by lines of one width."""
    for m in _BASE64.finditer(text):
        yield [m.span()], m[0]
    if "\n" not in text:
        return
    for m in _WRAPPED.finditer(text):
        lines = [(m.start() + x.start(), m.start() + x.end()) for x in _LINE.finditer(m[0])]
        groups, at = {(0, len(lines))}, 0
        while at < len(lines):
            width, stop = lines[at][1] - lines[at][0], at + 1
            while stop < len(lines) and lines[stop][1] - lines[stop][0] == width:
                stop += 1
            if stop < len(lines) and lines[stop][1] - lines[stop][0] < width:
                groups.add((at, stop + 1))
            groups.add((at, stop))
            at = stop
        for i, j in sorted(groups):
            if j - i > 1:
                yield lines[i:j], "".join(text[s:e] for s, e in lines[i:j])


def _unpacked_layers(layer: Layer, data: bytes, at: tuple[int, int]) -> Iterator[tuple[Layer, int, bool, bool]]:
    """Windows of packed data's text, and again as UTF-16 if it has zero bytes; all of them have their place as a whole."""
    parts, zeros = [(0, *at, False)], False
    for coding in ("utf-8", "utf-16-le", "utf-16-be"):
        if coding != "utf-8" and not zeros:
            return
        try:
            for i, (text, whole) in enumerate(_windows(_opened(data) or iter(()), coding)):
                zeros = zeros or (coding == "utf-8" and "\0" in text)
                yield Layer(text, layer, parts), len(text), i == 0 and coding == "utf-8", whole
        except TooDeep:
            yield Layer("", layer, parts), 0, False, False
            return


def _base64_layers(layer: Layer) -> Iterator[tuple[Layer, int, bool, bool]]:
    """What base64 runs hold, from each of their first four characters on, as other text may stand right before; the first counts.

    Compressed forms may begin anywhere in the decoded bytes.
    """
    for lines, run in _runs(layer.text):
        raw = run.rstrip("=").translate({45: 43, 95: 47})
        firsts = list(accumulate((e - s for s, e in lines), initial=0))
        start, end = lines[0][0], lines[-1][1]

        def place(k: int) -> int:
            i = min(bisect_right(firsts, k) - 1, len(lines) - 1)
            return lines[i][0] + k - firsts[i]

        for phase in range(4):
            some = raw[phase:]
            some = some[: len(some) - (len(some) % 4 == 1)]
            try:
                data = base64.b64decode(some + "=" * (-len(some) % 4))
            except (binascii.Error, ValueError):
                continue
            if not data:
                continue

            def sources(i: int, j: int) -> tuple[int, int]:
                """Where bytes i to j come from."""
                a, b = phase + i // 3 * 4, phase + (j - 1) // 3 * 4 + 3
                return place(a), min(end, place(min(b, len(run) - 1)) + 1)

            if _form(data[:6]) is not None and _opened(data) is not None:
                yield from _unpacked_layers(layer, data, (place(phase), end))
                continue
            for m in _MAGIC.finditer(data, 1):
                yield from _unpacked_layers(layer, data[m.start() :], (place(phase + m.start() // 3 * 4), end))
            try:
                text, valid = data.decode(), phase == 0
            except UnicodeDecodeError:  # one character for each byte, as what is sought is ASCII
                text, valid = data.decode("ascii", "replace"), False
            if text.isascii() or len(text) == len(data):
                parts = [(i, *sources(i, min(i + 3, len(text))), False) for i in range(0, len(text), 3)]
            else:
                parts = [(0, place(phase), end, False)]
            yield Layer(text, layer, parts), len(text), valid, True
            if b"\0" in data:
                for coding in ("utf-16-le", "utf-16-be"):
                    wide = data.decode(coding, "replace")
                    if "\0" in wide or not any(c.isascii() for c in wide):
                        continue
                    yield Layer(wide, layer, [(0, place(phase), end, False)]), len(wide), False, True


def _children(layer: Layer) -> Iterator[tuple[Layer, int, bool, bool]]:
    """(layer, decoded characters, whether it counts: not as a later window or if not UTF-8, whether no run was cut), one after the other."""
    for here, pattern, decode in (("%" in layer.text, _PERCENT, _percent), ("\\" in layer.text or "&#" in layer.text, _ESCAPE, _escape)):
        if here and (child := _replaced(layer, pattern, decode)):
            ends = [p[0] for p in child.parts[1:]] + [len(child.text)]
            yield child, sum(e - p[0] for p, e in zip(child.parts, ends) if not p[3]), True, True
    yield from _base64_layers(layer)


def _scan(text: str, most_decoded: int | None = MOST_DECODED) -> tuple[list, list, int, list]:
    """(base spans, all spans, layers beyond the text, places not unwrapped whole); spans as base_spans has them.

    Layers are made one at a time, deepest first: each is scanned, its spans are mapped to the document, and it is
    unwrapped once more in each way until nothing new comes. A layer met before at the same place isn't unwrapped
    again, which ends cycles.
    """
    base = base_spans(text)
    spans, seen, decoded, layers, cut = set(base), set(), 0, 0, []
    work = [_children(Layer(text))]
    while work:
        found = next(work[-1], None)
        if found is None:
            work.pop()
            continue
        child, new, begins, whole = found
        place = child.source(0, max(1, len(child.text)))
        if not whole:
            cut.append(place)
        key = (place, hashlib.blake2b(child.text.encode("utf-8", "surrogatepass"), digest_size=16).digest())
        if key in seen:
            continue
        seen.add(key)
        decoded += new
        if most_decoded is not None and decoded > most_decoded:
            return base, sorted(spans), layers, [(0, len(text))]
        layers += begins
        if not child.text:
            continue
        for s, kind, e in base_spans(child.text):
            s, e = child.source(s, e)
            spans.add((s, kind, e))
        work.append(_children(child))
    return base, sorted(spans), layers, cut


def scan(text: str, most_decoded: int | None = MOST_DECODED) -> tuple[list, list, int, bool]:
    """(base spans, all spans, layers beyond the text, whether all were unwrapped)."""
    base, spans, layers, cut = _scan(text, most_decoded)
    return base, spans, layers, not cut


def _listed(spans: list) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)


def find_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_assign, n_access, n_hex, base_sha256, spans, n_layers, complete of each row.

    Spans are in code points, the end exclusive. Null text counts as empty. complete is false where a packed
    layer has a run of over LONGEST_RUN characters without an end, or more than MOST_OPEN large packed layers inside
    each other; the text itself is scanned whole in any case. Each row, repeated ones too, has its answer; an empty
    table gives an empty one, and other columns don't matter.
    """
    slim = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_or_empty(docs, text_col).alias("text"))
    schema = "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_layers int, complete boolean"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in pieces(batches, "text"):
            rows = []
            for t in texts:
                base, spans, layers, whole = scan(t)
                rows.append((*(sum(k == kind for _, k, _ in base) for kind in range(3)), hashlib.sha256(_listed(base).encode()).hexdigest(), _listed(spans), layers, whole))
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int32(), pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, t) for c, t in zip(zip(*rows), kinds))], [x.split()[0] for x in schema.split(", ")])

    return slim.mapInArrow(run, schema).withColumnRenamed("doc_id", id_col)


def redact(text: str) -> str:
    """The text with each secret replaced by its kind; spans that overlap become one, of the first one's kind. What could not be scanned whole goes as well."""
    out, at = [], 0
    _, spans, _, cut = _scan(text)
    for s, name, e in sorted([(s, KINDS[k], e) for s, k, e in spans] + [(s, "unscanned", e) for s, e in cut], key=lambda x: x[0]):
        if s >= at:
            out += [text[at:s], f"[{name}]"]
        at = max(at, e)
    return "".join([*out, text[at:]]) if out else text


def redact_secrets(docs: DataFrame, text_col: str = "text", length_col: str | None = None) -> DataFrame:
    """docs with the secrets of the text replaced, and the length in characters renewed; null texts and all else stay.

    Every row stays, repeated ones and those with a null id too; an empty table gives an empty one. What could not be
    unwrapped whole is replaced as well.
    """
    schema = docs.schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept("secrets", dict)  # frees what the worker kept for another operator
        for batch, texts in pieces(batches, text_col):
            clean = [None if t is None else redact(t) for t in texts]
            cols = list(batch.columns)
            at = batch.schema.get_field_index(text_col)
            cols[at] = pa.array(clean, cols[at].type)
            if length_col:
                k = batch.schema.get_field_index(length_col)
                old = cols[k].to_pylist()
                cols[k] = pa.array([n if c == t else len(c) for n, c, t in zip(old, clean, texts)], cols[k].type)
            yield pa.RecordBatch.from_arrays(cols, schema=batch.schema)

    small_batches(docs.sparkSession)
    return docs.mapInArrow(run, schema)


def op9(spark, sf_dir: str) -> DataFrame:
    """find_secrets of documents. Odd rows: see find_secrets."""
    return find_secrets(spark.read.parquet(f"{sf_dir}/documents.parquet"))
