"""Frames of images and pages of files by decoders and renderers of the caller, one alive at a time, with bounds."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from typing import Protocol

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from papyra.functions.numbers import auto_dpi_of
from papyra.operators.inference import _own, _reason
from papyra.options import PdfOptions
from papyra.sources.inputs import parse_page_range


class FrameDecoder(Protocol):
    """An image's bytes as frames, one after the other: (width, height, bytes). It may stop being asked at any frame."""

    def frames(self, content: bytes) -> Iterator[tuple[int, int, bytes]]: ...


class PageRenderer(Protocol):
    """A file's pages: their sizes in points, and a page's picture at a resolution as (width, height, bytes)."""

    def sizes(self, content: bytes) -> list[tuple[float, float]]: ...

    def render(self, content: bytes, page: int, dpi: int) -> tuple[int, int, bytes]: ...


def _rows(files: DataFrame, make: Callable, own: str, content: str, each: Callable) -> DataFrame:
    keep = [f for f in files.schema.fields if f.name != content]
    schema = T.StructType([*keep, *[T.StructField(n, t) for n, t in ((own, T.IntegerType()), ("width", T.IntegerType()), ("height", T.IntegerType()), ("pixels", T.BinaryType()), ("error", T.StringType()))]])
    arrow, key = to_arrow_schema(schema), uuid.uuid4().hex

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = _own(key, make)
        for batch in batches:
            for row in batch.to_pylist():
                data, head = row.pop(content), row
                one = lambda n, w=None, h=None, p=None, e=None: pa.RecordBatch.from_pylist([head | {own: n, "width": w, "height": h, "pixels": p, "error": e}], schema=arrow)  # noqa: B023, E731
                try:
                    if data is None:
                        raise ValueError("no content")
                    for n, w, h, p in each(model, data):
                        yield one(n, w, h, p)
                except Exception as e:
                    yield one(None, e=_reason(e))

    return files.mapInArrow(run, schema)


def read_frames(images: DataFrame, make: Callable[[], FrameDecoder], content: str = "content", most_pixels: int = 178_956_970, most_frames: int = 0) -> DataFrame:
    """images without their bytes, a row for each frame: frame_index from 0 on, width, height, pixels; batch or stream.

    A row goes out before the next frame is decoded. A frame of more pixels, a frame beyond most_frames (0: no bound)
    and whatever the decoder raises end an image with a row that has an error and no number; frames before it stay.
    """

    def each(decoder, data: bytes):
        for i, (w, h, pixels) in enumerate(decoder.frames(data)):
            if w * h > most_pixels:
                raise ValueError("too many pixels")
            if most_frames and i >= most_frames:
                raise ValueError(f"more than {most_frames} frames")
            yield i, w, h, pixels

    return _rows(images, make, "frame_index", content, each)


def render_pages(files: DataFrame, make: Callable[[], PageRenderer], page_range: str | None = None, options: PdfOptions = PdfOptions(), auto_dpi: bool = False, content: str = "content") -> DataFrame:
    """files without their bytes, a row for each page in the range: page_number from 1 on, width, height, pixels; batch or stream.

    A page is rendered when the one before has gone out, so what stops reading stops rendering. A range that selects no
    page or more than options.most_pages is an error row, as are a page of too many pixels and what the renderer raises.
    """
    terms = parse_page_range(page_range)

    def each(renderer, data: bytes):
        sizes = renderer.sizes(data)
        pages = [n for n in range(1, len(sizes) + 1) if not terms or any(a <= n and (b is None or n <= b) for a, b in terms)]
        if not pages:
            raise ValueError("the page range selects no page")
        if len(pages) > options.most_pages:
            raise ValueError(f"more than {options.most_pages} pages")
        for n in pages:
            dpi = auto_dpi_of(*sizes[n - 1]) if auto_dpi else options.dpi
            if sizes[n - 1][0] * sizes[n - 1][1] * (dpi / 72) ** 2 > options.most_pixels:
                raise ValueError(f"page {n} has too many pixels")
            yield n, *renderer.render(data, n, dpi)

    return _rows(files, make, "page_number", content, each)
