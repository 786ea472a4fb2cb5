"""Where models plug in: recognisers of images and chat models, called in Arrow batches, with fakes for tests. No weights are included."""

from __future__ import annotations

import json
import re
import uuid
from collections.abc import Callable, Iterator
from typing import Protocol

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

_LINE = "struct<text:string,confidence:double,min_x:double,min_y:double,max_x:double,max_y:double>"


class Recognizer(Protocol):
    """Reads an image's bytes as lines: dicts of text, confidence and box. Raises for what it can't read."""

    def recognize(self, content: bytes) -> list[dict]: ...


class Stage(Protocol):
    """Any other model of the pipeline (detector, classifier, layout, table, seal, formula): a batch of inputs to a batch of results."""

    def run(self, batch: list) -> list: ...


class ChatModel(Protocol):
    """A language model: messages to (text, prompt tokens, completion tokens)."""

    supports_vision: bool

    def complete(self, messages: list[dict]) -> tuple[str, int | None, int | None]: ...


class FakeRecognizer:
    """For tests: the bytes' text lines one below the other."""

    def recognize(self, content: bytes) -> list[dict]:
        try:
            lines = content.decode().split("\n")
        except UnicodeDecodeError:
            raise ValueError("not readable") from None
        return [{"text": t, "confidence": 1.0, "min_x": 0.0, "min_y": 20.0 * i, "max_x": 8.0 * len(t), "max_y": 20.0 * i + 16} for i, t in enumerate(lines)]

    def recognize_region(self, content: bytes, points: list[tuple[float, float]]) -> dict | None:
        """The line, 20 units high, that the middle of the points falls on."""
        lines = self.recognize(content)
        at = int(sum(y for _, y in points) / len(points) // 20)
        return {"text": lines[at]["text"], "confidence": 1.0} if 0 <= at < len(lines) else None


class OnnxStage:
    """A model file run by onnxruntime on the CPU with one thread, as a task has one core."""

    def __init__(self, path: str):
        import onnxruntime as ort

        options = ort.SessionOptions()
        options.intra_op_num_threads = options.inter_op_num_threads = 1
        self.session = ort.InferenceSession(path, options, providers=["CPUExecutionProvider"])

    def run(self, batch: list) -> list:
        name = self.session.get_inputs()[0].name
        return [self.session.run(None, {name: x}) for x in batch]


_made: dict[str, object] = {}


def _own(key: str, make: Callable):
    """The worker's model, made once for all tasks of a query: the key is the query's own. Earlier queries' models go."""
    if key not in _made:
        _made.clear()
        _made[key] = make()
    return _made[key]


def _reason(e: Exception) -> str:
    """What an error row says: the message, with the kind of error unless a model or a server said so."""
    return str(e) if isinstance(e, (ValueError, OSError)) and str(e) else f"{type(e).__name__}: {e}"


def recognize(images: DataFrame, make: Callable[[], Recognizer], content: str = "content", stop_at_error: bool = False) -> DataFrame:
    """images without their bytes, with `lines` and `error`, exactly one of which is null; stop_at_error fails the job instead.

    Whatever the recogniser raises for an image is that row's error.

    Filters on rows belong before this, as Spark doesn't move them through Python.
    """
    keep = [f for f in images.schema.fields if f.name != content]
    schema = T.StructType([*keep, T.StructField("lines", T.ArrayType(T.StructType([T.StructField("text", T.StringType()), *[T.StructField(n, T.DoubleType()) for n in ("confidence", "min_x", "min_y", "max_x", "max_y")]]))), T.StructField("error", T.StringType())])
    arrow, key = to_arrow_schema(schema), uuid.uuid4().hex

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = _own(key, make)
        for batch in batches:
            lines, errors = [], []
            for data in batch.column(batch.schema.get_field_index(content)).to_pylist():
                try:
                    if data is None:
                        raise ValueError("no content")
                    lines.append(model.recognize(data))
                    errors.append(None)
                except Exception as e:
                    if stop_at_error:
                        raise
                    lines.append(None)
                    errors.append(_reason(e))
            cols = [batch.column(batch.schema.get_field_index(f.name)) for f in keep]
            yield pa.RecordBatch.from_arrays([*cols, pa.array(lines, arrow.field("lines").type), pa.array(errors, pa.string())], schema=arrow)

    return images.mapInArrow(run, schema)


def recognize_regions(images: DataFrame, make: Callable[[], Recognizer], polygons: str = "polygons", content: str = "content", stop_at_error: bool = False) -> DataFrame:
    """images without their bytes, with the lines that the recogniser reads in given polygons, and `error`.

    polygons: array<array<struct<x,y>>>. Those of fewer than three points are left out; the others keep their order, and
    each line its polygon's number in `region_index`. The recogniser has recognize_region(content, points), which gives
    a line or None. A region of interest of the page doesn't apply.
    """
    keep = [f for f in images.schema.fields if f.name not in (content, polygons)]
    line = T.StructType([T.StructField("region_index", T.IntegerType()), T.StructField("text", T.StringType()), *[T.StructField(n, T.DoubleType()) for n in ("confidence", "min_x", "min_y", "max_x", "max_y")]])
    schema = T.StructType([*keep, T.StructField("lines", T.ArrayType(line)), T.StructField("error", T.StringType())])
    arrow, key = to_arrow_schema(schema), uuid.uuid4().hex

    def read(model, data: bytes | None, regions: list) -> list[dict]:
        if data is None:
            raise ValueError("no content")
        out = []
        for i, points in enumerate(regions or []):
            if points is None or len(points) < 3:
                continue
            xs, ys = [p["x"] for p in points], [p["y"] for p in points]
            found = model.recognize_region(data, [(p["x"], p["y"]) for p in points])
            if found is not None:
                out.append({"region_index": i, "min_x": min(xs), "min_y": min(ys), "max_x": max(xs), "max_y": max(ys)} | found)
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = _own(key, make)
        for batch in batches:
            lines, errors = [], []
            for row in batch.select([content, polygons]).to_pylist():
                try:
                    lines.append(read(model, row[content], row[polygons]))
                    errors.append(None)
                except Exception as e:
                    if stop_at_error:
                        raise
                    lines.append(None)
                    errors.append(_reason(e))
            cols = [batch.column(batch.schema.get_field_index(f.name)) for f in keep]
            yield pa.RecordBatch.from_arrays([*cols, pa.array(lines, arrow.field("lines").type), pa.array(errors, pa.string())], schema=arrow)

    return images.mapInArrow(run, schema)


def explode_lines(pages: DataFrame) -> DataFrame:
    keep = [c for c in pages.columns if c not in ("lines", "error")]
    return pages.filter("error is null").select(*keep, F.posexplode("lines").alias("line_index", "l")).select(*keep, "line_index", "l.*")


def first_json_object(text: str | None) -> str | None:
    """The first balanced object in a reply, code fences aside; from its brace to the end if it never closes."""
    if not text or not text.strip():
        return None
    text = re.sub(r"^\s*```[A-Za-z]*\s*\n?|\n?```\s*$", "", text.strip()).strip()
    start = text.find("{")
    if start < 0:
        return None
    depth, quoted, skip = 0, False, False
    for i, c in enumerate(text[start:], start):
        if skip:
            skip = False
        elif quoted:
            skip, quoted = c == "\\", c != '"'
        elif c == '"':
            quoted = True
        elif c in "{}":
            depth += 1 if c == "{" else -1
            if not depth:
                return text[start : i + 1]
    return text[start:]


@F.pandas_udf(T.StringType())
def json_object(text: pd.Series) -> pd.Series:
    return text.map(first_json_object)


def fields_of_reply(reply: str | None, keys: list[str]) -> list[str | None]:
    """Values of the asked keys: strings as they are, numbers and truth values as written, objects as JSON, null for what isn't there."""
    try:
        found = json.loads(first_json_object(reply) or "null", parse_float=str, parse_int=str)
    except ValueError:
        found = None
    found = found if isinstance(found, dict) else {}
    text = lambda v: v if v is None or isinstance(v, str) else json.dumps(v, ensure_ascii=False)
    return [text(found.get(k)) for k in keys]


PROMPT_FIELDS = "Return one JSON object with exactly these keys and their values from the document, null where it has none: "
PROMPT_ANSWER = "Answer the question from the document alone."
PROMPT_CHART = 'Return one JSON object with "type", "title" and "data", a Markdown table of the chart\'s values.'


def _ask(rows: DataFrame, make: Callable[[], ChatModel], messages: Callable[[dict], list[dict]], needs_vision: bool = False) -> DataFrame:
    """rows with reply, prompt_tokens, completion_tokens and error."""
    schema = T.StructType([*rows.schema.fields, T.StructField("reply", T.StringType()), T.StructField("prompt_tokens", T.LongType()), T.StructField("completion_tokens", T.LongType()), T.StructField("error", T.StringType())])
    arrow, key = to_arrow_schema(schema), uuid.uuid4().hex

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = _own(key, make)
        if needs_vision and not model.supports_vision:
            raise ValueError("the chat model can't see images")
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                try:
                    reply, asked, given = model.complete(messages(row))
                    out.append(row | {"reply": reply, "prompt_tokens": asked, "completion_tokens": given, "error": None})
                except Exception as e:
                    out.append(row | {"reply": None, "prompt_tokens": None, "completion_tokens": None, "error": _reason(e)})
            yield pa.RecordBatch.from_pylist(out, schema=arrow)

    return rows.mapInArrow(run, schema)


def extract_with_model(documents: DataFrame, keys: list[str], make: Callable[[], ChatModel], text: str = "markdown", prompt: str = PROMPT_FIELDS) -> DataFrame:
    """One row for each document and key, in order: key_ordinal, key, value, and the call's tokens and error."""
    asked = _ask(documents, make, lambda r: [{"role": "system", "content": prompt + json.dumps(keys, ensure_ascii=False)}, {"role": "user", "content": r[text] or ""}])

    @F.pandas_udf(T.ArrayType(T.StringType()))
    def values(reply: pd.Series) -> pd.Series:
        return reply.map(lambda r: fields_of_reply(r, keys))

    keep = [c for c in asked.columns if c not in ("reply", text)]
    pairs = F.arrays_zip(F.array(*map(F.lit, keys)).alias("key"), values("reply").alias("value"))
    return asked.select(*keep, F.posexplode(pairs).alias("key_ordinal", "p")).select(*keep, "key_ordinal", F.col("p.key").alias("key"), F.col("p.value").alias("value"))


def ask(documents: DataFrame, question: str, make: Callable[[], ChatModel], text: str = "markdown", prompt: str = PROMPT_ANSWER) -> DataFrame:
    return _ask(documents, make, lambda r: [{"role": "system", "content": prompt}, {"role": "user", "content": f"{r[text] or ''}\n\n{question}"}])


def parse_charts(charts: DataFrame, make: Callable[[], ChatModel], image: str = "content", prompt: str = PROMPT_CHART) -> DataFrame:
    """charts (with a cut-out's bytes) with type, title and data, null where the reply has no such string."""
    import base64

    asked = _ask(charts, make, lambda r: [{"role": "system", "content": prompt}, {"role": "user", "content": [{"type": "image", "data": base64.b64encode(r[image] or b"").decode()}]}], needs_vision=True)
    return asked.withColumn("_j", F.from_json(json_object("reply"), "type string, title string, data string")).select(*[c for c in asked.columns if c != image], "_j.*")
