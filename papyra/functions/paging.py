"""Rows of a page together in one Python call, many pages to an Arrow batch."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from itertools import groupby

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType


def by_page(df: DataFrame, keys: list[str], order: list[str], fn: Callable[[list[dict]], Iterable[dict]], schema: str | StructType) -> DataFrame:
    """fn's rows for the rows of each page, sorted by `order`: one shuffle on the page's keys, and no call of Spark for each page.

    A page's rows are all that a task holds beside a batch. Used only where a rule carries state from row to row.
    """
    schema = StructType.fromDDL(schema) if isinstance(schema, str) else schema
    arrow = to_arrow_schema(schema)
    df = df.repartition(*keys).sortWithinPartitions(*keys, *order)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key = lambda r: tuple(r[k] for k in keys)
        held: list[dict] = []
        for batch in batches:
            rows = held + batch.to_pylist()
            if not rows:
                continue
            last = key(rows[-1])
            cut = len(rows)
            while cut and key(rows[cut - 1]) == last:
                cut -= 1
            held = rows[cut:]
            out = [x for _, page in groupby(rows[:cut], key) for x in fn(list(page))]
            if out:
                yield pa.RecordBatch.from_pylist(out, schema=arrow)
        if held:
            out = list(fn(held))
            if out:
                yield pa.RecordBatch.from_pylist(out, schema=arrow)

    return df.mapInArrow(run, schema)
