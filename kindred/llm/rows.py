"""Functions over many texts, run on Arrow batches so that keys and other columns keep their types and nulls.

A batch is worked on in slices of about ``SLICE`` characters, so that memory does not
follow the number of rows in a batch; a longer text is a slice of its own."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

SLICE = 1_000_000


def slices(batch: pa.RecordBatch, column: int, most: int = SLICE) -> Iterator[tuple[pa.RecordBatch, list]]:
    """Slices of a batch, of about ``most`` characters each, with the values of its text column."""
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    start, size = 0, 0
    for i, n in enumerate(sizes.tolist()):
        if size and size + n > most:
            part = batch.slice(start, i - start)
            yield part, part.column(column).to_pylist()
            start, size = i, 0
        size += n
    if start < batch.num_rows:
        part = batch.slice(start)
        yield part, part.column(column).to_pylist()


def map_texts(docs: DataFrame, compute: Callable[[list], dict], columns: str, as_bytes: bool = False, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key and, for each text (null: empty), the columns that ``compute`` gives for a list of texts."""
    value = F.coalesce(F.col(text), F.lit(""))
    rows = docs.select(F.col(key), (value.cast("binary") if as_bytes else value).alias(text))
    schema = StructType([docs.schema[key], *StructType.fromDDL(columns).fields])
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, texts in slices(batch, 1):
                found = compute(texts)
                yield pa.RecordBatch.from_arrays([part.column(0).cast(arrow.field(0).type), *(pa.array(found[f.name], f.type) for f in list(arrow)[1:])], schema=arrow)

    return rows.mapInArrow(run, schema)


def filter_texts(docs: DataFrame, keep: Callable[[list], list[bool]]) -> DataFrame:
    """The rows of docs whose text ``keep`` accepts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, texts in slices(batch, batch.schema.get_field_index("text")):
                yield part.filter(pa.array(keep(texts), pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def change_texts(docs: DataFrame, change: Callable[[str | None], str | None]) -> DataFrame:
    """docs with each text changed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.schema.get_field_index("text")
            for part, texts in slices(batch, at):
                yield part.set_column(at, batch.schema.field(at), pa.array([change(t) for t in texts], batch.schema.field(at).type))

    return docs.mapInArrow(run, docs.schema)
