"""Arrow-mapped columns and the word splitters that run inside tasks."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, types as T

#: Lower-cases A-Z; with SEPARATE, every other ASCII byte that is no letter or digit becomes a space.
LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
SEPARATE = bytes(
    c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256)
)


def space_words(text: bytes) -> list[bytes]:
    """Words between ASCII white space, A-Z lower-cased."""
    return text.translate(LOWER).split()


def plain_words(text: bytes) -> list[bytes]:
    """Runs of ASCII letters, digits and non-ASCII characters, A-Z lower-cased."""
    return text.translate(SEPARATE).split()


def slices(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of at most ``rows``: bounds what Python holds at once."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def texts(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes of each text; null gives b''."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def within_bytes(rows: list[bytes], size: int) -> Iterator[list[bytes]]:
    """The same texts in lists of at most ``size`` bytes, or of one text."""
    at, total = 0, 0
    for i, row in enumerate(rows):
        if total + len(row) > size and i > at:
            yield rows[at:i]
            at, total = i, 0
        total += len(row)
    if at < len(rows):
        yield rows[at:]


def with_arrow_columns(
    df: DataFrame,
    schema: T.StructType,
    make: Callable[[], Callable[[pa.RecordBatch], dict[str, list | pa.Array]]],
    drop: tuple[str, ...] = (),
    rows: int = 512,
) -> DataFrame:
    """``df`` with the columns of ``schema`` computed batch by batch.

    ``make`` runs once per task and returns the function of a batch. Columns of ``df`` whose names
    clash with new ones, and those in ``drop``, are read by the function but not returned.
    """
    new = {f.name for f in schema.fields}
    kept = [f for f in df.schema.fields if f.name not in new and f.name not in drop]
    out = T.StructType([*kept, *schema.fields])
    from pyspark.sql.pandas.types import to_arrow_type

    types = {f.name: to_arrow_type(f.dataType) for f in schema.fields}
    names = [f.name for f in kept]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = make()
        for batch in slices(batches, rows):
            made = of(batch)
            columns = [batch.column(n) for n in names]
            columns += [x if isinstance(x := made[n], pa.Array) else pa.array(x, t) for n, t in types.items()]
            yield pa.RecordBatch.from_arrays(columns, [*names, *types])

    return df.mapInArrow(run, out)
