"""Small helpers that the training-data operators share."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomwork.plans.store import discard
from loomwork.plans.store import written as materialise

__all__ = ["arrow_rows", "discard", "fresh", "in_class_sample", "materialise", "mix64", "numbered", "slices", "split_words", "table"]

SAMPLE_GRAIN = 1_000_000
#: Rows that each class has in a sample by class, or all of them if it has fewer.
CLASS_ROWS = 100


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def split_words(data: bytes) -> list[bytes]:
    """Words of UTF-8 bytes: bytes.split() cuts at exactly the six ASCII white-space bytes."""
    return data.split()


def in_class_sample(key: str, class_: str, counts: dict, bound: int):
    """A filter that lets about ``bound`` rows pass, by a hash of their key; of each class that would have fewer, about CLASS_ROWS.

    counts: class -> rows."""
    rows = sum(counts.values())
    shared = SAMPLE_GRAIN if rows <= bound else max(1, SAMPLE_GRAIN * bound // rows)
    own = {c: SAMPLE_GRAIN if n <= CLASS_ROWS else -(-SAMPLE_GRAIN * CLASS_ROWS // n) for c, n in counts.items()}
    grain = F.lit(shared)
    for c, g in sorted(own.items()):
        if g > shared:
            grain = F.when(F.col(class_) == F.lit(c), F.lit(g)).otherwise(grain)
    return F.pmod(F.xxhash64(F.col(key).cast("string"), F.lit("sample")), F.lit(SAMPLE_GRAIN)) < grain


def fresh(name: str, df: DataFrame) -> str:
    """The name, lengthened until no column of df has it."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def numbered(df: DataFrame, row: str = "row") -> DataFrame:
    """The same rows in a written table, each with a number of its own; ``row`` must not be a column of df."""
    return materialise(df.withColumn(row, F.monotonically_increasing_id()))


def arrow_rows(schema: pa.Schema, rows: Callable[[pa.RecordBatch], dict]) -> Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A mapInArrow function out of one that gives the columns of a batch."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cols = rows(batch)
            yield pa.RecordBatch.from_arrays([pa.array(cols[f.name], type=f.type) for f in schema], schema=schema)

    return run


def slices(batch: pa.RecordBatch, rows: int = 256) -> Iterator[pa.RecordBatch]:
    """Parts of a batch, so that what is built from texts stays small."""
    for at in range(0, batch.num_rows, rows):
        yield batch.slice(at, rows)


def mix64(x: np.ndarray) -> np.ndarray:
    """A finaliser for 64-bit hashes (the splitmix64 constants, fixed values)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))
