"""Small helpers shared by the operators."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from quire.session import write_table

#: Text bytes that one slice of an Arrow batch holds (a single longer text makes a slice of its own).
SLICE_BYTES = 1 << 20
#: Bytes of the Arrow batches that Spark sends to Python workers; Spark's own bound suits short rows.
BATCH_BYTES = 4 << 20
#: 64-bit multipliers of hashes (odd constants), and masks of the first 0 to 8 bytes of a little-endian number.
MIX = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC4CEB9FE1A85EC53))
FIRST_BYTES = np.array([(1 << 8 * i) - 1 for i in range(9)], np.uint64)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def stored(df: DataFrame, name: str) -> DataFrame:
    """Cut lineage: write ``df`` to the shared checkpoint folder and read it back."""
    return write_table(df, f"llm-{name}")


def map_batches(df: DataFrame, run, schema) -> DataFrame:
    """``df.mapInArrow``, in a session whose batches are bounded for long texts (the setting stays)."""
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    return df.mapInArrow(run, schema)


def slices(batches: Iterator[pa.RecordBatch], column: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut batches so that ``column`` holds at most ``limit`` bytes in each, one row at least."""
    for batch in batches:
        if not batch.num_rows:
            continue
        size = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        ends = np.cumsum(size, dtype=np.int64)
        start = 0
        while start < batch.num_rows:
            base = ends[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(ends, base + limit, side="right")))
            yield batch.slice(start, stop - start)
            start = stop


def raw_texts(batch: pa.RecordBatch, column: str) -> list[bytes]:
    """The UTF-8 bytes of a string column; null is empty."""
    return [t or b"" for t in batch.column(column).cast(pa.binary()).to_pylist()]


def texts(batch: pa.RecordBatch, column: str) -> list[str]:
    """A string column as text; null is empty."""
    return [t.decode("utf-8", "replace") for t in raw_texts(batch, column)]


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * MIX[0]
    x = (x ^ (x >> np.uint64(29))) * MIX[1]
    return x ^ (x >> np.uint64(32))


def word_keys(letters: np.ndarray, start: np.ndarray, end: np.ndarray, seed: np.ndarray | np.uint64) -> np.ndarray:
    """64-bit hashes of the words at letters[start:end], mixed with ``seed`` (one, or one for each word).

    Eight bytes of all words are mixed in at a time; words of up to eight bytes never share a hash with one of equal
    length and seed."""
    if not len(start):
        return np.zeros(0, np.uint64)
    padded = np.concatenate([letters, np.zeros(8, np.uint8)])
    eight = np.ndarray(len(letters) + 1, "<u8", padded, strides=(1,))  # the eight bytes from each place on
    size = end - start
    key = _mixed((seed + size.astype(np.uint64) * MIX[0]) ^ (eight[start] & FIRST_BYTES[np.minimum(size, 8)]))
    done, more = 8, np.flatnonzero(size > 8)
    while len(more):
        key[more] = _mixed(key[more] ^ (eight[start[more] + done] & FIRST_BYTES[np.minimum(size[more] - done, 8)]))
        done += 8
        more = more[size[more] > done]
    return key


def _numbered(df: DataFrame) -> DataFrame:
    """Columns by place, so that names with dots, or used twice, do no harm."""
    return df.toDF(*[f"c{i}" for i in range(len(df.columns))])


def with_text_columns(df: DataFrame, text_col: str, added: list[StructField],
                      compute: Callable[[list[bytes]], list[pa.Array]], limit: int = SLICE_BYTES) -> DataFrame:
    """``df``, in its order, with columns that ``compute`` derives from the whole texts of each slice."""
    plain, at = _numbered(df), f"c{df.columns.index(text_col)}"
    names = plain.columns + [f"new{i}" for i in range(len(added))]

    def run(batches):
        for batch in slices(batches, at, limit):
            yield pa.RecordBatch.from_arrays([*batch.columns, *compute(raw_texts(batch, at))], names=names)

    fields = [StructField(n, f.dataType) for n, f in zip(names[len(plain.columns):], added)]
    return map_batches(plain, run, StructType([*plain.schema.fields, *fields])).toDF(
        *df.columns, *[f.name for f in added])


def where_text(df: DataFrame, text_col: str, keep: Callable[[str], bool]) -> DataFrame:
    """The rows of ``df``, in its order, whose whole text satisfies ``keep``."""
    plain, at = _numbered(df), f"c{df.columns.index(text_col)}"

    def run(batches):
        for batch in slices(batches, at):
            yield batch.filter(pa.array([keep(t) for t in texts(batch, at)], pa.bool_()))

    return map_batches(plain, run, plain.schema).toDF(*df.columns)


def crc32_of_id(column: str = "doc_id"):
    """crc32 of an id's decimal text, the key of the label splits."""
    return F.crc32(F.col(column).cast("string").cast("binary"))


def labelled_sample(docs: DataFrame, labels: DataFrame, target: str, learn, per_class: int,
                    seed: int) -> list[tuple[int, str, int]]:
    """At most ``per_class`` labelled (doc_id, text, label) rows of each class, chosen by a hash of doc_id.

    ``learn`` is a condition on doc_id. Only the chosen ids (a bounded number)
    are collected and sent back to the documents; a text is fetched once per id.
    Null ids, null labels and labels other than 0 and 1 teach nothing.
    """
    order = F.xxhash64(F.col("doc_id"), F.lit(seed))
    known = (labels.select("doc_id", F.col(target).cast("int").alias("label"))
             .where(F.col("doc_id").isNotNull() & F.col("label").isin(0, 1) & learn)
             .groupBy("doc_id").agg(F.max("label").alias("label")))
    found = docs.select("doc_id").join(known, "doc_id").distinct()
    chosen = {}
    for label in (0, 1):
        rows = found.where(F.col("label") == label).orderBy(order, "doc_id").limit(per_class).collect()
        chosen.update({r["doc_id"]: label for r in rows})
    if not chosen:
        return []
    ids = docs.sparkSession.createDataFrame([(i,) for i in chosen], docs.select("doc_id").schema)
    got = docs.select("doc_id", "text").join(F.broadcast(ids), "doc_id").collect()
    first: dict[int, str] = {}
    for r in got:
        t = r["text"] or ""
        first[r["doc_id"]] = min(first[r["doc_id"]], t) if r["doc_id"] in first else t
    return [(i, first[i], chosen[i]) for i in sorted(first)]
