"""Token ids of whole texts as ORC files, read in parallel by stripe and pruned by metadata.

Documents are put in ascending doc_id order by a range partitioning, encoded, and written as ORC: integer
columns are run-length encoded, each stripe carries row indexes (least and largest doc_id of every stride of
rows) and a Bloom filter on doc_id, so a look-up by document skips files, stripes and strides, and a scan
reads stripes side by side.

A row holds doc_id, n_tokens and ids, and its place: `part` (the range partition), `begin` (ids before it in
that part). The place of a document in the whole corpus is `begin` plus the ids of all earlier parts; only
one number per part is needed for that.

Edge cases. A null or empty text has the end id alone. Rows without doc_id come first. Repeated rows and
rows with equal doc_id each keep a row, ordered by the hash of their text, and may lie in several partitions. Extra columns are not written. An
empty table gives no rows."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgerlens.llm.tokens import encoder

SCHEMA = "part int, begin long, doc_id long, n_tokens long, ids array<int>"
ORC_OPTIONS = {
    "compression": "zstd",
    "orc.stripe.size": str(16 << 20),
    "orc.create.index": "true",
    "orc.row.index.stride": "2000",
    "orc.bloom.filter.columns": "doc_id",
    "orc.bloom.filter.fpp": "0.01",
}
_ROWS_AT_ONCE = 500


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def encoded(docs: DataFrame, tokenizer: str, end_id: int) -> DataFrame:
    """The rows to be written, in ascending doc_id order within and across partitions."""

    def encode(batches) -> Iterator:
        import pyarrow as pa
        from pyspark import TaskContext

        encode_text, part, begin = encoder(tokenizer), TaskContext.get().partitionId(), 0
        end = np.array([end_id], "<u4").tobytes()
        for whole in batches:
            for at in range(0, whole.num_rows, _ROWS_AT_ONCE):
                batch = whole.slice(at, _ROWS_AT_ONCE)
                raw = [encode_text(t) + end for t in batch.column("text").to_pylist()]
                size = np.fromiter(map(len, raw), np.int64, len(raw)) // 4
                ends = np.cumsum(size)
                ids = pa.array(np.frombuffer(b"".join(raw), "<u4").astype(np.int32))
                offsets = pa.array(np.concatenate(([0], ends)).astype(np.int32))
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.full(len(raw), part, np.int32)),
                        pa.array(begin + ends - size),
                        batch.column("doc_id"),
                        pa.array(size),
                        pa.ListArray.from_arrays(offsets, ids),
                    ],
                    names=["part", "begin", "doc_id", "n_tokens", "ids"],
                )
                begin += int(ends[-1])

    # The number tells equal rows apart, so that no partition has to take all of them.
    order = [F.col("doc_id").asc_nulls_first(), F.col("version"), F.col("number")]
    number = F.monotonically_increasing_id().alias("number")
    rows = docs.select(F.col("doc_id").cast("long"), "text", F.xxhash64("text").alias("version"), number)
    placed = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    return placed.select("doc_id", "text").mapInArrow(encode, SCHEMA)


def write_tokens(docs: DataFrame, path: str, tokenizer: str, end_id: int) -> None:
    encoded(docs, tokenizer, end_id).write.options(**ORC_OPTIONS).orc(path)


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens and ids. Filters on doc_id reach the files."""
    rows = spark.read.schema(SCHEMA).orc(path)
    totals = rows.groupBy("part").agg(F.sum("n_tokens").alias("total"))  # a row per part
    before = F.sum("total").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    earlier = totals.select("part", F.coalesce(before, F.lit(0)).alias("earlier"))
    out = rows.join(F.broadcast(earlier), "part")
    return out.select("doc_id", (F.col("begin") + F.col("earlier")).alias("start"), "n_tokens", "ids")


def with_crc32(rows: DataFrame) -> DataFrame:
    """Replaces ids by ids_crc32, the checksum of the ids as little-endian unsigned 32-bit integers."""
    schema = "doc_id long, start long, n_tokens long, ids_crc32 long"

    def summed(batches) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            ids = batch.column("ids")
            raw = ids.values.to_numpy(zero_copy_only=False).astype("<u4").view(np.uint8)
            ends = ids.offsets.to_numpy().astype(np.int64) * 4
            sums = [zlib.crc32(raw[a:b]) for a, b in zip(ends[:-1].tolist(), ends[1:].tolist())]
            columns = [batch.column(c) for c in ("doc_id", "start", "n_tokens")]
            yield pa.RecordBatch.from_arrays(
                [*columns, pa.array(sums, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"]
            )

    return rows.select("doc_id", "start", "n_tokens", "ids").mapInArrow(summed, schema)
