"""Importance resampling towards a target distribution: hashed features, array-scored weights, exact cut-off.

Features are the words and pairs of neighbouring words of a text, hashed into BUCKETS buckets. A bucket's
gain is the logarithm of how much likelier it is in the target texts than in the documents, both smoothed;
a document's weight is the floored mean of its features' gains. Weight plus a Gumbel number made from the
document's id is its score, and the highest scores are drawn: a draw without replacement by weight.

Scale. Texts are read twice, to count buckets and to score; a task sends BUCKETS counts, and the gains are an
array of BUCKETS numbers that goes to every task. Scores are written to the shared folder. The cut-off is
found by bisection over that table: each job counts the rows at or above several thresholds at once and
leaves one interval of them, for the score first, then for the ids tied there, then for the numbers of equal
rows. Nothing is sorted for that. Only drawn rows are ordered, by range partitions that number their own rows.

Edge cases. A null or empty text, or one without a word, has no features and weight 0. A null id is hashed
as an empty one and loses ties. Rows that repeat an id keep a row and a score each; of equal ones the first
written is drawn first. Equal scores go to the smaller id. Extra columns are ignored. Without documents
there are no rows; without target texts all gains follow the documents alone; a share of 0 draws none."""

from __future__ import annotations

import hashlib
import math
import zlib
from collections.abc import Iterator
from itertools import repeat

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerlens.llm.support import settle

BUCKETS = 10_000
SCALE = 1_000
SEED = 7
LEAST_WORDS = 20
PERCENT = 25
#: Thresholds of one counting job: four halvings.
SECTIONS = 16
_ROWS_AT_ONCE = 1_000
_LAST = 2**63 - 1
#: Bytes of a word as they are, A-Z lower-cased, all other ASCII as white space.
_LETTERS = bytes(
    c if c >= 0x80 or chr(c).isalnum() else 0x20 for c in (ord(chr(b).lower()) if b < 0x80 else b for b in range(256))
)


def words(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "replace").translate(_LETTERS).split()


def features(text: str | None, buckets: int = BUCKETS) -> tuple[int, np.ndarray]:
    """Words of the text, and the bucket of each word and of each pair of neighbours."""
    found = words(text)
    own = list(map(zlib.crc32, found))
    # The checksum of "a b" goes on from that of "a".
    pairs = map(zlib.crc32, found[1:], map(zlib.crc32, repeat(b" "), own))
    hashed = np.fromiter([*own, *pairs], np.int64, max(0, 2 * len(found) - 1))
    return len(found), hashed % buckets


def bucket_counts(texts: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """How often each bucket occurs in all texts: an array of `buckets` numbers."""

    def counted(batches) -> Iterator:
        import pyarrow as pa

        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for text in batch.column(0).to_pylist():
                total += np.bincount(features(text, buckets)[1], minlength=buckets)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["bucket", "n"])

    rows = texts.select("text").mapInArrow(counted, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))
    out = np.zeros(buckets, np.int64)
    for row in rows.collect():  # no more rows than buckets
        out[row["bucket"]] = row["n"]
    return out


def gains(source: np.ndarray, target: np.ndarray, scale: int = SCALE) -> np.ndarray:
    """Scaled logarithm of each bucket's smoothed share in the target over that in the source, floored."""
    buckets = len(source)
    s_all, t_all = float(source.sum()) + buckets, float(target.sum()) + buckets
    return np.array(
        [math.floor(scale * math.log((t + 1) * s_all / ((s + 1) * t_all))) for s, t in zip(source.tolist(), target.tolist())],
        np.int64,
    )


def noise(doc_id: int | None, seed: int = SEED, scale: int = SCALE) -> int:
    """A Gumbel number of the id, scaled and floored."""
    key = f"{seed}:{'' if doc_id is None else doc_id}".encode()
    uniform = (int(hashlib.sha256(key).hexdigest()[:8], 16) + 0.5) / 4294967296
    return math.floor(-scale * math.log(-math.log(uniform)))


def scored(docs: DataFrame, gain: np.ndarray, seed: int = SEED, scale: int = SCALE) -> DataFrame:
    """doc_id, n_words, n_features, weight, score of every row, and row_no that tells rows apart."""
    schema = "doc_id long, n_words long, n_features long, weight long, score long, row_no long"
    names = [c.split()[0] for c in schema.split(", ")]
    sent = docs.sparkSession.sparkContext.broadcast(gain)

    def score(batches) -> Iterator:
        import pyarrow as pa
        from pyspark import TaskContext

        gain, first = sent.value, TaskContext.get().partitionId() << 40
        for whole in batches:
            for at in range(0, whole.num_rows, _ROWS_AT_ONCE):
                batch = whole.slice(at, _ROWS_AT_ONCE)
                ids, out = batch.column("doc_id").to_pylist(), []
                for doc_id, text in zip(ids, batch.column("text").to_pylist()):
                    n_words, found = features(text, len(gain))
                    weight = int(gain[found].sum()) // len(found) if len(found) else 0
                    out.append((n_words, len(found), weight, weight + noise(doc_id, seed, scale)))
                columns = [pa.array(c, pa.int64()) for c in zip(*out, strict=True)]
                row_no = pa.array(np.arange(first, first + len(out)))
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), *columns, row_no], names=names)
                first += len(out)

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(score, schema)


def bisect(rows: DataFrame, key: str, wanted: int, sections: int = SECTIONS) -> tuple[int, int]:
    """The largest value at which at least `wanted` of the rows are at or above it, and how many rows lie
    above it. Each job counts the rows at or above `sections` - 1 thresholds, without a shuffle of rows."""
    low, high = rows.agg(F.min(key), F.max(key)).first()  # rows at or above low: enough; above high: none
    above = 0
    while low < high:
        span = high - low
        marks = sorted({low + -(-span * i // sections) for i in range(1, sections)} | {high})
        counts = rows.agg(*[F.count_if(F.col(key) >= F.lit(m)) for m in marks]).first()
        enough = [m for m, n in zip(marks, counts) if n >= wanted]
        short = [(m, n) for m, n in zip(marks, counts) if n < wanted]
        low = max([low, *enough])
        if short:
            high, above = short[0][0] - 1, short[0][1]
    return low, above


def drawn(scores: DataFrame, wanted: int) -> Column | None:
    """The condition that holds for exactly `wanted` of the rows, None if there is none to draw: those of the
    highest score, then of the smallest id, then of the smallest row number."""
    if wanted <= 0:
        return None
    id_key, row_key = F.bitwise_not(F.coalesce("doc_id", F.lit(_LAST))), F.bitwise_not("row_no")  # falling
    rows = scores.select("score", id_key.alias("id"), row_key.alias("row"))
    out: Column | None = None
    tied, keys = F.lit(True), {"score": F.col("score"), "id": id_key, "row": row_key}
    for name, key in keys.items():
        cut, above = bisect(rows, name, wanted)
        beyond = tied & (key > cut)
        out = beyond if out is None else out | beyond
        wanted -= above
        tied = tied & (key == cut)
        rows = rows.where(F.col(name) == cut)
    return out | tied


def ranks(rows: DataFrame, order: list[Column]) -> DataFrame:
    """Adds `rank`, 1 for the first in `order`: range partitions number their rows, and what lies before
    each is one number per partition."""
    placed = rows.repartitionByRange(*order).withColumn("part", F.spark_partition_id())
    placed = settle(placed, "drawn")
    sizes = placed.groupBy("part").agg(F.count("*").alias("n"))  # a row per partition
    before = F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    earlier = sizes.select("part", F.coalesce(before, F.lit(0)).alias("earlier"))
    inside = F.row_number().over(Window.partitionBy("part").orderBy(*order)).cast("long")
    return placed.join(F.broadcast(earlier), "part").withColumn("rank", inside + F.col("earlier")).drop("part", "earlier")


def resample(
    docs: DataFrame, target: DataFrame, percent: int = PERCENT, least_words: int = LEAST_WORDS,
    buckets: int = BUCKETS, seed: int = SEED, scale: int = SCALE,
) -> DataFrame:
    """doc_id, n_features, weight, score and rank (null where not drawn) of every row: `percent` of the rows
    with at least `least_words` words are drawn."""
    gain = gains(bucket_counts(docs, buckets), bucket_counts(target, buckets), scale)
    scores = settle(scored(docs, gain, seed, scale), "scores")
    eligible = F.col("n_words") >= least_words
    n = scores.where(eligible).count()
    taken = drawn(scores.where(eligible), n * percent // 100)
    columns = ["doc_id", "n_features", "weight", "score"]
    none = F.lit(None).cast("long").alias("rank")
    if taken is None:
        return scores.select(*columns, none)
    taken = eligible & taken
    order = [F.col("score").desc(), F.col("doc_id").asc_nulls_last(), F.col("row_no")]
    ranked = ranks(scores.where(taken), order)
    return ranked.select(*columns, "rank").unionByName(scores.where(~taken).select(*columns, none))


def oracle() -> str:
    """DuckDB SQL of the query. The checksum of a feature runs over its bytes with the usual table of 256
    numbers, made here by its rule."""
    table = []
    for n in range(256):
        for _ in range(8):
            n = (n >> 1) ^ (0xEDB88320 if n & 1 else 0)
        table.append(n)
    return f"""
with recursive crc as (select {table} as t),
texts as (select 'd' as side, doc_id as id, coalesce(text, '') as text from documents
    union all select 'b', item_id, coalesce(text, '') from benchmark),
w as (select side, id, row_number() over () as r, regexp_extract_all(
    translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') as words from texts),
f as (select side, id, r, unnest(list_concat(words, list_transform(list_zip(words, words[2:])[:len(words) - 1],
    lambda p: p[1] || ' ' || p[2]))) as feature from w),
features as (select distinct feature, hex(feature) as h from f),
hashed as (select feature, xor(list_reduce(list_prepend(4294967295::bigint, list_transform(range(1, len(h), 2),
    lambda i: ('0x' || substr(h, i, 2))::bigint)),
    lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1]::bigint)), 4294967295) % {BUCKETS} as bucket from features, crc),
b as (select side, id, r, bucket from f join hashed using (feature)),
c as (select range as bucket, coalesce(s, 0) as s, coalesce(t, 0) as t from range({BUCKETS}) left join (
    select bucket, count(*) filter (side = 'd') as s, count(*) filter (side = 'b') as t from b group by bucket
    ) as n on n.bucket = range),
g as (select bucket, cast(floor({SCALE} * ln(((t + 1)::double * ((sum(s) over ()) + {BUCKETS})::double)
    / ((s + 1)::double * ((sum(t) over ()) + {BUCKETS})::double))) as bigint) as gain from c),
sizes as (select id, r, len(words) as n_words from w where side = 'd'),
d as (select w.id, w.r, n_words, count(gain) as n_features,
    case when count(gain) = 0 then 0 else cast((sum(gain) - ((sum(gain) % count(gain)) + count(gain)) % count(gain))
    // count(gain) as bigint) end as weight
    from sizes w left join b on b.r = w.r left join g using (bucket) group by w.id, w.r, n_words),
u as (select *, (('0x' || sha256('{SEED}:' || coalesce(id::varchar, ''))[:8])::bigint + 0.5) / 4294967296 as u from d),
x as (select *, weight + cast(floor(-{SCALE} * ln(-ln(u::double))) as bigint) as score from u),
k as (select *, row_number() over (order by n_words < {LEAST_WORDS}, score desc, id nulls last, r) as k,
    count(*) filter (n_words >= {LEAST_WORDS}) over () as n from x)
select id as doc_id, n_features, weight, score,
    case when n_words >= {LEAST_WORDS} and k <= n * {PERCENT} // 100 then k end as rank from k"""
