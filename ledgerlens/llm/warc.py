"""WARC archives with a Merkle fixity audit of replicas.

Pages become WARC records, each a gzip member of its own as is usual for WARC files, so that damage costs one
record and a record is read from its place alone. Every record has a SHA-256 digest. Inside a file records stand
in the order of the MD5 of their page_id, so a range of those is a range of offsets. Over each file stands a
tree: a leaf covers the records whose MD5 starts with the same digits, and a node's digest is that of its
children's digests in order; nodes carry the range of offsets they cover. Two replicas are compared root by root, and only the
children of differing nodes on the next level down. As nodes go by key and not by number, a lost record changes
the nodes above it and no other.

The query writes the archive, makes a damaged copy of its files, and takes both manifests from the files' bytes.
Where a member cannot be read, what its start still yields is the record, and reading goes on at the next member.

Scale. Records are compressed before the one shuffle that deals them to files; a copy is made file by file. A file
is closed after `file_bytes` of records, however many fall to its part; rows equal in all respects that make up
more than 1 / HEAVY_SHARE of the archive are dealt by number, all others by a hash of page_id and digest, so that
neither repeated, missing nor strided ids fill one part. Only digests and lengths are read back and shuffled then.
A task holds a file. Trees are tables in the shared folder.

Edge cases. A null url or body is empty, a null page_id counts as -1. Rows that share a page_id are
records of their own. Pages in differing ranges are matched whole, by how often each replica holds a digest in
a file, so unchanged ones are not reported. Of equal records the last of the file count as lost or added; what
remains of a page is paired by its order of digests. Extra columns are ignored. A record whose id cannot be read
counts as page -1. An empty replica loses every record; two empty ones give no rows."""

from __future__ import annotations

import hashlib
import math
import re
import zlib
from collections.abc import Callable, Iterator, Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgerlens.llm.support import settle

FILE_BYTES = 8 << 20
HEAVY_SHARE = 256
#: Children of a node: a hexadecimal digit of the key.
FANOUT = 16
DATE = "2024-01-01T00:00:00Z"
_BLANK = b"\r\n\r\n"
_ID = re.compile(rb"(?m)^WARC-Record-ID: <urn:page:(-?\d{1,19})>")
#: The head of every member that is written here: deflate, no flags, no time.
_MEMBER = b"\x1f\x8b\x08\x00\x00\x00\x00\x00"
_CHUNK = 1 << 14


def records(pages: DataFrame) -> DataFrame:
    """page_id and record: the WARC record of each page, without the blank lines that end it."""
    page_id, url = F.coalesce(F.col("page_id").cast("long"), F.lit(-1)), F.coalesce("url", F.lit(""))
    body = F.coalesce("html", F.lit(""))
    head = F.concat(
        F.lit("WARC/1.1\r\nWARC-Type: resource\r\nWARC-Record-ID: <urn:page:"), page_id.cast("string"),
        F.lit(f">\r\nWARC-Date: {DATE}\r\nWARC-Target-URI: "), url,
        F.lit("\r\nContent-Type: text/html\r\nContent-Length: "), F.octet_length(body).cast("string"), F.lit("\r\n\r\n"),
    )
    return pages.select(page_id.alias("page_id"), F.concat(head, body).alias("record"))


def layout(archive: DataFrame, file_bytes: int = FILE_BYTES, heavy_share: int = HEAVY_SHARE) -> tuple[int, list[int]]:
    """How many parts the archive is dealt to, and the hashes of rows so often repeated that they are dealt by
    number: fewer than heavy_share of them."""
    size = (F.octet_length("record") + 4).cast("long")
    same = archive.groupBy(F.xxhash64("page_id", "record").alias("same")).agg(F.count("*").alias("n"), F.sum(size).alias("bytes"))
    same = settle(same, "layout")
    rows, total = same.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("bytes"), F.lit(0))).first()
    heavy = [r["same"] for r in same.where(F.col("n") > 1 + rows // heavy_share).select("same").collect()]
    return max(1, -(-total // file_bytes)), heavy


def _packed(record: bytes) -> bytes:
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    return packer.compress(record + _BLANK) + packer.flush()


def _write_files(rows: DataFrame, path: str) -> None:
    """file, content: a file for each row, in a folder of its own. Zero bytes after a member are padding."""
    text = rows.select("file", F.col("content").cast("string").alias("value"))  # bytes as they are
    text.write.partitionBy("file").option("maxRecordsPerFile", 1).option("lineSep", "\0").text(path)


def write_warc(
    archive: DataFrame, path: str, parts: int = 1, heavy: Sequence[int] = (), file_bytes: int = FILE_BYTES
) -> None:
    """WARC files of an archive dealt to `parts`. The n-th file of a part is file part + n * parts."""
    digest = F.sha2(F.col("record").cast("binary"), 256)
    spread = F.conv(F.substring(F.md5(F.concat_ws(":", "page_id", digest)), 1, 8), 16, 10).cast("long")
    often = F.xxhash64("page_id", "record").isin([int(h) for h in heavy])
    spread = F.when(often, F.monotonically_increasing_id()).otherwise(spread) if heavy else spread
    placed = archive.select(F.pmod(spread, F.lit(parts)).alias("part"), F.md5(F.col("page_id").cast("string")).alias("range"), "page_id", digest.alias("digest"), F.col("record").cast("binary").alias("record"))

    def pack(batches) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            found = batch.column("record").to_pylist()
            sizes = pa.array([len(r) + 4 for r in found], pa.int64())
            kept = [batch.column(c) for c in ("part", "range", "page_id", "digest")]
            yield pa.RecordBatch.from_arrays(
                [*kept, sizes, pa.array(map(_packed, found), pa.binary())],
                names=["part", "range", "page_id", "digest", "size", "member"],
            )

    def fill(batches) -> Iterator:
        import pyarrow as pa

        part, before, file, content = None, 0, None, []

        def closed():
            raw = pa.array([b"".join(content)], pa.binary())
            return pa.RecordBatch.from_arrays([pa.array([file], pa.int64()), raw], names=["file", "content"])

        for batch in batches:
            for own, size, member in zip(*(batch.column(c).to_pylist() for c in ("part", "size", "member"))):
                if own != part:
                    part, before = own, 0
                wanted = part + before // file_bytes * parts
                if content and wanted != file:
                    yield closed()
                    content = []
                file, before = wanted, before + size
                content.append(member)
        if content:
            yield closed()

    packed = placed.mapInArrow(pack, "part long, range string, page_id long, digest string, size long, member binary")
    order = ["part", "range", "page_id", "digest"]
    filled = packed.repartition("part").sortWithinPartitions(*order).mapInArrow(fill, "file long, content binary")
    _write_files(filled, path)


def _read_member(content: memoryview, at: int) -> tuple[bytes, int | None]:
    """The record of the member at `at` and where the member ends, None if it does not end well."""
    unpacker, out, end = zlib.decompressobj(31), [], at
    try:
        while not unpacker.eof and end < len(content):
            piece = content[end : end + _CHUNK]
            out.append(unpacker.decompress(piece))
            end += len(piece)
    except zlib.error:
        return b"".join(out), None
    return b"".join(out), end - len(unpacker.unused_data) if unpacker.eof else None


def _starts_member(content: memoryview, at: int) -> bool:
    record, end = _read_member(content, at)
    return end is not None or record.startswith(b"WARC/")


def _salvaged(content: memoryview, at: int, end: int) -> bytes:
    """What can still be unpacked, byte by byte, of a damaged member."""
    unpacker, out = zlib.decompressobj(31), []
    try:
        for n in range(at, end):
            out.append(unpacker.decompress(content[n : n + 1]))
    except zlib.error:
        pass
    return b"".join(out)


def parse_warc(content: bytes) -> Iterator[tuple[int, int, bool, bytes]]:
    """(start of the member, its end, whether it is whole, record) of each record; after a damaged one it goes on at
    the next member."""
    view, at = memoryview(content), 0
    while at < len(content):
        record, end = _read_member(view, at)
        whole = end is not None
        if not whole:
            end = content.find(_MEMBER, at + 1)
            while end >= 0 and not _starts_member(view, end):  # those bytes can occur inside a member
                end = content.find(_MEMBER, end + 1)
            end = len(content) if end < 0 else end
            if not any(view[at:end]):
                return  # padding
            record = _salvaged(view, at, end)
        yield at, end, whole, record.removesuffix(_BLANK)
        at = end
        while at < len(content) and content[at] == 0 and not any(view[at : at + len(_MEMBER)]):
            at += 1


def _page_id(record: bytes) -> int:
    found = _ID.search(record, 0, max(record.find(_BLANK), 0) or len(record))
    page_id = int(found[1]) if found else -1
    return page_id if -(1 << 63) <= page_id < 1 << 63 else -1


def _files(spark: SparkSession, path: str) -> DataFrame:
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return files.select(F.regexp_extract("path", r"/file=(\d+)/[^/]*$", 1).cast("long").alias("file"), "content")


def copy_warc(spark: SparkSession, path: str, to: str, change: Callable[[int, bytes], bytes | None]) -> None:
    """A copy of an archive, file by file, in which `change` gives the record of each page (None: lost)."""

    def copied(batches) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            for file, content in zip(batch.column("file").to_pylist(), batch.column("content").to_pylist()):
                out = []
                for at, end, _, record in parse_warc(content):
                    new = change(_page_id(record), record)
                    if new is not None:
                        out.append(content[at:end] if new == record else _packed(new))
                raw = pa.array([b"".join(out)], pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array([file], pa.int64()), raw], names=["file", "content"])

    _write_files(_files(spark, path).mapInArrow(copied, "file long, content binary"), to)


def _parsed(spark: SparkSession, path: str, with_record: bool) -> DataFrame:
    schema = "file long, seq long, page_id long, offset long, length long, member long, digest string"
    names = [c.split()[0] for c in schema.split(", ")]

    def read(batches) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            for file, content in zip(batch.column("file").to_pylist(), batch.column("content").to_pylist()):
                rows, offset = [], 0
                for seq, (at, end, whole, record) in enumerate(parse_warc(content)):
                    size = len(record) + 4
                    # A damaged member is told from a whole one even if its record can still be unpacked.
                    digest = hashlib.sha256(record if whole else content[at:end]).hexdigest()
                    found = (file, seq, _page_id(record), offset, size, at, digest)
                    rows.append((*found, record) if with_record else found)
                    offset += size
                if rows:
                    columns = [pa.array(c) for c in zip(*rows)]
                    yield pa.RecordBatch.from_arrays(columns, names=[*names, "record"][: len(columns)])

    return _files(spark, path).mapInArrow(read, schema + ", record binary" * with_record)


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """page_id and record (raw bytes) of every record of an archive."""
    return _parsed(spark, path, True).select("page_id", "record")


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """file, seq, page_id, offset and length (of the unpacked archive), member (where its packed bytes start) and
    digest of every record, and the range key of its page."""
    return _parsed(spark, path, False).withColumn("range", F.md5(F.col("page_id").cast("string")))


def tree(manifest: DataFrame, depth: int) -> list[DataFrame]:
    """The levels of every file's tree, the root first: file, node (digits of the range key), digest, offset, end."""
    leaf = F.array_sort(F.collect_list(F.struct("range", "page_id", "digest")))  # of a file: bounded by its size
    listed = F.transform(leaf, lambda r: F.concat_ws(":", r["page_id"], r["digest"]))
    span = [F.min("offset").alias("offset"), F.max("end").alias("end")]
    leaves = manifest.withColumn("end", F.col("offset") + F.col("length"))
    out = [
        leaves.groupBy("file", F.substring("range", 1, depth).alias("node")).agg(
            F.sha2(F.array_join(listed, ",").cast("binary"), 256).alias("digest"), *span
        )
    ]
    for level in range(depth - 1, -1, -1):
        children = F.array_sort(F.collect_list(F.struct("node", "digest")))  # no more than FANOUT
        named = F.transform(children, lambda c: F.concat_ws(":", c["node"], c["digest"]))
        out.append(
            out[-1].groupBy("file", F.substring("node", 1, level).alias("up")).agg(
                F.sha2(F.array_join(named, ",").cast("binary"), 256).alias("digest"), *span
            ).withColumnRenamed("up", "node")
        )
    return out[::-1]


def depth_for(records_of_largest_file: int) -> int:
    """Digits of the key that leave a leaf some FANOUT records."""
    return max(1, math.ceil(math.log(max(records_of_largest_file, 1) / FANOUT, FANOUT)))


def differing_nodes(ours: DataFrame, theirs: DataFrame, depth: int) -> list[DataFrame]:
    """file, node of the nodes that differ or that one replica lacks, level by level, the root first. Below the root
    only children of differing nodes are compared."""
    a, b, out = tree(ours, depth), tree(theirs, depth), []
    for level in range(depth + 1):
        here = [t[level] for t in (a, b)]
        if level:
            up = out[-1].select("file", F.col("node").alias("parent"))
            parent = F.substring("node", 1, level - 1)
            here = [t.withColumn("parent", parent).join(up, ["file", "parent"], "left_semi") for t in here]
        one, two = (t.select("file", "node", F.col("digest").alias(name)) for t, name in zip(here, "xy"))
        wrong = one.join(two, ["file", "node"], "full").where(~F.col("x").eqNullSafe(F.col("y")))
        out.append(settle(wrong.select("file", "node"), "nodes"))
    return out


def audit(ours: DataFrame, theirs: DataFrame) -> DataFrame:
    """Records that differ between two manifests: file, page_id, status (altered, missing, extra), offset and
    length in each replica (ours, theirs) and both digests."""
    ours, theirs = settle(ours, "ours"), settle(theirs, "theirs")
    sizes = [m.groupBy("file").count().agg(F.max("count")).first()[0] or 0 for m in (ours, theirs)]
    depth = depth_for(max(sizes))
    leaves = differing_nodes(ours, theirs, depth)[-1]
    key, record = ["file", "page_id"], ["file", "page_id", "digest"]
    # A page's records in a file share a leaf.
    whole = [m.withColumn("node", F.substring("range", 1, depth)).join(leaves, ["file", "node"], "left_semi") for m in (ours, theirs)]
    whole = [settle(m, "pages") for m in whole]
    counts = [m.groupBy(*record).agg(F.count("*").alias(n)) for m, n in zip(whole, ("a", "b"))]
    common = counts[0].join(counts[1], record, "full").na.fill(0, ["a", "b"]).where("a <> b")
    common = settle(common.select(*record, F.least("a", "b").alias("common")), "counts")
    sides = []
    for side, rows in zip(("", "replica_"), whole):
        equal, others = Window.partitionBy(*record).orderBy("seq"), Window.partitionBy(*key).orderBy("digest", "seq")
        rows = rows.join(common, record).withColumn("n", F.row_number().over(equal)).where("n > common")
        rows = rows.withColumn("copy", F.row_number().over(others))
        sides.append(rows.select(*key, "copy", *[F.col(c).alias(side + c) for c in ("offset", "length", "digest")]))
    joined = sides[0].join(sides[1], [*key, "copy"], "full")
    status = F.when(F.col("replica_digest").isNull(), "missing").when(F.col("digest").isNull(), "extra").otherwise("altered")
    return joined.select(
        "file", "page_id", status.alias("status"), "offset", "length", "digest",
        "replica_offset", "replica_length", "replica_digest",
    )


# The query's second replica: some pages are altered, some cut short, some lost.
ALTERED, CUT, LOST = 97, 101, 103


def damage(page_id: int, record: bytes) -> bytes | None:
    """The record of the replica that the query audits, by a rule on page_id."""
    if page_id % LOST == 13:
        return None
    if page_id % ALTERED == 7:
        return b"X" + record[1:]
    return record.decode()[:-10].encode() if page_id % CUT == 11 else record


def oracle() -> str:
    """DuckDB SQL of the query, for page ids that do not repeat."""
    n = "chr(13) || chr(10)"
    return f"""
with a as (select coalesce(page_id, -1) as page_id, 'WARC/1.1' || {n} || 'WARC-Type: resource' || {n}
    || 'WARC-Record-ID: <urn:page:' || coalesce(page_id, -1) || '>' || {n} || 'WARC-Date: {DATE}' || {n}
    || 'WARC-Target-URI: ' || coalesce(url, '') || {n} || 'Content-Type: text/html' || {n} || 'Content-Length: '
    || strlen(coalesce(html, '')) || {n} || {n} || coalesce(html, '') as record from pages),
m as (select page_id, record, strlen(record) + 4 as length, sha256(record) as digest, md5(page_id::varchar) as range from a),
p as (select *, ('0x' || substr(md5(page_id || ':' || digest), 1, 8))::bigint % parts as part
    from m, (select greatest(1, cast(ceil(sum(length) / {FILE_BYTES}.0) as bigint)) as parts from m)),
f as (select *, sum(length) over (partition by part order by range, page_id, digest) - length as before from p),
ao as (select *, part + before // {FILE_BYTES} * parts as file, before - min(before)
    over (partition by part, before // {FILE_BYTES}) as o from f),
b as (select file, page_id, range, digest as was, case when page_id % {ALTERED} = 7 then 'X' || substr(record, 2)
    when page_id % {CUT} = 11 then substr(record, 1, length(record) - 10) else record end as record
    from ao where page_id % {LOST} <> 13),
bm as (select *, strlen(record) + 4 as length, sha256(record) as digest from b),
bo as (select *, sum(length) over (partition by file order by range, page_id, was) - length as o from bm)
select cast(ao.file as bigint) as file, ao.page_id, case when bo.page_id is null then 'missing' else 'altered' end as status,
    cast(ao.o as bigint) as offset, cast(ao.length as bigint) as length, ao.digest, cast(bo.o as bigint) as replica_offset,
    cast(bo.length as bigint) as replica_length, bo.digest as replica_digest
from ao left join bo on ao.page_id = bo.page_id where bo.page_id is null or ao.digest <> bo.digest"""
