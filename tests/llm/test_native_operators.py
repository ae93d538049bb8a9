"""License scans, sharding and WARC audits."""

import gzip
import hashlib
import random
import zlib
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from ledgerlens.llm import license_scan, sharding, warc
from ledgerlens.llm.support import ready


def plain_words(text):
    return "".join(c.lower() if c.isalnum() else " " for c in text or "").split()


def plain_cut(text):
    words = plain_words(text)
    return [tuple(words[i : i + 5]) for i in range(len(words) - 4)]


def plain_scan(rows, templates):
    sets = {name: set(cut) for name, t in templates.items() if (cut := plain_cut(t))}
    out = []
    for doc_id, text in rows:
        own = plain_cut(text)
        held = {name: sets[name] & set(own) for name in sets}
        passed = {n: h for n, h in held.items() if len(h) >= 0.8 * len(sets[n])}
        for name, shared in passed.items():
            rivals = [o for o in passed if o != name and len(sets[o] & sets[name]) >= 0.5 * min(len(sets[o]), len(sets[name]))]
            if not any(len(passed[o]) * len(sets[name]) > len(shared) * len(sets[o]) for o in rivals):
                out.append((doc_id, name, len(shared), len(sets[name]), 1 + min(own.index(s) for s in shared)))
    return sorted(out, key=str)


def test_scan_equals_brute_force(docs_of):
    rng = random.Random(1)
    noise = lambda n: " ".join("".join(rng.choice("abcdefg") for _ in range(rng.randint(2, 7))) for _ in range(n))
    rows = []
    for n, (name, text) in enumerate(license_scan.TEMPLATES.items()):
        words = text.split()
        rows += [(n, f"{noise(n * 3)}. {text}\n{noise(40)}"), (100 + n, text.upper())]
        for at in rng.sample(range(len(words)), len(words) // 40):
            words[at] = "changed"
        rows.append((200 + n, f"{noise(11)} {' '.join(words)} {noise(7)}"))
        rows.append((300 + n, " ".join(words[: len(words) // 2])))
    rows.append((999, " ".join(license_scan.TEMPLATES.values())))
    found = sorted(map(tuple, license_scan.scan(docs_of(rows)).collect()), key=str)
    assert found == plain_scan(rows, license_scan.TEMPLATES) and len(found) > 40


@pytest.mark.parametrize(
    ("text", "license"),
    [
        (license_scan.TEMPLATES["BSD-3-Clause-text"], "BSD-3-Clause-text"),
        (license_scan.TEMPLATES["BSD-2-Clause-text"], "BSD-2-Clause-text"),
        (license_scan.TEMPLATES["AGPL-3.0-header"], "AGPL-3.0-header"),
        (license_scan.TEMPLATES["GPL-2.0-header"].replace("This program", "This tool"), "GPL-2.0-header"),
        (license_scan.TEMPLATES["GPL-3.0-header"], "GPL-3.0-header"),
        (license_scan.TEMPLATES["LGPL-2.1-header"], "LGPL-2.1-header"),
        ("Hello there. Distributed under the MIT license, see the file.", "MIT-distributed"),
    ],
)
def test_families_are_told_apart(docs_of, text, license):
    assert [r.license for r in license_scan.scan(docs_of([(1, text)])).collect()] == [license]


def test_templates_are_found_by_bands_of_windows(spark, docs_of):
    """Only single-shingle notices have no window of several shingles; blocks of templates find the same."""
    index = license_scan.Index(spark, license_scan.TEMPLATES, license_scan.SCALES, license_scan.BANDS, 10**6)
    ((_, _, tables),) = index.blocks
    assert {index.names[n] for held in tables[1].values() for n in held} == {"MIT", "MIT-distributed", "MIT-licensed"}
    assert set(tables) == {1, 2, 4, 16}
    rows = [(n, f"before it {t} after it") for n, t in enumerate(license_scan.TEMPLATES.values())]
    whole, blocks = (sorted(map(tuple, license_scan.scan(docs_of(rows), block=b).collect())) for b in (10**6, 60))
    assert whole == blocks == sorted(plain_scan(rows, license_scan.TEMPLATES))


def test_scan_odd_documents(odd_docs, docs_of):
    extra = odd_docs.selectExpr("*", "1 as words", "2 as sh", "3 as license")
    assert license_scan.scan(extra).count() == 0
    assert license_scan.scan(docs_of([])).count() == 0
    assert license_scan.scan(odd_docs, {}).count() == 0
    twice = docs_of([(None, "Released under the MIT License.")] * 2)
    assert [r.license for r in license_scan.scan(twice).collect()] == ["MIT", "MIT"]
    short = license_scan.scan(twice, {"short": "MIT License"})
    assert short.count() == 0


@pytest.mark.parametrize("key", ["slot", "shard"])
def test_a_key_named_like_a_result_is_a_clear_error(spark, key):
    with pytest.raises(ValueError, match="rename"):
        sharding.place(spark.range(3).withColumnRenamed("id", key), key, [0, 0])


def test_table_shares_and_stability():
    names = sharding.shard_names(20)
    table = sharding.fill_table(names, 2003)
    shares = [table.count(i) for i in range(20)]
    assert max(shares) - min(shares) <= 1 and min(table) == 0
    fewer = sharding.fill_table(names[:-1], 2003)
    moved = sum(a != b for a, b in zip(table, fewer) if a != 19)
    assert moved < 0.15 * 2003


@pytest.mark.parametrize("bad", [([], 7), (["a", "a"], 7), (["a"], 8), (list("abcdefgh"), 7)])
def test_bad_tables_are_errors(bad):
    with pytest.raises(ValueError):
        sharding.fill_table(*bad)


def test_place_and_write(spark, docs_of, tmp_path):
    docs = docs_of([(i, f"t{i}") for i in range(200)] + [(None, None), (None, None), (5, "again")])
    table = sharding.fill_table(sharding.shard_names(7), 101)
    placed = sharding.place(docs.selectExpr("*", "1 as shard", "'x' as slot"), "doc_id", table)
    rows = placed.collect()
    assert len(rows) == 203 and all(table[r.slot] == r.shard for r in rows)
    assert len({r.shard for r in rows if r.doc_id is None}) == 1 and len({r.shard for r in rows if r.doc_id == 5}) == 1
    sharding.write_sharded(docs, "doc_id", table, str(tmp_path / "s"), files_per_shard=2)
    assert spark.read.parquet(str(tmp_path / "s")).groupBy("shard").count().count() == 7
    assert sharding.place(docs_of([]), "doc_id", table).count() == 0
    after = sharding.fill_table([*sharding.shard_names(6), "new"], 101)
    assert 0 < sharding.moved(docs, "doc_id", table, after).count() < 203


def pages_of(spark, n):
    rows = [(i, f"http://h/{i}", "<p>é " + "x" * (i % 50) + "\r\n\r\nWARC/1.1\r\n</p>") for i in range(n)]
    return ready(spark).createDataFrame(rows, "page_id long, url string, html string")


SCHEMA = "page_id long, url string, html string"


@pytest.fixture
def written(spark, tmp_path):
    """Writes an archive, returns its folder and manifest."""

    def write(archive, **layout):
        path = str(tmp_path / f"archive{len(list(tmp_path.iterdir()))}")
        warc.write_warc(archive, path, **layout)
        return path, warc.read_manifest(spark, path)

    return write


def statuses(ours, theirs):
    return sorted((r.page_id, r.status) for r in warc.audit(ours, theirs).collect())


def wanted_damage(n):
    out = {}
    for i in range(n):
        if i % warc.ALTERED == 7 or i % warc.CUT == 11:
            out[i] = "altered"
        if i % warc.LOST == 13:
            out[i] = "missing"
    return out


def test_audit_finds_the_damage_only(spark, written, tmp_path):
    path, ours = written(warc.records(pages_of(spark, 700)), parts=3, file_bytes=9_000)
    assert ours.select("file").distinct().count() > 10
    assert statuses(ours, ours) == []
    warc.copy_warc(spark, path, str(tmp_path / "copy"), warc.damage)
    theirs = warc.read_manifest(spark, str(tmp_path / "copy"))
    assert dict(statuses(ours, theirs)) == wanted_damage(700)
    assert dict(statuses(theirs, ours)) == {i: "extra" if s == "missing" else s for i, s in wanted_damage(700).items()}


def test_archive_round_trip_and_offsets(spark, written):
    archive = warc.records(pages_of(spark, 40))
    path, manifest = written(archive, parts=2)
    back = {r.page_id: bytes(r.record).decode() for r in warc.read_warc(spark, path).collect()}
    assert back == {r.page_id: r.record for r in archive.collect()}
    for file in Path(path).glob("file=*/part*"):
        packed = file.read_bytes()
        whole = gzip.decompress(packed)  # any gzip reader takes the file
        rows = manifest.where(f"file = {file.parent.name.split('=')[1]}").orderBy("seq").collect()
        assert b"".join(back[r.page_id].encode() + b"\r\n\r\n" for r in rows) == whole
        for r in rows:
            record = whole[r.offset : r.offset + r.length]
            assert record.endswith(b"\r\n\r\n") and f"<urn:page:{r.page_id}>".encode() in record[:90]
            assert zlib.decompressobj(31).decompress(packed[r.member :]) == record


def test_one_lost_record_is_found_along_one_branch(spark, written, tmp_path):
    path, ours = written(warc.records(pages_of(spark, 3_000)))
    warc.copy_warc(spark, path, str(tmp_path / "copy"), lambda page_id, record: None if page_id == 1234 else record)
    theirs = warc.read_manifest(spark, str(tmp_path / "copy"))
    assert statuses(ours, theirs) == [(1234, "missing")]
    depth = warc.depth_for(3_000)
    wrong = warc.differing_nodes(ours, theirs, depth)
    digits = hashlib.md5(b"1234").hexdigest()
    assert depth == 2 and [[tuple(r) for r in level.collect()] for level in wrong] == [[(0, digits[:n])] for n in range(3)]


@pytest.mark.parametrize("ids", [lambda i: 5, lambda i: None, lambda i: 640 * i, lambda i: i % 3])
def test_files_are_bounded_and_spread_whatever_the_ids(spark, written, ids):
    rows = [(ids(i), f"u{i}", "<p>" + "x" * 60 * (i % 7)) for i in range(1_500)]
    _, manifest = written(warc.records(ready(spark).createDataFrame(rows, SCHEMA)), parts=8, file_bytes=20_000)
    sizes = [r["sum(length)"] for r in manifest.groupBy("file").sum("length").collect()]
    assert sum(sizes) > 15 * 20_000 and max(sizes) < 21_000
    parts = [r["count"] for r in manifest.groupBy((F.col("file") % 8).alias("part")).count().collect()]
    assert len(parts) == 8 and max(parts) < 2 * 1_500 / 8


def test_rows_repeated_in_all_respects_are_dealt_by_number(spark, written):
    rows = [(1, "u", "same " * 20)] * 500 + [(i, "u", "other") for i in range(1_000)]
    archive = warc.records(ready(spark).createDataFrame(rows, SCHEMA).repartition(4))
    parts, heavy = warc.layout(archive, 20_000)
    assert len(heavy) == 1 and parts > 8
    path, manifest = written(archive, parts=parts, heavy=heavy, file_bytes=20_000)
    by_part = [r["count"] for r in manifest.where("page_id = 1").groupBy((F.col("file") % parts).alias("part")).count().collect()]
    assert sum(by_part) == 501 and max(by_part) < 3 * 501 / parts
    assert statuses(manifest, manifest) == []


def test_audit_odd_pages(spark, written):
    schema = "page_id long, url string, html string, digest int, file int, part int"
    rows = [(1, None, None, 0, 0, 0), (None, "u", "", 0, 0, 0), (2, "u", "same", 0, 0, 0), (2, "u", "same", 0, 0, 0), (2, "u", "z" * 100_000, 0, 0, 0)]
    archive = warc.records(ready(spark).createDataFrame(rows, schema))
    _, ours = written(archive)
    path, none = written(archive.where("false"))
    assert warc.layout(archive.where("false")) == (1, [])
    assert statuses(ours, ours) == [] and statuses(none, none) == []
    assert [s for _, s in statuses(ours, none)] == ["missing"] * 5
    warc.copy_warc(spark, path, path + "copy", warc.damage)
    assert warc.read_manifest(spark, path + "copy").count() == 0


def test_run_of_copies_after_a_lost_record(spark, written):
    rows = [(i, f"u{i}", "body") for i in range(1, 11)] + [(50, "u", "same")] * 100 + [(60 + i, "v", "x") for i in range(20)]
    manifest = lambda rows: written(warc.records(ready(spark).createDataFrame(rows, SCHEMA)))[1]
    ours = manifest(rows)
    found = lambda replica: statuses(ours, manifest(replica))
    assert found(rows[1:]) == [(1, "missing")]
    assert found([(0, "u", "new"), *rows]) == [(0, "extra")]
    assert found(rows[1:60] + rows[61:]) == [(1, "missing"), (50, "missing")]
    assert found([*rows[1:], rows[50]]) == [(1, "missing"), (50, "extra")]
    assert found([*rows[1:60], *rows[62:], (50, "u", "other")]) == [(1, "missing"), (50, "altered"), (50, "missing")]


def test_damaged_bytes_cost_one_record(spark, written, tmp_path):
    path, ours = written(warc.records(pages_of(spark, 200)))
    (file,) = Path(path).glob("file=*/part*")
    content, rows = bytearray(file.read_bytes()), ours.orderBy("seq").collect()
    hit = [rows[20].page_id, rows[77].page_id, rows[150].page_id]
    content[rows[20].member + 60] ^= 0xFF
    content[rows[77].member + 3] ^= 0xFF  # its head
    content[rows[151].member - 6] ^= 0xFF  # its checksum
    to = tmp_path / "damaged" / "file=0"
    to.mkdir(parents=True)
    (to / "part-0").write_bytes(content)
    theirs = warc.read_manifest(spark, str(tmp_path / "damaged"))
    found = warc.audit(ours, theirs).collect()
    assert {r.page_id for r in found} <= {*hit, -1} and {r.page_id for r in found if r.status != "extra"} == set(hit)


def test_reader_keeps_bytes_and_resumes():
    def record(i, body):
        head = f"WARC/1.1\r\nWARC-Type: resource\r\nWARC-Record-ID: <urn:page:{i}>\r\nContent-Length: {len(body)}\r\n\r\n"
        return head.encode() + body

    rows = [record(i, b"\xff\xfe " + b"y" * i + b"\r\n\r\nWARC/1.1\r\n" + random.Random(i).randbytes(i * 700)) for i in range(30)]
    members = [warc._packed(r) for r in rows]
    found = list(warc.parse_warc(b"".join(members) + b"\0"))
    assert [r for *_, r in found] == rows
    assert [end - at for at, end, *_ in found] == list(map(len, members)) and all(whole for *_, whole, _ in found)
    for n, at in ((0, 0), (4, 9), (12, 2_000), (29, 100)):
        damaged = [bytearray(m) for m in members]
        damaged[n][at] ^= 0x55
        found = [r for *_, r in warc.parse_warc(b"".join(damaged))]
        assert [r for k, r in enumerate(rows) if k != n and r not in found] == []
        cut = list(members)
        cut[n] = cut[n][: len(cut[n]) // 2]
        found = [r for *_, r in warc.parse_warc(b"".join(cut))]
        assert [r for k, r in enumerate(rows) if k != n and r not in found] == [] and len(found) == 30
    assert not list(warc.parse_warc(b"")) and not list(warc.parse_warc(bytes(9)))
    assert [r for *_, r in warc.parse_warc(b"no member at all")] == [b""]


@pytest.mark.parametrize("name", ["op1_license_scan", "op2_sharding", "op4_warc_fixity"])
def test_queries_equal_their_sql(spark, name):
    from check_oracles import compare, connect

    sf_dir = "/root/testdata/sf0.01"
    assert compare(spark, connect(sf_dir), name, sf_dir) is None
