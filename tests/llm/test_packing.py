import random
import struct
import zlib

import pytest

from ledgerlens.llm import packing, registry, token_orc


def assert_packed(rows, capacity):
    by_sequence = {}
    for r in rows:
        by_sequence.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in by_sequence.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity
    return len(by_sequence)


def test_pieces_and_sequences_of_the_query(spark):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(token_orc.tokenizer_path())
    rows = registry.op6_packing(spark, "/root/testdata/sf0.001").collect()
    docs = {r.doc_id: r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()}
    wanted, total = set(), 0
    for doc_id, text in docs.items():
        ids = [*tokenizer.encode(text, add_special_tokens=False).ids, 1]
        total += len(ids)
        for piece, at in enumerate(range(0, len(ids), 4096)):
            own = ids[at : at + 4096]
            wanted.add((doc_id, piece, at, len(own), zlib.crc32(struct.pack(f"<{len(own)}I", *own))))
    assert {(r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows} == wanted and len(rows) == len(wanted)
    assert assert_packed(rows, 4096) <= -(-total // 4096) + 1


@pytest.mark.parametrize("seed", range(3))
def test_evolution_keeps_every_piece_once_and_never_worsens(seed):
    rng = random.Random(seed)
    sizes = [rng.choice([rng.randint(1, 60), rng.randint(300, 700)]) for _ in range(200)]
    first = packing.best_fit(sizes, sorted(range(200), key=lambda i: -sizes[i]), 1000)
    last = packing.evolve(sizes, 1000, seed, [first], 5, 12, 6)
    assert sorted(i for b in last for i in b) == list(range(200))
    assert all(sum(sizes[i] for i in b) <= 1000 for b in last)
    assert packing.fitness(sizes, last) <= packing.fitness(sizes, first)


def test_crossover_injects_whole_bins():
    sizes = [5, 5, 4, 6, 3, 7]
    child = packing.crossover(sizes, 10, [[0, 1], [2, 3], [4, 5]], [[0, 2], [1, 3], [4, 5]], random.Random(1))
    assert sorted(i for b in child for i in b) == list(range(6)) and len(child) == 3


@pytest.mark.parametrize("low, high, gain", [(700, 1_900, 10), (1_300, 2_500, 3)])
def test_search_needs_fewer_sequences_than_best_fit_where_pieces_are_large(low, high, gain, monkeypatch):
    rng, calls = random.Random(low), []
    sizes = [rng.randint(low, high) for _ in range(2_000)]
    first = packing.best_fit(sizes, sorted(range(2_000), key=lambda i: -sizes[i]), 4_096)
    plain = packing.crossover
    monkeypatch.setattr(packing, "crossover", lambda *a: calls.append(1) or plain(*a))
    last = packing.evolve(sizes, 4_096, 3, [], packing.POPULATION, packing.GENERATIONS, packing.PATIENCE)
    assert sorted(i for b in last for i in b) == list(range(2_000)) and max(sum(sizes[i] for i in b) for b in last) <= 4_096
    assert len(last) <= len(first) - gain and len(calls) > 10


def test_small_blocks_pack_everything(docs_of):
    rng = random.Random(8)
    docs = docs_of([(i, "word " * rng.randint(0, 90)) for i in range(120)])
    rows = packing.pack(docs, token_orc.tokenizer_path(), capacity=64, block_items=20).collect()
    total = sum(r.length for r in rows)
    assert {r.doc_id for r in rows} == set(range(120)) and assert_packed(rows, 64) <= 1.15 * total / 64 + 2


def test_odd_documents(odd_docs, docs_of):
    docs = odd_docs.selectExpr("*", "1 as item", "2 as length", "3 as piece")
    rows = packing.pack(docs, token_orc.tokenizer_path()).collect()
    assert_packed(rows, 4096)
    assert sorted(r.length for r in rows if r.doc_id in (1, 2, 3)) == [1, 1, 1]
    assert len([r for r in rows if r.doc_id == 4]) == 2 and len([r for r in rows if r.doc_id is None]) == 1
    assert packing.pack(docs_of([]), token_orc.tokenizer_path()).count() == 0


def test_cutting_holds_few_texts_at_a_time(spark, docs_of, monkeypatch):
    """A worker turns some rows of a batch into strings at a time, whatever the batch holds."""
    monkeypatch.setattr(packing, "_ROWS_AT_ONCE", 3)
    docs = docs_of([(None if i == 4 else i, None if i % 5 == 0 else "some words " * i) for i in range(17)]).coalesce(1)
    cut = packing.split_documents(docs, token_orc.tokenizer_path(), capacity=8)
    assert "MapInArrow" in cut._jdf.queryExecution().executedPlan().toString()
    rows = cut.collect()
    assert {r.doc_id for r in rows if r.piece == 0} == {None, *range(17)} - {4} and sum(r.piece == 0 for r in rows) == 17
    ends = {}
    for r in rows:
        assert r.start == ends.get(r.doc_id, 0) and 0 < r.length <= 8
        ends[r.doc_id] = r.start + r.length
    assert all(ends[i] == 1 for i in (0, 5, 10, 15)) and ends[16] > 16
