"""Packing documents into as few fixed-size token sequences as possible, by a grouping genetic algorithm.

A document's ids end with an end id. Documents longer than a sequence are cut into full pieces and a rest;
full pieces are sequences of their own. All other pieces are packed whole: a hash deals them to blocks of
about `block_items` pieces, and each block is packed by islands, small populations of packings that evolve
apart. A child takes over bins of one parent whole, the better filled ones, then those bins of the other parent
that hold no piece twice; the pieces left over are placed by best fit, largest first. Islands breed until no packing
could be smaller, or until generations bring nothing better. After each round the best packing of an island migrates to the next island of its block, and the best of the last round wins. Bins
that stay under `well_filled` and under what is usual in their block are opened once more and their pieces are packed
again in blocks of their own, so that blocks do not cost a half-empty sequence each.

Scale. A block is bounded by the hash and its count, whatever the table holds; islands of all blocks evolve
side by side and exchange only bin numbers. Texts are read once, and only lengths and checksums travel.

Edge cases. A null or empty text is a piece of its end id. Rows without doc_id and repeated rows are packed
like any other, each on its own. Extra columns are ignored. An empty table gives no rows."""

from __future__ import annotations

import random
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlens.llm.support import settle
from ledgerlens.llm.tokens import encoder

CAPACITY = 4_096
END_ID = 1
BLOCK_ITEMS = 6_000
ISLANDS = 2
ROUNDS = 2
POPULATION = 8
GENERATIONS = 120
#: Generations without a better packing after which a round ends.
PATIENCE = 40
#: Bins that are as full as this part of their parent's bins are taken over whole.
INJECTED = 0.8
WELL_FILLED = 0.995
#: Texts that a worker holds as strings; an Arrow batch may hold many more.
_ROWS_AT_ONCE = 500

Bins = list[list[int]]


def split_documents(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32: every document's pieces of at most `capacity` ids."""

    def cut(batches) -> Iterator:
        import pyarrow as pa

        encode, end = encoder(tokenizer), end_id.to_bytes(4, "little")
        types = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
        names = ["doc_id", "piece", "start", "length", "ids_crc32"]
        for whole in batches:
            for first in range(0, whole.num_rows, _ROWS_AT_ONCE):
                batch = whole.slice(first, _ROWS_AT_ONCE)
                out = []
                for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()):
                    raw = encode(text) + end
                    for piece, at in enumerate(range(0, len(raw), 4 * capacity)):
                        own = raw[at : at + 4 * capacity]
                        out.append((doc_id, piece, at // 4, len(own) // 4, zlib.crc32(own)))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], names=names)

    schema = "doc_id long, piece int, start long, length long, ids_crc32 long"
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(cut, schema)


def best_fit(sizes: list[int], items: list[int], capacity: int, bins: Bins | None = None) -> Bins:
    """Places items in the given order, each into the fullest bin that still takes it."""
    bins = [list(b) for b in bins or []]
    by_room: list[list[int]] = [[] for _ in range(capacity + 1)]
    rooms = 0  # bit r is set where a bin with room r exists
    for at, b in enumerate(bins):
        room = capacity - sum(sizes[i] for i in b)
        by_room[room].append(at)
        rooms |= 1 << room
    for i in items:
        size = sizes[i]
        fitting = rooms >> size
        if fitting:
            room = size + (fitting & -fitting).bit_length() - 1
            at = by_room[room].pop()
            if not by_room[room]:
                rooms ^= 1 << room
            bins[at].append(i)
        else:
            room, at = capacity, len(bins)
            bins.append([i])
        by_room[room - size].append(at)
        rooms |= 1 << (room - size)
    return bins


def fitness(sizes: list[int], bins: Bins) -> tuple[int, int]:
    """Fewer bins first, then more unequal filling, which leaves room that can be used."""
    return len(bins), -sum(sum(sizes[i] for i in b) ** 2 for b in bins)


def crossover(sizes: list[int], capacity: int, first: Bins, second: Bins, rng: random.Random) -> Bins:
    """A child with well-filled bins of `first` injected whole into `second`. What is well filled goes by the
    parent's own bins, so there is something to inject however hard the pieces are to pack."""
    fills = [sum(sizes[i] for i in b) for b in first]
    keep = sorted(fills)[int(len(fills) * (1 - INJECTED))]
    filled = [b for b, fill in zip(first, fills) if fill >= keep]
    injected = [b for b in filled if rng.random() < 0.7] or filled[:1]
    taken = bytearray(len(sizes))
    for b in injected:
        for i in b:
            taken[i] = 1
    child, displaced = list(injected), []
    for b in second:
        if any(taken[i] for i in b):
            displaced += [i for i in b if not taken[i]]
        else:
            child.append(b)
    # Some poor bins give up their pieces too: best fit finds them other company.
    kept = []
    for b in child:
        if sum(sizes[i] for i in b) < keep and rng.random() < 0.5:
            displaced += b
        else:
            kept.append(b)
    rng.shuffle(displaced)
    displaced.sort(key=lambda i: -sizes[i])
    return best_fit(sizes, displaced, capacity, kept)


def evolve(
    sizes: list[int], capacity: int, seed: int, given: list[Bins], population: int, generations: int, patience: int
) -> Bins:
    """One island's round: a population from the given packings, its own and mixed ones, bred by crossover."""
    rng = random.Random(seed)
    falling = sorted(range(len(sizes)), key=lambda i: -sizes[i])
    floor = -(-sum(sizes) // capacity)
    pool = [*given] or [best_fit(sizes, falling, capacity)]
    if min(map(len, pool)) <= floor:  # no packing has fewer bins
        return min(pool, key=lambda b: fitness(sizes, b))
    while len(pool) < population:
        jitter = 0.05 * len(pool)
        order = sorted(falling, key=lambda i: -sizes[i] * (1 + rng.uniform(-jitter, jitter)))
        pool.append(best_fit(sizes, order, capacity))
    pool = sorted(((fitness(sizes, b), n, b) for n, b in enumerate(pool)))
    best, idle = pool[0][0], 0
    for n in range(generations):
        if best[0] <= floor or idle >= patience:
            break
        first, second = rng.sample(range(len(pool)), 2)
        child = crossover(sizes, capacity, pool[min(first, second)][2], pool[max(first, second)][2], rng)
        pool = sorted([*pool[:-1], (fitness(sizes, child), len(pool) + n, child)])
        idle = idle + 1 if pool[0][0] == best else 0
        best = pool[0][0]
    return pool[0][2]


def _bins_of(column: pd.Series) -> Bins:
    out: dict[int, list[int]] = {}
    for i, b in enumerate(column.tolist()):
        out.setdefault(b, []).append(i)
    return list(out.values())


def pack_blocks(items: DataFrame, capacity: int, blocks: int, settings: dict) -> DataFrame:
    """item, length, block, bin, offset, filled (of its bin), typical (median of its block's bins): the best packing of
    each block of items (item, length)."""
    islands = settings["islands"]
    placed = items.withColumn("block", F.pmod(F.xxhash64("item"), F.lit(blocks)).cast("int"))
    state = placed.withColumn("island", F.explode(F.array(*[F.lit(i) for i in range(islands)])))
    state = state.withColumn("own", F.lit(None).cast("int")).withColumn("guest", F.lit(None).cast("int"))
    schema = "item long, length long, block int, island int, bin int, bins int, squares double"

    def island_round(number: int):
        def run(rows: pd.DataFrame) -> pd.DataFrame:
            rows = rows.sort_values("item", ignore_index=True)
            sizes = rows["length"].tolist()
            given = [_bins_of(rows[c]) for c in ("own", "guest") if rows[c].notna().all()]
            seed = (int(rows["block"][0]) * 1_009 + int(rows["island"][0])) * 31 + number
            bins = evolve(
                sizes, capacity, seed, given, settings["population"], settings["generations"], settings["patience"]
            )
            number_of = [0] * len(sizes)
            for at, b in enumerate(bins):
                for i in b:
                    number_of[i] = at
            count, squares = fitness(sizes, bins)
            out = rows[["item", "length", "block", "island"]].copy()
            out["bin"], out["bins"], out["squares"] = number_of, count, float(squares)
            return out

        return run

    for number in range(settings["rounds"]):
        evolved = state.groupBy("block", "island").applyInPandas(island_round(number), schema)
        evolved = settle(evolved, "islands")
        # The best packing of each island visits the next one.
        visit = evolved.select(
            "item", ((F.col("island") + 1) % islands).alias("island"), F.col("bin").alias("guest")
        )
        state = evolved.select("item", "length", "block", "island", F.col("bin").alias("own")).join(
            visit, ["item", "island"]
        )
    rank = F.min(F.struct("bins", "squares", "island")).alias("best")
    winner = evolved.groupBy("block").agg(rank).select("block", F.col("best.island").alias("island"))
    chosen = evolved.join(F.broadcast(winner), ["block", "island"])  # a row per block of thousands of items

    def laid_out(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["bin", "item"], ignore_index=True)
        by_bin = rows.groupby("bin")["length"]
        rows["offset"] = by_bin.cumsum() - rows["length"]
        rows["filled"] = by_bin.transform("sum")
        rows["typical"] = int(by_bin.sum().median())
        return rows[["item", "length", "block", "bin", "offset", "filled", "typical"]]

    return chosen.groupBy("block").applyInPandas(
        laid_out, "item long, length long, block int, bin int, offset long, filled long, typical long"
    )


def pack(
    docs: DataFrame,
    tokenizer: str,
    capacity: int = CAPACITY,
    end_id: int = END_ID,
    block_items: int = BLOCK_ITEMS,
    islands: int = ISLANDS,
    rounds: int = ROUNDS,
    population: int = POPULATION,
    generations: int = GENERATIONS,
    patience: int = PATIENCE,
    well_filled: float = WELL_FILLED,
) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset: one row per piece."""
    settings = {
        "islands": islands, "rounds": rounds, "population": population,
        "generations": generations, "patience": patience,
    }
    cut = settle(split_documents(docs, tokenizer, capacity, end_id), "pieces")
    pieces = settle(cut.withColumn("item", F.monotonically_increasing_id()), "numbered")
    # Three kinds of sequences, told apart by the remainder: full pieces, first packing, second packing.
    full = pieces.where(F.col("length") == capacity)
    full = full.select("item", (F.col("item") * 3).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    parts, rest = [full], pieces.where(F.col("length") < capacity).select("item", "length")
    for again in (False, True):
        count = rest.count()
        if not count:
            break
        packed = settle(pack_blocks(rest, capacity, -(-count // block_items), settings), "packed")
        poor = F.lit(False) if again else F.col("filled") < F.least(F.lit(well_filled * capacity), "typical")
        number = (F.col("block").cast("long") * block_items * 16 + F.col("bin")) * 3 + (2 if again else 1)
        parts.append(packed.where(~poor).select("item", number.alias("sequence_id"), "offset"))
        rest = packed.where(poor).select("item", "length")
    placed = parts[0]
    for part in parts[1:]:
        placed = placed.union(part)
    return pieces.join(placed, "item").select(
        "doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"
    )
