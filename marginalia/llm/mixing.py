"""Mixing sources to target weights by Pfair scheduling.

Each source is cut into blocks of BLOCK rows.  Block k (from 1) of a source of
weight w is released at slot floor((k-1)/w) and due by slot ceil(k/w);
earliest-deadline-first fills one slot at a time with a released block, which
keeps every source less than one block from its weight.  Weights are multiples
of 1/SLOTS, so the schedule repeats after SLOTS slots: only that period is
simulated, and every row finds its slot by arithmetic.  When a source runs out
the weights of the others are scaled up and a new phase begins, so that no row
is dropped or repeated.

Within a source rows are shuffled by a hash of the id, rows without an id by one
of all their columns; ties go by id, and rows equal throughout share a cell.
Null sources and those without a weight of their own share the stream OTHER,
which has a hundredth of the named weights' sum unless it is named itself.
Repeated rows take a place each; an empty table gives an empty result.  The added columns are named
``mix_*`` and replace columns of those names.
"""

from __future__ import annotations

import heapq
from dataclasses import dataclass
from math import ceil

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

BLOCK = 64  #: rows of a block
SLOTS = 1000  #: slots of a period, the resolution of weights
OTHER = "*"
#: Rows of a cell, in which ordinals are counted, and cells of a source at most.
CELL_ROWS, CELLS = 4096, 1 << 20


def shares(weights: dict[str, float], slots: int = SLOTS) -> dict[str, int]:
    """Slots of a period for each source: largest remainders, one slot at least."""
    if len(weights) > slots:
        raise ValueError(f"{len(weights)} sources do not fit into {slots} slots")
    total = sum(weights.values())
    exact = {s: w * slots / total for s, w in weights.items()}
    out = {s: max(1, int(x)) for s, x in exact.items()}
    while (left := slots - sum(out.values())) != 0:
        step = 1 if left > 0 else -1
        movable = [s for s in out if step > 0 or out[s] > 1]
        out[max(movable, key=lambda s: (step * (exact[s] - out[s]), s))] += step
    return out


def window(k: int, share: int, slots: int) -> tuple[int, int]:
    """Release and deadline of block k, from 1."""
    return (k - 1) * slots // share, -(-k * slots // share)


def earliest_deadline_first(share: dict[str, int]) -> dict[str, list[int]]:
    """The slots of each source's blocks over one period."""
    slots = sum(share.values())
    coming = [(*window(1, e, slots), s, 1) for s, e in share.items()]
    heapq.heapify(coming)
    ready: list[tuple[int, str, int]] = []
    out: dict[str, list[int]] = {s: [] for s in share}
    for slot in range(slots):
        while coming and coming[0][0] <= slot:
            _, due, s, k = heapq.heappop(coming)
            heapq.heappush(ready, (due, s, k))
        due, s, k = heapq.heappop(ready)
        if slot >= due:
            raise AssertionError("a deadline was missed")
        out[s].append(slot)
        if k < share[s]:
            heapq.heappush(coming, (*window(k + 1, share[s], slots), s, k + 1))
    return out


@dataclass(frozen=True)
class Stretch:
    """Blocks first .. first + blocks of one source, in one phase that starts at a slot."""

    stream: str
    phase: int
    first: int
    blocks: int
    share: int
    start: int
    at: list[int]


def phases(weights: dict[str, float], blocks: dict[str, int], slots: int = SLOTS) -> list[Stretch]:
    """The whole schedule: as many phases as sources at most."""
    left, done, start, out = {s: n for s, n in blocks.items() if n}, dict.fromkeys(blocks, 0), 0, []
    phase = 0
    while left:
        share = shares({s: weights[s] for s in left}, slots)
        at = earliest_deadline_first(share)
        length = 1 + min((n - 1) // share[s] * slots + at[s][(n - 1) % share[s]] for s, n in left.items())
        full, part = divmod(length, slots)
        for s in list(left):
            n = full * share[s] + sum(x < part for x in at[s])
            out.append(Stretch(s, phase, done[s], n, share[s], start, at[s]))
            done[s] += n
            left[s] -= n
            if not left[s]:
                del left[s]
        start += length
        phase += 1
    return out


def _stream(source: Column, weights: dict[str, float]) -> Column:
    return F.when(source.isin([s for s in weights if s != OTHER]), source).otherwise(F.lit(OTHER))


def mix(docs: DataFrame, weights: dict[str, float], id_col: str = "doc_id", source_col: str = "source", block: int = BLOCK, slots: int = SLOTS) -> DataFrame:
    """The documents with ``mix_stream, mix_block, mix_release, mix_deadline, mix_slot, mix_within``.

    ``mix_slot, mix_within`` is the order of the mixture.  Release and deadline
    count from the start of the block's phase.
    """
    weights = {OTHER: 0.01 * sum(weights.values())} | weights
    names = [c for c in docs.columns if not c.startswith("mix_")]
    key = F.when(F.col(id_col).isNotNull(), F.xxhash64(F.col(id_col), F.lit(11))).otherwise(F.xxhash64(*names))
    thin = docs.select(_stream(F.col(source_col), weights).alias("mix_stream"), key.alias("mix_key"))
    counts = {r["mix_stream"]: r["n"] for r in thin.groupBy("mix_stream").agg(F.count("*").alias("n")).collect()}  # a row a weight
    plan = phases(weights, {s: ceil(n / block) for s, n in counts.items()}, slots)
    bits = max(0, min(CELLS, sum(counts.values()) // CELL_ROWS).bit_length())
    cell = (F.shiftrightunsigned(F.col("mix_key"), 1) / F.lit(float(1 << 63)) * F.lit(float(1 << bits))).cast("int")  # equal ranges of the key's upper bits
    sizes = thin.groupBy("mix_stream", cell.alias("mix_cell")).agg(F.count("*").alias("n"))
    before = Window.partitionBy("mix_stream").orderBy("mix_cell").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("mix_stream", "mix_cell", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("mix_before"))

    rows = docs.select(*names, _stream(F.col(source_col), weights).alias("mix_stream"), key.alias("mix_key")).withColumn("mix_cell", cell)
    order = F.shiftrightunsigned(F.col("mix_key"), 1)
    within = F.row_number().over(Window.partitionBy("mix_stream", "mix_cell").orderBy(order, "mix_key", id_col))
    rows = rows.withColumn("mix_row", within).join(offsets, ["mix_stream", "mix_cell"])
    ordinal = F.col("mix_before") + F.col("mix_row") - 1
    rows = rows.withColumn("mix_block", F.floor(ordinal / block)).withColumn("mix_within", (ordinal % block).cast("int"))

    spark = docs.sparkSession
    kind = "p_stream string, p_phase int, p_first long, p_blocks long, p_share long, p_start long, p_at array<int>"
    known = spark.createDataFrame([(x.stream, x.phase, x.first, x.blocks, x.share, x.start, x.at) for x in plan], kind)
    # at most one row for each pair of weights, with at most `slots` numbers for each weight
    meets = (F.col("mix_stream") == F.col("p_stream")) & (F.col("mix_block") >= F.col("p_first")) & (F.col("mix_block") < F.col("p_first") + F.col("p_blocks"))
    k = F.col("mix_block") - F.col("p_first")
    slot = F.col("p_start") + F.floor(k / F.col("p_share")) * slots + F.get("p_at", (k % F.col("p_share")).cast("int"))
    return rows.join(F.broadcast(known), meets).select(
        *names,
        "mix_stream",
        "mix_block",
        F.expr(f"(mix_block - p_first) * {slots} div p_share").alias("mix_release"),
        F.ceil((k + 1) * slots / F.col("p_share")).alias("mix_deadline"),
        slot.cast("long").alias("mix_slot"),
        "mix_within",
    )


def in_order(mixed: DataFrame) -> DataFrame:
    """Rows laid out in files in the order of the mixture."""
    return mixed.repartitionByRange("mix_slot", "mix_within").sortWithinPartitions("mix_slot", "mix_within")
