"""Mixing sources to target weights by Pfair scheduling.

Every source is a task whose weight is its target share.  Its text, in a pseudo-random order of its documents,
is cut into blocks of ``block_chars`` code points.  Block j of a source of weight w is released at slot
floor(j / w) and due at slot ceil((j + 1) / w); one block is placed per slot, earliest deadline first among the
released ones.  Weights are rational with a common denominator D, so that the schedule repeats every D slots:
the driver computes one period (D is bounded by the number of sources) and any block's slot follows from it.
While no source has run dry, each has had its share of the slots to within less than one block.

``schedule`` gives every document the block in which it begins, with the block's window and slot; ``in_mix``
tells whether the document is in the mix.  By default every document is.  A caller that gives a ``coverage`` below 1
ends the mix at the horizon, the slot at which sources that hold that much of the target weight have run dry (their
turn comes and no block is left); then only sources that hold more than their target share lose documents.
``interleave`` returns the documents of the mix, in the order of the schedule.

Without explicit ``weights``, targets are the sources' sizes to the power ``alpha``, normalised; with them,
sources that they don't name (or name with 0) are left out.  A source's place sums are taken in three steps, over
hash ranges of a source, parts of a range and rows of a part, so that no source is gathered in one task.

Files don't keep an order that Spark reads them in: ``with_places`` gives the rows of a written mix their places
(number of the file, row in it), by which they can be sorted again.

Defined cases: a null source is a source of its own, a null or empty text counts as one code point, a very long
text begins in one block and fills those after it; repeated rows follow each other; without documents the result
is empty; more than ``max_sources`` sources are an error.
"""

from __future__ import annotations

import heapq
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import free_name, pack, stored, unpack

#: Ranges of a source, and parts of a range.
RANGE_BITS, PART_BITS = 7, 7


@dataclass(frozen=True)
class Settings:
    weights: dict[str, float] | None = None
    alpha: float = 0.7
    block_chars: int = 1 << 16
    coverage: float = 1.0
    slots: int = 1000
    max_sources: int = 4096


def quotas(weights: dict, slots: int) -> dict:
    """Blocks of each source in a period, at least one; their sum is the period."""
    total = sum(weights.values())
    size = max(slots, 20 * len(weights))
    return {s: max(1, round(w / total * size)) for s, w in weights.items()}


def window(j: int, quota: int, period: int) -> tuple[int, int]:
    """Release and deadline of block j."""
    return j * period // quota, -(-(j + 1) * period // quota)


def period_schedule(quota: dict) -> list[tuple[object, int, int]]:
    """(source, block in the period, slot): earliest deadline first among released blocks."""
    period = sum(quota.values())
    names = sorted(quota, key=lambda s: (s is not None, s))
    waiting = [(0, i, 0) for i in range(len(names))]
    ready: list[tuple[int, int, int]] = []
    out = []
    for slot in range(period):
        while waiting and waiting[0][0] <= slot:
            _, i, j = heapq.heappop(waiting)
            heapq.heappush(ready, (window(j, quota[names[i]], period)[1], i, j))
        if not ready:
            continue
        due, i, j = heapq.heappop(ready)
        if due <= slot:
            raise AssertionError("a deadline was missed")
        out.append((names[i], j, slot))
        if j + 1 < quota[names[i]]:
            heapq.heappush(waiting, (window(j + 1, quota[names[i]], period)[0], i, j + 1))
    return out


def block_slot(block: int, quota: int, period: int, slots: list[int]) -> int:
    return block // quota * period + slots[block % quota]


def places(docs: DataFrame, s: Settings) -> DataFrame:
    """(doc_id, source, h, size, before): the code points of the source before each document."""
    narrow = docs.select(
        "doc_id", "source", F.xxhash64("doc_id", "text").alias("h"), F.greatest(F.length(F.coalesce("text", F.lit(""))), F.lit(1)).cast("long").alias("size")
    ).withColumns({"r": F.shiftright("h", 64 - RANGE_BITS), "p": F.shiftright("h", 64 - RANGE_BITS - PART_BITS)})
    parts = narrow.groupBy("source", "r", "p").agg(F.sum("size").alias("total"))
    ranges = parts.groupBy("source", "r").agg(F.sum("total").alias("total"))
    # at most 2**RANGE_BITS rows a source, 2**PART_BITS a range
    until = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    before = lambda *by: F.coalesce(F.sum("total").over(until(Window.partitionBy(*by[:-1]).orderBy(by[-1]))), F.lit(0))
    low = ranges.select(F.col("source").alias("ls"), F.col("r").alias("lr"), before("source", "r").alias("low"))
    high = parts.select("source", "r", "p", before("source", "r", "p").alias("high"))
    starts = high.join(low, F.col("source").eqNullSafe(F.col("ls")) & (F.col("r") == F.col("lr"))).select(F.col("source").alias("s"), F.col("p").alias("sp"), (F.col("low") + F.col("high")).alias("start"))
    inside = Window.partitionBy("source", "p").orderBy("h", "doc_id").rowsBetween(Window.unboundedPreceding, -1)
    ranked = narrow.withColumn("own", F.coalesce(F.sum("size").over(inside), F.lit(0)))
    joined = ranked.join(starts, F.col("source").eqNullSafe(F.col("s")) & (F.col("p") == F.col("sp")))
    return joined.select("doc_id", "source", "h", "size", (F.col("start") + F.col("own")).alias("before"))


def schedule(docs: DataFrame, s: Settings = Settings()) -> DataFrame:
    """doc_id, source, h, block, release, deadline, slot, in_mix of every document of a weighted source."""
    spark = docs.sparkSession
    placed = stored(places(docs, s), "mix-places")
    found = placed.groupBy("source").agg(F.sum("size").alias("chars"), F.max("before").alias("last")).limit(s.max_sources + 1).collect()
    if len(found) > s.max_sources:
        raise ValueError(f"more than {s.max_sources} sources")
    weights = {r["source"]: (s.weights or {}).get(r["source"], 0.0) if s.weights else r["chars"] ** s.alpha for r in found}
    weights = {k: w for k, w in weights.items() if w > 0}
    quota = quotas(weights, s.slots) if weights else {}
    period = sum(quota.values())
    table = period_schedule(quota)
    slots: dict = {}
    for name, _, slot in table:
        slots.setdefault(name, []).append(slot)
    # a source has run dry when the turn of the block after its last one comes
    dry = sorted((block_slot(r["last"] // s.block_chars + 1, quota[r["source"]], period, slots[r["source"]]), quota[r["source"]]) for r in found if r["source"] in quota)
    held, horizon = 0, 0
    for at, q in dry:
        held, horizon = held + q, at
        if held >= s.coverage * period:
            break
    # a source that holds no more than its target share has no surplus: it stays whole
    chars = {r["source"]: r["chars"] for r in found if r["source"] in quota}
    whole = {k: s.coverage >= 1 or c * period <= quota[k] * sum(chars.values()) for k, c in chars.items()}
    rows = [(name, j, slot, quota[name]) for name, j, slot in table]
    # broadcast: one period, at most max(slots, 20 * max_sources) rows and a few
    period_table = F.broadcast(spark.createDataFrame(rows, "s string, j long, at long, quota long").coalesce(1))
    quota_table = F.broadcast(spark.createDataFrame([(k, q, whole[k]) for k, q in quota.items()], "qs string, q long, whole boolean").coalesce(1))
    block = F.floor(F.col("before") / s.block_chars).cast("long")
    blocks = placed.withColumn("block", block).join(quota_table, F.col("source").eqNullSafe(F.col("qs")))
    found = blocks.withColumn("b", F.col("block") % F.col("q")).join(period_table, F.col("source").eqNullSafe(F.col("s")) & (F.col("b") == F.col("j")))
    slot = (F.expr("block div q") * period + F.col("at")).alias("slot")
    release = F.expr(f"(block * {period}) div q").alias("release")
    deadline = F.expr(f"((block + 1) * {period} + q - 1) div q").alias("deadline")
    return found.select("doc_id", "source", "h", "before", "block", release, deadline, slot, "whole").withColumn("in_mix", F.col("whole") | (F.col("slot") < horizon)).drop("whole")


def mix(docs: DataFrame, s: Settings = Settings()) -> DataFrame:
    return schedule(docs, s).drop("h", "before")


def interleave(docs: DataFrame, s: Settings = Settings()) -> DataFrame:
    """The documents of the mix with their own columns, written order being the schedule's."""
    kept = schedule(docs, s).where("in_mix").select(F.col("doc_id").alias("_id"), F.col("h").alias("_h"), F.col("slot").alias("_slot"), F.col("before").alias("_before")).dropDuplicates(["_id", "_h"])
    needed = ("doc_id", "text", "source")
    keyed = pack(docs, *needed).withColumn("_key", F.xxhash64("doc_id", "text"))
    joined = keyed.join(kept, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("_key") == F.col("_h")))
    return unpack(joined.repartitionByRange("_slot", "_before").sortWithinPartitions("_slot", "_before"), docs.columns, needed)


def with_places(docs: DataFrame) -> DataFrame:
    """``docs``, read from the files of a written mix, with mix_file and mix_row (null where the rows aren't read from files)."""
    names = [free_name(n, docs.columns) for n in ("mix_file", "mix_row")]
    try:
        return docs.select("*", F.regexp_extract("_metadata.file_name", r"^part-(\d+)", 1).cast("int").alias(names[0]), F.col("_metadata.row_index").alias(names[1]))
    except AnalysisException:
        return docs.select("*", F.lit(None).cast("int").alias(names[0]), F.lit(None).cast("long").alias(names[1]))
