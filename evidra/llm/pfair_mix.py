"""Operator 9, mixing sources to target weights: Pfair scheduling, in DataFrame operations only.

The rows of each source, in hash order, are cut into blocks of ``block_rows``. With ``q`` of the
``period`` slots as its share, a source's block k (from 1) is released at ``floor((k-1)*period/q)`` and due by
``ceil(k*period/q)``; each slot goes to the released block with the earliest deadline. All windows are met
(the shares fill the period exactly), so at every slot each source has had its share of the slots to within
less than one block. The pattern repeats, so one period is planned from the shares alone, and block
b's slot is ``(b div q)*period + offset[b mod q]``: no task walks the corpus. A share differs from the target weight by less
than a slot of a period, which is long: to the weights themselves the mix is within less than two blocks for one period of rows.

A source that runs out leaves its later slots empty and the others close up; no row is dropped. The
hash order is numbered in buckets of bounded size, each with the count of the buckets before it, so a
source with a third of all rows is spread over many tasks.

A source whose target weight is less than one slot of a period has no share of it. Such small sources keep their own exact shares by Pfair
windows that are arithmetic in the plan: the slots are split between the planned and the small sources, and these by a binary tree over the sources, in which
each node's slots go to its two children by the Pfair windows of two tasks. For weights l and r of n = l + r block b
(from 0) of the left is at ``floor(b*n/l)``, that of the right at ``ceil((b+1)*n/r) - 1``.
The sources are dealt by falling weight, so that siblings are about equal and the levels' deviations (each under
one block) halve on the way down: a source is within about two blocks of its share. There may be any number of them; nothing of them is collected.

Defined results: a null source is a source of its own. A source that ``weights`` does not name has the least weight named. Rows alike in id and
text may trade places. An empty table gives an empty result. Other columns pass through; mix_slot and mix_index are replaced if there.
"""

from __future__ import annotations

import heapq
import json
import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Slots of the planned period, and so the most sources that are planned in it.
PERIOD = 1 << 16
#: Rows of a source are numbered in buckets of about this many.
BUCKET_ROWS = 4096
#: Sum of the whole weights of a split; times the count of blocks it fits decimals.
WHOLE = 2**46
#: Least weight of all small sources together, as a share of the mix, so that slots fit a long.
LEAST_SHARE = 2.0**-30
NULL_KEY = "\x00null"

_KEY, _HASH, _TIE, _BUCKET = "__mx_key", "__mx_hash", "__mx_tie", "__mx_bucket"


def shares(weights: dict[str, float], period: int) -> dict[str, int]:
    """Whole slots of a period for each weight, by largest remainder, ``period`` in all; each weight is worth a slot at least."""
    total = math.fsum(weights.values())
    exact = {k: w * period / total for k, w in weights.items()}
    out = {k: max(1, math.floor(x)) for k, x in exact.items()}
    left = period - sum(out.values())
    for k in sorted(exact, key=lambda k: (out[k] - exact[k], k))[: max(left, 0)]:
        out[k] += 1
    for k in sorted(out, key=lambda k: (-out[k], k))[: max(-left, 0)]:  # rounding of sums of weights just at a slot
        out[k] -= 1
    return out


def edf_pattern(share: dict[str, int], period: int) -> dict[str, list[int]]:
    """The slots of each source's blocks within one period, by earliest deadline first."""
    coming = [(0, -(-period // q), k, 1) for k, q in share.items()]  # release, deadline, source, block
    heapq.heapify(coming)
    ready: list[tuple[int, str, int]] = []
    out: dict[str, list[int]] = {k: [] for k in share}
    for slot in range(period):
        while coming and coming[0][0] <= slot:
            _, deadline, key, block = heapq.heappop(coming)
            heapq.heappush(ready, (deadline, key, block))
        _, key, block = heapq.heappop(ready)
        out[key].append(slot)
        if (q := share[key]) > block:
            heapq.heappush(coming, (block * period // q, -(-(block + 1) * period // q), key, block + 1))
    return out


def _plan(spark: SparkSession, counts: dict[str, int], weights: dict[str, float], period: int) -> DataFrame:
    """One row for each planned source: its slots in a period, and the bits of its buckets. At most ``period`` rows and slots in all."""
    rows = []
    if counts:
        share = shares({k: weights[k] for k in counts}, period)
        pattern = edf_pattern(share, period)
        rows = [
            {"key": k, "period": period, "offsets": pattern[k], "bits": max(0, math.ceil(math.log2(n / BUCKET_ROWS)))}
            for k, n in sorted(counts.items())
        ]
    schema = "array<struct<key:string,period:int,offsets:array<int>,bits:int>>"
    return spark.range(1).select(
        F.explode(F.from_json(F.lit(json.dumps(rows)), schema)).alias("p")
    ).select(*(F.col(f"p.{c}").alias(f"__mx_plan_{c}") for c in ("key", "period", "offsets", "bits")))


def _tree(rest: DataFrame, n_rest: int, w_rest: float, top: tuple[int, int]) -> DataFrame:
    """For each small source (key, count, w): the bits of its buckets, and the weights on its way from its leaf to the root and to the whole mix.

    ``top`` has the whole weights of the mix and of the small sources in it.

    Sources are numbered by falling weight (in classes of a fifth); the node of a source at depth d is its number modulo 2^d.
    """
    dealt = rest.select(
        F.col("key").alias("__mx_member"),
        F.greatest(F.lit(0), F.ceil(F.log2(F.col("count") / BUCKET_ROWS))).cast("int").alias("__mx_plan_bits"),
        F.greatest(F.lit(1), F.round(F.col("w") / w_rest * WHOLE)).cast("long").alias("w"),
        F.floor(F.log2("w") * -4).alias("class"),
        F.shiftrightunsigned(F.xxhash64("key"), 52).alias("part"),
    )
    before = (
        dealt.groupBy("class", "part")
        .agg(F.count(F.lit(1)).alias("n"))
        .withColumn("before", F.coalesce(F.sum("n").over(Window.orderBy("class", "part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
        .drop("n")
    )  # at most 4,096 rows of each class
    nr = F.row_number().over(Window.partitionBy("class", "part").orderBy("__mx_member"))
    numbered = dealt.withColumn("nr", nr).join(before, ["class", "part"]).withColumn("nr", F.col("nr") - 1 + F.col("before"))
    depth = max(1, (n_rest - 1).bit_length())
    at = numbered.select("__mx_member", "__mx_plan_bits", "nr", "w", F.explode(F.sequence(F.lit(0), F.lit(depth))).alias("d")).withColumn(
        "node", F.expr("nr % shiftleft(1L, d)")
    )
    sums = at.groupBy("d", "node").agg(F.sum("w").alias("own"))
    way = at.join(sums, ["d", "node"]).groupBy("__mx_member", "__mx_plan_bits", "nr").agg(
        F.sort_array(F.collect_list(F.struct("d", "own"))).alias("s")
    )
    step = "named_struct('n', cast(s[d - 1].own AS decimal(19,0)), 'own', cast(s[d].own AS decimal(19,0)), 'right', shiftright(nr, d - 1) % 2 = 1)"
    steps = F.expr(f"transform(sequence({depth}, 1, -1), d -> {step})")
    last = F.expr(f"array(named_struct('n', cast({top[0]} AS decimal(19,0)), 'own', cast({top[1]} AS decimal(19,0)), 'right', true))")
    return way.select("__mx_member", "__mx_plan_bits", F.concat(steps, last).alias("__mx_way"))


#: The slot of a small source's block: up the tree, then among the planned ones.
_UP = """aggregate(__mx_way, __mx_own, (b, x) -> CASE WHEN x.right
  THEN (cast(b + 1 AS decimal(19,0)) * x.n + x.own - 1) div x.own - 1 ELSE (cast(b AS decimal(19,0)) * x.n) div x.own END)"""


def _numbered(hashed: DataFrame) -> DataFrame:
    """``hashed`` with each row's place in the hash order of its source, from 0."""
    bucketed = hashed.withColumn(
        _BUCKET, F.when(F.col("__mx_plan_bits") == 0, F.lit(0).cast("long")).otherwise(F.expr(f"shiftrightunsigned({_HASH}, 64 - __mx_plan_bits)"))
    )
    before = (
        bucketed.groupBy(_KEY, _BUCKET)
        .agg(F.count(F.lit(1)).alias("__mx_n"))
        .withColumn("__mx_before", F.sum("__mx_n").over(Window.partitionBy(_KEY).orderBy(_BUCKET).rowsBetween(Window.unboundedPreceding, -1)))
        .select(_KEY, _BUCKET, F.coalesce("__mx_before", F.lit(0)).alias("__mx_before"))
    )
    nr = F.row_number().over(Window.partitionBy(_KEY, _BUCKET).orderBy(_HASH, _TIE))
    return bucketed.withColumn("__mx_nr", nr).join(before, [_KEY, _BUCKET]).withColumn("__mx_at", F.col("__mx_before") + F.col("__mx_nr") - 1)


def mix_sources(
    docs: DataFrame,
    weights: dict[str, float] | None = None,
    alpha: float = 0.5,
    block_rows: int = 64,
    period: int = PERIOD,
    id_col: str = "doc_id",
    text: str = "text",
    source: str = "source",
) -> DataFrame:
    """``docs`` with mix_slot (long) and mix_index (int); the mix is their order.

    ``weights`` gives the target weights of sources; those not named get the least named weight. Without it the
    weights are the sources' row counts to the power ``alpha``.
    """
    spark = docs.sparkSession
    others = [c for c in docs.columns if c.lower() not in {"mix_slot", "mix_index"}]
    raw = F.coalesce(F.col(source).cast("string"), F.lit(NULL_KEY))
    sizes = docs.groupBy(raw.alias("key")).count()
    if weights:
        least = min(w for w in weights.values() if w > 0)
        given = spark.range(1).select(F.explode(F.from_json(F.lit(json.dumps(weights)), "map<string,double>")).alias("key", "w"))
        sizes = sizes.join(F.broadcast(given), "key", "left").withColumn("w", F.greatest(F.coalesce("w", F.lit(float(least))), F.lit(least * 1e-6)))
    else:
        sizes = sizes.withColumn("w", F.pow(F.col("count").cast("double"), F.lit(float(alpha))))
    n_all, w_all = sizes.agg(F.count(F.lit(1)), F.sum("w")).first()
    # Weights worth a slot of the period: ``period`` of them at most.
    planned = sizes.where(F.col("w") * period >= F.lit(w_all or 0.0)).limit(period).collect()
    counts = {r["key"]: r["count"] for r in planned}
    plan = _plan(spark, counts, {r["key"]: r["w"] for r in planned}, period)

    hashed = docs.select(
        *others,
        raw.alias(_KEY),
        F.xxhash64(F.col(id_col).cast("string"), F.lit("order")).alias(_HASH),
        F.xxhash64(F.col(text)).alias(_TIE),
    )
    at = F.col("__mx_at")
    share = F.size("__mx_plan_offsets")
    block = F.floor(at / block_rows).cast("long")
    slot = F.floor(block / share).cast("long") * F.col("__mx_plan_period") + F.get(F.col("__mx_plan_offsets"), (block % share).cast("int"))
    index = (at % block_rows).cast("int").alias("mix_index")
    # The slots are joined after the shuffle, so that rows do not carry them through it.
    bits = plan.select("__mx_plan_key", "__mx_plan_bits")
    slots = plan.select(F.col("__mx_plan_key").alias("__mx_slots_key"), "__mx_plan_period", "__mx_plan_offsets")
    numbered = _numbered(hashed.join(F.broadcast(bits), F.col(_KEY) == F.col("__mx_plan_key")))
    placed = numbered.join(F.broadcast(slots), F.col(_KEY) == F.col("__mx_slots_key"))
    if n_all == len(counts):
        return placed.select(*others, slot.cast("long").alias("mix_slot"), index)
    rest = sizes.join(F.broadcast(plan.select(F.col("__mx_plan_key").alias("key"))), "key", "left_anti")
    n_rest, w_rest = rest.agg(F.count(F.lit(1)), F.sum("w")).first()
    small = min(max(1, round(max(w_rest / w_all, LEAST_SHARE) * WHOLE)), WHOLE - (1 if counts else 0))
    big = WHOLE - small
    tree = _tree(rest, n_rest, w_rest, (WHOLE, small))
    inner = _numbered(hashed.join(tree, F.col(_KEY) == F.col("__mx_member"))).withColumn("__mx_own", block)
    out = inner.select(*others, F.expr(_UP).cast("long").alias("mix_slot"), index)
    if counts:
        among = F.expr(f"cast(cast(__mx_slot AS decimal(19,0)) * cast({WHOLE} AS decimal(19,0)) div cast({big} AS decimal(19,0)) AS long)")
        out = placed.withColumn("__mx_slot", slot.cast("long")).select(*others, among.alias("mix_slot"), index).unionByName(out)
    return out


def in_order(mixed: DataFrame, slots_each: int = 256) -> DataFrame:
    """The rows laid out in mix order: partition p holds the p-th run of ``slots_each`` slots, sorted.

    The partition is known from the slot, so nothing is sampled, and a partition has a bounded number of rows. Where small weights leave most slots
    empty, the bounds of partitions are sampled instead.
    """
    last, n = mixed.agg(F.max("mix_slot"), F.count(F.lit(1))).first()
    parts = (last or 0) // slots_each + 1
    few = n // (16 * slots_each) + 1
    if parts <= 4 * few:
        placed = mixed.repartitionById(parts, F.floor(F.col("mix_slot") / slots_each).cast("int"))
    else:
        placed = mixed.repartitionByRange(max(1, n // (64 * slots_each)), "mix_slot")
    return placed.sortWithinPartitions("mix_slot", "mix_index").drop("mix_slot", "mix_index")
