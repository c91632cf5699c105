"""Shards of near equal bytes: minimax contiguous partition of groups of equal texts."""

from __future__ import annotations

from bisect import bisect_left, bisect_right

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from harrow.llm.common import leading_bits, parts_for, text_or_empty
from harrow.session import cut_lineage

#: Bytes that a document takes besides its text.
OVERHEAD = 16
#: Parts whose sums are added up in one window.
PARTS_IN_BLOCK = 4096


def shard_documents(
    docs: DataFrame,
    id_column: str = "doc_id",
    text_column: str = "text",
    shards: int = 40,
    cells: int = 512,
    rows_per_part: int = 10_000,
) -> DataFrame:
    """(id, size, text_crc32, shard, slot): each row's shard and place in it.

    Size is the UTF-8 bytes of the text plus 16. Rows of equal text form an atomic
    group; groups are ordered by the SHA-256 of their text. Groups larger than an
    equal share get a shard of their own (largest first); the ordered rest is cut
    into contiguous shards of the smallest capacity that suffices, found by binary
    search with a greedy check. Slots run from 0 without gaps in each shard.

    Null and empty texts are one group of size 16 a row. Null ids and repeated rows
    keep their rows, each with a slot of its own. An empty table gives no rows. Other
    columns are not read, so their names cannot clash.

    A group of any size spreads over parts of about ``rows_per_part`` rows; the
    driver sees at most ``shards`` groups and, each round, ``cells`` summaries a shard, or
    8 times ``shards`` if that is more.
    """
    text = text_or_empty(text_column)
    rows = cut_lineage(
        docs.select(
            F.col(id_column).alias("id"),
            (F.octet_length(text) + F.lit(OVERHEAD)).cast("long").alias("size"),
            F.crc32(text.cast("binary")).alias("crc"),
            F.sha2(text.cast("binary"), 256).alias("key"),
        )
    )
    parts = parts_for(rows.count(), rows_per_part)
    salted = rows.withColumn("salt", leading_bits(F.sha2(F.coalesce(F.col("id").cast("string"), F.lit("")).cast("binary"), 256), parts))
    in_part = salted.groupBy("key", "salt").agg(F.count("*").alias("rows"), F.sum("size").alias("bytes"))
    before = Window.partitionBy("key").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    in_part = cut_lineage(in_part.withColumn("part_base", F.coalesce(F.sum("rows").over(before), F.lit(0))))
    groups = in_part.groupBy("key").agg(F.sum("rows").alias("rows"), F.sum("bytes").alias("bytes"))
    alone = _alone(groups, shards)
    placed = _prefix_sums(groups, alone, parts)
    ends = smallest_capacity_cuts(placed, shards - len(alone), cells)
    # an own shard's number follows the contiguous ones
    own = F.create_map(*[F.lit(x) for i, k in enumerate(alone) for x in (k, shards - len(alone) + i)]) if alone else None
    shard = F.size(F.filter(F.array(*[F.lit(e) for e in ends]).cast("array<bigint>"), lambda e: e < F.col("upto")))
    shard = F.coalesce(own[F.col("key")], shard) if alone else shard
    placed = placed.withColumn("shard", shard.cast("int"))
    first = placed.groupBy("shard").agg(F.min("rows_before").alias("shard_base"))
    placed = placed.join(first, "shard").select(
        "key", "shard", F.when(F.col("key").isin(alone), F.lit(0)).otherwise(F.col("rows_before") - F.col("shard_base")).alias("group_base")
    )
    bases = in_part.join(placed, "key").select("key", "salt", "shard", (F.col("group_base") + F.col("part_base")).alias("base"))
    inside = Window.partitionBy("key", "salt").orderBy("id")
    return salted.join(bases, ["key", "salt"]).select(
        F.col("id").alias(id_column),
        "size",
        F.col("crc").alias("text_crc32"),
        "shard",
        (F.col("base") + F.row_number().over(inside) - 1).alias("slot"),
    )


def _alone(groups: DataFrame, shards: int) -> list[str]:
    """Keys of groups that exceed an equal share of what the other shards hold; fewer than ``shards``."""
    total = groups.agg(F.sum("bytes")).first()[0] or 0
    keys: list[str] = []
    for key, size in groups.orderBy(F.desc("bytes"), "key").select("key", "bytes").limit(shards - 1).collect():
        if size * (shards - len(keys)) <= total:
            break
        keys.append(key)
        total -= size
    return keys


def _prefix_sums(groups: DataFrame, alone: list[str], parts: int) -> DataFrame:
    """Each group's inclusive byte sum and the rows before it, in key order; groups of ``alone`` weigh nothing."""
    counted = ~F.col("key").isin(alone)
    weighed = groups.select(
        "key",
        leading_bits(F.col("key"), parts).alias("part"),
        F.when(counted, F.col("bytes")).otherwise(0).alias("bytes"),
        F.when(counted, F.col("rows")).otherwise(0).alias("rows"),
    )
    # sums before a part: those before its block of parts, of which there are few, and those inside
    block = (F.col("part") / PARTS_IN_BLOCK).cast("int")
    totals = weighed.groupBy("part").agg(F.sum("bytes").alias("b"), F.sum("rows").alias("r")).withColumn("block", block)
    blocks = totals.groupBy("block").agg(F.sum("b").alias("bb"), F.sum("r").alias("rr"))
    earlier = Window.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    inside = Window.partitionBy("block").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    none = F.lit(0)
    blocks = blocks.select("block", *[F.coalesce(F.sum(c).over(earlier), none).alias(c) for c in ("bb", "rr")])
    totals = totals.select("part", "block", *[F.coalesce(F.sum(c).over(inside), none).alias(c) for c in ("b", "r")]).join(blocks, "block")
    totals = totals.select("part", (F.col("b") + F.col("bb")).alias("part_bytes"), (F.col("r") + F.col("rr")).alias("part_rows"))
    here = Window.partitionBy("part").orderBy("key").rowsBetween(Window.unboundedPreceding, 0)
    return cut_lineage(
        weighed.join(totals, "part").select(
            "key",
            (F.col("part_bytes") + F.sum("bytes").over(here)).alias("upto"),
            (F.col("part_rows") + F.sum("rows").over(here) - F.col("rows")).alias("rows_before"),
        )
    )


def smallest_capacity_cuts(prefix: DataFrame, shards: int, cells: int = 512, column: str = "upto") -> list[int]:
    """Ends of the first ``shards - 1`` contiguous shards under the smallest feasible capacity.

    ``prefix`` holds the inclusive prefix sums, which stay distributed. Each round
    summarises the stretches of the sums in which a cut may lie by the least and
    greatest sum in equal cells. The greedy check run on the summary brackets every
    cut, and capacities certain either way bound the binary search. The next round's
    stretches lie between the brackets. Of the cuts that keep to the capacity, those up
    to equal shares are taken.

    All stretches of a round share ``shards`` times ``cells`` cells of one width w, with
    ``cells`` at least 8 times ``shards``. A bracket is wrong by less than w a shard, and
    the capacity by a few w, so the stretches' length falls by a factor each round, to
    about a third at worst, until cells hold single sums; if it did not, that is an
    error. The driver holds two numbers for each cell with a sum in it.
    """
    top = prefix.agg(F.max(column)).first()[0] or 0
    if top == 0 or shards == 1:
        return [top] * (shards - 1)
    cells = shards * max(cells, 8 * shards)
    infeasible, feasible = (top - 1) // shards, top
    spans = [(0, top)]
    while True:
        known = Summary(prefix, spans, cells, column)
        # capacities up to `low` are certainly infeasible, from `high` on certainly feasible
        low = _search(infeasible, feasible, lambda c: known.greedy(c, shards)[-1][1] < top)
        high = _search(low, feasible, lambda c: known.greedy(c, shards)[-1][0] < top) + 1
        chain = known.greedy(high, shards)
        if high == low + 1 and all(a == b for a, b in chain):
            break
        infeasible, feasible = low, high
        spans = _narrowed(spans, [(a, b) for (a, _), (_, b) in zip(known.greedy(low + 1, shards), chain, strict=True)])
    spans = [(0, top)]
    while True:
        known = Summary(prefix, spans, cells, column)
        cuts = known.level(high, shards, top)
        if all(a == b for a, b in cuts):
            return [a for a, _ in cuts[:-1]]
        spans = _narrowed(spans, [*known.needed, *cuts])


def _narrowed(before: list[tuple[int, int]], spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The new stretches, which must be shorter together than those before."""
    after = _merged(spans)
    if _length(after) >= _length(before):
        raise RuntimeError("the search for cuts does not narrow")
    return after


def _length(spans: list[tuple[int, int]]) -> int:
    return sum(b - a + 1 for a, b in spans)


def _search(low: int, high: int, fails) -> int:
    """The largest value that fails, given that ``low`` does and ``high`` does not; ``fails`` is monotone."""
    while high - low > 1:
        middle = (low + high) // 2
        if fails(middle):
            low = middle
        else:
            high = middle
    return low


def _merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1] + 1:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


class Summary:
    """Least and greatest prefix sum of every non-empty cell of the disjoint spans; answers come as bounds.

    All spans are cut into cells of one width, so that about ``cells`` cover them together.
    """

    def __init__(self, prefix: DataFrame, spans: list[tuple[int, int]], cells: int, column: str):
        v = F.col(column)
        width = max(1, -(-_length(spans) // cells))
        # a few spans for each shard at most
        table = F.array(*[F.struct(F.lit(a).cast("long").alias("a"), F.lit(b).cast("long").alias("b")) for a, b in spans])
        within = F.filter(table, lambda s: (s["a"] <= v) & (v <= s["b"]))
        found = (
            prefix.select(v.alias("v"), F.get(within, F.lit(0)).alias("span"))
            .where(F.col("span").isNotNull())
            .groupBy(F.col("span.a").alias("a"), F.expr(f"(v - span.a) div {width}").alias("cell"))
            .agg(F.min("v").alias("least"), F.max("v").alias("most"))
            .collect()
        )
        pairs = sorted({(r["least"], r["most"]) for r in found} | {(0, 0)})
        self.least, self.most = [p[0] for p in pairs], [p[1] for p in pairs]
        self.needed: list[tuple[int, int]] = []

    def down(self, limit: int) -> tuple[int, int]:
        """Bounds of the greatest sum up to ``limit``."""
        i = bisect_right(self.least, limit) - 1
        return (self.most[i], self.most[i]) if self.most[i] <= limit else (self.least[i], limit)

    def up(self, limit: int) -> tuple[int, int]:
        """Bounds of the least sum from ``limit`` on."""
        i = bisect_left(self.most, limit)
        return (self.least[i], self.least[i]) if self.least[i] >= limit else (limit, self.most[i])

    def greedy(self, capacity: int, shards: int) -> list[tuple[int, int]]:
        """Bounds of the end of each shard when every shard takes all it can hold."""
        ends, low, high = [], 0, 0
        for _ in range(shards):
            low, high = self.down(low + capacity)[0], self.down(high + capacity)[1]
            ends.append((low, high))
        return ends

    def level(self, capacity: int, shards: int, top: int) -> list[tuple[int, int]]:
        """Bounds of the ends when each shard goes up to its equal share, or as far as the rest needs."""
        rest = [(top, top)]
        for _ in range(shards - 1):
            a, b = rest[-1]
            rest.append((self.up(max(0, a - capacity))[0], self.up(max(0, b - capacity))[1]))
        rest.reverse()
        self.needed = rest
        ends, low, high = [], 0, 0
        for i, (a, b) in enumerate(rest, 1):
            share = top * i // shards
            low = self.down(min(low + capacity, max(share, a)))[0]
            high = self.down(min(high + capacity, max(share, b)))[1]
            ends.append((low, high))
        return ends
