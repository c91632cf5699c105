"""Near-duplicate documents by SimHash fingerprints and pigeonhole blocks."""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from harrow.operators.linkage import connected_groups
from harrow.session import cut_lineage

BITS = 64
SEED = 42


def fingerprint(text: str | None, words_per_shingle: int = 3) -> int:
    """SimHash of a text: bit b is set if it is set in more than half the shingles' hashes.

    Shingles are counted as often as they occur; a text with fewer words is one
    shingle, one without words has fingerprint 0.
    """
    words = (text or "").encode().lower().split()  # on bytes both know ASCII only
    if not words:
        return 0
    joined = b" ".join(words)
    lengths = np.fromiter(map(len, words), np.int64, len(words)) + 1
    ends = np.cumsum(lengths) - 1
    starts = (ends - lengths + 1).tolist()
    ends = ends.tolist()
    k = min(words_per_shingle, len(words))
    digest = xxhash.xxh64_digest
    raw = b"".join([digest(joined[a:b], SEED) for a, b in zip(starts, ends[k - 1 :])])
    values = np.frombuffer(raw, ">u8")
    counts = bit_counts(values)
    set_bits = counts * 2 > len(values)
    return int(sum(1 << b for b in np.flatnonzero(set_bits).tolist()))


def bit_counts(values: np.ndarray) -> np.ndarray:
    """How often each of the 64 bits is set; eight byte counters are added up in one word."""
    rows = 255  # a byte counter's limit
    padded = np.zeros(-(-len(values) // rows) * rows, np.uint64)
    padded[: len(values)] = values
    table = padded.reshape(-1, rows)
    ones = np.uint64(0x0101010101010101)
    counts = np.zeros(BITS, np.int64)
    for bit in range(8):
        lanes = ((table >> np.uint64(bit)) & ones).sum(axis=1, dtype=np.uint64)
        counts[bit::8] = lanes.astype("<u8").view(np.uint8).reshape(-1, 8).sum(axis=0)
    return counts


def with_fingerprint(docs: DataFrame, text_column: str = "text", out: str = "fingerprint", words_per_shingle: int = 3) -> DataFrame:
    """``docs`` with the fingerprint of each text as a signed 64-bit number."""

    @F.pandas_udf("long")
    def signed(texts: pd.Series) -> pd.Series:
        found = np.fromiter((fingerprint(t, words_per_shingle) for t in texts), np.uint64, len(texts))
        return pd.Series(found.astype(np.int64))

    return docs.withColumn(out, signed(F.col(text_column)))


def hex_digits(value: Column) -> Column:
    return F.lower(F.lpad(F.hex(value), 16, "0"))


def block_keys(value: Column, differing: int, blocks: int) -> Column:
    """The keys a fingerprint is looked up by: ``blocks - differing`` whole blocks of bits.

    Two fingerprints that differ in at most ``differing`` bits differ in at most so
    many blocks, so they agree on all the others together and share that key.
    """
    edges = [BITS * i // blocks for i in range(blocks + 1)]
    keys = []
    for i, chosen in enumerate(combinations(range(blocks), blocks - differing)):
        mask = sum(((1 << (edges[b + 1] - edges[b])) - 1) << edges[b] for b in chosen)
        mask -= (1 << BITS) if mask >= 1 << (BITS - 1) else 0
        keys.append(F.struct(F.lit(i).alias("place"), value.bitwiseAND(F.lit(mask).cast("long")).alias("bits")))
    return F.array(*keys)


def fingerprint_links(prints: DataFrame, differing: int = 2, blocks: int = 4, largest: int = 50) -> DataFrame:
    """(a, b): links that connect exactly the distinct fingerprints ``fp`` at most ``differing`` bits apart.

    Fingerprints are joined on their block keys and the pairs verified. A key with
    more than ``largest`` fingerprints gives no pairs. Its fingerprints meet in their
    variants instead: two of them are at most two bits apart exactly if flipping at
    most one bit of each gives a common value, and a value has no more than 65 such
    origins, each linked with the least of them. Nothing is left out either way.
    """
    if differing != 2:
        raise ValueError("variants are for two differing bits")
    keyed = cut_lineage(prints.select("fp", F.inline(block_keys(F.col("fp"), differing, blocks))))
    sizes = keyed.groupBy("place", "bits").agg(F.count("*").alias("n")).where(F.col("n") > 1)
    met = keyed.join(sizes, ["place", "bits"])
    few = met.where(F.col("n") <= largest)
    left = few.select("place", "bits", F.col("fp").alias("a"))
    right = few.select("place", "bits", F.col("fp").alias("b"))
    close = F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= differing
    pairs = left.join(right, (left["place"] == right["place"]) & (left["bits"] == right["bits"]) & (left["a"] < right["b"]) & close)
    flips = F.array(F.lit(0).cast("long"), *[F.lit((1 << b) - (1 << BITS if b == BITS - 1 else 0)).cast("long") for b in range(BITS)])
    many = met.where(F.col("n") > largest).select("fp").distinct()
    variants = many.select("fp", F.explode(flips).alias("flip")).select("fp", F.col("fp").bitwiseXOR(F.col("flip")).alias("variant"))
    least = variants.groupBy("variant").agg(F.min("fp").alias("least"), F.count("*").alias("n")).where(F.col("n") > 1)
    stars = variants.join(least, "variant").where(F.col("fp") != F.col("least"))
    return pairs.select("a", "b").unionByName(stars.select(F.col("least").alias("a"), F.col("fp").alias("b"))).distinct()


def near_duplicates(
    docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", differing: int = 2, blocks: int = 4, words_per_shingle: int = 3
) -> DataFrame:
    """(id, fingerprint, component_id, text_hash): each row with the smallest id that links reach from it.

    Fingerprints link at ``differing`` or fewer differing bits. ``text_hash`` tells
    rows of the same id apart. Null and empty texts have fingerprint 0 and link like
    others; null ids are members but never the smallest, so a component of null ids
    only has a null component id. Repeated rows get equal results. An empty table gives
    no rows. Other columns are not read.

    Links are sought among distinct fingerprints, so exact copies cost nothing beyond
    one row; a fingerprint or block shared by any number of rows is never gathered.
    """
    rows = with_fingerprint(docs.select(F.col(id_column).alias("id"), F.col(text_column).alias("text")), "text", "fp", words_per_shingle)
    rows = cut_lineage(rows.select("id", "fp", F.xxhash64("text").alias("text_hash")))
    prints = rows.groupBy("fp").agg(F.min("id").alias("least"))
    links = fingerprint_links(prints.select("fp"), differing, blocks)
    groups = connected_groups(prints.select("fp"), links, node="fp")
    named = prints.join(groups, "fp")
    smallest = named.groupBy("group").agg(F.min("least").alias("component_id"))
    named = named.join(smallest, "group").select(F.col("fp").alias("__fp"), "component_id")
    return rows.join(named, F.col("fp") == F.col("__fp")).select(
        F.col("id").alias(id_column), hex_digits(F.col("fp")).alias("fingerprint"), "component_id", "text_hash"
    )


def one_of_each_group(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", **options) -> DataFrame:
    """The row with the smallest id of each component, in the columns of ``docs``.

    Of a component without ids, and of rows with the same id, the one with the least
    text hash stays; of rows also equal in text, any one.
    """
    found = near_duplicates(docs, id_column, text_column, **options)
    # components of null ids have no component id: they go by fingerprint
    keys = (F.col("component_id"), F.when(F.col("component_id").isNull(), F.col("fingerprint")))
    chosen = found.groupBy(*[k.alias(f"k{i}") for i, k in enumerate(keys)]).agg(
        F.min(F.struct(F.col(id_column).isNull().alias("none"), F.col(id_column).alias("id"), "text_hash")).alias("first")
    )
    none = F.lit(-(1 << 63)).cast("long")
    chosen = chosen.select(F.coalesce(F.col("first.id"), none).alias("__sim_id"), F.col("first.text_hash").alias("__sim_hash")).distinct()
    rows = docs.withColumns({"__sim_id": F.coalesce(F.col(id_column), none), "__sim_hash": F.xxhash64(F.col(text_column))})
    kept = rows.join(chosen, ["__sim_id", "__sim_hash"], "left_semi")
    return kept.dropDuplicates(["__sim_id", "__sim_hash"]).select(*docs.columns)
