"""What several of the text operators share."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Words are maximal runs of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


def text_or_empty(column: str | Column) -> Column:
    return F.coalesce(column if isinstance(column, Column) else F.col(column), F.lit(""))


def without(df: DataFrame, names: Sequence[str]) -> DataFrame:
    """``df`` less the columns that a result column would clash with (any letter case)."""
    taken = {n.lower() for n in names}
    return df.drop(*[c for c in df.columns if c.lower() in taken])


def leading_bits(digest: Column, parts: int) -> Column:
    """Part 0 to ``parts - 1`` by the first 32 bits of a hexadecimal digest.

    Parts rise with the digest, so the order inside the parts continues across them.
    """
    first = F.conv(F.substring(digest, 1, 8), 16, 10).cast("long")
    return F.floor(first * F.lit(parts) / F.lit(1 << 32)).cast("int")


def parts_for(rows: int, rows_per_part: int) -> int:
    return max(1, -(-rows // rows_per_part))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is worked out once.

    An expression used inside a lambda is otherwise worked out for each element.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))


def running(values: Column, step: Callable[[Column, Column], Column], start: Column, block: int = 256) -> Column:
    """For each element of an array, ``step`` over ``start`` and all elements before it.

    ``step`` is associative with ``start`` as its neutral element. Work is done by
    blocks, so time is near linear in the array's length.
    """
    def of_blocks(v: Column) -> Column:
        starts = F.sequence(F.lit(1), F.greatest(F.size(v), F.lit(1)), F.lit(block))
        return F.aggregate(
            F.transform(starts, lambda a: F.aggregate(F.slice(v, a, F.lit(block)), start, step)),
            F.array(start),
            lambda done, x: F.concat(done, F.array(step(F.element_at(done, -1), x))),
        )

    def place(v: Column, base: Column) -> Column:
        def one(_, i):
            inside = i % block
            return F.aggregate(F.slice(v, i - inside + 1, inside), F.get(base, ((i - inside) / block).cast("int")), step)

        return F.transform(v, one)

    return let(values, lambda v: let(of_blocks(v), lambda base: place(v, base)))
