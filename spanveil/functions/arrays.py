"""Small array helpers that keep per-row work close to linear."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# A fold copies its state with every item.  Working in blocks bounds the copy to one
# block per item, and to one copy of all per block.
BLOCK = 128


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once and use it several times inside ``body``."""
    return F.transform(F.array(value), body).getItem(0)


def empty_array(element_type: str) -> Column:
    return F.array().cast(f"array<{element_type}>")


def stretch(items: Column, number: Column, size: int | Column) -> Column:
    """Block ``number`` of the items, taken one by one: ``slice`` would read the whole array."""
    last = F.least((number + 1) * size, F.size(items)) - 1
    return F.transform(F.sequence(number * size, last), lambda i: F.get(items, i))


def fold_array(
    items: Column,
    carry: Column,
    step: Callable[[Column, Column], tuple[Column, Column]],
    emit_type: str,
) -> Column:
    """Left fold that emits rows on the way.

    ``step(carry, item)`` returns (array of emitted rows, next carry).  The result
    is a struct ``carry, out``; ``items`` should be a bound variable (see ``let``).
    """
    none = empty_array(emit_type)
    last_block = F.floor((F.size(items) - 1) / BLOCK).cast("int")

    def one(state: Column, item: Column) -> Column:
        emitted, following = step(state["carry"], item)
        return F.struct(following.alias("carry"), F.concat(state["out"], emitted).alias("out"))

    def block(state: Column, number: Column) -> Column:
        # What earlier blocks gave stays out of the inner fold, which copies its state per item.
        inner = F.aggregate(
            stretch(items, number, BLOCK),
            F.struct(state["carry"].alias("carry"), none.alias("out")),
            one,
        )
        return let(
            inner,
            lambda s: F.struct(
                s["carry"].alias("carry"),
                F.concat(state["blocks"], F.array(s["out"])).alias("blocks"),
            ),
        )

    numbers = F.when(F.size(items) > 0, F.sequence(F.lit(0), last_block)).otherwise(
        empty_array("int")
    )
    return F.aggregate(
        numbers,
        F.struct(carry.alias("carry"),
                 F.array().cast(f"array<array<{emit_type}>>").alias("blocks")),
        block,
        lambda s: F.struct(s["carry"].alias("carry"), F.flatten(s["blocks"]).alias("out")),
    )


def running_total(numbers: Column) -> Column:
    """Inclusive running sum of an ``array<int>``."""
    def step(total: Column, number: Column) -> tuple[Column, Column]:
        following = total + number
        return F.array(following), following

    return let(
        numbers,
        lambda n: F.when(F.size(n) <= 1, n).otherwise(fold_array(n, F.lit(0), step, "int")["out"]),
    )
