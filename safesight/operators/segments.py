"""Running values over long sequences in blocks: what earlier rows of a key hand on, without one key's rows in one task.

A window sees one block of a key's rows. Per block an aggregate is taken, a window over
the blocks (a row each) carries it on, and it is joined back to the rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from safesight.lineage import cut, large


def spans(rows: DataFrame, keys: list[str]) -> bool:
    """Whether a key has rows in several blocks (a column ``block``)."""
    first, last = rows.agg(F.min("block"), F.max("block")).first()
    if first == last:
        return False
    return not rows.groupBy(*keys).agg((F.min("block") < F.max("block")).alias("several")).where("several").isEmpty()


def carried(rows: DataFrame, keys: list[str], at: str, name: str, value: Column, how: str, inclusive: bool, several: bool) -> DataFrame:
    """rows with a column: value over all rows of the key up to this one in order of at (itself too, if inclusive).

    how: "last" value that isn't null, "max" or "sum". Blocks must follow one another in
    order of at; several: spans(rows, keys), without which nothing has to be handed on. Keys are not null.
    """
    within = Window.partitionBy(*keys, "block").orderBy(at).rowsBetween(Window.unboundedPreceding, 0 if inclusive else -1)
    combine = {"last": lambda c: F.last(c, ignorenulls=True), "max": F.max, "sum": F.sum}[how]
    if not several:
        own = combine(value).over(within)
        return rows.withColumn(name, F.coalesce(own, F.lit(0)) if how == "sum" else own)
    total = F.max_by(value, F.when(value.isNotNull(), F.col(at))) if how == "last" else combine(value)
    earlier = Window.partitionBy(*keys).orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    # cut after its window, too, so that a join deals it like the rows and not the rows like it
    before = cut(cut(rows.groupBy(*keys, "block").agg(total.alias("_total"))).withColumn("_before", combine(F.col("_total")).over(earlier)).drop("_total"))
    own = rows.withColumn("_own", combine(value).over(within)).join(large(before), [*keys, "block"])
    both = {"last": F.coalesce("_own", "_before"), "max": F.greatest("_own", "_before"), "sum": F.coalesce("_own", F.lit(0)) + F.coalesce("_before", F.lit(0))}[how]
    return own.withColumn(name, both).drop("_own", "_before")
