"""Plan builders that the operators are composed of: islands, as-of, range join, sweep, fold, budgets.

All are lazy and take explicit keys and orders. Windows are by key, so a key's rows meet in one task, sorted and spilled as need be;
folds come last and only over islands that stateless breaks have cut.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def islands(df: DataFrame, flag: Column, keys: list[str], order: list[str], name: str = "island") -> DataFrame:
    """df with the number of the island (from 0) that each row belongs to; flag marks an island's first row."""
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    first = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(name, F.sum(F.when(F.row_number().over(first) == 1, 0).otherwise(F.when(F.coalesce(flag, F.lit(False)), 1).otherwise(0))).over(w).cast("long"))


def as_of(left: DataFrame, right: DataFrame, keys: list[str], at: str, start: str, values: list[str], forward: bool = False) -> DataFrame:
    """left with the values of the last row of right with start <= at (forward: the first with start >= at); null if there is none.

    One shuffle by key: both sides are united, sorted by time, and the last value is carried along.
    """
    data = F.struct(*[F.col(v) for v in [start, *values]])
    rows = left.withColumns({"__t": F.col(at), "__side": F.lit(-1 if forward else 1), "__v": F.lit(None).cast(right.select(data.alias("v")).schema["v"].dataType)})
    other = right.select(*keys, F.col(start).alias("__t"), F.lit(0).alias("__side"), data.alias("__v"))
    both = rows.unionByName(other, allowMissingColumns=True)
    # forward goes through the rows in reverse: a frame up to the end would be held, and gone through again for each row
    order = [F.desc("__t"), F.desc("__side")] if forward else ["__t", "__side"]
    found = F.last("__v", ignorenulls=True).over(Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    out = both.withColumn("__f", found).filter("__side <> 0")
    return out.select(*left.columns, *[F.col(f"__f.{v}").alias(f"right_{v}") for v in [start, *values]])


def range_join(a: DataFrame, b: DataFrame, keys: list[str], a_span: tuple[str, str], b_span: tuple[str, str], width: int) -> DataFrame:
    """Pairs of rows whose half-open intervals overlap, each once. Intervals go to buckets of `width`; an overlapping pair is
    taken in the bucket where its overlap begins, so no distinct is needed. Other columns must have different names."""
    buckets = lambda s, e: F.explode(F.sequence(F.expr(f"{s} div {width}"), F.expr(f"greatest({s}, {e} - 1) div {width}")))
    left = a.withColumn("__b", buckets(*a_span))
    right = b.withColumn("__b", buckets(*b_span))
    same = [left[k] == right[k] for k in keys]
    met = left.join(right, [*same, left["__b"] == right["__b"], F.col(a_span[0]) < F.col(b_span[1]), F.col(b_span[0]) < F.col(a_span[1]), F.expr(f"greatest({a_span[0]}, {b_span[0]}) div {width}") == left["__b"]])
    for k in keys:
        met = met.drop(right[k])
    return met.drop("__b")


def merged(df: DataFrame, keys: list[str], start: str = "start_ms", end: str = "end_ms", touching: bool = True) -> DataFrame:
    """The union of intervals of each key as disjoint intervals; touching ones become one, or not."""
    w = Window.partitionBy(*keys).orderBy(start, end)
    before = F.max(end).over(w.rowsBetween(Window.unboundedPreceding, -1))
    apart = (F.col(start) > before) if touching else (F.col(start) >= before)
    marked = islands(df.select(*keys, start, end).filter(F.col(start) < F.col(end)), apart, keys, [start, end])
    return marked.groupBy(*keys, "island").agg(F.min(start).alias(start), F.max(end).alias(end), F.count("*").alias("members"))


def sweep(sets: dict[str, DataFrame], keys: list[str], start: str = "start_ms", end: str = "end_ms") -> DataFrame:
    """Elementary segments between all interval ends of each key, with the number of open intervals of each set (n_<set>)."""
    edges = None
    for name, df in sets.items():
        part = df.filter(F.col(start) < F.col(end)).select(*keys, F.explode(F.array(F.struct(F.col(start).alias("t"), F.lit(1).alias("d")), F.struct(F.col(end).alias("t"), F.lit(-1).alias("d")))).alias("x"))
        part = part.select(*keys, "x.t", *[(F.col("x.d") if n == name else F.lit(0)).alias(f"d_{n}") for n in sets])
        edges = part if edges is None else edges.unionByName(part)
    edges = edges.groupBy(*keys, "t").agg(*[F.sum(f"d_{n}").alias(f"d_{n}") for n in sets])
    w = Window.partitionBy(*keys).orderBy("t")
    out = edges.withColumns({f"n_{n}": F.sum(f"d_{n}").over(w.rowsBetween(Window.unboundedPreceding, 0)) for n in sets} | {"t_end": F.lead("t").over(w)})
    return out.filter("t_end is not null").select(*keys, F.col("t").alias(start), F.col("t_end").alias(end), *[f"n_{n}" for n in sets])


def fold(df: DataFrame, keys: list[str], order: list[str], columns: list[str], step: Callable, name: str = "group") -> DataFrame:
    """df with a group number decided row after row: step(state, row) -> (state, opens), state None at the start of a key.

    For rules whose state depends on their own last decision, which no window expresses. Rows are dealt by key and sorted, and a task streams its keys one after
    the other with the state of one of them, so neither the number of keys nor the length of one counts.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, state, group = None, None, -1
        for batch in batches:
            out = []
            for key, row in zip(zip(*(batch.column(k).to_pylist() for k in keys)), zip(*(batch.column(c).to_pylist() for c in columns))):
                if key != last:
                    last, state, group = key, None, -1
                state, opens = step(state, row)
                group += opens
                out.append(group)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.int64())], names=[*batch.schema.names, name])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema) + f", `{name}` long"
    return df.repartition(*keys).sortWithinPartitions(*keys, *order).mapInArrow(run, schema)


def trail(df: DataFrame, keys: list[str], order: list[str], columns: list[str], step: Callable, outputs: dict[str, str], tasks: int | None = None) -> DataFrame:
    """df with what a fold leaves after each row: step(state, row) -> (state, values of the outputs), state None at the start of a key. As fold, it streams its keys with one state; `tasks` says in how many tasks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, state = None, None
        for batch in batches:
            out = []
            for key, row in zip(zip(*(batch.column(k).to_pylist() for k in keys)), zip(*(batch.column(c).to_pylist() for c in columns))):
                state, values = step(None if key != last else state, row)
                last = key
                out.append(values)
            more = [pa.array(list(v), t) for v, t in zip(zip(*out) if out else [()] * len(types), types)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *more], names=[*batch.schema.names, *outputs])

    types = [{"long": pa.int64(), "boolean": pa.bool_(), "double": pa.float64(), "string": pa.string()}[t] for t in outputs.values()]
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema), *(f"`{n}` {t}" for n, t in outputs.items())])
    dealt = df.repartition(tasks, *keys) if tasks else df.repartition(*keys)
    return dealt.sortWithinPartitions(*keys, *order).mapInArrow(run, schema)


def page(df: DataFrame, keys: list[str], order: list[Column | str], cursor: int, limit: int) -> DataFrame:
    """Rows cursor+1 to cursor+limit of each key in a total order."""
    if not 1 <= limit <= 1000 or cursor < 0:
        raise ValueError("limit must be 1 to 1000 and cursor 0 or more")
    n = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("position", n.cast("long")).filter((F.col("position") > cursor) & (F.col("position") <= cursor + limit))
