"""Rules over many tables as data, checked in one pass of each table.

A table's catalogue says which identities a row has, which ones it needs, and what breaks it by itself. Every row gives its facts; needs then meet identities in one window over
(scope, space, key) for all rules of all tables, rather than in a join for each rule. Facts are many times the rows that they are of: either they are written once, or, where all tables are dealt by scope, they
stay in the tasks where they are made, and only rows were shuffled.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexiline.plans.shared import shared_folder

_FACT = "struct<role:string,rule:string,space:string,key:array<string>,value:string,after:string,rest:array<string>,lenient:boolean>"


@dataclass(frozen=True)
class Has:
    """A row has an identity in a space, with a value that can be looked up by it; one for each element x of an array where `each` names one. `unique` names the rule that a second row of that identity breaks.
    An identity with a null part is none."""

    space: str
    key: tuple[str, ...]
    when: str = "true"
    value: str = "null"
    unique: str | None = None
    each: str | None = None


@dataclass(frozen=True)
class Lacks:
    """A row breaks a rule if some row of its scope has an identity."""

    rule: str
    space: str
    key: tuple[str, ...]
    when: str = "true"


@dataclass(frozen=True)
class Needs:
    """A row needs an identity of its scope; of each element x of an array where `each` names one. Where `after` names a space, the value found must, followed by `rest`, be an identity there; if `lenient`, only that counts."""

    rule: str
    space: str
    key: tuple[str, ...]
    when: str = "true"
    each: str | None = None
    after: str | None = None
    rest: tuple[str, ...] = ()
    lenient: bool = False


@dataclass(frozen=True)
class Breaks:
    """A row breaks a rule by itself. A condition that is null doesn't hold."""

    rule: str
    when: str


def _texts(parts: tuple[str, ...]) -> str:
    return f"array({', '.join(f'cast({p} as string)' for p in parts)})" if parts else "cast(array() as array<string>)"


def _fact(role: str, rule: str | None, space: str = "", key: tuple[str, ...] = (), value: str = "null", after: str | None = None, rest: tuple[str, ...] = (), lenient: bool = False) -> str:
    name = lambda x: "null" if x is None else f"'{x}'"
    return f"cast(struct('{role}', {name(rule)}, '{space}', {_texts(key)}, cast({value} as string), {name(after)}, {_texts(rest)}, {str(lenient).lower()}) as {_FACT})"


def _facts(rule: Has | Needs | Lacks | Breaks) -> str:
    """An expression for the facts of a row by one rule, as an array."""
    if isinstance(rule, Breaks):
        return f"if({rule.when}, array({_fact('breaks', rule.rule)}), array())"
    if isinstance(rule, Lacks):
        return f"if({rule.when}, array({_fact('lacks', rule.rule, rule.space, rule.key)}), array())"
    one = _fact("has", rule.unique, rule.space, rule.key, rule.value) if isinstance(rule, Has) else _fact("needs", rule.rule, rule.space, rule.key, "null", rule.after, rule.rest, rule.lenient)
    return f"if({rule.when}, {f'transform(coalesce({rule.each}, array()), x -> {one})' if rule.each else f'array({one})'}, array())"


def facts(tables: dict[str, DataFrame], catalogue: dict[str, tuple[str, list]], scope: str) -> DataFrame:
    """(scope, subject, row, the fields of a fact) of all rows; catalogue: a table's expression for the name of a row, and its rules. A table may be absent."""
    out = []
    for name, df in tables.items():
        row, rules = catalogue[name]
        out.append(df.select(scope, F.lit(name).alias("subject"), F.expr(f"cast({row} as string)").alias("row"), F.explode(F.concat(*[F.expr(f"cast({_facts(r)} as array<{_FACT}>)") for r in rules])).alias("x")).select(scope, "subject", "row", "x.*"))
    return reduce(DataFrame.unionByName, out)


def violations(tables: dict[str, DataFrame], catalogue: dict[str, tuple[str, list]], scope: str, dealt: bool = False) -> DataFrame:
    """(scope, subject, row, rule), each once, of what breaks a catalogue's rules. Rows of a null scope see no identity. For a rule of distinctness the row is the identity, its parts joined by commas.
    `dealt` says that the tables come dealt by scope, in equal numbers of tasks: then no fact is written, nor shuffled to meet another of its key."""
    some = next(iter(tables.values()))
    spark, kind = some.sparkSession, some.schema[scope].dataType.simpleString()
    schema = f"{scope} {kind}, subject string, row string, rule string, space string, key array<string>, value string, after string, rest array<string>, lenient boolean, role string"
    if not dealt:
        path = f"{shared_folder(spark)}/facts"
        facts(tables, catalogue, scope).write.partitionBy("role").parquet(path)

    def part(keep, where: str) -> DataFrame:
        """Facts of the rules that `keep` takes, which are those of `where`."""
        if not dealt:
            return spark.read.schema(schema).parquet(path).filter(where)
        kept = {n: (catalogue[n][0], [r for r in catalogue[n][1] if keep(r)]) for n in tables}
        given = {n: df for n, df in tables.items() if kept[n][1]}
        return facts(given, kept, scope) if given else spark.createDataFrame([], schema)

    told = [scope, "subject", "row", "rule"]
    at = [scope, "space", "key"]
    identity = "not exists(key, p -> p is null)"
    met = part(lambda r: isinstance(r, (Has, Lacks)) or isinstance(r, Needs) and not r.lenient, "role in ('has', 'lacks') or role = 'needs' and not lenient").filter(f"role <> 'has' or {identity}")
    has, same = F.col("role") == "has", Window.partitionBy(*at)
    met = met.select(*told, "space", "key", "role").withColumns({"known": F.max(has).over(same) & F.col(scope).isNotNull(), "ruled": F.count_if(has & F.col("rule").isNotNull()).over(same)})
    broken = met.filter("role = 'lacks' and known or role = 'needs' and not known").select(*told)
    twice = met.filter("role = 'has' and rule is not null and ruled > 1").groupBy(*at, "subject", "rule").agg(F.count("*").alias("n")).filter("n > 1").select(scope, "subject", F.array_join("key", ",").alias("row"), "rule")
    # what is found by a need, and must be an identity of another space
    further = [r for n in tables for r in catalogue[n][1] if isinstance(r, Needs) and r.after]
    listed = lambda spaces: f"role = 'has' and space in ({', '.join(repr(x) for x in sorted(spaces)) or 'null'})"
    of = lambda spaces: part(lambda r: isinstance(r, Has) and r.space in spaces, listed(spaces)).filter(identity)
    values = of({r.space for r in further}).select(*at, "value").distinct()
    beyond = part(lambda r: isinstance(r, Needs) and r.after, "role = 'needs' and after is not null").select(*told, "space", "key", "after", "rest").join(values, at).select(*told, F.col("after").alias("space"), F.concat(F.array("value"), "rest").alias("key"))
    lost = beyond.join(of({r.after for r in further}).select(*at).distinct(), at, "left_anti").select(*told)
    alone = part(lambda r: isinstance(r, Breaks), "role = 'breaks'").select(*told)
    return reduce(DataFrame.unionByName, [alone, broken, twice, lost]).distinct()
