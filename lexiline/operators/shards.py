"""Work that was split into shards: whether each stays within its work item, and whether together they are the plan, in its order and without shared writes.

Everything is compared as rows, entry by entry, so neither a shard nor a manifest is ever gathered into one value. Only the spans of a plan's work items (not what its shards hold) are walked in order.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lexiline.functions.text import blank
from lexiline.sources.timeline import table

# fixed values, by kind of shard and role of entry
#: the kind of artifact that a shard is stored as, where that is told
STORED = {"inventory": "proposal", "author": "proposal", "review": "checks"}
#: what stands between a work item and the rest of an entry's name
NAMESPACES = {"inventory/opportunity": ":", "author/candidate": ":candidate:", "review/missing": ":missing:", "review/finding": ":finding:", "repair/operation": ":operation:", "repair/addition": ":candidate:"}
#: entries that must lie in the span of their work item, by the first sentence of their core
ANCHORED = ("inventory/opportunity", "review/missing")
#: entries that decide what was assigned, one by one in its order
IN_ORDER = ("author/opportunity", "review/candidate", "review/opportunity", "review/overlap", "review/handoff")
#: entries that must name all that they answer, in any order, and nothing else: the role, and the role of what is answered
ANSWERS = {"repair/finding": "finding", "author/mapped": "candidate"}
#: entries of one name in a plan, and those that several shards may not write (though one may, again and again)
ONCE, WRITES = ("inventory/opportunity", "author/candidate", *IN_ORDER[1:]), ("repair/candidate_write", "repair/opportunity_write")
#: names that a shard makes itself and may then refer to
OWN = {"review/missing": "opportunity", "repair/addition": "candidate"}


def _what() -> Column:
    return F.concat_ws("/", "kind", "role")


def _named(values: dict[str, str], key: Column) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for pair in values.items() for x in pair]), key)


def _found(df: DataFrame, rule: str | Column) -> DataFrame:
    return df.select("plan", "shard", (F.lit(rule) if isinstance(rule, str) else rule).alias("rule"), "id")


def overlapping(items: DataFrame, keys: list[str]) -> DataFrame:
    """Items (keys, place, first, last) whose span begins at or before the end of one that begins before it (or with it, at an earlier place). Items without a span overlap with none."""
    before = Window.partitionBy(*keys).orderBy("first", "place").rowsBetween(Window.unboundedPreceding, -1)
    return items.filter("first is not null and last is not null").withColumn("reached", F.max("last").over(before)).filter("reached >= first").drop("reached")


def shard_violations(plans: DataFrame, items: DataFrame, assigned: DataFrame, scope: DataFrame, shards: DataFrame, entries: DataFrame, refs: DataFrame, whole: DataFrame) -> DataFrame:
    """(plan, shard, rule, id) of each rule that a plan's shards break; shard is the place in the manifest, id the entry, where there is one.

    plans: (plan, kind, sha256, basis: the digest of what it was made from); items: (plan, place, item, first, last, discovers); assigned: (plan, item, role, place, id); scope: (plan, item, role, id), what entries may
    refer to; shards: (plan, place, item, first, last, plan_sha256, basis, family, stored_kind, stored_sha256, sha256); entries: (plan, shard, role, place, id, anchor); refs: (plan, shard, role, id);
    whole: (plan, role, place, id), what all shards of an author's or reviewer's plan must decide, in order. A plan's places are distinct, and so are the names of its items. A null name or anchor breaks the rules of its role.

    no_plan, missing, surplus, moved: the shards aren't the plan's items one for one in order. identity, artifact, family: made from something else, stored as something else, by nobody. overlap, reversed: spans of items.
    namespace, anchor, omission: names and places outside the item; a find where none was asked for. assignment, unanswered, foreign: what was assigned isn't what was decided. scope: a name that wasn't shown.
    repeated, conflict: decided or written by more than one shard. order, undecided: the shards put together aren't the whole."""
    # the set of shards
    known = items.join(plans, "plan").select("plan", F.col("place").alias("shard"), "kind", "item", "first", "last", "discovers", "sha256", "basis")
    given = shards.select("plan", F.col("place").alias("shard"), *[F.col(c).alias(f"s_{c}") for c in ("item", "first", "last", "plan_sha256", "basis", "family", "stored_kind", "stored_sha256", "sha256")], F.lit(True).alias("given"))
    met = known.join(given, ["plan", "shard"], "full").join(plans.select("plan", F.lit(True).alias("is_plan")), "plan", "left").withColumn("id", F.coalesce("s_item", "item"))
    both = F.col("given") & F.col("kind").isNotNull()
    same = lambda a, b: F.col(a).eqNullSafe(F.col(b))
    stored = _named(STORED, F.col("kind"))
    rules = {
        "no_plan": F.col("is_plan").isNull(), "missing": F.col("given").isNull(), "surplus": F.col("is_plan") & F.col("kind").isNull(),
        "moved": both & ~(same("s_item", "item") & same("s_first", "first") & same("s_last", "last")), "identity": both & ~(same("s_plan_sha256", "sha256") & same("s_basis", "basis")),
        "artifact": both & stored.isNotNull() & ~(F.col("s_stored_kind").eqNullSafe(stored) & same("s_stored_sha256", "s_sha256")),
        "family": both & (F.col("kind") != "inventory") & F.coalesce(blank("s_family"), F.lit(True)), "reversed": F.col("first") > F.col("last"),
    }
    broken = F.array_compact(F.array(*[F.when(c, F.lit(n)) for n, c in rules.items()]))
    out = [_found(met, F.explode(broken)), _found(overlapping(items, ["plan"]).select("plan", F.col("place").alias("shard"), F.col("item").alias("id")), "overlap")]

    # each entry by itself
    owners = known.join(shards.select("plan", F.col("place").alias("shard")), ["plan", "shard"], "left_semi").select("plan", "shard", "kind", "item", "first", "last", "discovers")
    e = entries.join(owners, ["plan", "shard"]).withColumn("what", _what())
    space = _named(NAMESPACES, F.col("what"))
    sought = F.col("discovers") | (F.col("kind") == "inventory")
    checks = {
        "namespace": space.isNotNull() & ~F.coalesce(F.startswith(F.col("id"), F.concat("item", space)), F.lit(False)),
        "anchor": F.col("what").isin(*ANCHORED) & sought & ~F.coalesce(F.col("anchor").between(F.col("first"), F.col("last")), F.lit(False)),
        "omission": (F.col("what") == "review/missing") & ~F.coalesce("discovers", F.lit(False)),
    }
    out.append(_found(e, F.explode(F.array_compact(F.array(*[F.when(c, F.lit(n)) for n, c in checks.items()])))))

    # what was assigned
    due = assigned.join(owners, ["plan", "item"]).withColumn("what", _what())
    at = ["plan", "shard", "what", "place"]
    pair = due.filter(F.col("what").isin(*IN_ORDER)).select(*at, F.col("id").alias("due"), F.lit(True).alias("is_due")).join(e.filter(F.col("what").isin(*IN_ORDER)).select(*at, F.col("id").alias("said"), F.lit(True).alias("is_said")), at, "full")
    out.append(_found(pair.filter("is_due is null or is_said is null or due <> said or due is null or said is null").withColumn("id", F.coalesce("said", "due")), "assignment"))
    answer = e.filter(F.col("what").isin(*ANSWERS)).select("plan", "shard", _named(ANSWERS, F.col("what")).alias("role"), "id").distinct().withColumn("is_said", F.lit(True))
    asked = due.filter("what = 'repair/finding'").unionByName(e.filter("what = 'author/candidate'"), allowMissingColumns=True).select("plan", "shard", "role", "id").distinct().withColumn("is_due", F.lit(True))
    either = asked.join(answer, ["plan", "shard", "role", "id"], "full").filter("is_due is null or is_said is null")
    out.append(_found(either, F.when(F.col("is_said").isNull(), F.lit("unanswered")).otherwise(F.lit("foreign"))))

    # what was shown, and what a shard made itself
    may = scope.join(owners.select("plan", "item", "shard"), ["plan", "item"]).select("plan", "shard", "role", "id").unionByName(e.filter(F.col("what").isin(*OWN)).select("plan", "shard", _named(OWN, F.col("what")).alias("role"), "id"))
    out.append(_found(refs.join(owners.select("plan", "shard"), ["plan", "shard"], "left_semi").join(may, ["plan", "shard", "role", "id"], "left_anti").distinct(), "scope"))

    # among the shards of a plan
    by = e.filter(F.col("what").isin(*ONCE, *WRITES)).groupBy("plan", "what", "id", "shard").agg(F.count("*").alias("n")).withColumn("held", F.min("shard").over(Window.partitionBy("plan", "what", "id")))
    out.append(_found(by.filter(F.col("what").isin(*ONCE) & ((F.col("n") > 1) | (F.col("shard") > F.col("held")))), "repeated"))
    out.append(_found(by.filter(F.col("what").isin(*WRITES) & (F.col("shard") > F.col("held"))), "conflict"))

    # the whole: the place of an author's decision is that in its shard, after all of the shards before
    mine = e.filter("what = 'author/opportunity'")
    sizes = mine.groupBy("plan", "shard").agg(F.count("*").alias("n"), F.min("place").alias("low"))
    ahead = sizes.withColumn("ahead", F.coalesce(F.sum("n").over(Window.partitionBy("plan").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    put = mine.join(ahead, ["plan", "shard"]).select("plan", "shard", "id", (F.col("ahead") + F.col("place") - F.col("low")).alias("place"))
    authors = whole.join(plans.filter("kind = 'author'").select("plan"), "plan", "left_semi").filter("role = 'opportunity'").select("plan", "place", F.col("id").alias("due"))
    out.append(_found(put.join(authors, ["plan", "place"], "left").filter(~F.coalesce(F.col("id") == F.col("due"), F.lit(False))), "order"))
    lost = whole.join(plans.filter("kind in ('author', 'review')").select("plan", "kind"), "plan").withColumn("what", _what()).join(e.select("plan", "what", "id"), ["plan", "what", "id"], "left_anti")
    out.append(_found(lost.select("plan", F.lit(None).cast("long").alias("shard"), "id"), "undecided"))
    return reduce(DataFrame.unionByName, [x.select("plan", F.col("shard").cast("long").alias("shard"), "rule", "id") for x in out])


# ---- queries -------------------------------------------------------------------------------------------------

def _frames(s: SparkSession, d: str) -> list[DataFrame]:
    """Plans of eight work items of eight orders each; kinds take turns. What is wrong is said by the numbers of plans, places and customers."""
    k, c, p, i, e, kind = (F.col(x) for x in "k c p i e kind".split())
    o = table(s, d, "orders").select(F.col("o_orderkey").alias("k"), F.col("o_custkey").alias("c")).filter("k is not null and c is not null")
    o = o.withColumns({"p": F.expr("k div 64"), "i": F.expr("(k div 8) % 8"), "e": F.expr("k % 8")}).withColumn("kind", F.element_at(F.array(*[F.lit(x) for x in ("inventory", "author", "review", "repair")]), (p % 4 + 1).cast("int")))
    txt = lambda *parts: F.concat(*[x.cast("string") if isinstance(x, Column) else F.lit(x) for x in parts])
    plans = o.select(p.alias("plan"), "kind").distinct().select("plan", "kind", txt("p", F.col("plan")).alias("sha256"), txt("b", F.col("plan")).alias("basis"))
    w = o.select("p", "i", "kind").distinct()
    spanned = (kind == "inventory") | ((kind == "review") & (i % 2 == 0))
    last = i * 100 + 99 + F.when((p % 5 == 1) & (i == 3), 5).otherwise(0)
    items = w.select(p.alias("plan"), i.alias("place"), txt("w", i).alias("item"), F.when(spanned, i * 100).alias("first"), F.when(spanned, last).alias("last"), ((kind == "review") & (i % 2 == 0)).alias("discovers"))
    said = F.when((p % 7 == 3) & i.isin(1, 2), 3 - i).when((p % 7 == 4) & (i == 6), 5).otherwise(i)
    listed = w.filter("not (p % 7 = 2 and i = 5)").unionByName(w.filter("p % 7 = 5 and i = 0").withColumn("i", F.lit(8).cast("long")))
    off = lambda m, at: (p % 9 == m) & (i == at)
    shards = listed.select(
        p.alias("plan"), i.alias("place"), txt("w", F.when(i == 8, 0).otherwise(said)).alias("item"), F.when(spanned, i * 100).alias("first"), F.when(spanned, last).alias("last"), F.when(off(4, 0), "old").otherwise(txt("p", p)).alias("plan_sha256"), txt("b", p).alias("basis"),
        F.when(off(7, 3), " \n").otherwise("f").alias("family"), F.when(off(5, 1), "edit").when(kind == "review", "checks").otherwise("proposal").alias("stored_kind"), F.when(off(6, 2), "other").otherwise("h").alias("stored_sha256"), F.lit("h").alias("sha256"),
    )
    four = lambda e: F.when(e < 3, "candidate").when(e < 6, "opportunity").when(e == 6, "overlap").otherwise("handoff")
    role = F.when(kind == "author", "opportunity").when(kind == "repair", "finding").otherwise(four(e))
    name = lambda x: txt("n", x)
    assigned = o.filter("kind <> 'inventory'").select(p.alias("plan"), txt("w", i).alias("item"), role.alias("role"), e.alias("place"), name(k).alias("id"))
    entry = lambda cond, role, id, anchor=F.lit(None).cast("long"): F.when(cond, F.struct((role if isinstance(role, Column) else F.lit(role)).alias("role"), e.alias("place"), id.alias("id"), anchor.alias("anchor")))
    made = lambda mid, m, r: F.when(c % m == r, txt("x", mid, k)).otherwise(txt("w", i, mid, k))
    anchor = i * 100 + c % 110
    each = F.array_compact(F.array(
        entry(kind == "inventory", "opportunity", F.when(c % 17 == 3, txt("w", i, ":", k - k % 2)).otherwise(made(":", 13, 5)), anchor), entry(kind.isin("author", "review"), role, name(F.when(c % 13 == 5, k + 1).otherwise(k))),
        entry(kind == "author", "candidate", made(":candidate:", 17, 3)), entry((kind == "author") & (c % 19 != 4), "mapped", made(":candidate:", 17, 3)), entry((kind == "review") & (c % 5 == 2), "missing", made(":missing:", 3, 1), anchor),
        entry((kind == "review") & (c % 5 == 3), "finding", made(":finding:", 2, 1)), entry(kind == "repair", "operation", made(":operation:", 17, 3)), entry((kind == "repair") & (c % 13 != 5), "finding", name(F.when(c % 13 == 6, 0).otherwise(k))),
        entry(kind == "repair", "candidate_write", name(c % 50)), entry(kind == "repair", "opportunity_write", name(c % 500)),
    ))
    entries = o.select(p.alias("plan"), i.alias("shard"), F.explode(each).alias("x")).select("plan", "shard", "x.*")
    scope = w.filter("kind = 'review'").select(p.alias("plan"), txt("w", i).alias("item"), F.lit("candidate").alias("role"), F.explode(F.sequence(F.lit(0), F.lit(15))).alias("id")).withColumn("id", name(F.col("id")))
    refs = o.filter("kind = 'review'").select(p.alias("plan"), i.alias("shard"), F.explode(F.array(F.struct(F.lit("candidate").alias("role"), name(c % 20).alias("id")), F.struct(F.lit("opportunity").alias("role"), txt("w", i, ":missing:", k).alias("id")))).alias("x")).select("plan", "shard", "x.*")
    whole = o.filter("kind in ('author', 'review')").select(p.alias("plan"), role.alias("role"), F.expr("k % 64").alias("place"), name(k).alias("id"))
    return [plans, items, assigned, scope, shards, entries, refs, whole]


QUERIES = {"v11_shard_violations": lambda s, d: shard_violations(*_frames(s, d))}
_ROLE = "CASE WHEN kind = 'author' THEN 'opportunity' WHEN e < 3 THEN 'candidate' WHEN e < 6 THEN 'opportunity' WHEN e = 6 THEN 'overlap' ELSE 'handoff' END"
ORACLES = {
    "v11_shard_violations": f"""WITH o AS (SELECT *, ['inventory', 'author', 'review', 'repair'][p % 4 + 1] AS kind FROM (SELECT o_orderkey AS k, o_custkey AS c, o_orderkey // 64 AS p, o_orderkey // 8 % 8 AS i, o_orderkey % 8 AS e FROM orders)),
w AS (SELECT DISTINCT p, i, kind FROM o), h AS (SELECT * FROM o WHERE NOT (p % 7 = 2 AND i = 5)), hw AS (SELECT DISTINCT p, i, kind FROM h), an AS (SELECT *, i * 100 + c % 110 AS a, i * 100 + 99 + CASE WHEN p % 5 = 1 AND i = 3 THEN 5 ELSE 0 END AS z FROM h),
au AS (SELECT *, CASE WHEN c % 13 = 5 THEN k + 1 ELSE k END AS n, {_ROLE} AS role FROM h WHERE kind IN ('author', 'review')), inv AS (SELECT p, i, CASE WHEN c % 17 = 3 THEN 'w' || i || ':' || (k - k % 2) WHEN c % 13 = 5 THEN 'x:' || k ELSE 'w' || i || ':' || k END AS id FROM h WHERE kind = 'inventory'),
wr AS (SELECT DISTINCT p, i, 'c' AS r, c % 50 AS n FROM h WHERE kind = 'repair' UNION SELECT p, i, 'o', c % 500 FROM h WHERE kind = 'repair'), fd AS (SELECT DISTINCT p, i, CASE WHEN c % 13 = 6 THEN 0 ELSE k END AS n FROM h WHERE kind = 'repair' AND c % 13 <> 5),
mine AS (SELECT p, i, e, n, sum(1) OVER (PARTITION BY p ORDER BY i, e) - 1 AS g FROM au WHERE kind = 'author'), f AS (
SELECT p, i, 'missing' AS rule, 'w' || i AS id FROM w WHERE p % 7 = 2 AND i = 5 UNION ALL SELECT p, 8, 'surplus', 'w0' FROM w WHERE p % 7 = 5 AND i = 0 UNION ALL SELECT p, i, 'moved', 'w' || (3 - i) FROM hw WHERE p % 7 = 3 AND i IN (1, 2) UNION ALL SELECT p, i, 'moved', 'w5' FROM hw WHERE p % 7 = 4 AND i = 6
UNION ALL SELECT p, i, r, CASE WHEN p % 7 = 3 AND i IN (1, 2) THEN 'w' || (3 - i) ELSE 'w' || i END FROM (SELECT *, CASE WHEN p % 9 = 4 AND i = 0 THEN 'identity' WHEN p % 9 = 5 AND i = 1 AND kind <> 'repair' OR p % 9 = 6 AND i = 2 AND kind <> 'repair' THEN 'artifact' WHEN p % 9 = 7 AND i = 3 AND kind <> 'inventory' THEN 'family' END AS r FROM hw) WHERE r IS NOT NULL
UNION ALL SELECT p, i, 'overlap', 'w' || i FROM w WHERE kind = 'inventory' AND p % 5 = 1 AND i = 4
UNION ALL SELECT p, i, 'namespace', id FROM inv WHERE id LIKE 'x%' UNION ALL SELECT p, i, 'namespace', 'x:candidate:' || k FROM h WHERE kind = 'author' AND c % 17 = 3 UNION ALL SELECT p, i, 'namespace', 'x:missing:' || k FROM h WHERE kind = 'review' AND c % 5 = 2 AND c % 3 = 1
UNION ALL SELECT p, i, 'namespace', 'x:finding:' || k FROM h WHERE kind = 'review' AND c % 5 = 3 AND c % 2 = 1 UNION ALL SELECT p, i, 'namespace', 'x:operation:' || k FROM h WHERE kind = 'repair' AND c % 17 = 3
UNION ALL SELECT p, i, 'anchor', CASE WHEN c % 17 = 3 THEN 'w' || i || ':' || (k - k % 2) WHEN c % 13 = 5 THEN 'x:' || k ELSE 'w' || i || ':' || k END FROM an WHERE kind = 'inventory' AND a > z
UNION ALL SELECT p, i, CASE WHEN i % 2 = 0 THEN 'anchor' ELSE 'omission' END, CASE WHEN c % 3 = 1 THEN 'x' ELSE 'w' || i END || ':missing:' || k FROM an WHERE kind = 'review' AND c % 5 = 2 AND (i % 2 = 1 OR a > z)
UNION ALL SELECT p, i, 'assignment', 'n' || n FROM au WHERE n <> k UNION ALL SELECT p, i, 'unanswered', 'n' || k FROM h WHERE kind = 'repair' AND NOT EXISTS (SELECT 1 FROM fd WHERE fd.p = h.p AND fd.i = h.i AND fd.n = h.k)
UNION ALL SELECT p, i, 'foreign', 'n' || n FROM fd WHERE n // 8 <> p * 8 + i UNION ALL SELECT p, i, 'unanswered', CASE WHEN c % 17 = 3 THEN 'x' ELSE 'w' || i END || ':candidate:' || k FROM h WHERE kind = 'author' AND c % 19 = 4
UNION ALL SELECT DISTINCT p, i, 'scope', 'n' || c % 20 FROM h WHERE kind = 'review' AND c % 20 > 15 UNION ALL SELECT p, i, 'scope', 'w' || i || ':missing:' || k FROM h WHERE kind = 'review' AND NOT (c % 5 = 2 AND c % 3 <> 1)
UNION ALL SELECT p, i, 'repeated', id FROM inv GROUP BY ALL HAVING count(*) > 1
UNION ALL SELECT p, i, 'repeated', 'n' || n FROM (SELECT p, i, role, n, count(*) AS m, min(i) OVER (PARTITION BY p, role, n) AS held FROM au WHERE kind = 'review' GROUP BY p, i, role, n) WHERE m > 1 OR i > held
UNION ALL SELECT p, i, 'conflict', 'n' || n FROM (SELECT *, min(i) OVER (PARTITION BY p, r, n) AS held FROM wr) WHERE i > held
UNION ALL SELECT p, i, 'order', 'n' || n FROM mine WHERE n <> p * 64 + g OR NOT EXISTS (SELECT 1 FROM o WHERE o.k = mine.n)
UNION ALL SELECT p, NULL, 'undecided', 'n' || k FROM (SELECT *, {_ROLE} AS role FROM o WHERE kind IN ('author', 'review')) q WHERE NOT EXISTS (SELECT 1 FROM au WHERE au.p = q.p AND au.role = q.role AND au.n = q.k))
SELECT p AS plan, i::BIGINT AS shard, rule, id FROM f"""
}
