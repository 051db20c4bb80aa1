"""What must be repaired together, in bounded work items; and what a finished source adds to its ledger."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lexiline.operators.compile import components_of
from lexiline.sources.timeline import table

# fixed values: the most findings, candidates and opportunities of a work item
MOST = {"findings": 12, "candidates": 8, "opportunities": 24}


def repair_work_items(findings: DataFrame, named: DataFrame, opportunities: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Findings that touch a resource in common, directly or through others, are one work item; (work items, their members).

    findings: (source_id, finding_id, place, severity), of which the required ones count; named: (source_id, finding_id, kind: candidate or opportunity, id); opportunities: (source_id, id, candidate_id), one row for each candidate.
    A finding touches the candidates and opportunities that it names, and the opportunities of these candidates. Work items: (source_id, ordinal: by their first finding, findings, candidates, opportunities, refused: why it
    needs a decision by hand: too many of something, or a finding that touches nothing (no_authority); null if it doesn't). Members: (source_id, ordinal, kind, id). Nothing is cut to fit. Rows with null ids touch nothing."""
    required = findings.filter("severity = 'required' and source_id is not null and finding_id is not null").select("source_id", "finding_id", "place")
    direct = required.select("source_id", "finding_id").join(named.select("source_id", "finding_id", "kind", "id"), ["source_id", "finding_id"]).filter("id is not null")
    linked = direct.filter("kind = 'candidate'").join(opportunities.select("source_id", F.col("candidate_id").alias("id"), F.col("id").alias("to")), ["source_id", "id"]).filter("to is not null")
    touched = direct.unionByName(linked.select("source_id", "finding_id", F.lit("opportunity").alias("kind"), F.col("to").alias("id"))).distinct()
    node = lambda kind, c: F.to_json(F.array(F.col("source_id").cast("string"), kind, F.col(c).cast("string")))
    f = node(F.lit("finding"), "finding_id")
    edges = touched.select(f.alias("a"), node(F.col("kind"), "id").alias("b")).unionByName(required.select(f.alias("a"), f.alias("b")))
    owners = components_of(edges)
    mine = required.withColumn("node", f).join(owners, "node").select("source_id", "finding_id", "place", "component")
    sizes = mine.groupBy("source_id", "component").agg(F.min("place").alias("first"), F.count("*").alias("findings"))
    things = touched.select("source_id", "kind", "id").distinct().withColumn("node", node(F.col("kind"), "id")).join(owners, "node").select("source_id", "component", "kind", "id")
    counted = things.groupBy("source_id", "component").agg(F.count_if(F.col("kind") == "candidate").alias("candidates"), F.count_if(F.col("kind") == "opportunity").alias("opportunities"))
    items = sizes.join(counted, ["source_id", "component"], "left").na.fill(0, ["candidates", "opportunities"])
    items = items.withColumn("ordinal", F.row_number().over(Window.partitionBy("source_id").orderBy("first", "component")).cast("long") - 1)
    why = F.when((F.col("candidates") == 0) & (F.col("opportunities") == 0), "no_authority")
    for what, most in MOST.items():
        why = why.when(F.col(what) > most, what)
    members = mine.select("source_id", "component", F.lit("finding").alias("kind"), F.col("finding_id").cast("string").alias("id")).unionByName(things.withColumn("id", F.col("id").cast("string"))).join(items.select("source_id", "component", "ordinal"), ["source_id", "component"])
    return items.select("source_id", "ordinal", "findings", "candidates", "opportunities", why.alias("refused")), members.select("source_id", "ordinal", "kind", "id")


def metered(stored: DataFrame, incoming: DataFrame, ledger: DataFrame, runs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(artifacts after runs have written theirs, entries that the ledger gains).

    stored: (source_id, kind, size_bytes), one for each source and kind; incoming: the same and ord, the last of which replaces what is stored; ledger: (source_id, kind, category, quantity, key); runs: (source_id, run,
    duration_ms), those that end now. Of a source with a run, storage is metered as the difference of all its artifacts to earlier entries of category artifacts, if there is one; processing in whole seconds of media (a half
    goes to the even one), once for each source and run, so that a repeated run adds nothing. A size that is null counts as nothing."""
    last = incoming.groupBy("source_id", "kind").agg(F.max_by("size_bytes", "ord").alias("size_bytes"))
    after = stored.select("source_id", "kind", "size_bytes").join(last, ["source_id", "kind"], "left_anti").unionByName(last)
    ended = runs.select("source_id").distinct()
    totals = after.groupBy("source_id").agg(F.sum("size_bytes").alias("total"))
    before = ledger.filter("kind = 'storage_bytes' and category = 'artifacts'").groupBy("source_id").agg(F.sum("quantity").alias("before"))
    delta = ended.join(totals, "source_id", "left").join(before, "source_id", "left").withColumn("quantity", F.coalesce("total", F.lit(0)) - F.coalesce("before", F.lit(0))).filter("quantity <> 0")
    storage = delta.select("source_id", F.lit("storage_bytes").alias("kind"), F.lit("artifacts").alias("category"), "quantity", F.lit(None).cast("string").alias("key"))
    keyed = runs.groupBy("source_id", "run").agg(F.max("duration_ms").alias("ms")).withColumn("key", F.concat_ws(":", F.lit("processing"), "source_id", "run")).join(ledger.filter("key is not null").select("key"), "key", "left_anti")
    processing = keyed.select("source_id", F.lit("processing_seconds").alias("kind"), F.lit(None).cast("string").alias("category"), F.bround(F.col("ms").cast("decimal(20,0)") / 1000, 0).cast("long").alias("quantity"), "key")
    return after, storage.unionByName(processing)


# ---- queries -------------------------------------------------------------------------------------------------

def h11_work_items(s: SparkSession, d: str) -> DataFrame:
    """Orders as findings, sixty-four to a source; so many in a row, as the source says, name one opportunity, and every second one a candidate, of which every third has an opportunity of its own."""
    o = table(s, d, "orders").select(F.col("o_orderkey").alias("k"), F.col("o_custkey").alias("c")).filter("k is not null and c is not null").selectExpr("k", "c", "k div 64 as source_id", "k % 64 as place", "(k % 64) div (2 + (k div 64) % 15) as g")
    named = o.filter("c % 50 <> 7").selectExpr("source_id", "k as finding_id", "'opportunity' as kind", "concat('g', g) as id").unionByName(o.filter("k % 2 = 0 and c % 50 <> 7").selectExpr("source_id", "k as finding_id", "'candidate' as kind", "concat('c', k) as id"))
    items, _ = repair_work_items(o.selectExpr("source_id", "k as finding_id", "place", "if(c % 10 = 4, 'unknown', 'required') as severity"), named, o.filter("k % 6 = 0").selectExpr("source_id", "concat('o', k) as id", "concat('c', k) as candidate_id"))
    return items


def r11_metered(s: SparkSession, d: str) -> DataFrame:
    """Users as sources, types of events as kinds of artifacts."""
    e = table(s, d, "events").select(F.col("user_id").alias("source_id"), F.col("event_type").alias("kind"), (F.col("event_id") * 7 % 1000).alias("size_bytes"), F.col("event_id").alias("ord")).filter("source_id is not null")
    stored = e.filter("ord % 3 = 0").groupBy("source_id", "kind").agg(F.max_by("size_bytes", "ord").alias("size_bytes"))
    held = stored.filter("source_id % 2 = 0").groupBy("source_id").agg(F.sum("size_bytes").alias("quantity"))
    entry = lambda df, kind, category, quantity, key: df.selectExpr("source_id", f"'{kind}' as kind", f"{category} as category", f"{quantity} as quantity", f"{key} as key")
    users = e.select("source_id").distinct()
    done = "concat_ws(':', 'processing', source_id, source_id % 5)"
    ledger = entry(held, "storage_bytes", "'artifacts'", "quantity", "cast(null as string)").unionByName(entry(users, "storage_bytes", "'master'", "source_id", "cast(null as string)")).unionByName(entry(users.filter("source_id % 4 = 0"), "processing_seconds", "cast(null as string)", "source_id", done))
    return metered(stored, e.filter("ord % 3 = 1"), ledger, users.selectExpr("source_id", "source_id % 5 as run", "source_id * 500 as duration_ms").filter("source_id % 7 <> 3"))[1]


QUERIES = {"h11_work_items": h11_work_items, "r11_metered": r11_metered}
ORACLES = {
    "h11_work_items": """WITH o AS (SELECT o_orderkey AS k, o_custkey AS c, o_orderkey // 64 AS source_id, o_orderkey % 64 AS place, (o_orderkey % 64) // (2 + (o_orderkey // 64) % 15) AS g FROM orders WHERE o_custkey % 10 <> 4), t AS (
SELECT source_id, min(place) AS first, count(*) AS findings, count(*) FILTER (k % 2 = 0) AS candidates, 1 + count(*) FILTER (k % 6 = 0) AS opportunities FROM o WHERE c % 50 <> 7 GROUP BY source_id, g UNION ALL SELECT source_id, place, 1, 0, 0 FROM o WHERE c % 50 = 7)
SELECT source_id, row_number() OVER (PARTITION BY source_id ORDER BY first) - 1 AS ordinal, findings, candidates, opportunities, CASE WHEN opportunities = 0 THEN 'no_authority' WHEN findings > 12 THEN 'findings' WHEN candidates > 8 THEN 'candidates' WHEN opportunities > 24 THEN 'opportunities' END AS refused FROM t""",
    "r11_metered": """WITH e AS (SELECT user_id AS u, event_type AS t, event_id * 7 % 1000 AS z, event_id AS i FROM events), st AS (SELECT u, t, arg_max(z, i) AS z FROM e WHERE i % 3 = 0 GROUP BY 1, 2), ic AS (SELECT u, t, arg_max(z, i) AS z FROM e WHERE i % 3 = 1 GROUP BY 1, 2),
s AS (SELECT u, sum(z) AS z FROM st WHERE u % 2 = 0 GROUP BY 1), a AS (SELECT u, sum(coalesce(ic.z, st.z)) AS z FROM st FULL JOIN ic USING (u, t) GROUP BY 1), r AS (SELECT DISTINCT u FROM e WHERE u % 7 <> 3)
SELECT u AS source_id, 'storage_bytes' AS kind, 'artifacts' AS category, (coalesce(a.z, 0) - coalesce(s.z, 0))::BIGINT AS quantity, NULL AS key FROM r LEFT JOIN a USING (u) LEFT JOIN s USING (u) WHERE coalesce(a.z, 0) <> coalesce(s.z, 0)
UNION ALL SELECT u, 'processing_seconds', NULL, round_even(u * 500 / 1000, 0)::BIGINT, 'processing:' || u || ':' || u % 5 FROM r WHERE u % 4 <> 0""",
}
