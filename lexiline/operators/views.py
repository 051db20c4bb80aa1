"""What a user sees of a source's runs: one nested row, of bounded lists only.

Lists are the latest so many rows of a key, which each task cuts before anything is shuffled, so a run with very many events costs no more than one with a few.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lexiline.sources.timeline import table

# fixed values: runs and events that are shown
RUNS, EVENTS = 20, 50


def latest_rows(df: DataFrame, keys: list[str], order: list[Column], most: int, fields: list[str], name: str) -> DataFrame:
    """(keys, name): structs of the first `most` rows of each key in an order, in that order."""
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    cut = df.select(*keys, F.struct(*fields).alias("x"), place.alias("place")).filter(F.col("place") <= most)
    return cut.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "x"))), lambda r: r["x"]).alias(name))


def run_views(runs: DataFrame, events: DataFrame, revisions: DataFrame, artifacts: DataFrame, asked: DataFrame) -> DataFrame:
    """(source_id, runs, run, status, events, current_edit, accepted_edit, artifacts) of each source with a run.

    runs: (source_id, run, created, status, current_revision, accepted_revision); events: (run, created, key, action, state, message); revisions: (run, revision, artifact); artifacts: (source_id, id, kind, sha256,
    edit_sha256: the edit that it was made from); asked: (source_id, run, key), at most one row for a source. The run shown is the one asked for, if the source has it, else, where none is asked for, the latest. It is
    listed after the latest twenty if it isn't one of them, and the event with the key asked for comes before the latest fifty if it isn't one of them. Edits are the artifacts of kind edit that the run's current and
    accepted revisions (from 1 on) point to, and artifacts are those made from either. Of rows at one time that with the greater identity is later."""
    order = [F.desc("created"), F.desc("run")]
    listed = latest_rows(runs, ["source_id"], order, RUNS, ["run", "created", "status"], "runs")
    latest = runs.withColumn("place", F.row_number().over(Window.partitionBy("source_id").orderBy(*order))).filter("place = 1").select("source_id", F.col("run").alias("latest"))
    base = listed.join(latest, "source_id").join(asked.select("source_id", F.col("run").alias("wanted"), F.col("key").alias("pending")), "source_id", "left").withColumn("run", F.coalesce("wanted", "latest"))
    shown = base.join(runs.select("source_id", "run", F.struct("run", "created", "status").alias("own"), "status", "current_revision", "accepted_revision"), ["source_id", "run"], "left")
    among = F.exists("runs", lambda x: x["run"] == F.col("run"))
    shown = shown.withColumn("runs", F.when(F.col("own").isNotNull() & ~among, F.array_append("runs", F.col("own"))).otherwise(F.col("runs"))).withColumn("run", F.col("own.run"))
    # events of the runs shown
    fields = ["created", "key", "action", "state", "message"]
    mine = events.join(shown.select("run"), "run", "left_semi")
    recent = latest_rows(mine, ["run"], [F.desc("created"), F.desc("key")], EVENTS, fields, "events")
    one = mine.join(shown.select("run", F.col("pending").alias("key")), ["run", "key"]).groupBy("run").agg(F.max_by(F.struct(*fields), F.struct("created", "key")).alias("waiting"))
    # edits that the run points to, and what was made from them
    points = shown.select("source_id", "run", F.explode(F.array(*[F.struct(F.lit(c).alias("which"), F.col(f"{c}_revision").alias("revision")) for c in ("current", "accepted")])).alias("x")).select("source_id", "run", "x.*").filter("revision > 0")
    edits = points.join(revisions, ["run", "revision"]).join(artifacts.filter("kind = 'edit'").select("source_id", F.col("id").alias("artifact"), F.struct("id", "sha256").alias("edit")), ["source_id", "artifact"])
    pointers = edits.groupBy("run").agg(*[F.max(F.when(F.col("which") == c, F.col("edit"))).alias(f"{c}_edit") for c in ("current", "accepted")])
    made = artifacts.join(edits.select("source_id", "run", F.col("edit.sha256").alias("edit_sha256")).distinct(), ["source_id", "edit_sha256"])
    made = made.groupBy("run").agg(F.array_sort(F.collect_set(F.struct("id", "kind", "sha256"))).alias("artifacts"))  # what was rendered from two edits
    out = shown.select("source_id", "runs", "run", "status").join(recent, "run", "left").join(one, "run", "left").join(pointers, "run", "left").join(made, "run", "left")
    known = F.coalesce("events", F.filter(F.array(F.col("waiting")), lambda x: F.lit(False)))
    ahead = F.col("waiting").isNotNull() & ~F.coalesce(F.exists("events", lambda x: x["key"] == F.col("waiting.key")), F.lit(False))
    return out.select("source_id", "runs", "run", "status", F.when(ahead, F.concat(F.array("waiting"), known)).otherwise(known).alias("events"), "current_edit", "accepted_edit", F.coalesce("artifacts", F.array().cast("array<struct<id:bigint,kind:string,sha256:string>>")).alias("artifacts"))


# ---- queries -------------------------------------------------------------------------------------------------

def r17_run_view(s: SparkSession, d: str) -> DataFrame:
    """Users as runs of five sources, their events as events and artifacts; a third of the sources asks for an old run, and for the user's first event."""
    e = table(s, d, "events").withColumn("ms", F.expr("unix_micros(cast(ts as timestamp)) div 1000"))
    u, k = F.col("user_id"), F.col("event_id")
    source = (u % 5).alias("source_id")
    runs = e.groupBy("user_id").agg(F.max("ms").alias("created"), F.max("event_id").alias("top"), F.min("event_id").alias("low")).select(source, u.alias("run"), "created", F.when(u % 3 == 0, "ready").otherwise("running").alias("status"), F.col("top").alias("current_revision"), F.when(u % 4 != 1, F.col("low")).otherwise(0).alias("accepted_revision"))
    events = e.select(u.alias("run"), F.col("ms").alias("created"), k.cast("string").alias("key"), F.col("event_type").alias("action"), F.lit("done").alias("state"), F.lit(None).cast("string").alias("message"))
    sha = lambda c: F.concat(F.lit("h"), c.cast("string"))
    artifacts = e.select(source, k.alias("id"), F.lit("edit").alias("kind"), sha(k).alias("sha256"), F.lit(None).cast("string").alias("edit_sha256")).unionByName(e.select(source, (k + 10_000_000).alias("id"), F.lit("render").alias("kind"), sha(-k).alias("sha256"), sha(k).alias("edit_sha256")))
    asked = runs.filter("source_id in (1, 3)").groupBy("source_id").agg(F.min_by("run", F.struct("created", "run")).alias("run"))
    asked = asked.join(events.groupBy("run").agg(F.min_by("key", F.struct("created", "key")).alias("key")), "run").select("source_id", "run", "key")
    v = run_views(runs, events, e.select(u.alias("run"), k.alias("revision"), k.alias("artifact")), artifacts, asked)
    text = lambda c, f: F.array_join(F.transform(c, lambda x: x[f].cast("string")), ",")
    return v.select("source_id", text("runs", "run").alias("runs"), "run", "status", text("events", "key").alias("events"), F.col("current_edit.id").alias("current_edit"), F.col("accepted_edit.id").alias("accepted_edit"), text("artifacts", "id").alias("artifacts"))


QUERIES = {"r17_run_view": r17_run_view}
ORACLES = {
    "r17_run_view": f"""WITH e AS (SELECT *, epoch_us(ts) // 1000 AS ms, event_id::VARCHAR AS key FROM events), r AS (SELECT user_id % 5 AS source_id, user_id AS run, max(ms) AS created, max(event_id) AS top, min(event_id) AS low FROM e GROUP BY user_id),
n AS (SELECT *, row_number() OVER (PARTITION BY source_id ORDER BY created DESC, run DESC) AS p, row_number() OVER (PARTITION BY source_id ORDER BY created, run) AS q FROM r), sh AS (SELECT * FROM n WHERE CASE WHEN source_id IN (1, 3) THEN q = 1 ELSE p = 1 END),
ls AS (SELECT n.source_id, string_agg(n.run, ',' ORDER BY n.p) AS runs FROM n JOIN sh USING (source_id) WHERE n.p <= {RUNS} OR n.run = sh.run GROUP BY 1),
ev AS (SELECT user_id AS run, key, row_number() OVER (PARTITION BY user_id ORDER BY ms DESC, key DESC) AS p, row_number() OVER (PARTITION BY user_id ORDER BY ms, key) AS q FROM e),
ex AS (SELECT sh.run, string_agg(key, ',' ORDER BY CASE WHEN ev.p <= {EVENTS} THEN ev.p ELSE 0 END) AS events FROM sh JOIN ev USING (run) WHERE ev.p <= {EVENTS} OR sh.source_id IN (1, 3) AND ev.q = 1 GROUP BY 1)
SELECT sh.source_id, runs, sh.run, CASE WHEN sh.run % 3 = 0 THEN 'ready' ELSE 'running' END AS status, ex.events, top AS current_edit, CASE WHEN sh.run % 4 <> 1 AND low > 0 THEN low END AS accepted_edit,
CASE WHEN sh.run % 4 <> 1 AND low > 0 AND low <> top THEN (low + 10000000) || ',' || (top + 10000000) ELSE (top + 10000000)::VARCHAR END AS artifacts FROM sh JOIN ls USING (source_id) JOIN ex ON ex.run = sh.run"""
}
