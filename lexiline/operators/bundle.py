"""Bundles: all that a run rests on at one moment, written as documents along the graph of dependencies, with a manifest of hashes; and their check.

A bundle is a folder of lines, one for each artifact with its dependencies and, for kinds that are read again, its body, so neither a large run nor a large
artifact list is gathered into one row. Its hash is built from those of pieces of PIECE lines in order.

An artifact is in many bundles. Its line is made and hashed once; what goes through the shuffles for each bundle are its place and that hash, and its line meets them where it is written.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lexiline.operators.compile import closure
from lexiline.plans.shared import shared_folder, stored
from lexiline.sources.timeline import table

# fixed values: kinds and formats whose bodies are in a bundle, and the kind that stays a reference to what a provider said
BODIES = ("evidence", "edit", "checks")
FORMATS = ("topic-renders/1", "chapter-renders/1", "topic-export/1", "topic-selection/2", "topic-rubric/1")
RESPONSE = "model_response"
PIECE = 10_000
ARCHIVE_LINES = 1_000_000  # of a file of an archive, which is compressed and read by one task
LINE = "id long, sha256 string, fingerprint string, kind string, format string, size_bytes long, created long, dependencies array<long>, body_status string, body string"


def snapshot(rows: DataFrame, version: int) -> DataFrame:
    """What a table held at a version: rows written by then."""
    return rows.filter(F.col("version") <= version).drop("version")


def body_status(kind: Column, format_: Column) -> Column:
    return F.when(kind.isin(*BODIES) | F.coalesce(format_.isin(*FORMATS), F.lit(False)), "included").when(kind == RESPONSE, "retained_reference").otherwise("binary_reference")


def bundle_lines(roots: DataFrame, artifacts: DataFrame, dependencies: DataFrame, version: int) -> tuple[DataFrame, DataFrame]:
    """(run, source_id, id) of what each run rests on, and the lines of these artifacts, each once: (source_id, id, copy, the columns of LINE, hash, rule), both stored. Where a source has an artifact more than once, copy tells its
    rows apart; where it has none, the line is empty and its rule says so. Tables are as for bundle_rows."""
    r, a, d = (snapshot(t, version) for t in (roots, artifacts, dependencies))
    d = stored(d.select("id", "input"), "dependencies")
    starts = r.select(F.col("run").alias("root"), F.col("id").alias("node")).distinct()
    reached = closure(d.select(F.col("id").alias("a"), F.col("input").alias("b")), starts).select(F.col("root").alias("run"), F.col("node").alias("id"))
    scoped = stored(reached.join(r.select("run", "source_id").distinct(), "run").select("run", "source_id", "id"), "scoped")
    inputs = d.groupBy("id").agg(F.array_sort(F.collect_set("input")).alias("dependencies"))  # one artifact's inputs
    full = scoped.select("source_id", "id").distinct().join(inputs, "id", "left").join(a.withColumn("found", F.lit(True)), ["source_id", "id"], "left")
    full = full.withColumns({"dependencies": F.coalesce("dependencies", F.array().cast("array<long>")), "body_status": body_status(F.col("kind"), F.col("format"))})
    full = full.withColumn("body", F.when(F.col("body_status") == "included", F.col("body")))
    wrong = (F.col("body_status") == "included") & ~F.sha2("body", 256).eqNullSafe(F.col("sha256"))
    full = full.withColumns({"rule": F.when(F.col("found").isNull(), "absent").when(wrong, "body"), "hash": F.unhex(_line_hash())})
    full = full.withColumn("copy", F.row_number().over(Window.partitionBy("source_id", "id").orderBy("hash")))
    return scoped, stored(full.select("source_id", "copy", *_columns(), "hash", "rule"), "lines")


def bundle_refusals(scoped: DataFrame, lines: DataFrame) -> DataFrame:
    """(run, id, rule): why runs have no bundle."""
    unnamed = scoped.filter("source_id is null or id is null").select("run", "id", F.lit("absent").alias("rule"))
    return scoped.join(lines.filter("rule is not null").select("source_id", "id", "rule"), ["source_id", "id"]).select("run", "id", "rule").unionByName(unnamed)


def bundle_pieces(scoped: DataFrame, lines: DataFrame) -> DataFrame:
    """Bundles as pieces of PIECE lines, without what the lines say: (run, piece, members, n, k, b, hash), members as (source_id, id, copy) in order."""
    met = scoped.join(lines.select("source_id", "id", "copy", "created", "size_bytes", (F.col("body_status") == "included").alias("included"), "hash", F.col("rule").isNull().alias("good")), ["source_id", "id"], "left")
    order = Window.partitionBy("run").orderBy("created", "id", "source_id", "copy")
    whole = F.min(F.coalesce("good", F.lit(False))).over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    fine = met.withColumns({"whole": whole, "position": F.row_number().over(order) - 1}).filter("whole")
    pieces = fine.groupBy("run", F.expr(f"position div {PIECE}").alias("piece")).agg(
        F.count("*").alias("n"), F.count_if("included").alias("k"), F.sum("size_bytes").alias("b"), F.array_sort(F.collect_list(F.struct("position", "source_id", "id", "copy", "hash"))).alias("lines"),
    )
    members = F.transform("lines", lambda x: F.struct(x["source_id"].alias("source_id"), x["id"].alias("id"), x["copy"].alias("copy")))
    return pieces.select("run", "piece", members.alias("members"), "n", "k", "b", _joined(F.transform("lines", lambda x: F.lower(F.hex(x["hash"])))).alias("hash"))


def piece_rows(pieces: DataFrame, lines: DataFrame) -> DataFrame:
    """The rows of bundles: (run, position, the columns of LINE)."""
    placed = pieces.select("run", "piece", F.posexplode("members").alias("at", "member")).select("run", (F.col("piece") * PIECE + F.col("at")).cast("long").alias("position"), "member.*")
    return placed.join(lines, ["source_id", "id", "copy"]).select("run", "position", *_columns())


def bundle_rows(roots: DataFrame, artifacts: DataFrame, dependencies: DataFrame, version: int) -> tuple[DataFrame, DataFrame]:
    """The artifacts of each run's bundle, and why runs have none: (run, id, rule).

    roots: (run, source_id, id, version), what a run made, its evidence, revisions and results; artifacts: (source_id, id, sha256, fingerprint, kind, format, size_bytes, created, body, version); dependencies: (id, input,
    version). All three are read as they were at one version, so what comes later is in no bundle. A run is refused where an artifact that it rests on is absent from
    its source (absent), or a body in it hasn't the hash that it was accepted with (body)."""
    scoped, lines = bundle_lines(roots, artifacts, dependencies, version)
    return piece_rows(stored(bundle_pieces(scoped, lines), "pieces"), lines), bundle_refusals(scoped, lines)


def _columns() -> list[str]:
    return [c.split()[0] for c in LINE.split(", ")]


def _joined(hashes: Column) -> Column:
    return F.sha2(F.array_join(hashes, "\n"), 256)


def _line_hash() -> Column:
    return F.sha2(F.to_json(F.struct(*_columns())), 256)


def _in_order(at: str, value: str) -> Column:
    return _joined(F.transform(F.array_sort(F.collect_list(F.struct(at, value))), lambda x: x[value]))


def _of_pieces(pieces: DataFrame) -> DataFrame:
    return pieces.groupBy("run").agg(F.sum("n").alias("artifacts"), F.sum("k").alias("included"), F.sum("b").alias("bytes"), _in_order("piece", "hash").alias("sha256"))


def manifest(rows: DataFrame) -> DataFrame:
    """(run, artifacts, included, bytes, sha256) of bundles' rows: the hash of the hashes of pieces of lines, in order."""
    lines = rows.select("run", "position", "size_bytes", (F.col("body_status") == "included").alias("included"), _line_hash().alias("line"), F.expr(f"position div {PIECE}").alias("piece"))
    return _of_pieces(lines.groupBy("run", "piece").agg(F.count("*").alias("n"), F.count_if("included").alias("k"), F.sum("size_bytes").alias("b"), _in_order("position", "line").alias("hash")))


def write_bundles(rows: DataFrame, path: str, archive: bool = False, pieces: DataFrame | None = None) -> None:
    """Writes bundles below run=<run>, and then the manifest, so that one that has none isn't whole. Runs of more than PIECE lines are several files. An archive has the lines of many runs, each with its run, in
    compressed files, so that many runs need few files. Where the pieces of the rows are known, the manifest is made of them."""
    if archive:
        rows.write.options(ignoreNullFields=False, compression="gzip", maxRecordsPerFile=ARCHIVE_LINES).json(f"{path}/bundles")
    else:
        rows.withColumn("piece", F.expr(f"position div {PIECE}")).repartition("run", "piece").sortWithinPartitions("run", "position").drop("piece").write.partitionBy("run").option("ignoreNullFields", False).json(f"{path}/bundles")
    (manifest(rows) if pieces is None else _of_pieces(pieces)).write.option("ignoreNullFields", False).json(f"{path}/manifest")


def read_bundles(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Rows and manifest as they were written; anything else in the files ends the reading with an error."""
    strict = spark.read.option("mode", "FAILFAST")
    rows = strict.schema(f"position long, {LINE}, run long").json(f"{path}/bundles")
    return rows, strict.schema("run long, artifacts long, included long, bytes long, sha256 string").json(f"{path}/manifest")


def bundle_violations(rows: DataFrame, stated: DataFrame) -> DataFrame:
    """(run, rule): bundles without a line in the manifest (unlisted), lines without a bundle (missing), and bundles that aren't what was written (changed); also those whose artifacts rest on
    others that aren't in them (open), and bodies that haven't their hash (body)."""
    now = manifest(rows)
    both = now.select("run", F.struct("artifacts", "included", "bytes", "sha256").alias("now")).join(stated.select("run", F.struct("artifacts", "included", "bytes", "sha256").alias("then")), "run", "full_outer")
    whole = both.select("run", F.when(F.col("then").isNull(), "unlisted").when(F.col("now").isNull(), "missing").when(F.col("now") != F.col("then"), "changed").alias("rule")).filter("rule is not null")
    rests = rows.select("run", F.explode("dependencies").alias("id")).distinct().join(rows.select("run", "id"), ["run", "id"], "left_anti").select("run", F.lit("open").alias("rule")).distinct()
    bodies = rows.filter((F.col("body_status") == "included") & ~F.sha2("body", 256).eqNullSafe(F.col("sha256"))).select("run", F.lit("body").alias("rule")).distinct()
    return whole.unionByName(rests).unionByName(bodies)


# ---- queries -------------------------------------------------------------------------------------------------

SEEN = 5


def _store(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Orders as artifacts that rest on those of a half and a third of their number; runs are every fiftieth. Some come after the moment of the bundle, some have another body than they were accepted with."""
    k = F.col("o_orderkey")
    o = table(s, d, "orders")
    body = F.concat(F.lit('{"id": '), k.cast("string"), F.lit(', "status": "'), "o_orderstatus", F.lit('"}'))
    kind = F.element_at(F.array(*map(F.lit, ("evidence", "edit", RESPONSE, "media"))), (k % 4 + 1).cast("int"))
    late = F.when(k % 1997 == 1203, SEEN + 1).otherwise(k % SEEN).cast("long")
    a = o.select(
        F.lit(0).cast("long").alias("source_id"), k.alias("id"), F.sha2(F.when(k % 2003 == 1507, "other").otherwise(body), 256).alias("sha256"), F.concat(F.lit("f"), (k % 12).cast("string")).alias("fingerprint"), kind.alias("kind"), F.when(k % 9 == 2, FORMATS[0]).alias("format"),
        F.char_length(body).cast("long").alias("size_bytes"), F.col("o_custkey").alias("created"), body.alias("body"), late.alias("version"),
    )
    edges = o.select(k.alias("id"), F.explode(F.array(F.expr("o_orderkey div 2"), F.expr("o_orderkey div 3"))).alias("input"), late.alias("version")).filter("input > 0")
    return a.filter("id % 50 = 0").select(F.col("id").alias("run"), "source_id", "id", "version"), a, edges.join(a.select(F.col("id").alias("input")), "input", "left_semi").select("id", "input", "version")


def _archived(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    path = f"{shared_folder(s)}/bundles"
    scoped, lines = bundle_lines(*_store(s, d), SEEN)
    pieces = stored(bundle_pieces(scoped, lines), "pieces")
    write_bundles(piece_rows(pieces, lines), path, archive=True, pieces=pieces)
    return read_bundles(s, path)


def k6_bundles(s: SparkSession, d: str) -> DataFrame:
    return _archived(s, d)[0].select("run", "position", "id", F.array_join("dependencies", ",").alias("dependencies"), "body_status", F.when(F.col("body_status") == "included", F.col("body")).otherwise("").alias("body"))


def k6_manifest(s: SparkSession, d: str) -> DataFrame:
    return _archived(s, d)[1].select("run", "artifacts", "included", "bytes")


QUERIES = {"k6_bundles": k6_bundles, "k6_manifest": k6_manifest, "k6_refused": lambda s, d: bundle_refusals(*bundle_lines(*_store(s, d), SEEN))}
_B = f"""WITH RECURSIVE a AS (SELECT o_orderkey AS k, o_custkey AS created, '{{"id": ' || o_orderkey || ', "status": "' || o_orderstatus || '"}}' AS body, o_orderkey % 1997 = 1203 AS late, (o_orderkey % 4 IN (0, 1) OR o_orderkey % 9 = 2) AS inc FROM orders),
e AS (SELECT DISTINCT k AS p, unnest([k // 2, k // 3]) AS q FROM a WHERE NOT late), d AS (SELECT p, q FROM e WHERE q > 0 AND q IN (SELECT k FROM a)), r AS (SELECT k AS run, k AS id FROM a WHERE k % 50 = 0 AND NOT late UNION SELECT run, q FROM r JOIN d ON d.p = r.id),
j AS (SELECT r.run, r.id, a.*, CASE WHEN late THEN 'absent' WHEN inc AND k % 2003 = 1507 THEN 'body' END AS rule FROM r JOIN a ON a.k = r.id), ok AS (SELECT * FROM j WHERE run NOT IN (SELECT run FROM j WHERE rule IS NOT NULL))"""
ORACLES = {
    "k6_bundles": f"""{_B}, i AS (SELECT p, string_agg(q, ',' ORDER BY q) AS ds FROM d GROUP BY p) SELECT run, row_number() OVER (PARTITION BY run ORDER BY created, id) - 1 AS position, id, coalesce(ds, '') AS dependencies,
CASE WHEN inc THEN 'included' WHEN id % 4 = 2 THEN 'retained_reference' ELSE 'binary_reference' END AS body_status, CASE WHEN inc THEN body ELSE '' END AS body FROM ok LEFT JOIN i ON i.p = ok.id""",
    "k6_manifest": f"{_B} SELECT run, count(*) AS artifacts, count(*) FILTER (inc) AS included, sum(length(body))::BIGINT AS bytes FROM ok GROUP BY run",
    "k6_refused": f"{_B} SELECT run, id, rule FROM j WHERE rule IS NOT NULL",
}
