"""Edits of people: corrections of proposals as transactions, and review commands as logs with undo. Both say what came from what.

A correction is judged and applied for all plans at once by joins. A review command depends on what the ones before it left, so the log of a plan, which one
person writes, is folded by one task in order; plans are dealt over tasks.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from fractions import Fraction
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import _parse_datatype_string

from lexiline.functions.text import blank
from lexiline.operators.segment import GRID_SQL, sentence_grid
from lexiline.sources.timeline import words

# fixed values: how many parents and children an operation has (least, most; null: any number), and the longest identifier
COUNTS = {"adjust_extent": ((1, 1), (1, 1)), "retitle": ((1, 1), (1, 1)), "add": ((0, 0), (1, 1)), "drop": ((1, 1), (0, 0)), "merge": ((2, None), (1, 1)), "split": ((1, 1), (2, None))}
LONGEST_ID = 256
CANDIDATE = "struct<id:string,first:long,last:long,title:string,purpose:string>"


# ---- corrections -----------------------------------------------------------------------------------------------

def patch_refusals(candidates: DataFrame, operations: DataFrame, commands: DataFrame) -> DataFrame:
    """(plan, op, rule) of corrections that can't be made. candidates: (plan, id, first, last, title, purpose); operations: (plan, op, kind, parents, children), children being
    arrays of candidates; commands: (plan, reason, seconds, method), one to a plan. Rules of the command have op null.

    reason, time (without its method, or the other way round, or not a number from 0 on); identity (blank or repeated op), absent, repeated (a parent named twice in one operation), shared (a
    parent of two operations), count (parents or children that the kind doesn't have), kept (an extent or title of another identity), content (a title that changes more), same (nothing
    changes), known (a new identity that exists), twice (a child's identity given twice)."""
    seconds, method = F.col("seconds"), F.col("method")
    time = (seconds.isNull() != method.isNull()) | F.coalesce((seconds < 0) | F.isnan(seconds) | (seconds == float("inf")), F.lit(False)) | F.coalesce(blank("method"), F.lit(False))
    whole = {"reason": F.coalesce(blank("reason"), F.lit(True)), "time": time}
    listed = lambda rules: F.explode(F.filter(F.array(*[F.when(cond, F.lit(rule)) for rule, cond in rules.items()]), lambda x: x.isNotNull())).alias("rule")
    out = commands.select("plan", F.lit(None).cast("string").alias("op"), listed(whole))
    none = F.array()
    ops = operations.withColumns({"parents": F.coalesce("parents", none.cast("array<string>")), "children": F.coalesce("children", none.cast(f"array<{CANDIDATE}>")), "same_op": F.count("*").over(Window.partitionBy("plan", "op"))})
    p, c = F.size("parents"), F.size("children")
    within = lambda n, span: (n >= span[0]) & (F.lit(True) if span[1] is None else n <= span[1])
    fits = reduce(lambda a, kind: a.when(F.col("kind") == kind, within(p, COUNTS[kind][0]) & within(c, COUNTS[kind][1])), COUNTS, F.when(F.lit(False), F.lit(False))).otherwise(F.lit(False))
    own = {"identity": F.coalesce(blank("op"), F.lit(True)) | (F.col("same_op") > 1), "repeated": F.size(F.array_distinct("parents")) < p, "count": ~F.coalesce(fits, F.lit(False))}
    out = out.unionByName(ops.select("plan", "op", listed(own)))
    # an operation's parents and children, each met with the candidate of its identity
    known = candidates.select("plan", F.col("id").alias("known"), F.struct("id", "first", "last", "title", "purpose").alias("prior"))
    number = ops.withColumn("row", F.monotonically_increasing_id())
    parents = number.select("plan", "op", "row", F.explode(F.array_distinct("parents")).alias("known")).join(known, ["plan", "known"], "left").withColumn("uses", F.count("*").over(Window.partitionBy("plan", "known")))
    out = out.unionByName(parents.select("plan", "op", "row", listed({"absent": F.col("prior").isNull(), "shared": F.col("uses") > 1})).distinct().drop("row"))
    keeps = F.col("kind").isin("retitle", "adjust_extent")
    children = number.select("plan", "op", "row", "kind", F.get("parents", F.lit(0)).alias("parent"), F.explode("children").alias("child")).withColumns({"known": F.col("child.id"), "given": F.count("*").over(Window.partitionBy("plan", "child.id"))})
    met = children.join(known, ["plan", "known"], "left")
    untitled = lambda s: F.struct(F.col(f"{s}.id"), F.col(f"{s}.first"), F.col(f"{s}.last"), F.col(f"{s}.purpose"))
    mine = keeps & F.col("known").eqNullSafe(F.col("parent"))
    rules = {
        "kept": keeps & ~F.col("known").eqNullSafe(F.col("parent")), "content": mine & (F.col("kind") == "retitle") & F.col("prior").isNotNull() & ~untitled("child").eqNullSafe(untitled("prior")), "same": mine & F.col("child").eqNullSafe(F.col("prior")),
        "known": ~keeps & F.col("prior").isNotNull(), "twice": F.col("given") > 1,
    }
    return out.unionByName(met.select("plan", "op", "row", listed(rules)).distinct().drop("row"))


def patched_plans(candidates: DataFrame, operations: DataFrame, refused: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Candidates (plan, ord, id, first, last, title, purpose, replaced) after the corrections of plans that aren't refused, by their first sentence, and the lineage
    (plan, child, parent) of what was replaced, parent null for what was added. A plan that is refused stays as it is."""
    fine = operations.join(refused.select("plan").distinct(), "plan", "left_anti")
    gone = fine.select("plan", F.explode("parents").alias("id"))
    new = fine.select("plan", F.explode("children").alias("x")).select("plan", "x.*", F.lit(True).alias("replaced"))
    kept = candidates.select("plan", "id", "first", "last", "title", "purpose", F.lit(False).alias("replaced")).join(gone, ["plan", "id"], "left_anti")
    out = kept.unionByName(new)
    order = (F.row_number().over(Window.partitionBy("plan").orderBy("first", "id")) - 1).cast("long")
    lineage = fine.select("plan", F.explode("children").alias("x"), "parents").select("plan", F.col("x.id").alias("child"), F.explode_outer("parents").alias("parent"))
    return out.select("plan", order.alias("ord"), "id", "first", "last", "title", "purpose", "replaced"), lineage


def remapped_opportunities(opportunities: DataFrame, after: DataFrame, lineage: DataFrame, operations: DataFrame, refused: DataFrame, keys: DataFrame) -> DataFrame:
    """Opportunities (plan, id, candidates, disposition, reason) after the corrections: those that lose a candidate keep the others and are proposed again, or need evidence; each
    replaced or added candidate makes one of its own, named by the command's key (plan, key)."""
    gone = operations.join(refused.select("plan").distinct(), "plan", "left_anti").select("plan", F.explode("parents").alias("candidate")).distinct().withColumn("gone", F.lit(True))
    each = opportunities.select("plan", "id", F.posexplode_outer("candidates").alias("k", "candidate")).join(gone, ["plan", "candidate"], "left")
    left = F.transform(F.array_sort(F.collect_list(F.when(F.col("candidate").isNotNull() & F.col("gone").isNull(), F.struct("k", "candidate")))), lambda x: x["candidate"])
    g = opportunities.join(each.groupBy("plan", "id").agg(left.alias("left"), F.coalesce(F.bool_or("gone"), F.lit(False)).alias("changed")), ["plan", "id"])
    changed = F.col("changed")
    old = g.select(
        "plan", "id", F.when(changed, F.col("left")).otherwise(F.col("candidates")).alias("candidates"), F.when(changed & (F.size("left") > 0), "proposed").when(changed, "needs_evidence").otherwise(F.col("disposition")).alias("disposition"),
        F.when(changed, "Human-corrected treatment; portfolio representation needs review.").otherwise(F.col("reason")).alias("reason"),
    )
    name = F.concat(F.lit("human:"), "key", F.lit(":"), "id")
    named = F.when(F.char_length(name) > LONGEST_ID, F.concat(F.lit("human:"), F.sha2(name, 256))).otherwise(name)
    new = after.filter("replaced").join(keys, "plan").select("plan", named.alias("id"), F.array("id").alias("candidates"), F.lit("proposed").alias("disposition"), F.lit("Human-specified treatment; value and completeness remain unassessed.").alias("reason"))
    return old.unionByName(new)


# ---- review ------------------------------------------------------------------------------------------------------

SECTION = "struct<id:string,kind:string,title:string,flags:array<string>,state:string,reason:string,quotes:array<bigint>,parents:array<string>>"
BOUNDARY = "struct<id:string,num:bigint,den:bigint,risky:boolean,reasons:array<string>>"
COMMAND = "struct<seq:bigint,action:string,section:string,other:string,boundary:string,target_ms:bigint,target:bigint,reason:string,key:string>"
REVIEWED = f"plan long, seq long, revision long, refused string, sections array<{SECTION}>, boundaries array<{BOUNDARY}>"


class Refused(ValueError):
    """A command that its plan's revision doesn't allow."""


class Review:
    """The revisions of one plan: a row of sections between boundaries, and commands that make the next one of it."""

    def __init__(self, sections: list[dict], boundaries: list[dict], rate: Fraction):
        self.edits, self.rate = [(sections, boundaries)], rate

    def do(self, command: dict) -> None:
        sections, boundaries = self.edits[-1]
        action = getattr(self, f"_{command['action']}", None)
        if action is None or command["action"] not in ACTIONS:
            raise Refused("operational")
        if command["action"] != "undo" and command["target"] is not None:
            raise Refused("target")
        self.edits.append(action(list(sections), list(boundaries), command, (command["reason"] or "").strip()))

    @staticmethod
    def _at(sections: list[dict], ident: str | None) -> int:
        found = [i for i, s in enumerate(sections) if s["id"] == ident]
        if ident is None or len(found) != 1:
            raise Refused("section")
        return found[0]

    @staticmethod
    def _marked(section: dict, *flags: str, **change) -> dict:
        return section | {"flags": list(dict.fromkeys([*section["flags"], *flags]))} | change

    def _accept(self, sections, boundaries, command, reason):
        i = self._at(sections, command["section"])
        if not reason and (sections[i]["kind"] == "drop" or boundaries[i]["risky"] or boundaries[i + 1]["risky"]):
            raise Refused("reason")
        sections[i] = self._marked(sections[i], *([f"accepted_reason:{reason}"] if reason else []), state="accepted")
        return sections, boundaries

    def _reject(self, sections, boundaries, command, reason):
        if not reason:
            raise Refused("reason")
        i = self._at(sections, command["section"])
        sections[i] = self._marked(sections[i], f"rejected_reason:{reason}", state="rejected")
        return sections, boundaries

    def _restore(self, sections, boundaries, command, reason):
        i = self._at(sections, command["section"])
        if sections[i]["kind"] != "drop":
            raise Refused("kind")
        sections[i] = self._marked(sections[i], f"restored_reason:{reason}", kind="keep", state="proposed")
        return sections, boundaries

    def _nudge(self, sections, boundaries, command, reason):
        found = [i for i, b in enumerate(boundaries) if b["id"] == command["boundary"]]
        if command["boundary"] is None or command["target_ms"] is None or len(found) != 1 or found[0] in (0, len(boundaries) - 1):
            raise Refused("boundary")
        i = found[0]
        left, right = (Fraction(boundaries[j]["num"], boundaries[j]["den"]) * self.rate for j in (i - 1, i + 1))
        first, last = math.floor(left) + 1, math.ceil(right) - 1
        if first > last:
            raise Refused("room")
        wanted = math.ceil(Fraction(command["target_ms"], 1000) * self.rate - Fraction(1, 2))  # the nearest point, the earlier of two
        time = min(max(wanted, first), last) / self.rate
        reasons = [f"manual_nudge:{reason or 'manual boundary adjustment'}", f"manual_requested_ms:{command['target_ms']}"]
        boundaries[i] = boundaries[i] | {"num": time.numerator, "den": time.denominator, "risky": True, "reasons": reasons}
        for j in (i - 1, i):
            sections[j] = self._marked(sections[j], "manual_boundary_changed", state="proposed")
        return sections, boundaries

    def _merge(self, sections, boundaries, command, reason):
        i, j = self._at(sections, command["section"]), self._at(sections, command["other"])
        if j != i + 1:
            raise Refused("adjacent")
        a, b = sections[i], sections[j]
        if a["kind"] != "keep" or b["kind"] != "keep":
            raise Refused("kind")
        one = {
            "id": f"merge-{command['key']}", "kind": "keep", "title": f"{a['title']} / {b['title']}".strip(" /"), "state": "proposed", "reason": reason or f"Merged {a['id']} and {b['id']}", "flags": list(dict.fromkeys([*a["flags"], *b["flags"], "manual_merge"])),
            "quotes": list(a["quotes"]) + [q for q in dict.fromkeys(b["quotes"]) if q not in set(a["quotes"])], "parents": [a["id"], b["id"]],
        }
        return [*sections[:i], one, *sections[j + 1 :]], [*boundaries[: i + 1], *boundaries[i + 2 :]]

    def _undo(self, sections, boundaries, command, reason):
        if command["target"] is None or not 0 <= command["target"] < len(self.edits) - 1:
            raise Refused("target")
        return self.edits[command["target"]]


ACTIONS = ("accept", "reject", "restore", "nudge", "merge", "undo")


def reviewed(sections: DataFrame, boundaries: DataFrame, commands: DataFrame, rates: DataFrame | None = None) -> DataFrame:
    """(plan, seq, revision, refused, sections, boundaries): what each command of a plan's log made of it, in order of seq; revision 0 (seq null) is the plan as it was.

    sections: (plan, ord, id, kind, title, flags, state, reason, quotes); boundaries: (plan, ord, id, num, den, risky, reasons), in seconds, one more than sections; commands: (plan, seq, action, section, other,
    boundary, target_ms, target, reason, key); rates: (plan, num, den), points of the media's grid in a second, 1000 where there is none. A refused command makes no revision (revision and both arrays
    are null; refused says what it lacks). An undo makes a new revision that is like an earlier one, so that it can be undone too. parents of a section are the two that it was merged from. Commands of plans
    without sections or boundaries give nothing."""
    nested = lambda df, order, fields, name, types: df.groupBy("plan").agg(F.transform(F.array_sort(F.collect_list(F.struct(F.col(order).alias("__o"), F.struct(*fields).cast(types).alias("x")))), lambda x: x["x"]).alias(name))
    s = sections.withColumns({"flags": F.coalesce("flags", F.array().cast("array<string>")), "quotes": F.coalesce("quotes", F.array().cast("array<bigint>")), "parents": F.array().cast("array<string>")})
    p = nested(s, "ord", ["id", "kind", "title", "flags", "state", "reason", "quotes", "parents"], "sections", SECTION).join(nested(boundaries, "ord", ["id", "num", "den", "risky", "reasons"], "boundaries", BOUNDARY), "plan")
    p = p.join(nested(commands, "seq", ["seq", "action", "section", "other", "boundary", "target_ms", "target", "reason", "key"], "commands", COMMAND), "plan", "left")
    p = p.join(rates.select("plan", F.col("num").cast("long").alias("num"), F.col("den").cast("long").alias("den")), "plan", "left") if rates is not None else p.withColumns({"num": F.lit(1000).cast("long"), "den": F.lit(1).cast("long")})
    schema = to_arrow_schema(_parse_datatype_string(REVIEWED))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                review = Review(row["sections"], row["boundaries"], Fraction(row["num"] or 1000, row["den"] or 1))
                out = [{"plan": row["plan"], "seq": None, "revision": 0, "refused": None, "sections": row["sections"], "boundaries": row["boundaries"]}]
                for command in row["commands"] or []:
                    try:
                        review.do(command)
                        made, (now, cuts) = len(review.edits) - 1, review.edits[-1]
                        out.append({"plan": row["plan"], "seq": command["seq"], "revision": made, "refused": None, "sections": now, "boundaries": cuts})
                    except Refused as why:
                        out.append({"plan": row["plan"], "seq": command["seq"], "revision": None, "refused": str(why), "sections": None, "boundaries": None})
                yield pa.RecordBatch.from_pylist(out, schema=schema)

    return p.withColumn("plan", F.col("plan").cast("long")).mapInArrow(run, REVIEWED)


def section_lineage(history: DataFrame) -> DataFrame:
    """(plan, child, parent) of all sections that any revision of a history (`reviewed`) merged, each once."""
    each = history.select("plan", F.explode("sections").alias("x")).select("plan", F.col("x.id").alias("child"), F.explode("x.parents").alias("parent"))
    return each.distinct()


# ---- queries -------------------------------------------------------------------------------------------------

def _videos(s: SparkSession, d: str) -> DataFrame:
    """A candidate for each three sentences of a source."""
    g = sentence_grid(words(s, d)).select("source_id", "sentence_id")
    k = F.expr("sentence_id div 3")
    c = g.groupBy(F.col("source_id").alias("plan"), k.alias("k")).agg(F.min("sentence_id").alias("first"), F.max("sentence_id").alias("last"))
    return c.withColumns({"id": F.concat(F.lit("v"), F.col("k").cast("string")), "title": F.concat(F.lit("title "), F.col("k").cast("string")), "purpose": F.lit("p")})


def _corrections(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Operations on some candidates by their number, with faults in some plans, and the commands."""
    c = _videos(s, d)
    child = lambda ident, first, last, title, purpose="purpose": F.struct(ident.alias("id"), F.expr(first).cast("long").alias("first"), F.expr(last).cast("long").alias("last"), title.alias("title"), F.expr(purpose).alias("purpose"))
    at, ident, new = F.expr("k % 11"), F.col("id"), lambda more: F.concat("id", F.lit(more))
    self_, after = F.array("id"), F.array("id", F.concat(F.lit("v"), (F.col("k") + 1).cast("string")))
    top = F.max("k").over(Window.partitionBy("plan"))
    none = F.array().cast("array<string>")
    ops = c.withColumn("top", top).select(
        "plan", F.concat(F.lit("op"), F.col("k").cast("string")).alias("op"),
        F.when(at == 1, "retitle").when(at == 2, "drop").when((at == 3) & (F.col("k") < F.col("top")), "merge").when(at == 5, "split").when(at == 6, "adjust_extent").when(at == 8, "add").alias("kind"),
        F.when(at == 3, after).when(at == 8, none).otherwise(self_).alias("parents"),
        F.when(at == 1, F.array(child(ident, "first", "last", F.lit("better"), "if(plan % 13 = 3, 'other', purpose)"))).when(at == 2, F.array().cast(f"array<{CANDIDATE}>")).when(at == 3, F.array(child(new("m"), "first", "last + 3", F.lit("both"))))
        .when(at == 5, F.array(child(new("a"), "first", "first", F.lit("a")), child(new("b"), "first + 1", "last", F.lit("b")))).when(at == 6, F.array(child(ident, "first", "if(plan % 13 = 5, last, last + 1)", F.col("title"))))
        .when(at == 8, F.array(child(F.when(F.col("plan") % 13 == 7, ident).otherwise(new("x")), "first", "last", F.lit("new")))).alias("children"),
    ).filter("kind is not null")
    commands = c.select("plan").distinct().select("plan", F.when(F.col("plan") % 13 == 9, " \n").otherwise("because").alias("reason"), F.when(F.col("plan") % 13 == 11, 4.0).alias("seconds"), F.lit(None).cast("string").alias("method"), F.concat(F.lit("key"), F.col("plan").cast("string")).alias("key"))
    return c, ops, commands


def h16_refusals(s: SparkSession, d: str) -> DataFrame:
    return patch_refusals(*_corrections(s, d))


def h16_corrections(s: SparkSession, d: str) -> DataFrame:
    c, ops, commands = _corrections(s, d)
    return patched_plans(c, ops, patch_refusals(c, ops, commands))[0]


def h16_lineage(s: SparkSession, d: str) -> DataFrame:
    c, ops, commands = _corrections(s, d)
    return patched_plans(c, ops, patch_refusals(c, ops, commands))[1]


def h17_review_log(s: SparkSession, d: str) -> DataFrame:
    """A log for each conversation: what each command made, as the number of sections, their states and what was merged."""
    c = _videos(s, d)
    k, plan = F.col("k"), F.col("plan")
    sections = c.select("plan", k.alias("ord"), "id", F.when(k % 5 == 4, "drop").otherwise("keep").alias("kind"), "title", F.array().cast("array<string>").alias("flags"), F.lit("proposed").alias("state"), F.lit("").alias("reason"), F.array("first").alias("quotes"))
    cut = lambda at, ms: F.struct(at.cast("long").alias("ord"), F.concat(F.lit("b"), at.cast("string")).alias("id"), ms.alias("num"), F.lit(10).cast("long").alias("den"), (at % 7 == 3).alias("risky"), F.array(F.lit("pause")).alias("reasons"))
    edges = c.groupBy("plan").agg((F.max("k") + 1).alias("n")).select("plan", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n"))).alias("at"))
    boundaries = edges.select("plan", cut(F.col("at"), F.col("at") * 37).alias("x")).select("plan", "x.*")
    action = F.element_at(F.array(*map(F.lit, ("accept", "merge", "nudge", "reject", "undo", "restore", "undo", "merge"))), (k % 8 + 1).cast("int"))
    name = lambda n: F.concat(F.lit("v"), n.cast("string"))
    commands = c.select(
        "plan", k.alias("seq"), action.alias("action"), name(k).alias("section"), name(k + 1).alias("other"), F.concat(F.lit("b"), k.cast("string")).alias("boundary"), (k * 3700 + plan % 9 * 411).alias("target_ms"),
        F.when(action == "undo", F.greatest(F.lit(0).cast("long"), F.expr("k div 2 - plan % 3"))).alias("target"), F.when((k + plan) % 4 == 1, "said").otherwise(" ").alias("reason"), F.col("id").alias("key"),
    )
    h = reviewed(sections, boundaries, commands)
    states = F.array_join(F.transform("sections", lambda x: F.concat(x["id"], F.lit(":"), x["kind"], F.lit(":"), x["state"], F.lit(":"), F.array_join(x["parents"], "+"))), ",")
    cuts = F.array_join(F.transform("boundaries", lambda x: F.concat(x["num"].cast("string"), F.lit("/"), x["den"].cast("string"))), ",")
    return h.select("plan", "seq", "revision", "refused", F.size("sections").cast("long").alias("n"), F.md5(states).alias("states"), F.md5(cuts).alias("cuts"))


QUERIES = {"h16_refusals": h16_refusals, "h16_corrections": h16_corrections, "h16_lineage": h16_lineage, "h17_review_log": h17_review_log}
_C = f"""{GRID_SQL}, c AS (SELECT source_id AS plan, sentence_id // 3 AS k, min(sentence_id) AS f, max(sentence_id) AS l, 'v' || (sentence_id // 3) AS id FROM grid GROUP BY ALL), t AS (SELECT *, max(k) OVER (PARTITION BY plan) AS top FROM c),
rf AS (SELECT plan, NULL AS op, 'reason' AS rule FROM (SELECT DISTINCT plan FROM c) WHERE plan % 13 = 9 UNION ALL SELECT plan, NULL, 'time' FROM (SELECT DISTINCT plan FROM c) WHERE plan % 13 = 11 UNION ALL SELECT plan, 'op' || k, 'content' FROM c WHERE plan % 13 = 3 AND k % 11 = 1
UNION ALL SELECT plan, 'op' || k, 'same' FROM c WHERE plan % 13 = 5 AND k % 11 = 6 UNION ALL SELECT plan, 'op' || k, 'known' FROM c WHERE plan % 13 = 7 AND k % 11 = 8), ok AS (SELECT * FROM t WHERE plan NOT IN (SELECT plan FROM rf))"""
ORACLES = {
    "h16_refusals": f"WITH {_C} SELECT plan, op, rule FROM rf",
    "h16_corrections": f"""WITH {_C}, nw AS (SELECT plan, id, f AS "first", l AS "last", 'title ' || k AS title, 'p' AS purpose, false AS replaced FROM t WHERE plan IN (SELECT plan FROM rf) OR k % 11 IN (0, 7, 8, 9, 10) OR k % 11 = 3 AND k = top
UNION ALL SELECT plan, id, f, l, 'better', 'p', true FROM ok WHERE k % 11 = 1 UNION ALL SELECT plan, id || 'm', f, l + 3, 'both', 'p', true FROM ok WHERE k % 11 = 3 AND k < top UNION ALL SELECT plan, id || 'a', f, f, 'a', 'p', true FROM ok WHERE k % 11 = 5
UNION ALL SELECT plan, id || 'b', f + 1, l, 'b', 'p', true FROM ok WHERE k % 11 = 5 UNION ALL SELECT plan, id, f, l + 1, 'title ' || k, 'p', true FROM ok WHERE k % 11 = 6 UNION ALL SELECT plan, id || 'x', f, l, 'new', 'p', true FROM ok WHERE k % 11 = 8)
SELECT plan, row_number() OVER (PARTITION BY plan ORDER BY "first", id) - 1 AS ord, id, "first", "last", title, purpose, replaced FROM nw""",
    "h16_lineage": f"""WITH {_C} SELECT plan, id AS child, id AS parent FROM ok WHERE k % 11 IN (1, 6) UNION ALL SELECT plan, id || 'm', 'v' || (k + x) FROM ok, (VALUES (0), (1)) AS v(x) WHERE k % 11 = 3 AND k < top
UNION ALL SELECT plan, id || x, id FROM ok, (VALUES ('a'), ('b')) AS v(x) WHERE k % 11 = 5 UNION ALL SELECT plan, id || 'x', NULL FROM ok WHERE k % 11 = 8""",
}
