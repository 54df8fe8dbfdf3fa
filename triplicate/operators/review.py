"""Reviews as a log of requests: which of them hold, why others are refused, and what they leave behind.

A project is in one of the states DRAFT, PROCESSING, REVIEW_REQUIRED, FAILED, COMPLETED and FINALIZED. Runs of processing
are facts of the log. Whether a project may be finalized depends on all that was reviewed before, and whether a review
holds on whether the project was final by then; the rest follows from these. So the log is cut at the few events that
can change a project's state, and only those are decided one after another, with counts of open critical differences in
place of the differences. Everything else is joins and windows.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from triplicate.sources.scratch import cut

#: What a reviewer's action makes of a difference, and what counts as reviewed.
ACTIONS = {"ACCEPT_FINDING": "ACCEPTED", "FALSE_POSITIVE": "FALSE_POSITIVE", "ESCALATE": "ESCALATED", "ACKNOWLEDGE_MFR_CHANGE": "ACKNOWLEDGED"}
REVIEWED = ("ACCEPTED", "FALSE_POSITIVE", "ACKNOWLEDGED")
#: Endings of files that a document may have, and bytes at most.
ENDINGS = (".pdf", ".jpg", ".jpeg", ".png", ".gif", ".bmp", ".webp", ".tif", ".tiff", ".xls", ".xlsx", ".csv", ".txt", ".md", ".doc", ".docx")
LARGEST = 200 * 1024 * 1024
#: The state that each fact of processing leaves.
FACTS = {"PROCESSING_STARTED": "PROCESSING", "PROCESSING_COMPLETED": "REVIEW_REQUIRED", "PROCESSING_FAILED": "FAILED"}
TURNING = ("FINALIZE", "REPLACE_DOCUMENT", *FACTS)

_TURNS = "project_id long, number int, event_id long, state string, before string, reason string"
_SCHEMA = pa.schema([("project_id", pa.int64()), ("number", pa.int32()), ("event_id", pa.int64()), ("state", pa.string()), ("before", pa.string()), ("reason", pa.string())])


@dataclass
class Outcome:
    """``verdicts``: event_id, project_id, kind, accepted, reason. ``differences``: the given columns but ``since``, with
    status and whether one still stands (``kept``). ``projects``: project_id, status. ``audit``: event_id, project_id,
    action, resource_type, resource_id, previous, new, bulk."""

    verdicts: DataFrame
    differences: DataFrame
    projects: DataFrame
    audit: DataFrame


def _kept(df: DataFrame) -> DataFrame:
    """``cut``, and joined by shuffles: such tables grow with the log, but their files are so small that Spark would broadcast them."""
    return cut(df).hint("merge")


def _numbered(events: DataFrame) -> DataFrame:
    """Events with ``number``, the turning events up to them, and whether a run of processing was under way."""
    order = Window.partitionBy("project_id").orderBy("at", "event_id")
    so_far = order.rowsBetween(Window.unboundedPreceding, 0)
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    running = F.last(F.when(F.col("kind").isin(*FACTS), F.col("kind") == "PROCESSING_STARTED"), ignorenulls=True).over(before)
    return events.withColumns({"number": F.count_if(F.col("kind").isin(*TURNING)).over(so_far).cast("int"), "running": F.coalesce(running, F.lit(False))})


def _replacements(turns: DataFrame, documents: DataFrame) -> DataFrame:
    """project_id, number and why a replacement of a document is refused, null if it isn't."""
    asked = turns.where("kind = 'REPLACE_DOCUMENT'").join(documents.select("project_id", "document_type", F.col("document_hash").alias("held"), F.lit(True).alias("known")), ["project_id", "document_type"], "left")
    name = F.lower(F.coalesce("file_name", F.lit("")))
    ending = F.lit(False)
    for e in ENDINGS:
        ending = ending | name.endswith(e)
    why = (
        F.when(F.col("known").isNull(), "Document not found").when(F.col("document_type") == "ORDER", "Legacy Purchase Order documents cannot be replaced")
        .when(F.col("running"), "A cross-check is currently running").when(name == "", "Filename is missing").when(F.coalesce("file_size", F.lit(0)) == 0, "File is empty")
        .when(F.col("file_size") > LARGEST, "File too large").when(~ending, "Unsupported file type")
    )
    # A refused file of the same content leaves the same content, so what is held is the last that was fit.
    order = Window.partitionBy("project_id", "document_type").orderBy("number").rowsBetween(Window.unboundedPreceding, -1)
    last = F.coalesce(F.last(F.when(F.col("unfit").isNull(), F.col("document_hash")), ignorenulls=True).over(order), F.col("held"))
    checked = asked.withColumn("unfit", why).withColumn("last", last)
    same = F.when(F.col("document_hash") == F.col("last"), "The uploaded file is identical to the current document")
    return checked.select("project_id", "number", F.coalesce("unfit", same).alias("refused"))


def _with_epochs(log: DataFrame, documents: DataFrame) -> DataFrame:
    """The log with why turning events are refused, as far as documents tell, and the number of the last one that wiped."""
    refused = _replacements(log.where(F.col("kind").isin(*TURNING)), documents)
    asked = F.col("kind") == "REPLACE_DOCUMENT"
    marked = log.join(refused.withColumn("kind", F.lit("REPLACE_DOCUMENT")), ["project_id", "number", "kind"], "left")
    wipes = (F.col("kind") == "PROCESSING_COMPLETED") | (asked & F.col("refused").isNull())
    so_far = Window.partitionBy("project_id").orderBy("at", "event_id").rowsBetween(Window.unboundedPreceding, 0)
    return marked.withColumn("wipes", wipes).withColumn("epoch", F.coalesce(F.max(F.when(F.col("wipes"), F.col("number"))).over(so_far), F.lit(0)))


def _decided(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """States after each turning event, projects one after another, their rows by number.

    Of open critical differences only counts are held, by the numbers of the stretches in which they are reviewed.
    """
    project, state, at = None, "", 0
    open_: Counter[tuple[int, ...]] = Counter()

    def reviewed() -> None:
        """What is reviewed in the stretch that ends, unless the project was final, is no longer open."""
        if state != "FINALIZED":
            for stretches in [s for s in open_ if at in s]:
                del open_[stretches]

    for batch in batches:
        out = []
        for row in batch.to_pylist():
            if row["project_id"] != project:
                project, state, at = row["project_id"], row["initial"], 0
                open_.clear()
                out.append((project, 0, None, state, None, None))
            if row["event_id"] is None:
                if row["n"]:
                    open_[tuple(row["stretches"])] += row["n"]
                continue
            reviewed()
            at, kind, before, reason = row["number"], row["kind"], state, row["refused"]
            if kind in FACTS:
                state = FACTS[kind]
            elif kind == "FINALIZE":
                reason = (
                    "Project is already finalized" if state == "FINALIZED" else "Project processing is not complete" if state in ("DRAFT", "PROCESSING")
                    else "Cannot finalize project with open Critical discrepancies" if open_ else None
                )
                state = state if reason else "FINALIZED"
            elif not reason:
                state = "DRAFT"
            if row["wipes"]:
                open_.clear()
            out.append((project, at, row["event_id"], state, before, reason))
        columns = list(zip(*out, strict=True)) or [()] * len(_SCHEMA)
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _SCHEMA, strict=True)], schema=_SCHEMA)


def _born(rows: DataFrame, turns: DataFrame) -> DataFrame:
    """Rows with ``born``: how many turning events of their project were before ``since``; 0 for what always was.

    What is found at the time of a wiping event is found after it.
    """
    marks = turns.select("project_id", F.col("at").alias("since"), "number", F.when(F.col("wipes"), 0).otherwise(2).alias("kind_"))
    both = rows.withColumns({"number": F.lit(None).cast("int"), "kind_": F.lit(1)}).unionByName(marks, allowMissingColumns=True)
    so_far = Window.partitionBy("project_id").orderBy("since", "kind_", "number").rowsBetween(Window.unboundedPreceding, 0)
    return both.withColumn("born", F.coalesce(F.max("number").over(so_far), F.lit(0))).where("kind_ = 1").drop("number", "kind_")


def review_log(projects: DataFrame, documents: DataFrame, differences: DataFrame, members: DataFrame, events: DataFrame) -> Outcome:
    """What a log of requests comes to.

    ``projects``: project_id, status. ``documents``: project_id, document_type, document_hash. ``differences``:
    difference_id, project_id, group_id, severity, since (null: from the start). ``members``: project_id, group_id,
    item_id, field, value, since. ``events``: event_id, project_id, at, kind, difference_id, group_id, item_id, field,
    value, document_type, document_hash, file_name, file_size. Kinds are those of ``ACTIONS`` and ``TURNING``,
    BULK_ACCEPT and OVERRIDE_DATA. Events of one time go by event_id. A finished run and a replaced document wipe what
    was found before. Events of an unknown project, of an unknown kind, and on what isn't there are refused.
    """
    projects, documents = projects.hint("merge"), documents.hint("merge")
    known = events.join(projects.select("project_id", F.col("status").alias("initial")), "project_id", "left")
    log = _kept(_with_epochs(_numbered(known.where("initial is not null")), documents))
    lost = known.where("initial is null").select("event_id", "project_id", "kind", F.lit("Project not found").alias("reason"))
    turns = log.where(F.col("kind").isin(*TURNING))
    found = _kept(_born(differences, turns))
    groups = _kept(_born(members.select("project_id", "group_id", "item_id", "since").distinct(), turns))
    there = lambda x: F.col(f"{x}.born").between(F.col("e.epoch"), F.col("e.number")) & (F.col(f"{x}.since").isNull() | (F.col(f"{x}.since") <= F.col("e.at")))
    d, e = found.alias("d"), log.alias("e")
    of_project = F.col("e.project_id") == F.col("d.project_id")
    direct = e.where(F.col("e.kind").isin(*ACTIONS)).join(d, of_project & (F.col("e.difference_id") == F.col("d.difference_id")) & there("d"), "left")
    overrides = _placed(e.where("e.kind = 'OVERRIDE_DATA'"), groups, there)
    beaten = overrides.where("item_there").alias("e").join(d, of_project & (F.col("e.group_id") == F.col("d.group_id")) & there("d"))

    # Turning events one after another, with the counts of critical differences by the stretches in which they are reviewed.
    touched = [x.where("d.severity = 'Critical'").select("d.project_id", "d.difference_id", "e.number") for x in (direct, beaten)]
    stretches = touched[0].unionByName(touched[1]).groupBy("project_id", "difference_id").agg(F.array_sort(F.collect_set("number")).alias("stretches"))
    counted = found.where("severity = 'Critical'").join(stretches, ["project_id", "difference_id"], "left")
    counts = counted.groupBy("project_id", F.col("born").alias("number"), F.coalesce("stretches", F.array().cast("array<int>")).alias("stretches")).agg(F.count("*").alias("n"))
    initial = projects.select("project_id", F.col("status").alias("initial"))
    columns = ["project_id", "initial", "number", "event_id", "kind", "refused", "wipes"]
    rows = turns.select(*columns).unionByName(counts.join(initial, "project_id"), allowMissingColumns=True).unionByName(initial.withColumn("number", F.lit(0)), allowMissingColumns=True)
    n = int(events.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = rows.select(*columns, "stretches", "n").repartition(n, "project_id").sortWithinPartitions("project_id", "number", F.col("event_id").asc_nulls_last())
    states = _kept(ordered.mapInArrow(_decided, _TURNS))
    turned = states.where("event_id is not null")

    # Everything else in the state that its project was in by then.
    stretch = states.select("project_id", "number", "state")
    in_state = lambda df: df.join(stretch, ["project_id", "number"])
    final = F.when(F.col("state") == "FINALIZED", "Cannot modify a finalized project")
    named = F.col("d.difference_id").isNotNull().alias("difference_there")
    reviews = in_state(direct.select("e.*", named)).withColumn("reason", F.when(~F.col("difference_there"), "Discrepancy not found").otherwise(final))
    why = F.when(~F.col("group_there"), "MatchGroup not found").otherwise(F.coalesce(final, F.when(~F.col("item_there"), "Item does not belong to this MatchGroup")))
    overrides = _kept(in_state(overrides).withColumn("reason", why))
    bulk = in_state(log.where("kind = 'BULK_ACCEPT'")).withColumn("reason", final)
    other = log.where(~F.col("kind").isin(*ACTIONS, *TURNING, "OVERRIDE_DATA", "BULK_ACCEPT")).withColumn("reason", F.lit("Unknown action"))
    verdicts = lost.unionByName(turned.join(turns.select("event_id", "project_id", "kind"), ["event_id", "project_id"]).select(*lost.columns))
    for part in (reviews, overrides, bulk, other):
        verdicts = verdicts.unionByName(part.select(*lost.columns))
    verdicts = verdicts.select("event_id", "project_id", "kind", F.col("reason").isNull().alias("accepted"), "reason")

    # What holds of it, on each difference in order. Only what is open yields to an override or to accepting all.
    held = reviews.where("reason is null").select("project_id", "difference_id", "at", "event_id", F.col("kind").alias("action"), F.lit(False).alias("if_open"))
    beaten = in_state(beaten.select("e.project_id", "e.number", "d.difference_id", "e.at", "e.event_id", F.lit("OVERRIDE_DATA").alias("action"), F.lit(True).alias("if_open")))
    held = held.unionByName(beaten.where(final.isNull()).drop("number", "state"))
    held = held.unionByName(_next_bulk(found.where("severity <> 'Critical'"), bulk.where("reason is null")))
    by_difference = Window.partitionBy("project_id", "difference_id").orderBy("at", "event_id")
    effective = held.withColumn("nth", F.row_number().over(by_difference)).where("nth = 1 or not if_open")
    outcome = F.create_map(*(F.lit(x) for pair in {**ACTIONS, "BULK_ACCEPT": "ACCEPTED", "OVERRIDE_DATA": "SUPERSEDED"}.items() for x in pair))
    steps = effective.withColumn("new", outcome[F.col("action")]).withColumn("previous", F.lag("new", 1, "OPEN").over(by_difference))
    steps = _kept(steps)
    left = steps.groupBy("project_id", "difference_id").agg(F.max_by("new", F.struct("at", "event_id")).alias("status"))
    epochs = log.groupBy("project_id").agg(F.max("epoch").alias("epoch"))
    after = found.join(left, ["project_id", "difference_id"], "left").join(epochs, "project_id", "left")
    columns = [c for c in differences.columns if c != "since"]
    after = after.select(*columns, F.coalesce("status", F.lit("OPEN")).alias("status"), (F.col("born") >= F.coalesce("epoch", F.lit(0))).alias("kept"))
    now = states.groupBy("project_id").agg(F.max_by("state", "number").alias("status"))
    return Outcome(verdicts, after, now, _audit(steps, overrides.where("reason is null"), members, turned))


def _placed(asked: DataFrame, groups: DataFrame, there) -> DataFrame:
    """Overrides with whether their group, and their item in it, were there at the time."""
    same = (F.col("e.project_id") == F.col("g.project_id")) & (F.col("e.group_id") == F.col("g.group_id"))
    met = asked.join(groups.alias("g"), same & there("g")).groupBy("e.project_id", "e.event_id").agg(F.bool_or(F.col("g.item_id").eqNullSafe(F.col("e.item_id"))).alias("item_there"))
    joined = asked.join(met, ["project_id", "event_id"], "left")
    return joined.select(*asked.columns, F.col("item_there").isNotNull().alias("group_there"), F.coalesce("item_there", F.lit(False)).alias("item_there"))


def _next_bulk(found: DataFrame, bulk: DataFrame) -> DataFrame:
    """For each difference the first accepting of all after it was found, if it still stood then."""
    calls = bulk.select("project_id", F.col("number").alias("born"), F.col("at").alias("since"), F.lit(1).alias("kind_"), F.struct("at", "event_id", "epoch").alias("call"))
    both = found.select("project_id", "difference_id", "born", "since", F.lit(0).alias("kind_")).unionByName(calls, allowMissingColumns=True)
    ordered = Window.partitionBy("project_id").orderBy(F.col("born").desc(), F.col("since").desc_nulls_last(), F.col("kind_").desc(), F.col("call.event_id").desc_nulls_first())
    next_ = F.last("call", ignorenulls=True).over(ordered.rowsBetween(Window.unboundedPreceding, 0))
    met = both.withColumn("next", next_).where((F.col("kind_") == 0) & (F.col("born") >= F.col("next.epoch")))
    return met.select("project_id", "difference_id", "next.at", "next.event_id", F.lit("BULK_ACCEPT").alias("action"), F.lit(True).alias("if_open"))


def _audit(steps: DataFrame, overrides: DataFrame, members: DataFrame, turned: DataFrame) -> DataFrame:
    """One row for each change that a person made: of a difference, of an item's field, of a project."""
    bulk = F.col("action") == "BULK_ACCEPT"
    of_difference = steps.where("action <> 'OVERRIDE_DATA'").select(
        "event_id", "project_id", F.when(bulk, "ACCEPT_FINDING").otherwise(F.col("action")).alias("action"), F.lit("Discrepancy").alias("resource_type"),
        F.col("difference_id").cast("string").alias("resource_id"), "previous", "new", bulk.alias("bulk"),
    )
    base = members.groupBy("project_id", "item_id", "field").agg(F.min_by("value", F.coalesce("since", F.lit("1970-01-01").cast("timestamp"))).alias("base"))
    w = Window.partitionBy("project_id", "item_id", "field").orderBy("at", "event_id")
    set_ = overrides.join(base.hint("merge"), ["project_id", "item_id", "field"], "left").withColumns({"nth": F.row_number().over(w), "earlier": F.lag("value").over(w)})
    of_item = set_.select(
        "event_id", "project_id", F.lit("OVERRIDE_DATA").alias("action"), F.lit("CanonicalLineItem").alias("resource_type"), F.col("item_id").cast("string").alias("resource_id"),
        F.when(F.col("nth") == 1, F.col("base")).otherwise(F.col("earlier")).alias("previous"), F.col("value").alias("new"), F.lit(False).alias("bulk"),
    )
    of_project = turned.where("state = 'FINALIZED' and before <> 'FINALIZED'").select(
        "event_id", "project_id", F.lit("PROJECT_FINALIZED").alias("action"), F.lit("Project").alias("resource_type"), F.col("project_id").cast("string").alias("resource_id"),
        F.col("before").alias("previous"), F.col("state").alias("new"), F.lit(False).alias("bulk"),
    )
    return of_difference.unionByName(of_item).unionByName(of_project)


def rank() -> Column:
    """The order in which severities are shown."""
    return F.when(F.col("severity") == "Critical", 1).when(F.col("severity") == "Warning", 3).otherwise(4)


def filtered(differences: DataFrame, texts: tuple[str, ...], status: str | None = None, severity: str | None = None, search: str | None = None) -> DataFrame:
    """Differences of a status and a severity, whatever their case, and with a text in any of ``texts``; none filters nothing."""
    for column, value in (("status", status), ("severity", severity)):
        differences = differences.where(F.upper(column) == value.upper()) if value else differences
    word = (search or "").strip().lower()
    hit = F.lit(not word)
    for t in texts if word else ():
        hit = hit | F.coalesce(F.contains(F.lower(F.col(t).cast("string")), F.lit(word)), F.lit(False))
    return differences.where(hit)


def summary(differences: DataFrame) -> DataFrame:
    """How many differences are open, escalated and reviewed, and how many of each severity, in one row."""
    s, v = (lambda *x: F.count_if(F.col("status").isin(*x))), (lambda x: F.count_if(F.col("severity") == x))
    none = F.lit(0).cast("long")
    return differences.agg(
        s("OPEN").alias("open"), s("ESCALATED").alias("escalated"), s(*REVIEWED).alias("reviewed"), v("Critical").alias("critical"), none.alias("high"), v("Warning").alias("warning"), v("Info").alias("info")
    )


def may_finalize(projects: DataFrame, differences: DataFrame) -> DataFrame:
    """Each project's verdict: FINAL already, INCOMPLETE, BLOCKED by open critical differences, or READY."""
    blocked = differences.where("status = 'OPEN' and severity = 'Critical'").select("project_id").distinct().withColumn("blocked", F.lit(True))
    verdict = F.when(F.col("status") == "FINALIZED", "FINAL").when(F.col("status").isin("DRAFT", "PROCESSING"), "INCOMPLETE").when(F.col("blocked"), "BLOCKED").otherwise("READY")
    return projects.hint("merge").join(blocked, "project_id", "left").select("project_id", verdict.alias("verdict"))
