"""Queries over logs of reviews: events of a user stand in for requests on a project.

Each project has three documents at most, eight differences in four groups, and two items in each group; some of the
differences and groups are found by the first or last completed run.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from triplicate.operators import review
from triplicate.sources.line_items import table
from triplicate.sources.scratch import stored

_STATES = ("DRAFT", "PROCESSING", "REVIEW_REQUIRED", "FAILED", "COMPLETED", "FINALIZED")
_KINDS = (
    "ACCEPT_FINDING", "FALSE_POSITIVE", "ESCALATE", "ACKNOWLEDGE_MFR_CHANGE", "ACCEPT_FINDING", "OVERRIDE_DATA", "FINALIZE", "REPLACE_DOCUMENT", "PROCESSING_STARTED", "PROCESSING_COMPLETED",
    "BULK_ACCEPT", "ACKNOWLEDGE_MFR_CHANGE", "OVERRIDE_DATA", "FINALIZE", "ESCALATE", "PROCESSING_FAILED", "ACCEPT_FINDING", "FALSE_POSITIVE", "REPLACE_DOCUMENT", "NOTE",
)
_TYPES = ("DESIGN", "ORDER", "ACKNOWLEDGEMENT")
_FILES = ("x.PDF", "y.xlsx", "z.exe", "a.csv", "", "b.png")
_SEVERITIES = ("Critical", "Warning", "Info")
_DIFFERENCES, _GROUPS = 8, 4


def _nth(values: tuple[str, ...], n) -> F.Column:
    return F.element_at(F.lit(list(values)), (n % len(values) + 1).cast("int"))


def _requests(events: DataFrame) -> DataFrame:
    n, tenth = F.col("event_id"), F.floor(F.col("event_id") / 20)
    return events.select(
        "event_id", F.col("user_id").alias("project_id"), F.col("ts").cast("timestamp").alias("at"), _nth(_KINDS, n).alias("kind"), (F.col("user_id") * 100 + tenth % 9).alias("difference_id"),
        (tenth % 5).alias("group_id"), F.concat(F.lit("i"), F.floor(n / 100) % 5).alias("item_id"), F.lit("finish").alias("field"), F.concat(F.lit("v"), n).alias("value"),
        _nth(_TYPES, tenth).alias("document_type"), F.concat(F.lit("h"), F.floor(n / 60) % 3).alias("document_hash"), _nth(_FILES, tenth).alias("file_name"), (tenth % 7 * 1000).alias("file_size"),
    )


def _tables(spark, sf_dir) -> tuple[DataFrame, ...]:
    """projects, documents, differences, members and events, the arguments of ``review_log``."""
    asked = _requests(table(spark, sf_dir, "events"))
    runs = F.when(F.col("kind") == "PROCESSING_COMPLETED", F.col("at"))
    users = asked.groupBy("project_id").agg(F.min(runs).alias("first"), F.max(runs).alias("last"))
    p = F.col("project_id")
    projects = users.select("project_id", _nth(_STATES, p).alias("status"))
    documents = users.select("project_id", F.explode(F.lit(list(_TYPES))).alias("document_type"), F.concat(F.lit("h"), p % 3).alias("document_hash"))
    documents = documents.where("document_type <> 'ACKNOWLEDGEMENT' or project_id % 4 <> 0")
    since = F.when(F.col("i") == 5, F.col("first")).when(F.col("i") > 5, F.col("last"))
    each = users.select("*", F.explode(F.sequence(F.lit(0), F.lit(_DIFFERENCES - 1))).alias("i"))
    differences = each.select((p * 100 + F.col("i")).alias("difference_id"), "project_id", (F.col("i") % _GROUPS).cast("long").alias("group_id"), _nth(_SEVERITIES, p + F.col("i")).alias("severity"), since.alias("since"))
    placed = users.select("*", F.explode(F.sequence(F.lit(0), F.lit(_GROUPS - 1))).alias("g")).select("*", F.explode(F.array("g", (F.col("g") + 1) % 5)).alias("i"))
    names = placed.select("project_id", F.col("g").cast("long").alias("group_id"), F.concat(F.lit("i"), "i").alias("item_id"), F.lit("finish").alias("field"), F.concat(F.lit("f"), "i").alias("value"), "last")
    always = names.withColumn("last", F.lit(None).cast("timestamp"))
    members = always.unionByName(names.where("group_id < 2 and last is not null")).withColumnRenamed("last", "since")
    return projects, documents, differences, members, asked


def _outcome(spark, sf_dir) -> review.Outcome:
    """The log decided once and stored: its verdicts, differences, projects and audit rows."""
    events = [f"{sf_dir}/events.parquet"]
    kept: dict[str, review.Outcome] = {}

    def part(name: str):
        def build() -> DataFrame:
            kept["out"] = kept.get("out") or review.review_log(*_tables(spark, sf_dir))
            return getattr(kept["out"], name)

        return stored(f"review-{name}", spark, events, build)

    return review.Outcome(*(part(name) for name in ("verdicts", "differences", "projects", "audit")))


def review_verdicts(spark, sf_dir):
    """Every request with whether it holds, and why not."""
    return _outcome(spark, sf_dir).verdicts


def review_audit(spark, sf_dir):
    """What people changed, one row for each change."""
    return _outcome(spark, sf_dir).audit


def review_states(spark, sf_dir):
    return _outcome(spark, sf_dir).projects


def review_outcomes(spark, sf_dir):
    return _outcome(spark, sf_dir).differences


def review_filter(spark, sf_dir):
    """Differences that still stand, by status, by severity and by a word in any of their texts; the gravest first."""
    rows = _outcome(spark, sf_dir).differences.where("kept").select("*", F.concat(F.lit("SKU-"), "difference_id").alias("sku"), F.concat(F.lit("v"), "group_id").alias("design_value"))
    found = review.filtered(rows, ("sku", "design_value"), status="accepted", severity=None, search="-1")
    return found.orderBy(review.rank(), "difference_id").select("difference_id", "severity", "status").limit(100)


def review_counts(spark, sf_dir):
    return review.summary(_outcome(spark, sf_dir).differences.where("kept"))


def finalize_gate(spark, sf_dir):
    """Whether each project may be finalized after all that the log holds."""
    out = _outcome(spark, sf_dir)
    return review.may_finalize(out.projects, out.differences.where("kept"))


def latest_reviews(spark, sf_dir):
    """The last person's change to each difference, over the audit rows."""
    rows = _outcome(spark, sf_dir).audit.where("resource_type = 'Discrepancy'")
    w = Window.partitionBy("resource_id").orderBy(F.col("event_id").desc())
    return rows.withColumn("nth", F.row_number().over(w)).where("nth = 1").select("resource_id", "event_id", "action", "previous", "new", "bulk")


def _listed(values) -> str:
    return "[" + ", ".join(f"'{v}'" for v in values) + "]"


#: The same log as a fold in SQL: one step for each event of a project, with everything that it holds in lists.
_FOLD = f"""WITH RECURSIVE ev AS (SELECT event_id, user_id AS p, ts AS tm, {_listed(_KINDS)}[event_id % 20 + 1] AS kind, event_id // 20 % 9 AS di, event_id // 20 % 5 AS g, event_id // 100 % 5 AS it,
    event_id // 20 % 3 + 1 AS dn, 'h' || event_id // 60 % 3 AS h, lower({_listed(_FILES)}[event_id // 20 % 6 + 1]) AS fname, event_id // 20 % 7 AS fsize,
    row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events),
  c AS (SELECT p, min(tm) FILTER (kind = 'PROCESSING_COMPLETED') AS c1, max(tm) FILTER (kind = 'PROCESSING_COMPLETED') AS c2 FROM ev GROUP BY p),
  s AS (SELECT p, c1, c2, 0::BIGINT AS n, NULL::BIGINT AS event_id, NULL::VARCHAR AS kind, NULL::VARCHAR AS why, {_listed(_STATES)}[p % 6 + 1] AS status, NULL::VARCHAR AS before, false AS running, NULL::TIMESTAMP AS wiped,
      list_transform(range({_DIFFERENCES}), lambda i: 'OPEN') AS st, list_transform(range({_DIFFERENCES}), lambda i: 'OPEN') AS old,
      ['h' || p % 3, 'h' || p % 3, CASE WHEN p % 4 <> 0 THEN 'h' || p % 3 END] AS docs, list_transform(range(5), lambda i: 'f' || i) AS vals, NULL::BIGINT AS it, NULL::VARCHAR AS was, NULL::BOOLEAN[] AS al FROM c
    UNION ALL
    SELECT p, c1, c2, n, event_id, kind, why, CASE WHEN why IS NOT NULL THEN status WHEN kind = 'FINALIZE' THEN 'FINALIZED' WHEN kind = 'REPLACE_DOCUMENT' THEN 'DRAFT' WHEN kind = 'PROCESSING_STARTED' THEN 'PROCESSING'
        WHEN kind = 'PROCESSING_COMPLETED' THEN 'REVIEW_REQUIRED' WHEN kind = 'PROCESSING_FAILED' THEN 'FAILED' ELSE status END, status,
      CASE WHEN kind LIKE 'PROCESSING_%' THEN kind = 'PROCESSING_STARTED' ELSE running END, CASE WHEN kind = 'PROCESSING_COMPLETED' OR kind = 'REPLACE_DOCUMENT' AND why IS NULL THEN tm ELSE wiped END,
      list_transform(st, lambda x, i: CASE WHEN why IS NOT NULL OR NOT al[i] THEN x WHEN kind = 'BULK_ACCEPT' AND x = 'OPEN' AND (p + i - 1) % 3 <> 0 THEN 'ACCEPTED' WHEN kind = 'OVERRIDE_DATA' AND x = 'OPEN' AND (i - 1) % {_GROUPS} = g THEN 'SUPERSEDED'
        WHEN i = di + 1 AND outcome IS NOT NULL THEN outcome ELSE x END), st,
      CASE WHEN kind = 'REPLACE_DOCUMENT' AND why IS NULL THEN list_transform(docs, lambda x, i: CASE WHEN i = dn THEN h ELSE x END) ELSE docs END,
      CASE WHEN kind = 'OVERRIDE_DATA' AND why IS NULL THEN list_transform(vals, lambda x, i: CASE WHEN i = it + 1 THEN 'v' || event_id ELSE x END) ELSE vals END, it, vals[it + 1], al
    FROM (SELECT *, CASE
        WHEN outcome IS NOT NULL THEN CASE WHEN di = {_DIFFERENCES} OR NOT al[di + 1] THEN 'Discrepancy not found' WHEN status = 'FINALIZED' THEN 'Cannot modify a finalized project' END
        WHEN kind = 'BULK_ACCEPT' THEN CASE WHEN status = 'FINALIZED' THEN 'Cannot modify a finalized project' END
        WHEN kind = 'OVERRIDE_DATA' THEN CASE WHEN g >= {_GROUPS} OR NOT (wiped IS NULL OR g < 2 AND coalesce(c2 <= tm AND c2 >= wiped, false)) THEN 'MatchGroup not found' WHEN status = 'FINALIZED' THEN 'Cannot modify a finalized project'
          WHEN it <> g AND it <> (g + 1) % 5 THEN 'Item does not belong to this MatchGroup' END
        WHEN kind = 'FINALIZE' THEN CASE WHEN status = 'FINALIZED' THEN 'Project is already finalized' WHEN status IN ('DRAFT', 'PROCESSING') THEN 'Project processing is not complete'
          WHEN len(list_filter(st, lambda x, i: x = 'OPEN' AND al[i] AND (p + i - 1) % 3 = 0)) > 0 THEN 'Cannot finalize project with open Critical discrepancies' END
        WHEN kind = 'REPLACE_DOCUMENT' THEN CASE WHEN docs[dn] IS NULL THEN 'Document not found' WHEN dn = 2 THEN 'Legacy Purchase Order documents cannot be replaced' WHEN running THEN 'A cross-check is currently running'
          WHEN fname = '' THEN 'Filename is missing' WHEN fsize = 0 THEN 'File is empty' WHEN fname LIKE '%.exe' THEN 'Unsupported file type' WHEN docs[dn] = h THEN 'The uploaded file is identical to the current document' END
        WHEN kind LIKE 'PROCESSING_%' THEN NULL ELSE 'Unknown action' END AS why
      FROM (SELECT s.p, s.c1, s.c2, e.n, e.event_id, e.kind, s.status, s.running, s.wiped, s.st, s.docs, s.vals, e.tm, e.di, e.g, e.it, e.dn, e.h, e.fname, e.fsize,
          list_transform([NULL, NULL, NULL, NULL, NULL, s.c1, s.c2, s.c2]::TIMESTAMP[], lambda t: CASE WHEN t IS NULL THEN s.wiped IS NULL ELSE t <= e.tm AND (s.wiped IS NULL OR t >= s.wiped) END) AS al,
          CASE e.kind WHEN 'ACCEPT_FINDING' THEN 'ACCEPTED' WHEN 'FALSE_POSITIVE' THEN 'FALSE_POSITIVE' WHEN 'ESCALATE' THEN 'ESCALATED' WHEN 'ACKNOWLEDGE_MFR_CHANGE' THEN 'ACKNOWLEDGED' END AS outcome
        FROM s JOIN ev e ON e.p = s.p AND e.n = s.n + 1) AS joined) AS judged),
  steps AS (SELECT * FROM s WHERE n > 0),
  ends AS (SELECT p, arg_max(status, n) AS status, arg_max(st, n) AS st, arg_max(wiped, n) AS wiped, any_value(c1) AS c1, any_value(c2) AS c2 FROM s GROUP BY p),
  d AS (SELECT p * 100 + i AS difference_id, p AS project_id, i % {_GROUPS} AS group_id, {_listed(_SEVERITIES)}[(p + i) % 3 + 1] AS severity, st[i + 1] AS status,
      CASE WHEN i < 5 OR (CASE WHEN i = 5 THEN c1 ELSE c2 END) IS NULL THEN wiped IS NULL ELSE wiped IS NULL OR (CASE WHEN i = 5 THEN c1 ELSE c2 END) >= wiped END AS kept
    FROM (SELECT *, unnest(range({_DIFFERENCES})) AS i FROM ends) AS each),
  a AS (SELECT event_id, p AS project_id, CASE WHEN kind = 'BULK_ACCEPT' THEN 'ACCEPT_FINDING' ELSE kind END AS action, 'Discrepancy' AS resource_type, CAST(p * 100 + i - 1 AS VARCHAR) AS resource_id, old[i] AS previous, st[i] AS new, kind = 'BULK_ACCEPT' AS bulk
      FROM (SELECT *, unnest(range(1, {_DIFFERENCES + 1})) AS i, NULL FROM steps WHERE why IS NULL AND kind = 'BULK_ACCEPT') AS each WHERE old[i] <> st[i]
    UNION ALL SELECT t.event_id, t.p, t.kind, 'Discrepancy', CAST(t.p * 100 + e.di AS VARCHAR), old[e.di + 1], st[e.di + 1], false FROM steps t JOIN ev e ON e.event_id = t.event_id WHERE why IS NULL AND t.kind IN ('ACCEPT_FINDING', 'FALSE_POSITIVE', 'ESCALATE', 'ACKNOWLEDGE_MFR_CHANGE')
    UNION ALL SELECT event_id, p, kind, 'CanonicalLineItem', 'i' || it, was, 'v' || event_id, false FROM steps WHERE why IS NULL AND kind = 'OVERRIDE_DATA'
    UNION ALL SELECT event_id, p, 'PROJECT_FINALIZED', 'Project', CAST(p AS VARCHAR), before, 'FINALIZED', false FROM steps WHERE why IS NULL AND kind = 'FINALIZE')"""

SQL = {
    "review_verdicts": f"{_FOLD} SELECT event_id, p AS project_id, kind, why IS NULL AS accepted, why AS reason FROM steps",
    "review_audit": f"{_FOLD} SELECT * FROM a",
    "review_states": f"{_FOLD} SELECT p AS project_id, status FROM ends",
    "review_outcomes": f"{_FOLD} SELECT * FROM d",
    "review_filter": f"{_FOLD} SELECT difference_id, severity, status FROM d WHERE kept AND status = 'ACCEPTED' AND (contains('sku-' || difference_id, '-1') OR contains('v' || group_id, '-1')) ORDER BY CASE severity WHEN 'Critical' THEN 1 WHEN 'Warning' THEN 3 ELSE 4 END, difference_id LIMIT 100",
    "review_counts": f"""{_FOLD} SELECT count(*) FILTER (status = 'OPEN') AS open, count(*) FILTER (status = 'ESCALATED') AS escalated, count(*) FILTER (status IN ('ACCEPTED', 'FALSE_POSITIVE', 'ACKNOWLEDGED')) AS reviewed,
        count(*) FILTER (severity = 'Critical') AS critical, 0::BIGINT AS high, count(*) FILTER (severity = 'Warning') AS warning, count(*) FILTER (severity = 'Info') AS info FROM d WHERE kept""",
    "finalize_gate": f"""{_FOLD} SELECT p AS project_id, CASE WHEN e.status = 'FINALIZED' THEN 'FINAL' WHEN e.status IN ('DRAFT', 'PROCESSING') THEN 'INCOMPLETE'
        WHEN EXISTS (SELECT 1 FROM d WHERE d.project_id = e.p AND kept AND d.status = 'OPEN' AND severity = 'Critical') THEN 'BLOCKED' ELSE 'READY' END AS verdict FROM ends e""",
    "latest_reviews": f"""{_FOLD} SELECT resource_id, event_id, action, previous, new, bulk FROM (SELECT *, row_number() OVER (PARTITION BY resource_id ORDER BY event_id DESC) AS nth FROM a WHERE resource_type = 'Discrepancy') WHERE nth = 1""",
}
QUERIES = [review_verdicts, review_audit, review_states, review_outcomes, review_filter, review_counts, finalize_gate, latest_reviews]
