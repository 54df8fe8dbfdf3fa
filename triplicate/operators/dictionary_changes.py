"""A makers' dictionary under changes: entries created, edited, deactivated and deleted in order, imports, approvals.

Changes of one code of one maker depend on one another, others don't. So entries and changes meet by maker and code and
stream through in order, with one entry held at a time.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from triplicate.functions.text import normalize_sku
from triplicate.operators.dictionary import CATEGORIES, import_check
from triplicate.sources.scratch import cut

#: What an edit may set; a null sets nothing.
SETTABLE = ("category", "description", "alias_group", "is_primary", "is_current")
ENTRY = "maker string, entry_id long, code string, category string, description string, alias_group string, is_primary boolean, is_current boolean, version int, last_change long"
CHANGE = "change_id long, action string, maker string, entry_id long, code string, category string, description string, alias_group string, is_primary boolean, is_current boolean"
_FIELDS = [f.split()[0] for f in ENTRY.split(", ")]
_STEPS = f"{ENTRY}, change_id long, verdict string"


def _applied(arrow: pa.Schema):
    """Entries after all changes, and a verdict for each change; rows come by maker and code, the entry there is first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: tuple | None = None
        live: dict | None = None
        out: list[tuple] = []

        def flush() -> None:
            if live:
                out.append((*(live[f] for f in _FIELDS), None, None))

        def made() -> pa.RecordBatch:
            columns = list(zip(*out, strict=True)) or [()] * len(arrow)
            out.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, arrow, strict=True)], schema=arrow)

        for batch in batches:
            for row in batch.to_pylist():
                key = (row["maker"], row["normalized"])
                if key != held:
                    flush()
                    held, live = key, None
                if row["action"] is None:
                    if live:  # several entries of one code: only the first takes part in changes
                        out.append((*(row[f] for f in _FIELDS), None, None))
                    else:
                        live = {f: row[f] for f in _FIELDS}
                    continue
                action, n, mine = row["action"], row["change_id"], live is not None and live["entry_id"] == row["entry_id"]
                if mine and live["last_change"] is not None and n <= live["last_change"]:
                    verdict = "Already applied"
                elif action == "CREATE":
                    verdict = "Code cannot be empty" if not row["normalized"] else "Invalid category" if row["category"] not in CATEGORIES else "Code already exists for this manufacturer" if live else None
                    if not verdict:
                        given = lambda f, default: default if row[f] is None else row[f]  # noqa: B023, E731
                        live = {f: row.get(f) for f in _FIELDS} | {"version": 1, "last_change": n, "is_primary": given("is_primary", True), "is_current": given("is_current", True)}
                elif not mine:
                    verdict = "Dictionary entry not found"
                elif action == "DELETE":
                    verdict, live = None, None
                elif action in ("UPDATE", "DEACTIVATE"):
                    verdict = "Invalid category" if action == "UPDATE" and row["category"] is not None and row["category"] not in CATEGORIES else None
                    if not verdict:
                        set_ = {"is_current": False} if action == "DEACTIVATE" else {f: row[f] for f in SETTABLE if row[f] is not None}
                        live |= set_ | {"version": live["version"] + 1, "last_change": n}
                else:
                    verdict = "Unknown action"
                out.append((*[None] * len(_FIELDS), n, verdict or "APPLIED"))
            yield made()
        flush()
        yield made()

    return run


def apply_changes(dictionary: DataFrame, changes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The dictionary (``ENTRY``) after ``changes`` (``CHANGE``), and each change's verdict: APPLIED, or why not.

    Changes of a code are taken in the order of change_id. A code exists once for a maker, whatever its spelling, so of two
    that create it the first wins, until it is deleted. Edits, deactivations and deletions name an entry; an entry that
    isn't there, or isn't any more, is not found. An entry ignores changes up to its ``last_change``: the same changes a
    second time change nothing.
    """
    base = dictionary.withColumn("normalized", normalize_sku(F.col("code")))
    own = changes.withColumn("normalized", normalize_sku(F.col("code")))
    created = own.where("action = 'CREATE'").withColumn("normalized", F.coalesce("normalized", F.lit("")))
    # The code that an entry's number stands for: that of the entry, or of what would create it.
    code_of = base.select("maker", "entry_id", "normalized").unionByName(created.select("maker", "entry_id", "normalized")).groupBy("maker", "entry_id").agg(F.min("normalized").alias("normalized"))
    others = changes.where("action <> 'CREATE' or action is null").join(code_of, ["maker", "entry_id"], "left")
    lost = others.where("normalized is null")
    rows = base.unionByName(created, allowMissingColumns=True).unionByName(others.where("normalized is not null").withColumn("action", F.coalesce("action", F.lit(""))), allowMissingColumns=True)
    n = int(dictionary.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = rows.select(*_FIELDS, "change_id", "action", "normalized").repartition(n, "maker", "normalized").sortWithinPartitions("maker", "normalized", F.col("change_id").asc_nulls_first(), "entry_id")
    steps = cut(ordered.mapInArrow(_applied(to_arrow_schema(StructType.fromDDL(_STEPS))), _STEPS))
    verdicts = steps.where("change_id is not null").select("change_id", "verdict")
    return steps.where("change_id is null").select(*_FIELDS), verdicts.unionByName(lost.select("change_id", F.lit("Dictionary entry not found").alias("verdict")))


def import_changes(rows: DataFrame, dictionary: DataFrame, maker: str, first_entry: int, first_change: int) -> DataFrame:
    """Changes that create the rows of a file (row_id, code, category, description) which are new to a maker's dictionary.

    Invalid rows and duplicates, of the dictionary or of a row before, create nothing.
    """
    mine = dictionary.where(F.col("maker") == maker)
    new = rows.join(import_check(rows, mine).where("verdict = 'NEW'").select("row_id"), "row_id")
    return new.select(
        (F.col("row_id") + first_change).alias("change_id"), F.lit("CREATE").alias("action"), F.lit(maker).alias("maker"), (F.col("row_id") + first_entry).alias("entry_id"), F.trim("code").alias("code"),
        F.upper(F.trim("category")).alias("category"), F.when(F.trim("description") != "", F.trim("description")).alias("description"), *[F.lit(None).cast(t).alias(c) for c, t in (("alias_group", "string"), ("is_primary", "boolean"), ("is_current", "boolean"))],
    )


def approve(rows: DataFrame, dictionary: DataFrame, asked: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Rows of catalogues (maker, row_id, code, category, description, status) after approval, and the rows to be created.

    Pending rows that are ``asked`` for (by row_id; all where it is None) become APPROVED, also those whose code the
    dictionary or a row before has, which create nothing.
    """
    pending = F.col("status") == "PENDING"
    if asked is not None:
        rows = rows.join(asked.select("row_id").distinct().withColumn("asked_", F.lit(True)), "row_id", "left")
        pending = pending & F.coalesce("asked_", F.lit(False))
    code = normalize_sku(F.col("code"))
    known = dictionary.select("maker", normalize_sku(F.col("code")).alias("normalized_"), F.lit(True).alias("known_")).distinct()
    marked = rows.withColumns({"taken_": pending, "normalized_": code}).join(known, ["maker", "normalized_"], "left")
    nth = F.row_number().over(Window.partitionBy("maker", "normalized_", "taken_").orderBy("row_id"))
    marked = marked.withColumn("new_", F.col("taken_") & F.col("known_").isNull() & (nth == 1) & F.col("normalized_").isNotNull())
    after = marked.withColumn("status", F.when(F.col("taken_"), "APPROVED").otherwise(F.col("status")))
    columns = [c for c in rows.columns if c != "asked_"]
    return after.select(*columns), after.where("new_").select(*columns)


def edit_rows(rows: DataFrame, edits: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Pending rows of catalogues with a new code, category or description, or REJECTED; and each edit's verdict.

    ``edits`` has edit_id, row_id, action (UPDATE or REJECT), code, category, description, and is taken in the order of
    edit_id. Only pending rows can be edited; any row can be rejected. A null sets nothing.
    """
    w = Window.partitionBy("row_id").orderBy("edit_id")
    asked = edits.join(rows.select("row_id", "status"), "row_id", "left")
    gone = F.coalesce(F.bool_or(F.col("action") == "REJECT").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(False))
    why = (
        F.when(F.col("status").isNull(), "Spec book row not found").when(F.col("action") == "REJECT", None).when(F.col("action") != "UPDATE", "Unknown action")
        .when(gone | (F.col("status") != "PENDING"), "Only pending rows can be edited")
    )
    judged = asked.withColumn("verdict", F.coalesce(why, F.lit("APPLIED")))
    done = judged.where("verdict = 'APPLIED'")
    last = lambda c: F.max_by(c, F.when(F.col(c).isNotNull() & (F.col("action") == "UPDATE"), F.col("edit_id"))).alias(f"{c}_")
    left = done.groupBy("row_id").agg(last("code"), last("category"), last("description"), F.bool_or(F.col("action") == "REJECT").alias("rejected_"))
    joined = rows.join(left, "row_id", "left")
    new = {c: F.coalesce(f"{c}_", c) for c in ("code", "category", "description")} | {"status": F.when(F.col("rejected_"), "REJECTED").otherwise(F.col("status"))}
    return joined.withColumns(new).select(*rows.columns), judged.select("edit_id", "verdict")
