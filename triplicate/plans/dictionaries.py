"""Queries over changes of makers' dictionaries and over tables kept by key; events stand in for changes."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from triplicate.operators import dictionary_changes as changes
from triplicate.operators.matching import match_units
from triplicate.operators.units import aggregate_units
from triplicate.plans import reconciliation as r
from triplicate.sources import store
from triplicate.sources.line_items import ITEMS_SQL, line_items, table
from triplicate.sources.scratch import shared_folder, stored

#: Makers and codes of each; codes whose numbers come to an even sum with the maker's are there from the start.
_MAKERS, _CODES = 25, 40
_ROUND = _MAKERS * _CODES
_ACTIONS = ("CREATE", "UPDATE", "CREATE", "DEACTIVATE", "UPDATE", "DELETE", "CREATE", "RENAME")
_KINDS = ("CABINET", "PANEL", "FILLER", "GADGET", "MOLDING")


def _nth(values, n) -> F.Column:
    return F.element_at(F.lit(list(values)), (n % len(values) + 1).cast("int"))


def _dictionary(spark) -> DataFrame:
    """The first entries: as many as half of all makers' codes."""
    m, c = F.floor(F.col("id") / _CODES), F.col("id") % _CODES
    rows = spark.range(_ROUND).where((m + c) % 2 == 0)
    return rows.select(
        F.concat(F.lit("M"), m).alias("maker"), F.col("id").alias("entry_id"), F.concat(F.lit("c- "), c).alias("code"), F.lit("CABINET").alias("category"), F.lit("first").alias("description"), F.lit(None).cast("string").alias("alias_group"),
        F.lit(True).alias("is_primary"), F.lit(True).alias("is_current"), F.lit(1).alias("version"), F.lit(None).cast("long").alias("last_change"),
    )


def _changes(events: DataFrame) -> DataFrame:
    n = F.col("event_id")
    m, c = n % _MAKERS, F.floor(n / _MAKERS) % _CODES
    action = _nth(_ACTIONS, n + F.floor(n / _ROUND))
    earlier = 1_000_000 + n - _ROUND * (1 + n % 3)
    target = F.when(action == "CREATE", 1_000_000 + n).when(n % 2 == 0, earlier).otherwise(m * _CODES + c)
    return events.select(
        n.alias("change_id"), action.alias("action"), F.concat(F.lit("M"), m).alias("maker"), target.alias("entry_id"), F.when(action == "CREATE", F.concat(F.lit(" C-  "), c)).alias("code"),
        F.when(n % 3 != 0, _nth(_KINDS, n)).alias("category"), F.when(n % 4 != 0, F.concat(F.lit("d"), n)).alias("description"), F.lit(None).cast("string").alias("alias_group"),
        F.lit(None).cast("boolean").alias("is_primary"), F.when(n % 11 == 0, n % 2 == 0).alias("is_current"),
    )


def _applied(spark, sf_dir, part: int) -> DataFrame:
    asked = _changes(table(spark, sf_dir, "events"))
    name = ("dictionary-after", "dictionary-verdicts")[part]
    return stored(name, spark, [f"{sf_dir.rstrip('/')}/events.parquet"], lambda: changes.apply_changes(_dictionary(spark), asked)[part])


def dictionary_after(spark, sf_dir):
    """Makers' dictionaries after all changes; the same changes once more would change nothing."""
    return _applied(spark, sf_dir, 0).select("maker", "entry_id", "code", "category", "description", "is_current", "version", "last_change")


def dictionary_verdicts(spark, sf_dir):
    """Each change with its verdict."""
    return _applied(spark, sf_dir, 1)


def catalogue_approvals(spark, sf_dir):
    """Rows of catalogues after edits and approval, with whether they come into the dictionary."""
    parts = table(spark, sf_dir, "part")
    k = F.col("p_partkey")
    rows = parts.select(F.concat(F.lit("M"), k % _MAKERS).alias("maker"), k.alias("row_id"), F.concat(F.lit("C-"), F.floor(k / _MAKERS) % 100).alias("code"), F.lit("PANEL").alias("category"), F.col("p_type").alias("description"),
                        F.when(k % 7 == 0, "REJECTED").otherwise("PENDING").alias("status"))
    edits = parts.where("p_partkey % 3 = 0").select(k.alias("edit_id"), k.alias("row_id"), F.when(k % 2 == 0, "REJECT").otherwise("UPDATE").alias("action"), F.concat(F.lit("E"), k % 50).alias("code"), F.lit(None).cast("string").alias("category"), F.lit("edited").alias("description"))
    edited = changes.edit_rows(rows, edits)[0]
    after, new = changes.approve(edited, _dictionary(spark), rows.where("row_id % 5 <> 0").select("row_id"))
    return after.join(new.select("row_id", F.lit(True).alias("added")), "row_id", "left").select("row_id", "maker", "code", "description", "status", F.coalesce("added", F.lit(False)).alias("added"))


def rebuilt_projects(spark, sf_dir):
    """A table kept by project, some of whose projects are built anew, twice: all its rows."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", "o_custkey")
    path = f"{shared_folder(spark)}/orders-{uuid.uuid4().hex}"
    store.replace_keys(path, "o_orderkey", orders, orders, 16)
    fresh = orders.where("o_custkey % 3 = 0 and o_orderkey % 7 <> 0").withColumn("o_orderstatus", F.lit("N"))
    touched = orders.where("o_custkey % 3 = 0")
    for _ in range(2):
        store.replace_keys(path, "o_orderkey", touched, fresh, 16)
    return store.read_store(spark, path)


def audit_log(spark, sf_dir):
    """A log to which batches are added, one of them twice: all its rows."""
    path = f"{shared_folder(spark)}/log-{uuid.uuid4().hex}"
    log = table(spark, sf_dir, "events").select(F.col("event_type").alias("action"), F.col("user_id").cast("string").alias("resource"))
    more = table(spark, sf_dir, "orders").where("o_orderstatus = 'F'").select(F.lit("FINALIZE").alias("action"), F.col("o_orderkey").cast("string").alias("resource"))
    for batch, rows in ((0, log), (1, more), (1, more)):
        store.append_once(path, batch, rows)
    return spark.read.parquet(path).select("action", "resource", F.col("batch").cast("int").alias("batch"))


#: Projects whose order came in anew without its first line.
_ANEW = "project_id % 50 = 7"


def rematched_groups(spark, sf_dir):
    """All groups after some projects' orders were replaced: only those projects are matched again."""
    path = f"{shared_folder(spark)}/groups-{uuid.uuid4().hex}"
    groups = r._groups(spark, sf_dir)
    store.replace_keys(path, "project_id", groups, groups, 16)
    items = line_items(spark, sf_dir).where(_ANEW)
    touched = items.select("project_id").distinct()
    now = items.where("not (side = 'ORDER' and ord = 1)")
    store.replace_keys(path, "project_id", touched, match_units(aggregate_units(now)), 16)
    return store.read_store(spark, path).select("project_id", "design_id", "order_id", "ack_id", "status")


def _listed(values) -> str:
    return "[" + ", ".join(f"'{v}'" for v in values) + "]"


#: Changes of each code one after another, with the entry that is there.
_FOLD = f"""WITH RECURSIVE q AS (SELECT event_id AS n, event_id % {_MAKERS} AS m, event_id // {_MAKERS} % {_CODES} AS c, {_listed(_ACTIONS)}[(event_id + event_id // {_ROUND}) % {len(_ACTIONS)} + 1] AS action,
    CASE WHEN event_id % 3 <> 0 THEN {_listed(_KINDS)}[event_id % {len(_KINDS)} + 1] END AS cat, CASE WHEN event_id % 4 <> 0 THEN 'd' || event_id END AS descr, CASE WHEN event_id % 11 = 0 THEN event_id % 2 = 0 END AS cur FROM events),
  t AS (SELECT *, CASE WHEN action = 'CREATE' THEN 1000000 + n WHEN n % 2 = 0 THEN 1000000 + n - {_ROUND} * (1 + n % 3) ELSE m * {_CODES} + c END AS target FROM q),
  k AS (SELECT t.*, row_number() OVER (PARTITION BY m, c ORDER BY n) AS i FROM t),
  s AS (SELECT id // {_CODES} AS m, id % {_CODES} AS c, 0::BIGINT AS i, NULL::BIGINT AS n, NULL::VARCHAR AS verdict, CASE WHEN (id // {_CODES} + id % {_CODES}) % 2 = 0
      THEN {{'entry_id': id, 'code': 'c- ' || id % {_CODES}, 'category': 'CABINET', 'description': 'first', 'is_current': true, 'version': 1, 'last_change': NULL::BIGINT}} END AS live FROM (SELECT unnest(range({_ROUND})) AS id)
    UNION ALL
    SELECT m, c, i, n, verdict, CASE WHEN verdict <> 'APPLIED' THEN live WHEN action = 'CREATE' THEN {{'entry_id': target, 'code': ' C-  ' || c, 'category': cat, 'description': descr, 'is_current': coalesce(cur, true), 'version': 1, 'last_change': n}}
        WHEN action = 'DELETE' THEN NULL ELSE {{'entry_id': live.entry_id, 'code': live.code, 'category': CASE WHEN action = 'UPDATE' THEN coalesce(cat, live.category) ELSE live.category END,
          'description': CASE WHEN action = 'UPDATE' THEN coalesce(descr, live.description) ELSE live.description END, 'is_current': CASE WHEN action = 'UPDATE' THEN coalesce(cur, live.is_current) ELSE false END, 'version': live.version + 1, 'last_change': n}} END
    FROM (SELECT s.m, s.c, k.i, k.n, k.action, k.target, k.cat, k.descr, k.cur, s.live,
        CASE WHEN k.action = 'CREATE' THEN CASE WHEN coalesce(k.cat IN ('GADGET'), true) THEN 'Invalid category' WHEN s.live IS NOT NULL THEN 'Code already exists for this manufacturer' ELSE 'APPLIED' END
          WHEN s.live IS NULL OR s.live.entry_id <> k.target THEN 'Dictionary entry not found' WHEN k.action = 'RENAME' THEN 'Unknown action' WHEN k.action = 'UPDATE' AND k.cat = 'GADGET' THEN 'Invalid category' ELSE 'APPLIED' END AS verdict
      FROM s JOIN k ON k.m = s.m AND k.c = s.c AND k.i = s.i + 1) AS x)"""

SQL = {
    "dictionary_after": f"""{_FOLD}, e AS (SELECT m, c, arg_max({{'live': live}}, i).live AS live FROM s GROUP BY m, c)
        SELECT 'M' || m AS maker, live.entry_id, live.code, live.category, live.description, live.is_current, live.version, live.last_change FROM e WHERE live IS NOT NULL""",
    "dictionary_verdicts": f"{_FOLD} SELECT n AS change_id, verdict FROM s WHERE i > 0",
    "catalogue_approvals": f"""WITH e AS (SELECT p_partkey AS k, p_partkey % 3 = 0 AND p_partkey % 2 <> 0 AND p_partkey % 7 <> 0 AS edited, p_partkey % 3 = 0 AND p_partkey % 2 = 0 OR p_partkey % 7 = 0 AS rejected, p_type FROM part),
        r AS (SELECT k, 'M' || k % {_MAKERS} AS maker, CASE WHEN edited THEN 'E' || k % 50 ELSE 'C-' || k // {_MAKERS} % 100 END AS code, CASE WHEN edited THEN 'edited' ELSE p_type END AS description, rejected, NOT rejected AND k % 5 <> 0 AS taken FROM e),
        n AS (SELECT *, row_number() OVER (PARTITION BY maker, code, taken ORDER BY k) AS nth FROM r)
        SELECT k AS row_id, maker, code, description, CASE WHEN rejected THEN 'REJECTED' WHEN taken THEN 'APPROVED' ELSE 'PENDING' END AS status, taken AND nth = 1 AS added FROM n""",
    "rebuilt_projects": "SELECT o_orderkey, CASE WHEN o_custkey % 3 = 0 THEN 'N' ELSE o_orderstatus END AS o_orderstatus, o_custkey FROM orders WHERE o_custkey % 3 <> 0 OR o_orderkey % 7 <> 0",
    "audit_log": "SELECT event_type AS action, CAST(user_id AS VARCHAR) AS resource, 0 AS batch FROM events UNION ALL SELECT 'FINALIZE', CAST(o_orderkey AS VARCHAR), 1 FROM orders WHERE o_orderstatus = 'F'",
    "rematched_groups": f"""WITH {ITEMS_SQL}, now AS (SELECT * FROM items WHERE NOT ({_ANEW} AND side = 'ORDER' AND ord = 1)){r._WRITTEN.replace("FROM items", "FROM now")} SELECT project_id, design_id, order_id, ack_id, {r._STATUS} AS status FROM pairs""",
}
QUERIES = [dictionary_after, dictionary_verdicts, catalogue_approvals, rebuilt_projects, audit_log, rematched_groups]
