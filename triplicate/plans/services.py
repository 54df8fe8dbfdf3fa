"""Queries behind lists, counters, reviews, imports and readings."""

from __future__ import annotations

from pyspark.sql import functions as F

from triplicate.operators import dictionary, readings
from triplicate.operators.projects import PRICES, cost
from triplicate.plans import reconciliation as r
from triplicate.sources.line_items import table
from triplicate.sources.scratch import cut
from triplicate.streaming.activity import beats, fixed_window, limited, recent_hits, windowed_counts

_STATES = ("O", "F", "P", "X")


def _orders(spark, sf_dir):
    return table(spark, sf_dir, "orders")


def project_states(spark, sf_dir):
    """How many projects are in each state, those without any too."""
    states = spark.createDataFrame([(s,) for s in _STATES], "status string")
    counts = _orders(spark, sf_dir).groupBy(F.col("o_orderstatus").alias("status")).agg(F.count("*").alias("n"))
    return states.join(counts, "status", "left").select("status", F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def project_search(spark, sf_dir):
    names = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_name")
    hit = F.lower("c_name").contains("12") | F.lower("o_orderpriority").contains("urgent")
    return _orders(spark, sf_dir).where("o_orderstatus = 'O'").join(names, "o_custkey").where(hit).select("o_orderkey", "c_name", "o_orderpriority")


def project_recent(spark, sf_dir):
    return _orders(spark, sf_dir).orderBy(F.desc("o_orderdate"), "o_orderkey").select("o_orderkey", "o_orderstatus").limit(5)


def audit_page(spark, sf_dir):
    return table(spark, sf_dir, "events").orderBy(F.desc("ts"), "event_id").select("event_id", "event_type").offset(100).limit(100)


def audit_rollup(spark, sf_dir):
    return _orders(spark, sf_dir).rollup("o_orderstatus", "o_orderpriority").agg(F.count("*").alias("n")).select("o_orderstatus", "o_orderpriority", "n")


def activity_daily(spark, sf_dir):
    """Events of each of the last 30 days up to the last event's, days without any too."""
    events = table(spark, sf_dir, "events").select(F.to_date("ts").alias("day"))
    span = events.agg(F.max("day").alias("last")).select(F.explode(F.sequence(F.date_sub("last", 29), F.col("last"), F.expr("interval 1 day"))).alias("day"))
    counts = events.groupBy("day").agg(F.count("*").alias("n"))
    return span.join(counts, "day", "left").select(F.col("day").cast("string").alias("day"), F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def activity_windows(spark, sf_dir):
    return windowed_counts(table(spark, sf_dir, "events")).select(F.col("start").cast("date").cast("string").alias("day"), "event_type", "n")


def sliding_hits(spark, sf_dir):
    return recent_hits(table(spark, sf_dir, "events")).select("event_id", "hits")


def sliding_limiter(spark, sf_dir):
    return limited(table(spark, sf_dir, "events"))


def window_limiter(spark, sf_dir):
    return limited(table(spark, sf_dir, "events"), rule=fixed_window)


def job_stretches(spark, sf_dir):
    """Stretches in which a user's job told something at least every two days."""
    return beats(table(spark, sf_dir, "events"))


def job_state(spark, sf_dir):
    """Each user's state: the first final event (purchase or error), which nothing after it changes, else the last one."""
    at = F.struct("ts", "event_id")
    final = F.col("event_type").isin("purchase", "error")
    g = table(spark, sf_dir, "events").groupBy("user_id").agg(F.min_by(F.when(final, F.col("event_type")), F.when(final, at)).alias("final"), F.max_by("event_type", at).alias("last"))
    return g.select("user_id", F.coalesce("final", "last").alias("state"))


def stale_jobs(spark, sf_dir):
    """Users whose last event is a signup more than five minutes before the last of all."""
    e = table(spark, sf_dir, "events")
    now = e.agg(F.max("ts").alias("now"))  # one row
    last = e.groupBy("user_id").agg(F.max_by("event_type", F.struct("ts", "event_id")).alias("state"), F.max("ts").alias("ts"))
    return last.join(F.broadcast(now), F.col("ts") < F.col("now") - F.expr("interval 5 minutes")).where("state = 'signup'").select("user_id")


_MODELS = (*PRICES, "another")


def usage_cost(spark, sf_dir):
    """Tokens and cost of each model's calls."""
    model = F.element_at(F.lit(list(_MODELS)), (F.col("event_id") % len(_MODELS) + 1).cast("int"))
    e = table(spark, sf_dir, "events").select(model.alias("model"), (F.col("event_id") % 1000 * 10).alias("tin"), (F.col("event_id") % 77).alias("tout"))
    return e.groupBy("model").agg(F.sum("tin").alias("tokens_in"), F.sum("tout").alias("tokens_out"), F.sum(cost(F.col("model"), F.col("tin"), F.col("tout"))).cast("double").alias("cost"))


def report_rows(spark, sf_dir):
    """Every group with each of its differences; groups without any have one row."""
    members, found = r._checked(spark, sf_dir)
    groups = r.finalize(members, found)
    key = lambda: F.concat_ws("|", *(F.coalesce(c, F.lit("-")) for c in ("design_id", "order_id", "ack_id")))
    rows = groups.withColumn("k", key()).join(found.select("project_id", key().alias("k"), "field", "severity", "introduced_at"), ["project_id", "k"], "left")
    return rows.select("project_id", "design_id", "order_id", "ack_id", "status", "final_sku", "field", "severity", "introduced_at")


def bulk_accept(spark, sf_dir):
    """Open differences that are not critical are accepted together; what each field then holds."""
    found = r._checked(spark, sf_dir)[1]
    status = F.when((F.col("status") == "OPEN") & (F.col("severity") != "Critical"), "ACCEPTED").otherwise(F.col("status"))
    return found.groupBy("field", status.alias("status")).agg(F.count("*").alias("n"))


def actionable(spark, sf_dir):
    """The first 100 of what still needs somebody, the gravest first."""
    found = r._checked(spark, sf_dir)[1].where(F.col("status").isin("OPEN", "ESCALATED"))
    rank = F.when(F.col("severity") == "Critical", 1).when(F.col("severity") == "Warning", 3).otherwise(4)
    item = F.coalesce("design_id", "order_id", "ack_id")
    return found.orderBy(rank, "project_id", item, "field", "introduced_at").select("project_id", item.alias("item"), "field", "severity", "introduced_at").limit(100)


def dictionary_lookup(spark, sf_dir):
    parts = table(spark, sf_dir, "part")
    entries = parts.where("p_partkey % 3 = 0").select(
        F.col("p_brand").alias("maker"), F.lower("p_name").alias("code"), F.col("p_partkey").alias("entry_id"), F.col("p_type").alias("category"),
        (F.col("p_size") % 2 == 0).alias("is_primary"), (F.col("p_partkey") % 5 != 0).alias("is_current"),
    )
    items = parts.select("p_partkey", F.col("p_brand").alias("maker"), F.concat(F.lit("  "), F.col("p_name")).alias("sku"))
    return dictionary.lookup(items, entries).select("p_partkey", "found_category", "found_by")


def dictionary_import(spark, sf_dir):
    parts = table(spark, sf_dir, "part")
    category = F.element_at(F.lit(["cabinet", " Panel", "widget"]), (F.col("p_partkey") % 3 + 1).cast("int"))
    rows = parts.select(F.col("p_partkey").alias("row_id"), F.when(F.col("p_partkey") % 10 != 0, F.concat("p_name", F.lit(" "), "p_brand")).alias("code"), category.alias("category"))
    existing = parts.where("p_partkey % 50 = 1").select(F.concat(F.upper("p_name"), F.lit("  "), "p_brand").alias("code"))
    return dictionary.import_check(rows, existing).groupBy("verdict").agg(F.count("*").alias("n"))


#: Headers of a catalogue: every name of a field in its letters alone, and others.
_HEADERS = (*(n for names in dictionary.HEADERS.values() for n in names), "weight", "colour")


def header_names(spark, sf_dir):
    """Which field a header names, for each part one of the headers, spelled with marks or followed by the part's name."""
    k = F.col("p_partkey")
    name = F.element_at(F.lit(list(_HEADERS)), (k % len(_HEADERS) + 1).cast("int"))
    spelled = F.when(k % 5 == 0, F.concat_ws(" ", name, "p_name")).when(k % 2 == 0, F.concat(F.substring(F.upper(name), 1, 3), F.lit("_ "), F.substring(name, 4, 99), F.lit(" #"))).otherwise(name)
    return dictionary.header_column(table(spark, sf_dir, "part").select("p_partkey", spelled.alias("header"))).select("p_partkey", "field")


def document_cache(spark, sf_dir):
    """Documents whose text was not seen under a smaller doc_id: the others' readings can be taken over."""
    d = table(spark, sf_dir, "documents").select("doc_id", F.sha2("text", 256).alias("hash"))
    return d.groupBy("hash").agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("copies"))


def page_states(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    state = F.when(F.length("text") == 0, "EMPTY").when(F.length("text") < 80, "SPARSE").otherwise("READ")
    return d.groupBy("lang", state.alias("state")).agg(F.count("*").alias("pages"), F.max(F.length("text")).cast("long").alias("longest"))


def page_anchors(spark, sf_dir):
    p = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey"), F.col("l_linenumber").alias("page"), (F.col("l_partkey") % 3).alias("kind"))
    return readings.nearest_after(p.where("kind = 0").distinct(), p.where("kind = 1"), "l_orderkey", "page")


def line_gaps(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", F.concat(F.lit("*"), "l_linenumber").alias("line"))
    return readings.line_gaps(rows, "l_orderkey", "line").select("l_orderkey", F.array_join("missing", ",").alias("missing"))


def first_seen(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select(
        F.when(F.col("l_partkey") % 10 != 0, F.col("l_partkey")).alias("sku"), F.col("l_suppkey").alias("page"),
        F.when(F.col("l_quantity") > 25, F.col("l_quantity")).alias("quantity"), (F.col("l_orderkey") * 1000000 + F.col("l_linenumber") * 100000 + F.col("l_extendedprice")).alias("at"), F.col("l_discount").alias("confidence"),
    )
    return readings.first_seen(rows, ("sku", "page"), "at", ("quantity",)).select("sku", "page", "quantity", "confidence")


def _readings(spark, sf_dir):
    rows = r.line_items(spark, sf_dir).where(F.col("side").isin("DESIGN", "ACK")).select(
        "side", F.col("project_id").alias("document_id"), "ord", F.regexp_replace(F.upper(F.trim("raw_sku")), "[^A-Z0-9]", "").alias("sku"), F.col("quantity").cast("string").alias("quantity"),
        F.lit(1).alias("page_number"), "description", "finish", "door_style", F.col("ord").cast("string").alias("line_number"),
    )
    rows = cut(rows)  # each reading is read twice, to find counterparts and to bring them together
    return tuple(rows.where(F.col("side") == side).drop("side") for side in ("DESIGN", "ACK"))


def readings_merged(spark, sf_dir):
    ocr, vision = _readings(spark, sf_dir)
    m = readings.merge(readings.align(ocr, vision))
    return m.select("document_id", "sku", "quantity", "finish", "basis", F.array_join("conflicts", ",").alias("conflicts"), "verdict")


def readings_paired(spark, sf_dir):
    """Two readings of pages on which codes repeat and are misread."""
    n = F.col("l_linenumber")
    rows = cut(table(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.min("l_partkey").alias("k")))
    one = rows.select(
        F.col("l_orderkey").alias("document_id"), n.alias("ord"), F.when(n % 3 == 0, F.concat(F.lit("B0S"), n)).otherwise("REP-9").alias("sku"), n.alias("page_number"),
        F.concat(F.lit("base "), F.repeat(F.lit("oak "), n)).alias("description"), (F.col("k") % 9).cast("string").alias("quantity"),
    )
    other = rows.where("k % 5 <> 0").select(
        F.col("l_orderkey").alias("document_id"), (100 - n).alias("ord"), F.when(n % 3 == 0, F.concat(F.lit("BO5"), n)).otherwise("REP-9").alias("sku"), F.when(F.col("k") % 7 == 0, n + 50).otherwise(n).alias("page_number"),
        F.lit("zzz").alias("description"), (F.col("k") % 9).cast("string").alias("quantity"),
    )
    a = readings.align(one, other)
    return a.select("document_id", F.col("o.ord").alias("o"), F.col("v.ord").alias("v"), "basis")


def readings_issues(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select(
        "l_orderkey", F.when(F.col("l_partkey") % 7 != 0, F.concat(F.lit("ABCDEFGHIJKLMN"), F.col("l_partkey"))).alias("sku"), (F.col("l_quantity") * 12 - 30).cast("int").alias("quantity"), (F.col("l_discount") * 20 - 0.5).alias("confidence")
    )
    return readings.issues(rows).select(F.explode("issues").alias("issue")).groupBy("issue").agg(F.count("*").alias("n"))


def organization_counts(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select("c_custkey", F.col("c_nationkey").alias("organization_id"))
    o = _orders(spark, sf_dir).groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("n"))
    return c.join(o, "c_custkey", "left").groupBy("organization_id").agg(F.count("*").alias("members"), F.sum(F.coalesce("n", F.lit(0))).cast("long").alias("projects"))


_F = r._FINAL
def _limiter_sql(kept: str, passes: str) -> str:
    """A user's hits one after another, with what is held of them in a list: ``kept`` before, ``passes`` for this one."""
    return f"""WITH RECURSIVE e AS (SELECT event_id, user_id, epoch_us(ts) AS t, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events),
        s AS (SELECT DISTINCT user_id, 0::BIGINT AS n, NULL::BIGINT AS event_id, NULL::BOOLEAN AS passes, []::BIGINT[] AS held FROM events
          UNION ALL SELECT user_id, n, event_id, {passes}, CASE WHEN {passes} OR kept_all THEN list_append(held, t) ELSE held END
          FROM (SELECT e.user_id, e.n, e.event_id, e.t, {kept} AS held FROM s JOIN e ON e.user_id = s.user_id AND e.n = s.n + 1) AS x)
        SELECT event_id, user_id, passes FROM s WHERE n > 0"""


SQL = {
    "sliding_limiter": _limiter_sql("list_filter(s.held, lambda k: k > e.t - 3600000000)", "len(held) < 3").replace(" OR kept_all", ""),
    "window_limiter": _limiter_sql("CASE WHEN len(s.held) = 0 OR e.t >= s.held[1] + 3600000000 THEN []::BIGINT[] ELSE s.held END", "len(held) < 3").replace("OR kept_all", "OR true"),
    "job_stretches": """WITH g AS (SELECT user_id, ts, CASE WHEN ts < lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) + INTERVAL 2 DAY THEN 0 ELSE 1 END AS starts FROM events),
        n AS (SELECT user_id, ts, sum(starts) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS stretch FROM g)
        SELECT user_id, min(ts) AS started, max(ts) AS last_seen, count(*) AS n FROM n GROUP BY user_id, stretch""",
    "project_states": "SELECT s.status, count(o_orderkey) AS n FROM (VALUES ('O'), ('F'), ('P'), ('X')) AS s(status) LEFT JOIN orders ON o_orderstatus = s.status GROUP BY 1",
    "project_search": "SELECT o_orderkey, c_name, o_orderpriority FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_orderstatus = 'O' AND (lower(c_name) LIKE '%12%' OR lower(o_orderpriority) LIKE '%urgent%')",
    "project_recent": "SELECT o_orderkey, o_orderstatus FROM orders ORDER BY o_orderdate DESC, o_orderkey LIMIT 5",
    "audit_page": "SELECT event_id, event_type FROM events ORDER BY ts DESC, event_id LIMIT 100 OFFSET 100",
    "audit_rollup": "SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY ROLLUP (o_orderstatus, o_orderpriority)",
    "activity_daily": "WITH e AS (SELECT CAST(ts AS DATE) AS day FROM events), m AS (SELECT max(day) AS last FROM e), d AS (SELECT CAST(unnest(generate_series(last - 29, last, INTERVAL 1 DAY)) AS DATE) AS day FROM (SELECT CAST(last AS DATE) AS last FROM m)) SELECT CAST(d.day AS VARCHAR) AS day, count(e.day) AS n FROM d LEFT JOIN e ON e.day = d.day GROUP BY d.day",
    "activity_windows": "SELECT CAST(CAST(ts AS DATE) AS VARCHAR) AS day, event_type, count(*) AS n FROM events GROUP BY 1, 2",
    "sliding_hits": "SELECT event_id, count(*) OVER (PARTITION BY user_id ORDER BY epoch_us(ts) RANGE BETWEEN 3599999999 PRECEDING AND CURRENT ROW) AS hits FROM events",
    "job_state": "SELECT user_id, coalesce(arg_min(CASE WHEN event_type IN ('purchase', 'error') THEN event_type END, CASE WHEN event_type IN ('purchase', 'error') THEN (ts, event_id) END), arg_max(event_type, (ts, event_id))) AS state FROM events GROUP BY 1",
    "stale_jobs": "SELECT user_id FROM (SELECT user_id, arg_max(event_type, (ts, event_id)) AS state, max(ts) AS ts FROM events GROUP BY 1) WHERE state = 'signup' AND ts < (SELECT max(ts) FROM events) - INTERVAL 5 MINUTE",
    "usage_cost": f"""WITH e AS (SELECT [{', '.join(repr(m) for m in _MODELS)}][event_id % {len(_MODELS)} + 1] AS model, event_id % 1000 * 10 AS tin, event_id % 77 AS tout FROM events),
        p(model, i, o) AS (VALUES {', '.join(f"('{m}', {i}::DECIMAL(9,3), {o}::DECIMAL(9,3))" for m, (i, o) in PRICES.items())})
        SELECT e.model, CAST(sum(tin) AS BIGINT) AS tokens_in, CAST(sum(tout) AS BIGINT) AS tokens_out, CAST(sum(round((tin * coalesce(i, 5) + tout * coalesce(o, 15)) * 0.000001::DECIMAL(9,6), 6)) AS DOUBLE) AS cost FROM e LEFT JOIN p USING (model) GROUP BY 1""",
    "report_rows": f"{_F} SELECT g.project_id, g.design_id, g.order_id, g.ack_id, g.status, g.final_sku, f.field, f.severity, f.introduced_at FROM g LEFT JOIN f ON f.project_id = g.project_id AND coalesce(f.design_id, f.order_id, f.ack_id) = coalesce(g.design_id, g.order_id, g.ack_id)",
    "bulk_accept": f"{_F} SELECT field, CASE WHEN severity <> 'Critical' THEN 'ACCEPTED' ELSE 'OPEN' END AS status, count(*) AS n FROM f GROUP BY 1, 2",
    "actionable": f"{_F} SELECT project_id, coalesce(design_id, order_id, ack_id) AS item, field, severity, introduced_at FROM f ORDER BY CASE severity WHEN 'Critical' THEN 1 WHEN 'Warning' THEN 3 ELSE 4 END, project_id, item, field, introduced_at LIMIT 100",
    "dictionary_lookup": "WITH e AS (SELECT * FROM (SELECT p_brand, upper(p_name) AS code, p_type, p_size, row_number() OVER (PARTITION BY p_brand, upper(p_name) ORDER BY p_partkey) AS n FROM part WHERE p_partkey % 3 = 0 AND p_partkey % 5 <> 0) WHERE n = 1) SELECT p.p_partkey, e.p_type AS found_category, CASE WHEN e.code IS NULL THEN NULL WHEN e.p_size % 2 = 0 THEN 'EXACT' ELSE 'ALIAS' END AS found_by FROM part p LEFT JOIN e ON e.p_brand = p.p_brand AND e.code = upper(p.p_name)",
    "dictionary_import": "WITH t AS (SELECT p_partkey AS id, CASE WHEN p_partkey % 10 <> 0 THEN upper(p_name || ' ' || p_brand) END AS code, p_partkey % 3 <> 2 AND p_partkey % 10 <> 0 AS valid FROM part), k AS (SELECT DISTINCT upper(p_name || ' ' || p_brand) AS code FROM part WHERE p_partkey % 50 = 1), n AS (SELECT t.*, row_number() OVER (PARTITION BY t.code, valid ORDER BY id) AS n, k.code IS NOT NULL AS known FROM t LEFT JOIN k ON k.code = t.code) SELECT CASE WHEN NOT valid THEN 'INVALID' WHEN n > 1 OR known THEN 'DUPLICATE' ELSE 'NEW' END AS verdict, count(*) AS n FROM n GROUP BY 1",
    "header_names": "SELECT p_partkey, CASE WHEN p_partkey % 5 <> 0 THEN CASE " + " ".join(f"WHEN n IN {names} THEN '{field}'" for field, names in dictionary.HEADERS.items()) + f" END END AS field FROM (SELECT p_partkey, {list(_HEADERS)}[p_partkey % {len(_HEADERS)} + 1] AS n FROM part)",
    "document_cache": "SELECT sha256(text) AS hash, min(doc_id) AS doc_id, count(*) AS copies FROM documents GROUP BY 1",
    "page_states": "SELECT lang, CASE WHEN length(text) = 0 THEN 'EMPTY' WHEN length(text) < 80 THEN 'SPARSE' ELSE 'READ' END AS state, count(*) AS pages, max(length(text)) AS longest FROM documents GROUP BY 1, 2",
    "page_anchors": "WITH p AS (SELECT DISTINCT l_orderkey, l_linenumber AS page, l_partkey % 3 AS kind FROM lineitem) SELECT a.l_orderkey, a.page, min(b.page) AS anchor FROM p a JOIN p b ON a.l_orderkey = b.l_orderkey AND a.kind = 0 AND b.kind = 1 AND b.page BETWEEN a.page + 1 AND a.page + 3 GROUP BY 1, 2",
    "line_gaps": "WITH d AS (SELECT DISTINCT l_orderkey, l_linenumber FROM lineitem), s AS (SELECT l_orderkey, unnest(generate_series(min(l_linenumber), max(l_linenumber))) AS n FROM d GROUP BY 1) SELECT s.l_orderkey, string_agg(CAST(s.n AS VARCHAR), ',' ORDER BY s.n) AS missing FROM s LEFT JOIN d ON d.l_orderkey = s.l_orderkey AND d.l_linenumber = s.n WHERE d.l_linenumber IS NULL GROUP BY 1",
    "first_seen": "WITH t AS (SELECT CASE WHEN l_partkey % 10 <> 0 THEN l_partkey END AS sku, l_suppkey AS page, CASE WHEN l_quantity > 25 THEN l_quantity END AS quantity, l_orderkey * 1000000 + l_linenumber * 100000 + l_extendedprice AS seen, l_discount AS confidence FROM lineitem) SELECT sku, page, quantity, confidence FROM t WHERE sku IS NULL UNION ALL SELECT sku, page, arg_min(quantity, CASE WHEN quantity IS NOT NULL THEN seen END), max(confidence) FROM t WHERE sku IS NOT NULL GROUP BY 1, 2",
    "readings_merged": f"""WITH {r.ITEMS_SQL}, t AS (SELECT project_id AS document_id, side, ord, regexp_replace(upper(trim(raw_sku)), '[^A-Z0-9]', '', 'g') AS sku, CAST(quantity AS VARCHAR) AS quantity, finish, door_style FROM items),
        j AS (SELECT coalesce(o.document_id, v.document_id) AS document_id, coalesce(o.sku, v.sku) AS sku, coalesce(o.quantity, v.quantity) AS quantity, coalesce(v.finish, o.finish) AS finish,
          CASE WHEN o.sku IS NULL THEN 'VISION_ONLY' WHEN v.sku IS NULL THEN 'OCR_ONLY' ELSE 'EXACT_CODE' END AS basis,
          concat_ws(',', CASE WHEN o.quantity <> v.quantity THEN 'quantity' END, CASE WHEN upper(o.finish) <> upper(v.finish) THEN 'finish' END, CASE WHEN upper(o.door_style) <> upper(v.door_style) THEN 'door_style' END) AS conflicts
        FROM (SELECT * FROM t WHERE side = 'DESIGN') o FULL JOIN (SELECT * FROM t WHERE side = 'ACK') v ON o.document_id = v.document_id AND o.sku = v.sku)
        SELECT *, CASE WHEN conflicts = '' AND basis = 'EXACT_CODE' THEN 'VERIFIED' ELSE 'UNCERTAIN' END AS verdict FROM j""",
    "readings_paired": """WITH r AS (SELECT l_orderkey AS document_id, l_linenumber AS n, min(l_partkey) AS k FROM lineitem GROUP BY 1, 2),
        s AS (SELECT *, n % 3 = 0 AS misread, k % 5 <> 0 AS seen, count(*) FILTER (n % 3 <> 0) OVER w AS ro, count(*) FILTER (n % 3 <> 0 AND k % 5 <> 0) OVER w AS rv FROM r WINDOW w AS (PARTITION BY document_id)),
        t AS (SELECT *, CASE WHEN misread THEN CASE WHEN seen AND k % 7 <> 0 THEN 'MISREAD_CODE' END WHEN ro = 1 AND rv = 1 AND seen THEN 'EXACT_CODE' WHEN seen AND k % 7 <> 0 THEN 'REPEATED_CODE' END AS basis FROM s)
        SELECT document_id, n AS o, CASE WHEN basis IS NOT NULL THEN 100 - n END AS v, coalesce(basis, 'OCR_ONLY') AS basis FROM t
        UNION ALL SELECT document_id, NULL, 100 - n, 'VISION_ONLY' FROM t WHERE seen AND basis IS NULL""",
    "readings_issues": """WITH t AS (SELECT CASE WHEN l_partkey % 7 <> 0 THEN 'ABCDEFGHIJKLMN' || l_partkey END AS sku, CAST(trunc(l_quantity * 12 - 30) AS INT) AS q, l_discount * 20 - 0.5 AS c FROM lineitem)
        SELECT issue, count(*) AS n FROM (SELECT 'EMPTY_SKU' AS issue FROM t WHERE sku IS NULL UNION ALL SELECT 'SUSPICIOUS_MERGED_SKU' FROM t WHERE length(sku) > 18
          UNION ALL SELECT CASE WHEN q < 0 THEN 'NEGATIVE_QUANTITY' ELSE 'UNUSUALLY_LARGE_QUANTITY' END FROM t WHERE q < 0 OR q > 500 UNION ALL SELECT 'OUT_OF_BOUNDS_CONFIDENCE' FROM t WHERE c < 0 OR c > 1) GROUP BY 1""",
    "organization_counts": "SELECT c_nationkey AS organization_id, count(DISTINCT c_custkey) AS members, count(o_orderkey) AS projects FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1",
}
QUERIES = [
    project_states, project_search, project_recent, audit_page, audit_rollup, activity_daily, activity_windows, sliding_hits, sliding_limiter, window_limiter, job_stretches, job_state, stale_jobs,
    usage_cost, report_rows, bulk_accept, actionable, dictionary_lookup, dictionary_import, header_names, document_cache, page_states, page_anchors, line_gaps,
    first_seen, readings_merged, readings_paired, readings_issues, organization_counts,
]
