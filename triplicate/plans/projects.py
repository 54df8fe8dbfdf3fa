"""Queries over projects, documents, reviews and dictionaries, with the tables of orders standing in for them.

A project is an order, its documents are the order's lines, differences and reviews are events of a user.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from triplicate.functions.dimensions import parse
from triplicate.functions.display import format_display
from triplicate.functions.text import parse_flag, safe_filename
from triplicate.operators import dictionary
from triplicate.operators import projects as p

from triplicate.sources.line_items import table

_STATES = ("DRAFT", "PROCESSING", "REVIEW_REQUIRED", "FAILED", "COMPLETED", "FINALIZED")
_TYPES = ("DESIGN", "ORDER", "ACKNOWLEDGEMENT", "CABINET_LIST")


def _one_of(values: tuple[str, ...], n: str) -> Column:
    return F.element_at(F.lit(list(values)), (F.expr(n) % len(values) + 1).cast("int"))


def _sql_one_of(values: tuple[str, ...], n: str) -> str:
    return f"[{', '.join(repr(v) for v in values)}][({n}) % {len(values)} + 1]"


def tenant_projects(spark, sf_dir):
    """Projects of one organization; the filter of the dimension reaches its scan."""
    mine = table(spark, sf_dir, "customer").where("c_nationkey = 7").select(F.col("c_custkey").alias("o_custkey"))
    return table(spark, sf_dir, "orders").join(mine, "o_custkey", "left_semi").select("o_orderkey", "o_orderstatus")


def project_lookup(spark, sf_dir):
    mine = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_nationkey")
    return table(spark, sf_dir, "orders").where("o_orderkey = 42").join(mine, "o_custkey").select("o_orderkey", "c_nationkey").limit(1)


def visible_makers(spark, sf_dir):
    """What organization 3 may see, and what of it it may change."""
    common, own = F.col("p_partkey") % 4 == 0, F.col("p_size") % 5 == 3
    return table(spark, sf_dir, "part").where(common | own).select("p_partkey", (~common & own).alias("editable"))


def lenient_filter(spark, sf_dir):
    """A value that isn't one of the domain filters nothing; another filters whatever its case."""
    orders = p.chosen(table(spark, sf_dir, "orders"), "o_orderstatus", "bogus", ("O", "F", "P"))
    return p.chosen(orders, "o_orderpriority", "1-urgent", ("1-URGENT", "2-HIGH")).groupBy("o_orderstatus").agg(F.count("*").alias("n"))


def _documents(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_shipdate", _one_of(_TYPES, "l_partkey").alias("kind"))


def required_documents(spark, sf_dir):
    m = p.missing_documents(_documents(spark, sf_dir), "l_orderkey", "kind")
    return m.select("l_orderkey", F.array_join("missing", ", ").alias("missing"), "ready")


def documents_by_type(spark, sf_dir):
    merged = F.when(F.col("kind") == "CABINET_LIST", "ORDER").otherwise(F.col("kind"))
    return _documents(spark, sf_dir).groupBy(merged.alias("kind")).agg(F.count("*").alias("n"))


def document_list(spark, sf_dir):
    """Documents by part of their source's name, language, and a state that stands for several."""
    d = table(spark, sf_dir, "documents").select("doc_id", F.col("source").alias("filename"), F.col("lang").alias("document_type"), _one_of(("PROCESSING", "UPLOADED", "COMPLETED", "FAILED"), "doc_id").alias("status"))
    found = [p.matching_documents(d, *asked).withColumn("asked", F.lit(n)) for n, asked in enumerate((("1", "ALL", "PROCESSING"), (" ", "de", "READY"), ("SO", "en", "FAILED"), ("", "fr", "ODD")))]
    return found[0].unionByName(found[1]).unionByName(found[2]).unionByName(found[3]).select("asked", "doc_id", "status")


def last_documents(spark, sf_dir):
    """The document of each type that was added last counts."""
    d = _documents(spark, sf_dir)
    return d.groupBy("l_orderkey", "kind").agg(F.max_by("l_partkey", F.struct("l_shipdate", "l_linenumber", "l_partkey")).alias("l_partkey"))


def vanished_documents(spark, sf_dir):
    """Projects of which a document went while they were processed: here those of suppliers divisible by 50."""
    d = _documents(spark, sf_dir)
    now = d.where("l_suppkey % 50 <> 0")
    keys = ["l_orderkey", "l_linenumber", "l_partkey"]
    return d.join(now, keys, "left_anti").select("l_orderkey").distinct()


def _facts(spark, sf_dir) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(
        F.count("*").alias("total"), F.count_if(F.col("l_partkey") % 3 == 0).alias("resolved"), F.count_distinct(F.col("l_partkey") % 3).alias("documents")
    )
    orders = table(spark, sf_dir, "orders").select("o_orderkey", _one_of(_STATES, "o_orderkey").alias("state"))
    whole = orders.join(lines, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    return whole.select("o_orderkey", "state", *(F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("total", "resolved", "documents")))


def project_overview(spark, sf_dir):
    how_far = p.progress(F.col("state"), F.col("total"), F.col("resolved"), F.col("documents"))
    return _facts(spark, sf_dir).select("o_orderkey", "state", "total", "resolved", "documents", how_far.alias("progress"))


def project_totals(spark, sf_dir):
    done = F.count_if(F.col("state").isin("COMPLETED", "FINALIZED"))
    open_ = F.sum(F.greatest(F.lit(0), F.col("total") - F.col("resolved"))).alias("open")
    rate = F.floor(done * 100 / F.count("*") + 0.5).cast("long").alias("rate")
    return _facts(spark, sf_dir).agg(F.sum("documents").alias("documents"), F.sum("total").alias("differences"), open_, done.alias("finished"), rate)


def dashboard(spark, sf_dir):
    merged = F.when(F.col("state") == "FINALIZED", "COMPLETED").otherwise(F.col("state"))
    return _facts(spark, sf_dir).groupBy(merged.alias("state")).agg(F.count("*").alias("n"), F.count_if(F.col("total") > F.col("resolved")).alias("unfinished"))


def items_per_page(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.count("*").alias("n"))


def groups_by_code(spark, sf_dir):
    code = F.coalesce(F.when(F.col("p_partkey") % 7 != 0, F.upper("p_name")), F.lit("Unknown SKU"))
    state = lambda n: F.count_if(F.col("p_partkey") % 3 == n)
    return table(spark, sf_dir, "part").groupBy(code.alias("code")).agg(state(0).alias("matched"), state(1).alias("changed"), state(2).alias("missing"))


def groups_with_critical(spark, sf_dir):
    critical = F.col("event_type") == "error"
    return table(spark, sf_dir, "events").groupBy("user_id").agg(F.bool_or(critical).alias("critical"), F.count_if(~critical & (F.col("value") > 100)).alias("open"))


def sorted_projects(spark, sf_dir):
    """The first 50 projects in each of the four orders."""
    names = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"), F.col("c_name").alias("name"))
    o = table(spark, sf_dir, "orders").join(names, "o_custkey").select("o_orderkey", "name", F.col("o_orderdate").alias("created_at"), F.when(F.col("o_orderkey") % 3 != 0, F.col("o_orderdate") + F.expr("interval 400 days")).alias("updated_at"))
    out = None
    for mode in ("updated_desc", "updated_asc", "name_asc", "name_desc"):
        first = p.sorted_projects(o, mode, "o_orderkey").select(F.lit(mode).alias("mode"), "o_orderkey", "name").limit(50)
        out = first if out is None else out.unionByName(first)
    return out


def catalogue_order(spark, sf_dir):
    page = F.when(F.col("p_size") % 4 != 0, F.col("p_size"))
    return table(spark, sf_dir, "part").select("p_partkey", page.alias("page"), "p_name").orderBy(F.asc_nulls_last("page"), "p_name", "p_partkey").limit(50)


def latest_job(spark, sf_dir):
    at = F.struct("ts", "event_id")
    active = ~F.col("event_type").isin("purchase", "error")
    return table(spark, sf_dir, "events").groupBy("user_id").agg(F.max_by("event_id", at).alias("job"), F.max_by(F.when(active, F.col("event_id")), F.when(active, at)).alias("active"))


def extraction_attempts(spark, sf_dir):
    a = p.attempts(table(spark, sf_dir, "events"), "user_id", ["ts", "event_id"])
    return a.select("event_id", "attempt", "is_latest")


def latest_extractions(spark, sf_dir):
    a = p.attempts(table(spark, sf_dir, "events"), "user_id", ["ts", "event_id"])
    return a.where("is_latest and user_id % 2 = 0").select("user_id", "event_id", "attempt")


def import_errors(spark, sf_dir):
    """The first fifty errors of each maker's import, in order, cut to 20 letters."""
    bad = table(spark, sf_dir, "part").where("p_partkey % 3 = 1").select("p_brand", "p_partkey", "p_name")
    # A limit on the number within a group is kept by each task before the shuffle too, so no group is held whole.
    first = bad.withColumn("n", F.row_number().over(Window.partitionBy("p_brand").orderBy("p_partkey"))).where("n <= 50")
    told = F.transform(F.array_sort(F.collect_list(F.struct("p_partkey", "p_name"))), lambda x: F.substring(F.concat(x["p_partkey"].cast("string"), F.lit(": "), x["p_name"]), 1, 20))
    return first.groupBy("p_brand").agg(F.array_join(told, ";").alias("errors")).join(bad.groupBy("p_brand").agg(F.count("*").alias("invalid")), "p_brand")


def overlaid_documents(spark, sf_dir):
    """A project's documents with newer ones in place of all of their type."""
    d = _documents(spark, sf_dir).select(F.concat_ws("/", "l_orderkey", "kind").alias("slot"), "l_partkey")
    newer = d.where("l_partkey % 10 = 0").groupBy("slot").agg((F.max("l_partkey") + 1).alias("l_partkey"))
    return p.replaced(d, newer, "slot").groupBy("slot").agg(F.count("*").alias("n"), F.max("l_partkey").alias("newest"))


def documents_to_extract(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select(
        "doc_id", F.sha2("text", 256).alias("hash"), (F.col("doc_id") % 3).alias("version"), "source", "lang", F.when(F.col("doc_id") % 5 != 0, F.col("doc_id") % 2).alias("prompt")
    )
    cached = d.where("doc_id % 4 <> 0")
    return p.to_extract(d, cached, ["hash", "version", "source", "lang", "prompt"]).select("doc_id")


def silent_jobs(spark, sf_dir):
    """Spans of more than two days in which a user's job told nothing."""
    before = F.lag("ts").over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    e = table(spark, sf_dir, "events").withColumn("before", before)
    return e.where(F.col("ts") > F.col("before") + F.expr("interval 2 days")).select("event_id", F.floor((F.unix_seconds(F.col("ts").cast("timestamp")) - F.unix_seconds(F.col("before").cast("timestamp"))) / 3600).cast("long").alias("hours"))


def timestamps(spark, sf_dir):
    """Dates from texts, null where they are none, and written out anew."""
    said = F.when(F.col("event_id") % 5 == 0, F.lit("soon")).otherwise(F.date_format("ts", "yyyy-MM-dd HH:mm:ss"))
    parsed = F.try_to_timestamp(said)
    return table(spark, sf_dir, "events").select("event_id", F.date_format(parsed, "yyyy-MM-dd HH:mm").alias("told"))


def json_values(spark, sf_dir):
    text = F.when(F.col("event_id") % 3 == 0, F.concat(F.lit("not "), "props")).otherwise(F.col("props"))
    return table(spark, sf_dir, "events").select("event_id", p.parsed(text, "$.k").alias("value"))


def flags_and_names(spark, sf_dir):
    said = _one_of(("", "yes", "TRUE", "0", "no", " y "), "p_partkey")
    name = F.concat(F.lit("../"), "p_name", F.lit("/a b#"), "p_partkey", F.lit(".pdf"))
    return table(spark, sf_dir, "part").select("p_partkey", parse_flag(said).alias("flag"), safe_filename(name).alias("name"))


def formatted_values(spark, sf_dir):
    size = _one_of(("36W x 12H x 24D", "12", "OPENING 30", ""), "p_partkey")
    field = _one_of(("item_presence", "door_style", "drawer_box", "sku"), "p_size")
    return table(spark, sf_dir, "part").select("p_partkey", p.format_size(parse(size)).alias("size"), p.field_label(field).alias("label"))


def page_evidence(spark, sf_dir):
    """Lines with what they say is on which page, judged by the pages' texts."""
    lines, k, n = table(spark, sf_dir, "lineitem"), F.col("l_partkey"), F.col("l_linenumber")
    items = lines.select(
        "l_orderkey", F.when(k % 9 != 0, n).alias("page"), k.alias("item"), F.when(k % 4 != 0, F.concat(F.lit(" Part  "), k % 10)).otherwise(" ").alias("said"), F.when(k % 5 == 0, "A  PART").alias("sku"),
    )
    pages = lines.where("l_linenumber <> 2").groupBy("l_orderkey", n.alias("page")).agg(F.max(k % 10).alias("k"))
    pages = pages.select(
        "l_orderkey", "page", F.when(F.col("page") == 3, "EMPTY").otherwise("PROCESSED").alias("status"), F.when(F.col("l_orderkey") % 11 == 0, "").otherwise(F.concat(F.lit("a  part "), "k", F.lit("\n b"))).alias("raw_text"),
    )
    return p.evidence(items, pages, ["l_orderkey", "page"]).select("l_orderkey", "page", "item", "verdict", "issue")


def sight_pages(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", F.col("l_linenumber").alias("page"), "l_partkey", "l_suppkey", "l_quantity")
    pages = lines.groupBy("l_orderkey", "page").agg(F.repeat(F.lit("x"), (F.min("l_suppkey") * 7 % 200).cast("int")).alias("raw_text"), (F.max("l_partkey") % 12).alias("n_blocks"))
    items = lines.where("l_partkey % 4 <> 0").select(
        "l_orderkey", "page", (F.col("l_partkey") % 2).alias("display"), F.when(F.col("l_partkey") % 11 != 0, F.col("l_quantity")).alias("quantity"),
        F.when(F.col("l_suppkey") % 2 == 0, "ELEVATION").otherwise("SCHEDULE").alias("view_type"), F.when(F.col("l_partkey") % 3 != 0, F.lit("OAK")).alias("finish"),
    )
    return p.needs_sight(pages, items, ["l_orderkey", "page"]).groupBy("why").agg(F.count("*").alias("n"))


def doubtful_by_sight(spark, sf_dir):
    """Items that only sight found, of little confidence; none given counts as full."""
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_discount")
    text = lines.where("l_partkey % 3 = 0").select("l_orderkey", "l_linenumber").distinct()
    seen = lines.where("l_partkey % 3 <> 0").join(text, ["l_orderkey", "l_linenumber"], "left_anti")
    sure = F.coalesce(F.nullif(F.round(F.col("l_discount") * 10, 2), F.lit(0.0)), F.lit(1.0))
    return seen.select("l_orderkey", "l_linenumber", "l_partkey", (sure < 0.4).alias("doubtful"))


def text_routes(spark, sf_dir):
    d = table(spark, sf_dir, "documents").groupBy("source").agg(F.sum(F.length(F.coalesce("text", F.lit("")))).alias("letters"), F.count("*").alias("pages"))
    return d.select("source", F.when(F.col("letters") >= 30, "TEXT").otherwise("IMAGE").alias("route"), F.ceil(F.col("pages") / 3).cast("long").alias("batches"))


def page_batches(spark, sf_dir):
    """Pages by the calls in which they are read, for each kind of call."""
    kinds = F.explode(F.array(*(F.struct(F.lit(k).alias("kind"), p.batch_number(F.col("l_linenumber"), k).alias("batch")) for k in p.PAGES_OF_A_CALL))).alias("x")
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber").repartition("l_orderkey")  # once a line, not once a line and kind
    rows = lines.select("l_orderkey", "l_linenumber", kinds).select("l_orderkey", "l_linenumber", "x.*")
    return rows.groupBy("l_orderkey", "kind", "batch").agg(F.min("l_linenumber").alias("first"), F.max("l_linenumber").alias("last"), F.count("*").alias("n"))


def page_texts(spark, sf_dir):
    """Blocks in reading order and pages put together."""
    blocks = table(spark, sf_dir, "lineitem").select(
        "l_orderkey", F.col("l_linenumber").alias("page"), F.monotonically_increasing_id().alias("row"), (F.col("l_partkey") % 97).cast("double").alias("y"), F.col("l_suppkey").alias("x"),
        F.concat_ws(".", "l_partkey", "l_suppkey", F.col("l_quantity").cast("int")).alias("text"),
    ).drop("row").withColumn("block_id", F.col("text"))
    return p.whole_text(p.reading_order(blocks, ["l_orderkey", "page"]), "l_orderkey", "page")


def sheet_rows(spark, sf_dir):
    cells = [F.when(F.col("p_partkey") % 3 != 0, F.col("p_name")), F.col("p_brand"), F.when(F.col("p_size") % 2 == 0, F.col("p_size").cast("string"))]
    return table(spark, sf_dir, "part").select("p_partkey", F.concat_ws(" | ", *cells).alias("row"))


def page_anchors_once(spark, sf_dir):
    pages = table(spark, sf_dir, "lineitem").select("l_orderkey", F.col("l_linenumber").alias("page"), (F.col("l_partkey") % 3).alias("kind"))
    return p.anchors_once(pages.where("kind = 0"), pages.where("kind = 1"), "l_orderkey", "page")


#: Values and how they are shown; ``#`` stands for a part's number.
_DISPLAYED = (
    (None, "—"), (" undefined ", "—"), (" plain \\ # ", "plain \\ #"), ('{"width": #, "height": "34.5H", "depth": null, "unit": "in"}', '#"W × 34.5H'), ('{"opening": "OPENING #"}', "OPENING #"), ("{'w': 36.0, 'D': ''}", '36"W'),
    ('["a", "#", null]', "a, #, —"), ("[]", "—"), ('{"raw": "x", "color": "red", "no": "", "n": #, "sub": {"w": 3}}', 'color: red, n: #, sub: 3"W'), ("{broken #}", "{broken #}"), ('{"axis_certainty": "x"}', "—"), ('{"a": ["b", "c"]}', "a: b, c"),
)


def displayed_values(spark, sf_dir):
    """Values of every kind as they are shown."""
    k = F.col("p_partkey")
    value = F.replace(F.element_at(F.array(*(F.lit(v) for v, _ in _DISPLAYED)), (k % len(_DISPLAYED) + 1).cast("int")), F.lit("#"), k.cast("string"))
    return table(spark, sf_dir, "part").select("p_partkey", format_display(value).alias("shown"))


def catalogue_rows(spark, sf_dir):
    named = table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("Weight"), F.when(F.col("p_partkey") % 6 != 0, F.concat(F.lit(" "), "p_name", F.lit(" "), F.col("p_partkey").cast("string"))).alias("Item #"), F.col("p_type").alias("Product Description"),
        _one_of(("panel", "Crown trim", "metallic", "Freight charge", "gizmo", "Wall unit", "FILLER", "pull knob"), "p_partkey").alias("Product Type"),
    )
    return dictionary.catalogue(named)


def dictionary_decisions(spark, sf_dir):
    parts = table(spark, sf_dir, "part")
    entries = parts.where("p_partkey % 3 = 0").select(
        F.col("p_brand").alias("maker"), F.concat("p_name", F.lit("-"), F.col("p_size") % 5).alias("code"), F.col("p_partkey").alias("entry_id"), F.lit("PANEL").alias("category"),
        (F.col("p_partkey") % 2 == 0).alias("is_primary"), (F.col("p_partkey") % 5 != 0).alias("is_current"), F.when(F.col("p_size") % 2 == 0, F.col("p_type")).alias("alias_group"),
    )
    items = parts.select(
        F.col("p_partkey").alias("item_id"), F.col("p_brand").alias("maker"), F.concat(F.lit("zz"), F.col("p_partkey")).alias("sku"),
        F.array(F.concat("p_name", F.lit("-"), (F.col("p_size") + 1) % 5), F.concat("p_name", F.lit("-"), F.col("p_size") % 5)).alias("spellings"),
        F.when(F.col("p_partkey") % 4 == 0, "wall cabinet").alias("description"), parse(F.lit(None).cast("string")).alias("dimensions"), (F.col("p_partkey") % 7 == 0).alias("code_conflict"),
    )
    d = dictionary.decide(items, entries)
    return d.select("item_id", "category", "level", "source", F.array_join("reasons", ",").alias("reasons"), F.size("variants").cast("long").alias("variants"))


def category_keywords(spark, sf_dir):
    parts = table(spark, sf_dir, "part")
    return parts.select("p_partkey", dictionary.infer_category(F.concat_ws(" ", F.when(F.col("p_partkey") % 5 != 0, F.col("p_name")), _one_of(("tall", "range top", "soffit", "hinge", "tray"), "p_size"))).alias("category"))


_DOCS = f"d AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_shipdate, {_sql_one_of(_TYPES, 'l_partkey')} AS kind FROM lineitem)"
_FACTS = f"""f AS (SELECT o_orderkey, {_sql_one_of(_STATES, 'o_orderkey')} AS state, coalesce(total, 0) AS total, coalesce(resolved, 0) AS resolved, coalesce(documents, 0) AS documents
  FROM orders LEFT JOIN (SELECT l_orderkey, count(*) AS total, count(*) FILTER (l_partkey % 3 = 0) AS resolved, count(DISTINCT l_partkey % 3) AS documents FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey)"""
_KEYWORDS = " ".join(f"WHEN regexp_matches(lower(t), '{'|'.join(k)}') THEN '{c}'" for c, k in dictionary.KEYWORDS.items())
_CATEGORIES = ", ".join(repr(c) for c in dictionary.CATEGORIES)
_INFER = f"CASE WHEN upper(trim(t)) IN ({_CATEGORIES}) THEN upper(trim(t)) {_KEYWORDS} ELSE 'UNKNOWN' END"

SQL = {
    "displayed_values": "SELECT p_partkey, replace([" + ", ".join(f"'{shown}'" for _, shown in _DISPLAYED) + f"][p_partkey % {len(_DISPLAYED)} + 1], '#', CAST(p_partkey AS VARCHAR)) AS shown FROM part",
    "tenant_projects": "SELECT o_orderkey, o_orderstatus FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_nationkey = 7)",
    "project_lookup": "SELECT o_orderkey, c_nationkey FROM orders JOIN customer ON c_custkey = o_custkey WHERE o_orderkey = 42 LIMIT 1",
    "visible_makers": "SELECT p_partkey, p_partkey % 4 <> 0 AND p_size % 5 = 3 AS editable FROM part WHERE p_partkey % 4 = 0 OR p_size % 5 = 3",
    "lenient_filter": "SELECT o_orderstatus, count(*) AS n FROM orders WHERE upper(o_orderpriority) = '1-URGENT' GROUP BY 1",
    "required_documents": f"""WITH {_DOCS}, k AS (SELECT l_orderkey, bool_or(kind = 'DESIGN') AS d, bool_or(kind = 'ACKNOWLEDGEMENT') AS a, bool_or(kind IN ('ORDER', 'CABINET_LIST')) AS o FROM d GROUP BY 1)
        SELECT l_orderkey, concat_ws(', ', CASE WHEN NOT d THEN 'DESIGN' END, CASE WHEN NOT a THEN 'ACKNOWLEDGEMENT' END, CASE WHEN NOT o THEN 'ORDER or CABINET_LIST' END) AS missing, d AND a AND o AS ready FROM k""",
    "documents_by_type": f"WITH {_DOCS} SELECT CASE WHEN kind = 'CABINET_LIST' THEN 'ORDER' ELSE kind END AS kind, count(*) AS n FROM d GROUP BY 1",
    "document_list": """WITH d AS (SELECT doc_id, lower(source) AS name, lang, ['PROCESSING', 'UPLOADED', 'COMPLETED', 'FAILED'][doc_id % 4 + 1] AS status FROM documents)
        SELECT 0 AS asked, doc_id, status FROM d WHERE contains(name, '1') AND status IN ('PROCESSING', 'UPLOADED') UNION ALL SELECT 1, doc_id, status FROM d WHERE lang = 'de' AND status = 'COMPLETED'
        UNION ALL SELECT 2, doc_id, status FROM d WHERE contains(name, 'so') AND lang = 'en' AND status = 'FAILED' UNION ALL SELECT 3, doc_id, status FROM d WHERE lang = 'fr'""",
    "last_documents": f"WITH {_DOCS} SELECT l_orderkey, kind, arg_max(l_partkey, (l_shipdate, l_linenumber, l_partkey)) AS l_partkey FROM d GROUP BY 1, 2",
    "vanished_documents": "WITH n AS (SELECT DISTINCT l_orderkey, l_linenumber, l_partkey FROM lineitem WHERE l_suppkey % 50 <> 0) SELECT DISTINCT l_orderkey FROM lineitem l WHERE NOT EXISTS (SELECT 1 FROM n WHERE n.l_orderkey = l.l_orderkey AND n.l_linenumber = l.l_linenumber AND n.l_partkey = l.l_partkey)",
    "project_overview": f"""WITH {_FACTS} SELECT *, CAST(CASE WHEN state IN ('FINALIZED', 'COMPLETED') THEN 100 WHEN state = 'PROCESSING' THEN 70 WHEN state = 'REVIEW_REQUIRED' THEN CASE WHEN total > 0 THEN 70 + floor(resolved / total * 30) ELSE 90 END
        WHEN state = 'FAILED' THEN 25 ELSE [0, 33, 66, 100][least(documents, 3) + 1] END AS INT) AS progress FROM f""",
    "project_totals": f"""WITH {_FACTS} SELECT CAST(sum(documents) AS BIGINT) AS documents, CAST(sum(total) AS BIGINT) AS differences, CAST(sum(greatest(0, total - resolved)) AS BIGINT) AS open,
        count(*) FILTER (state IN ('COMPLETED', 'FINALIZED')) AS finished, CAST(floor(count(*) FILTER (state IN ('COMPLETED', 'FINALIZED')) * 100 / count(*) + 0.5) AS BIGINT) AS rate FROM f""",
    "dashboard": f"WITH {_FACTS} SELECT CASE WHEN state = 'FINALIZED' THEN 'COMPLETED' ELSE state END AS state, count(*) AS n, count(*) FILTER (total > resolved) AS unfinished FROM f GROUP BY 1",
    "items_per_page": "SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY 1, 2",
    "groups_by_code": "SELECT CASE WHEN p_partkey % 7 <> 0 THEN upper(p_name) ELSE 'Unknown SKU' END AS code, count(*) FILTER (p_partkey % 3 = 0) AS matched, count(*) FILTER (p_partkey % 3 = 1) AS changed, count(*) FILTER (p_partkey % 3 = 2) AS missing FROM part GROUP BY 1",
    "groups_with_critical": "SELECT user_id, bool_or(event_type = 'error') AS critical, count(*) FILTER (event_type <> 'error' AND value > 100) AS open FROM events GROUP BY 1",
    "sorted_projects": """WITH o AS (SELECT o_orderkey, c_name AS name, CASE WHEN o_orderkey % 3 <> 0 THEN o_orderdate + INTERVAL 400 DAY ELSE o_orderdate END AS changed FROM orders JOIN customer ON c_custkey = o_custkey),
        r AS (SELECT *, row_number() OVER (ORDER BY changed DESC, o_orderkey) AS a, row_number() OVER (ORDER BY changed, o_orderkey) AS b, row_number() OVER (ORDER BY name, o_orderkey) AS c, row_number() OVER (ORDER BY name DESC, o_orderkey) AS d FROM o)
        SELECT 'updated_desc' AS mode, o_orderkey, name FROM r WHERE a <= 50 UNION ALL SELECT 'updated_asc', o_orderkey, name FROM r WHERE b <= 50 UNION ALL SELECT 'name_asc', o_orderkey, name FROM r WHERE c <= 50 UNION ALL SELECT 'name_desc', o_orderkey, name FROM r WHERE d <= 50""",
    "catalogue_order": "SELECT p_partkey, CASE WHEN p_size % 4 <> 0 THEN p_size END AS page, p_name FROM part ORDER BY page ASC NULLS LAST, p_name, p_partkey LIMIT 50",
    "latest_job": "SELECT user_id, arg_max(event_id, (ts, event_id)) AS job, arg_max(event_id, (ts, event_id)) FILTER (event_type NOT IN ('purchase', 'error')) AS active FROM events GROUP BY 1",
    "extraction_attempts": "SELECT event_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS INT) AS attempt, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1 AS is_latest FROM events",
    "latest_extractions": "SELECT user_id, arg_max(event_id, (ts, event_id)) AS event_id, CAST(count(*) AS INT) AS attempt FROM events WHERE user_id % 2 = 0 GROUP BY 1",
    "import_errors": "WITH b AS (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) AS n FROM part WHERE p_partkey % 3 = 1) SELECT p_brand, string_agg(substr(p_partkey || ': ' || p_name, 1, 20), ';' ORDER BY n) FILTER (n <= 50) AS errors, count(*) AS invalid FROM b GROUP BY 1",
    "overlaid_documents": f"""WITH {_DOCS}, s AS (SELECT l_orderkey || '/' || kind AS slot, l_partkey FROM d), w AS (SELECT slot, max(l_partkey) + 1 AS l_partkey FROM s WHERE l_partkey % 10 = 0 GROUP BY 1)
        SELECT slot, count(*) AS n, max(l_partkey) AS newest FROM (SELECT * FROM s WHERE slot NOT IN (SELECT slot FROM w) UNION ALL SELECT * FROM w) GROUP BY 1""",
    "documents_to_extract": """WITH d AS (SELECT doc_id, sha256(text) AS hash, doc_id % 3 AS version, source, lang, CASE WHEN doc_id % 5 <> 0 THEN doc_id % 2 END AS prompt FROM documents)
        SELECT doc_id FROM d WHERE NOT EXISTS (SELECT 1 FROM d c WHERE c.doc_id % 4 <> 0 AND c.hash IS NOT DISTINCT FROM d.hash AND c.version = d.version AND c.source IS NOT DISTINCT FROM d.source AND c.lang IS NOT DISTINCT FROM d.lang AND c.prompt IS NOT DISTINCT FROM d.prompt)""",
    "silent_jobs": "WITH e AS (SELECT *, lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS before FROM events) SELECT event_id, CAST(floor((epoch_us(ts) // 1000000 - epoch_us(before) // 1000000) / 3600) AS BIGINT) AS hours FROM e WHERE ts > before + INTERVAL 2 DAY",
    "timestamps": "SELECT event_id, CASE WHEN event_id % 5 <> 0 THEN strftime(ts, '%Y-%m-%d %H:%M') END AS told FROM events",
    "json_values": "SELECT event_id, CASE WHEN event_id % 3 = 0 THEN 'not ' || props ELSE regexp_extract(props, '\"k\": ([0-9]+)', 1) END AS value FROM events",
    "flags_and_names": "SELECT p_partkey, p_partkey % 6 NOT IN (3, 4) AS flag, regexp_replace(p_name || 'a b#' || p_partkey || '.pdf', '[^A-Za-z0-9._-]', '_', 'g') AS name FROM part",
    "formatted_values": "SELECT p_partkey, ['36 × 12 × 24', '12', 'OPENING 30', '-'][p_partkey % 4 + 1] AS size, ['Item presence', 'Door Style', 'Drawer Box', 'SKU'][p_size % 4 + 1] AS label FROM part",
    "page_evidence": """WITH g AS (SELECT l_orderkey, l_linenumber AS n, max(l_partkey % 10) AS k FROM lineitem WHERE l_linenumber <> 2 GROUP BY 1, 2),
        j AS (SELECT l.l_orderkey, CASE WHEN l_partkey % 9 <> 0 THEN l_linenumber END AS page, l_partkey AS item, l_partkey % 4 <> 0 AS says, l_partkey % 5 = 0 AS sku, g.k, l_partkey % 10 AS mine, g.n = 3 OR l.l_orderkey % 11 = 0 AS unread
          FROM lineitem l LEFT JOIN g ON g.l_orderkey = l.l_orderkey AND g.n = l_linenumber AND l_partkey % 9 <> 0),
        i AS (SELECT *, CASE WHEN page IS NULL THEN CASE WHEN NOT says THEN 'EMPTY_EVIDENCE' END WHEN k IS NULL THEN 'INVALID_EVIDENCE' WHEN unread THEN NULL WHEN NOT says THEN 'EMPTY_EVIDENCE' WHEN NOT sku AND k <> mine THEN 'SOURCE_TEXT_MISMATCH' END AS issue FROM j)
        SELECT l_orderkey, page, item, CASE WHEN page IS NOT NULL AND k IS NOT NULL AND NOT unread AND issue IS NULL THEN 'VERIFIED' ELSE 'UNCERTAIN' END AS verdict, issue FROM i""",
    "sight_pages": """WITH g AS (SELECT l_orderkey, l_linenumber AS page, min(l_suppkey) * 7 % 200 AS size, max(l_partkey) % 12 AS blocks FROM lineitem GROUP BY 1, 2),
        i AS (SELECT l_orderkey, l_linenumber AS page, count(*) AS n, count(*) FILTER (l_partkey % 11 = 0 OR l_quantity = 0) AS bare FROM lineitem WHERE l_partkey % 4 <> 0 GROUP BY 1, 2),
        u AS (SELECT DISTINCT l_orderkey, page FROM (SELECT l_orderkey, l_linenumber AS page, l_partkey % 2 AS display FROM lineitem WHERE l_partkey % 4 <> 0 AND l_suppkey % 2 = 0 GROUP BY ALL HAVING count(*) FILTER (l_partkey % 3 <> 0) = 0))
        SELECT CASE WHEN size = 0 THEN 'EMPTY' WHEN blocks < 3 OR size < 80 THEN 'SPARSE' WHEN n IS NULL THEN 'NO_ITEMS' WHEN bare > 0 THEN 'NO_QUANTITY' WHEN u.page IS NOT NULL THEN 'NO_FINISH' END AS why, count(*) AS n
        FROM g LEFT JOIN i USING (l_orderkey, page) LEFT JOIN u USING (l_orderkey, page) GROUP BY 1""",
    "doubtful_by_sight": """WITH t AS (SELECT DISTINCT l_orderkey, l_linenumber FROM lineitem WHERE l_partkey % 3 = 0) SELECT l_orderkey, l_linenumber, l_partkey, coalesce(nullif(round(l_discount * 10, 2), 0), 1) < 0.4 AS doubtful
        FROM lineitem l WHERE l_partkey % 3 <> 0 AND NOT EXISTS (SELECT 1 FROM t WHERE t.l_orderkey = l.l_orderkey AND t.l_linenumber = l.l_linenumber)""",
    "text_routes": "SELECT source, CASE WHEN sum(length(coalesce(text, ''))) >= 30 THEN 'TEXT' ELSE 'IMAGE' END AS route, CAST(ceil(count(*) / 3) AS BIGINT) AS batches FROM documents GROUP BY 1",
    "page_batches": """SELECT l_orderkey, kind, CAST(floor((l_linenumber - 1) / k) AS BIGINT) AS batch, min(l_linenumber) AS first, max(l_linenumber) AS last, count(*) AS n
        FROM lineitem, (VALUES ('text', 3), ('vision', 6), ('ocr', 6), ('spec_book', 10)) AS v(kind, k) GROUP BY 1, 2, 3""",
    "page_texts": """WITH b AS (SELECT l_orderkey, l_linenumber AS page, l_partkey || '.' || l_suppkey || '.' || CAST(trunc(l_quantity) AS INT) AS t, round_even(l_partkey % 97 / 10, 0) AS y, l_suppkey AS x FROM lineitem),
        g AS (SELECT l_orderkey, page, string_agg(t, chr(10) ORDER BY y, x, t) AS text FROM b GROUP BY 1, 2)
        SELECT l_orderkey, string_agg('--- PAGE ' || page || ' ---' || chr(10) || text, chr(10) ORDER BY page) AS text FROM g GROUP BY 1""",
    "sheet_rows": "SELECT p_partkey, concat_ws(' | ', CASE WHEN p_partkey % 3 <> 0 THEN p_name END, p_brand, CASE WHEN p_size % 2 = 0 THEN CAST(p_size AS VARCHAR) END) AS row FROM part",
    "catalogue_rows": f"""SELECT p_name || ' ' || p_partkey AS code, p_type AS description, {_INFER} AS category, CAST(1 AS DOUBLE) AS confidence
        FROM (SELECT *, ['panel', 'Crown trim', 'metallic', 'Freight charge', 'gizmo', 'Wall unit', 'FILLER', 'pull knob'][p_partkey % 8 + 1] AS t FROM part WHERE p_partkey % 6 <> 0)""",
    "category_keywords": f"SELECT p_partkey, {_INFER} AS category FROM (SELECT p_partkey, concat_ws(' ', CASE WHEN p_partkey % 5 <> 0 THEN p_name END, ['tall', 'range top', 'soffit', 'hinge', 'tray'][p_size % 5 + 1]) AS t FROM part)",
    "dictionary_decisions": """WITH c AS (SELECT p_brand AS maker, upper(p_name || '-' || p_size % 5) AS code, p_name || '-' || p_size % 5 AS written, p_partkey AS id, p_partkey % 2 = 0 AS main, CASE WHEN p_size % 2 = 0 THEN p_type END AS mates FROM part WHERE p_partkey % 3 = 0 AND p_partkey % 5 <> 0),
        e AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY maker, code ORDER BY id) AS n FROM c) WHERE n = 1),
        t AS (SELECT p.*, one.id AS id1, two.id AS id2, p_name || '-' || (p_size + 1) % 5 AS s1, p_name || '-' || p_size % 5 AS s2 FROM part p
          LEFT JOIN e one ON one.maker = p_brand AND one.code = upper(p_name || '-' || (p_size + 1) % 5) LEFT JOIN e two ON two.maker = p_brand AND two.code = upper(p_name || '-' || p_size % 5)),
        h AS (SELECT t.*, e.id, e.main, e.mates, e.maker FROM t LEFT JOIN e ON e.id = coalesce(id1, id2)),
        v AS (SELECT h.p_partkey, count(DISTINCT c.written) AS more FROM h JOIN c ON c.maker = h.maker AND c.mates = h.mates AND c.id <> h.id AND c.written NOT IN (h.s1, h.s2) GROUP BY 1)
        SELECT h.p_partkey AS item_id, CASE WHEN id IS NOT NULL THEN 'PANEL' WHEN h.p_partkey % 4 = 0 THEN 'CABINET' ELSE 'UNKNOWN' END AS category,
          CASE WHEN id IS NOT NULL THEN 'HIGH' WHEN h.p_partkey % 7 = 0 THEN 'UNCERTAIN' WHEN h.p_partkey % 4 = 0 THEN 'MEDIUM' ELSE 'LOW' END AS level,
          CASE WHEN id IS NOT NULL THEN CASE WHEN main THEN 'MANUFACTURER_EXACT' ELSE 'MANUFACTURER_ALIAS' END WHEN h.p_partkey % 4 = 0 THEN 'DOCUMENT_CONTEXT' ELSE 'NONE' END AS source,
          CASE WHEN id IS NOT NULL THEN CASE WHEN main THEN 'EXACT_MANUFACTURER_MATCH' ELSE 'MANUFACTURER_ALIAS_MATCH' END
            ELSE concat_ws(',', CASE WHEN h.p_partkey % 4 = 0 THEN 'DOCUMENT_CONTEXT_MATCH' ELSE 'AMBIGUOUS_SKU' END, 'NO_MANUFACTURER_MATCH', CASE WHEN h.p_partkey % 7 = 0 THEN 'OCR_VISION_CONFLICT' END) END AS reasons,
          3 + coalesce(more, 0) AS variants FROM h LEFT JOIN v ON v.p_partkey = h.p_partkey""",
}
QUERIES = [
    displayed_values,
    tenant_projects, project_lookup, visible_makers, lenient_filter, required_documents, documents_by_type, document_list, last_documents, vanished_documents, project_overview,
    project_totals, dashboard, items_per_page, groups_by_code, groups_with_critical, sorted_projects, catalogue_order, latest_job, extraction_attempts, latest_extractions,
    import_errors, overlaid_documents, documents_to_extract, silent_jobs, timestamps, json_values, flags_and_names, formatted_values,
    page_evidence, sight_pages, doubtful_by_sight, text_routes, page_batches, page_texts, sheet_rows, page_anchors_once, catalogue_rows, category_keywords, dictionary_decisions,
]
