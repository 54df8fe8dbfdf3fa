"""Queries over line items: normalization, units, matching, differences."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from triplicate.functions import classification as rules
from triplicate.functions import dimensions as dims
from triplicate.functions.classification import classify
from triplicate.functions.equivalence import code_match, item_match, with_features
from triplicate.functions.text import FINISH_ALIASES, SPEC_ALIASES, UNSPECIFIED, canonical_finish, normalize_quantity, normalize_sku, normalize_spec, sku_tokens
from triplicate.operators.crosscheck import discrepancies, finalize
from triplicate.operators.matching import match_members, split_scope
from triplicate.operators.units import aggregate_units, resolve_views
from triplicate.sources.scratch import stored
from triplicate.sources.contested_items import contested_items, groups_sql
from triplicate.sources.line_items import ITEMS_SQL, line_items, table


def _stored(spark: SparkSession, sf_dir: str, name: str, build) -> DataFrame:
    """What is made of lines and parts once and used by many queries."""
    return stored(name, spark, [f"{sf_dir.rstrip('/')}/{t}.parquet" for t in ("lineitem", "part")], build, alone=True)


_GROUP = ("project_id", "design_id", "order_id", "ack_id", "status", "decided")


def _members(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups with their units; lines become units and units groups in one go, of which this alone is kept."""
    return _stored(spark, sf_dir, "members", lambda: match_members(aggregate_units(line_items(spark, sf_dir))))


def _groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _members(spark, sf_dir).select(*_GROUP)


def _checked(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    members = _members(spark, sf_dir)
    return members, _stored(spark, sf_dir, "differences", lambda: discrepancies(members))


def sku_normalize(spark, sf_dir):
    return line_items(spark, sf_dir).select("item_id", normalize_sku(F.col("raw_sku")).alias("sku"), F.array_join(sku_tokens(F.col("raw_sku")), "+").alias("tokens"))


def size_parse(spark, sf_dir):
    d = F.col("dimensions")
    return line_items(spark, sf_dir).select("item_id", d["width"].alias("width"), d["height"].alias("height"), d["depth"].alias("depth"), d["axis_certainty"].alias("axis_certainty"))


def classify_parts(spark, sf_dir):
    parts = table(spark, sf_dir, "part")
    kinds = F.element_at(F.lit(["base cabinet", "crown molding", "Range hood", "end panel", "WALL FILLER", "lazy susan", "freight", "window", "plain"]), (F.col("p_partkey") % 9 + 1).cast("int"))
    codes = F.element_at(F.lit(["B", "EP", "REF.", "BF", "SCM", "X9-TK-", "CAB", "BFH-", "Z"]), (F.col("p_size") % 9 + 1).cast("int"))
    c = classify(F.concat(codes, F.col("p_size")), F.when(F.col("p_partkey") % 2 == 0, F.concat("p_name", F.lit(" "), kinds)))
    return parts.select("p_partkey", c["category"].alias("category"), c["confidence"].alias("confidence"), c["rule"].alias("rule"))


def units_aggregate(spark, sf_dir):
    """Two lines of one part in an order's design count as one unit: here lines are keyed by size alone."""
    rows = line_items(spark, sf_dir).withColumn("raw_sku", F.concat(F.lit("B"), F.col("dimensions.width").cast("int")))
    u = aggregate_units(rows)
    return u.select("project_id", "side", "unit_id", "raw_sku", "finish", "quantity", F.col("raw_line_count").alias("lines"), F.array_join("raw_line_ids", ",").alias("line_ids"))


def _viewed(spark, sf_dir) -> DataFrame:
    view = F.element_at(F.lit(["FLOORPLAN", "ELEVATION", "SCHEDULE", "LEGEND"]), (F.col("ord") % 4 + 1).cast("int"))
    rows = line_items(spark, sf_dir).where("side = 'DESIGN'")
    return rows.withColumns(
        {
            "view_type": F.when(F.col("ord") % 5 != 0, view),
            "position": F.concat(F.lit("Display "), (F.col("ord") % 2).cast("string")),
            "raw_sku": F.lit("B36"),
            "finish": F.when(F.col("quantity") % 3 != 0, F.col("finish")),
            "door_style": F.lit(None).cast("string"),
        }
    )


def views_resolved(spark, sf_dir):
    q = F.col("quantity_resolution")
    return resolve_views(_viewed(spark, sf_dir)).select(
        "item_id", "view_type", "finish", "quantity", q["resolved_quantity"].alias("resolved"), q["resolution_method"].alias("method"), q["confidence_status"].alias("confidence")
    )


def code_pairs(spark, sf_dir):
    """Codes of neighbouring lines of an order compared across sides and styles of writing."""
    rows = with_features(line_items(spark, sf_dir)).select("project_id", "side", "ord", "f")
    d, o = rows.where("side = 'DESIGN'").alias("d"), rows.where("side <> 'DESIGN'").alias("o")
    pairs = d.join(o, (F.col("d.project_id") == F.col("o.project_id")) & (F.abs(F.col("d.ord") - F.col("o.ord")) <= 1))
    m = code_match(F.col("d.f"), F.col("o.f"))
    return pairs.select("d.project_id", F.col("d.ord").alias("ord"), F.col("o.side").alias("side"), F.col("o.ord").alias("other"), m.alias("match"))


def size_pairs(spark, sf_dir):
    rows = line_items(spark, sf_dir).select("project_id", "side", "ord", "dimensions")
    d, o = rows.where("side = 'DESIGN'").alias("d"), rows.where("side = 'ORDER'").alias("o")
    pairs = d.join(o, ["project_id", "ord"])
    return pairs.select("project_id", "ord", dims.reason(F.col("d.dimensions"), F.col("o.dimensions")).alias("reason"))


def _versions(spark, sf_dir) -> DataFrame:
    """Two versions of each part: code and description of both, and what the second one substitutes."""
    k, size = F.col("p_partkey"), F.col("p_size") + 10
    text = lambda pattern: F.format_string(pattern, k)
    sized = lambda pattern, n=size: F.format_string(pattern, n)
    named, none = F.concat("p_name", F.lit(" panel")), F.lit(None).cast("string")
    ways = (
        (text("B36-%dTD"), none, text("b36 %dtd"), none, none), (text("B36%dTD"), none, text("B36 %dTD"), none, none),
        (sized("CAB-%d-L"), none, sized("CAB-%d-R"), none, none), (text("BASE%d"), none, text("WALL%d"), none, none),
        (sized("SB%d"), none, sized("SB%d BUTT"), none, none), (none, named, none, F.upper(named), none), (none, none, none, none, none),
        (text("W%d"), none, none, none, none), (text("W%d"), none, F.lit("X77"), none, text("w%d")),
        (sized("W%d"), F.lit("WALL DOOR BASE"), sized("V%d", size + 60), F.lit("WALL DOOR BASE"), none), (text("b%d  butt"), none, text("B%d BUTT"), none, none),
        (sized("BFHC%d"), F.lit("HUTCH COLUMN BASE"), sized("BPFHC%d"), F.lit("HUTCH COLUMN BASE"), none),
    )
    nth = (k % len(ways) + 1).cast("int")
    pick = lambda i: F.element_at(F.array(*(w[i] for w in ways)), nth)
    return table(spark, sf_dir, "part").select("p_partkey", *(pick(i).alias(c) for i, c in enumerate(("s1", "t1", "s2", "t2", "sub"))))


def item_pairs(spark, sf_dir):
    """How two versions of each part match."""
    rows = _versions(spark, sf_dir)
    side = lambda n: (F.col(f"s{n}").alias("raw_sku"), F.col(f"t{n}").alias("description"), F.lit("CABINET").alias("category"), dims.parse(F.lit(None).cast("string")).alias("dimensions"))
    one = with_features(rows.select("p_partkey", *side(1))).select("p_partkey", F.col("f").alias("a"))
    other = with_features(rows.select("p_partkey", "sub", *side(2)), substitution="sub").select("p_partkey", F.col("f").alias("b"))
    # Features are many times as large as the columns that they are made of, by whose size Spark would broadcast them.
    return one.join(other.hint("merge"), "p_partkey").select("p_partkey", item_match(F.col("a"), F.col("b")).alias("match"))


#: Ways of writing a name; each part has one of them.
_SPELLINGS = (F.lower, lambda c: F.concat(F.lit("  "), F.replace(c, F.lit(" "), F.lit("   "))), lambda c: F.concat(F.initcap(c), F.lit(" \t")))


def _spelled(names) -> Column:
    """One of the names for each part, spelled in one of the ways."""
    k = F.col("p_partkey")
    name = F.element_at(F.lit(list(names)), (k % len(names) + 1).cast("int"))
    return F.element_at(F.array(*(f(name) for f in _SPELLINGS)), (F.floor(k / len(names)) % 3 + 1).cast("int"))


_SPECS = (*SPEC_ALIASES, *UNSPECIFIED, "WALNUT", "RED  OAK")
_FINISHES = (*FINISH_ALIASES, *UNSPECIFIED, "CASHMERE", "ALPINE")


def spec_and_finish(spark, sf_dir):
    """Materials and finishes by their one names."""
    parts = table(spark, sf_dir, "part")
    return parts.select("p_partkey", normalize_spec(_spelled(_SPECS)).alias("spec"), canonical_finish(_spelled(_FINISHES)).alias("finish"))


def quantities(spark, sf_dir):
    """Quantities read from the texts in which they are written."""
    n = F.col("l_quantity").cast("int").cast("string")
    ways = F.array(F.lpad(n, 3, "0"), F.concat(n, F.lit(".0")), F.concat(F.lit("Qty: "), n), F.concat(F.lit(" qty "), n, F.lit(" EA")), F.concat(F.lit("-"), n), F.lit("N/A"), F.lit(None).cast("string"))
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", normalize_quantity(F.element_at(ways, (F.col("l_partkey") % 7 + 1).cast("int"))).alias("quantity"))


def scope(spark, sf_dir):
    rows = line_items(spark, sf_dir).withColumn("finish", F.when((F.col("side") == "DESIGN") & (F.col("ord") == 1), "Faraway Lacquer").otherwise(F.col("finish"))).withColumn("door_style", F.lit(None).cast("string"))
    inside, outside = split_scope(rows)
    return outside.select("item_id")


def match_groups(spark, sf_dir):
    return _groups(spark, sf_dir).select("project_id", "design_id", "order_id", "ack_id", "status")


def _contested(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _stored(spark, sf_dir, "contested-members", lambda: match_members(aggregate_units(contested_items(spark, sf_dir))))


def _contested_checked(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    members = _contested(spark, sf_dir)
    return members, _stored(spark, sf_dir, "contested-differences", lambda: discrepancies(members))


def contested_groups(spark, sf_dir):
    """Groups where codes repeat, are substituted, spelled otherwise or listed with the maker's code: most are decided in order."""
    return _contested(spark, sf_dir).select("project_id", "design_id", "order_id", "ack_id", "status")


def contested_differences(spark, sf_dir):
    return _contested_checked(spark, sf_dir)[1].groupBy("field", "introduced_at", "severity").agg(F.count("*").alias("n"))


def match_status_counts(spark, sf_dir):
    return _groups(spark, sf_dir).groupBy("status").agg(F.count("*").alias("n"))


def differences(spark, sf_dir):
    return _checked(spark, sf_dir)[1].select("project_id", "design_id", "order_id", "ack_id", "field", "design_value", "order_value", "ack_value", "introduced_at", "severity")


def final_state(spark, sf_dir):
    members, found = _checked(spark, sf_dir)
    return finalize(members, found)


def difference_summary(spark, sf_dir):
    s = lambda x: F.count_if(F.col("severity") == x)
    return _checked(spark, sf_dir)[1].agg(
        F.count_if(F.col("status") == "OPEN").alias("open"), s("Critical").alias("critical"), s("Warning").alias("warning"), s("Info").alias("info"), F.lit(0).cast("long").alias("high")
    )


def field_summary(spark, sf_dir):
    rank = F.when(F.col("severity") == "Critical", 3).when(F.col("severity") == "Warning", 2).otherwise(1)
    return _checked(spark, sf_dir)[1].where("field <> 'item_presence'").groupBy("field").agg(F.count("*").alias("n"), F.max(rank).alias("worst"))


def project_progress(spark, sf_dir):
    """Share of matched groups and a verdict for each project."""
    members, found = _checked(spark, sf_dir)
    g = finalize(members, found)
    k = g.groupBy("project_id").agg(F.count("*").alias("groups"), F.count_if(F.col("status") == "MATCHED").alias("matched"), F.count_if(F.col("status").isin("MISSING", "EXTRA")).alias("critical"))
    share = F.floor(F.col("matched") * 100 / F.col("groups")).cast("int")
    verdict = F.when((share >= 90) & (F.col("critical") == 0), "good").when(share >= 70, "fair").otherwise("poor")
    return k.select("project_id", "groups", "matched", "critical", share.alias("share"), verdict.alias("verdict"))


def _classify_sql() -> str:
    """The same rules by the other engine's regular expressions, from the same fixed values."""
    quoted = lambda x: "'" + x.replace("'", "''") + "'"
    steps = [f"WHEN regexp_matches(text, {quoted(rules.phrases_pattern(c, p))}) THEN ({quoted(c)}, {n}, 'description')" for c, n, p in rules.DESCRIPTION_RULES]
    steps += [f"WHEN regexp_matches(code, {quoted(rules.codes_pattern(p))}) THEN ({quoted(c)}, {n}, 'code')" for c, n, p in rules.CODE_RULES]
    kinds = " ".join(f"WHEN t IN ({', '.join(map(quoted, tokens))}) THEN {quoted(c)}" for c, tokens in rules.TOKEN_RULES.items())
    first = f"list_filter(list_transform(regexp_split_to_array(code, '[\\s\\-_./]+'), lambda t: CASE {kinds} END), lambda c: c IS NOT NULL)[1]"
    return f"""WITH p AS (SELECT p_partkey, ['B', 'EP', 'REF.', 'BF', 'SCM', 'X9-TK-', 'CAB', 'BFH-', 'Z'][p_size % 9 + 1] || p_size AS code,
          CASE WHEN p_partkey % 2 = 0 THEN upper(p_name || ' ' || ['base cabinet', 'crown molding', 'Range hood', 'end panel', 'WALL FILLER', 'lazy susan', 'freight', 'window', 'plain'][p_partkey % 9 + 1]) ELSE '' END AS text FROM part),
        c AS (SELECT p_partkey, {first} AS token, CASE {' '.join(steps)} END AS r FROM p)
        SELECT p_partkey, coalesce(r[1], token, 'UNKNOWN') AS category, CAST(CASE WHEN r IS NOT NULL THEN r[2] WHEN token IS NOT NULL THEN 0.85 ELSE 0.4 END AS DOUBLE) AS confidence,
          CASE WHEN r IS NOT NULL THEN r[3] WHEN token IS NOT NULL THEN 'token' ELSE 'none' END AS rule FROM c"""


def _aliases_sql() -> str:
    """Names looked up in the same fixed values, after trimming, single spaces and upper case."""
    quoted = lambda x: "'" + x.replace("'", "''") + "'"
    listed = lambda names: "[" + ", ".join(map(quoted, names)) + "]"
    known = lambda aliases: ", ".join(f"({quoted(a)}, {quoted(b)})" for a, b in aliases.items())
    written = lambda names: f"upper(regexp_replace(trim({listed(names)}[p_partkey % {len(names)} + 1]), '\\s+', ' ', 'g'))"
    told = lambda c: f"CASE WHEN {c} NOT IN ({', '.join(map(quoted, UNSPECIFIED))}) THEN {c} END"
    return f"""WITH t AS (SELECT p_partkey, {written(_SPECS)} AS s, {written(_FINISHES)} AS f FROM part), a AS (SELECT * FROM (VALUES {known(SPEC_ALIASES)}) AS x(raw, name)), b AS (SELECT * FROM (VALUES {known(FINISH_ALIASES)}) AS x(raw, name))
        SELECT p_partkey, coalesce(a.name, {told('s')}) AS spec, coalesce(b.name, {told('f')}) AS finish FROM t LEFT JOIN a ON a.raw = s LEFT JOIN b ON b.raw = f"""


_WRITTEN = ", pairs AS (SELECT project_id, ord, MAX(CASE WHEN side = 'DESIGN' THEN item_id END) AS design_id, MAX(CASE WHEN side = 'ORDER' THEN item_id END) AS order_id, MAX(CASE WHEN side = 'ACK' THEN item_id END) AS ack_id, ANY_VALUE(k) AS k FROM items GROUP BY project_id, ord)"
_STATUS = "CASE WHEN design_id IS NOT NULL AND order_id IS NOT NULL THEN 'MATCHED' WHEN design_id IS NOT NULL AND ack_id IS NOT NULL THEN 'CHANGED' WHEN design_id IS NOT NULL THEN 'MISSING' ELSE 'EXTRA' END"
_WIDE = """, w AS (
  SELECT p.*, STATUS AS status, d.quantity AS dq, o.quantity AS oq, a.quantity AS aq, d.width AS dw, o.width AS ow, a.width AS aw, d.height AS h,
    d.finish AS df, o.finish AS of, a.finish AS af, d.door_style AS dd, o.door_style AS od, a.door_style AS ad,
    d.species AS ds, o.species AS os, a.species AS as_, d.drawer_box AS db, o.drawer_box AS ob, a.drawer_box AS ab,
    coalesce(a.raw_sku, o.raw_sku, d.raw_sku) AS final_sku,
    CASE WHEN p.ack_id IS NOT NULL THEN a.quantity WHEN p.order_id IS NOT NULL THEN o.quantity ELSE d.quantity END AS final_quantity,
    CASE WHEN p.ack_id IS NOT NULL THEN a.finish WHEN p.order_id IS NOT NULL THEN o.finish ELSE d.finish END AS final_finish,
    CASE WHEN p.ack_id IS NOT NULL THEN a.door_style WHEN p.order_id IS NOT NULL THEN o.door_style ELSE d.door_style END AS final_door_style,
    coalesce(a.price, o.price, d.price) AS final_price
  FROM pairs p LEFT JOIN items d ON d.item_id = p.design_id LEFT JOIN items o ON o.item_id = p.order_id LEFT JOIN items a ON a.item_id = p.ack_id),
spec AS (SELECT * FROM (VALUES ('QS OAK', 'QUARTER SAWN OAK'), ('QSOAK', 'QUARTER SAWN OAK'), ('DT', 'DOVETAIL')) AS t(raw, name)),
n AS (SELECT w.*, coalesce(s1.name, upper(ds)) AS nds, coalesce(s2.name, upper(os)) AS nos, coalesce(s3.name, upper(as_)) AS nas, coalesce(s4.name, upper(db)) AS ndb, coalesce(s5.name, upper(ob)) AS nob, coalesce(s6.name, upper(ab)) AS nab
  FROM w LEFT JOIN spec s1 ON s1.raw = upper(ds) LEFT JOIN spec s2 ON s2.raw = upper(os) LEFT JOIN spec s3 ON s3.raw = upper(as_) LEFT JOIN spec s4 ON s4.raw = upper(db) LEFT JOIN spec s5 ON s5.raw = upper(ob) LEFT JOIN spec s6 ON s6.raw = upper(ab)),
f AS (
  SELECT *, 'item_presence' AS field, CASE WHEN design_id IS NOT NULL THEN 'PRESENT' ELSE 'ABSENT' END AS design_value,
    CASE WHEN design_id IS NOT NULL AND ack_id IS NULL THEN 'MISSING' WHEN design_id IS NOT NULL THEN 'OMITTED' WHEN order_id IS NULL THEN 'ABSENT' WHEN ack_id IS NULL THEN 'ADDED' ELSE 'PRESENT' END AS order_value,
    CASE WHEN design_id IS NOT NULL AND ack_id IS NULL THEN 'MISSING' WHEN design_id IS NOT NULL THEN 'RESTORED' WHEN ack_id IS NULL THEN 'OMITTED' ELSE 'PRESENT' END AS ack_value,
    CASE WHEN design_id IS NOT NULL THEN 'DESIGN' WHEN order_id IS NOT NULL THEN 'ORDER' ELSE 'ACKNOWLEDGEMENT' END AS introduced_at,
    CASE WHEN design_id IS NOT NULL AND ack_id IS NOT NULL THEN 'Warning' ELSE 'Critical' END AS severity
  FROM n WHERE design_id IS NULL OR order_id IS NULL
  UNION ALL SELECT *, 'quantity', dq::VARCHAR, oq::VARCHAR, aq::VARCHAR, 'ORDER', 'Warning' FROM n WHERE dq <> oq
  UNION ALL SELECT *, 'quantity', dq::VARCHAR, oq::VARCHAR, aq::VARCHAR, 'ACKNOWLEDGEMENT', 'Warning' FROM n WHERE NOT coalesce(dq <> oq, false) AND (oq <> aq OR oq IS NULL AND dq <> aq)
  UNION ALL SELECT *, 'dimensions', DW, OW, AW, 'ORDER', 'Warning' FROM n WHERE dw <> ow
  UNION ALL SELECT *, 'finish', df, of, af, 'ORDER', 'Warning' FROM n WHERE upper(df) <> upper(of)
  UNION ALL SELECT *, 'finish', df, of, af, 'ACKNOWLEDGEMENT', 'Warning' FROM n WHERE upper(of) <> upper(af)
  UNION ALL SELECT *, 'door_style', dd, od, ad, 'ORDER', 'Warning' FROM n WHERE upper(dd) <> upper(od)
  UNION ALL SELECT *, 'door_style', dd, od, ad, 'ACKNOWLEDGEMENT', 'Warning' FROM n WHERE upper(od) <> upper(ad)
  UNION ALL SELECT *, 'species', ds, os, as_, 'ORDER', 'Warning' FROM n WHERE nds <> nos
  UNION ALL SELECT *, 'species', ds, os, as_, 'ACKNOWLEDGEMENT', 'Warning' FROM n WHERE NOT coalesce(nds <> nos, false) AND nos <> nas
  UNION ALL SELECT *, 'drawer_box', db, ob, ab, 'ORDER', 'Warning' FROM n WHERE ndb <> nob
  UNION ALL SELECT *, 'drawer_box', db, ob, ab, 'ACKNOWLEDGEMENT', 'Warning' FROM n WHERE NOT coalesce(ndb <> nob, false) AND nob <> nab)
""".replace("STATUS AS", _STATUS + " AS").replace("'dimensions', DW, OW, AW", "'dimensions', dw || 'W x ' || h || 'H x 24D', ow || ' x ' || h || ' x 24', aw || '\" W'")
_GROUPS = f"WITH {ITEMS_SQL}{_WRITTEN}"
_ALL = f"WITH {ITEMS_SQL}{_WRITTEN}{_WIDE}"
_FINAL = _ALL + """, c AS (SELECT project_id, ord, count(*) AS n FROM f GROUP BY 1, 2),
g AS (SELECT w.project_id, design_id, order_id, ack_id, CASE WHEN status = 'MATCHED' AND n > 0 THEN 'CHANGED' ELSE status END AS status, coalesce(n, 0) AS n_discrepancies,
  final_sku, final_quantity, final_finish, final_door_style, final_price, CASE WHEN n > 0 THEN 'PENDING_REVIEW' ELSE 'RESOLVED_AUTO' END AS final_status
  FROM w LEFT JOIN c ON c.project_id = w.project_id AND c.ord = w.ord)"""

SQL = {
    "sku_normalize": f"WITH {ITEMS_SQL} SELECT item_id, upper(regexp_replace(trim(raw_sku), '\\s+', ' ', 'g')) AS sku, array_to_string(list_filter(regexp_split_to_array(upper(trim(raw_sku)), '[\\s\\-_./]+'), lambda x: x <> ''), '+') AS tokens FROM items",
    "size_parse": f"WITH {ITEMS_SQL} SELECT item_id, CAST(width AS DOUBLE) AS width, CASE WHEN side = 'ACK' THEN NULL ELSE CAST(height AS DOUBLE) END AS height, CASE WHEN side = 'ACK' THEN NULL ELSE 24.0::DOUBLE END AS depth, CASE WHEN side = 'ORDER' THEN 'UNLABELED' ELSE 'EXPLICIT' END AS axis_certainty FROM items",
    "classify_parts": _classify_sql(),
    "units_aggregate": f"""WITH {ITEMS_SQL} SELECT project_id, side, arg_min(item_id, ord) AS unit_id, 'B' || width AS raw_sku, arg_min(finish, ord) AS finish, CAST(sum(quantity) AS INT) AS quantity,
        count(*) AS lines, string_agg(item_id, ',' ORDER BY ord) AS line_ids FROM items GROUP BY project_id, side, width, coalesce(upper(finish), ''), upper(door_style)""",
    "views_resolved": f"""WITH {ITEMS_SQL}, v AS (SELECT item_id, project_id, ord, quantity, CASE WHEN quantity % 3 <> 0 THEN finish END AS finish, CASE WHEN ord % 5 <> 0 THEN ['FLOORPLAN', 'ELEVATION', 'SCHEDULE', 'LEGEND'][ord % 4 + 1] END AS view_type,
          CASE WHEN ord % 5 <> 0 THEN [2, 3, 4, 1][ord % 4 + 1] END AS p, CASE WHEN ord % 5 <> 0 THEN 'g' || ord % 2 ELSE item_id END AS key FROM items WHERE side = 'DESIGN'),
        t AS (SELECT *, p IS NULL OR p = max(p) OVER (PARTITION BY project_id, key) AS top FROM v),
        s AS (SELECT *, top AND (finish IS NOT NULL OR NOT bool_or(top AND finish IS NOT NULL) OVER (PARTITION BY project_id, key)) AS stays FROM t),
        x AS (SELECT *, max(CASE WHEN NOT stays AND view_type = 'FLOORPLAN' THEN quantity END) OVER (PARTITION BY project_id, key) AS fp,
          arg_min(CASE WHEN NOT stays THEN finish END, CASE WHEN NOT stays AND finish IS NOT NULL THEN ord END) OVER (PARTITION BY project_id, key) AS gone FROM s)
        SELECT item_id, view_type, coalesce(finish, gone) AS finish, quantity, CASE WHEN view_type IS NULL OR fp IS NULL THEN NULL ELSE greatest(fp, quantity) END AS resolved,
          CASE WHEN view_type IS NULL OR fp IS NULL THEN NULL WHEN fp > quantity THEN 'floorplan_higher_inferred' WHEN fp = quantity THEN 'views_agree' ELSE 'elevation_higher_flagged' END AS method,
          CASE WHEN view_type IS NULL OR fp IS NULL THEN NULL WHEN fp > quantity THEN 'INFERRED' WHEN fp = quantity THEN 'HIGH' ELSE 'NEEDS_REVIEW' END AS confidence FROM x WHERE stays""",
    "code_pairs": f"""WITH {ITEMS_SQL} SELECT d.project_id, d.ord, o.side, o.ord AS other, CASE WHEN d.compact = o.compact AND d.brand = o.brand THEN
          CASE WHEN o.side = 'ACK' AND o.k % 3 = 0 THEN 'COMPACT_EQUIVALENCE' ELSE 'DELIMITER_EQUIVALENCE' END ELSE 'NO_MATCH' END AS match
        FROM (SELECT i.*, regexp_extract(compact, 'B([0-9]+)N', 1) AS brand FROM items i) d JOIN (SELECT i.*, regexp_extract(compact, 'B([0-9]+)N', 1) AS brand FROM items i) o
          ON d.project_id = o.project_id AND abs(d.ord - o.ord) <= 1 AND d.side = 'DESIGN' AND o.side <> 'DESIGN'""",
    "size_pairs": f"WITH {ITEMS_SQL} SELECT d.project_id, d.ord, CASE WHEN d.width <> o.width THEN 'AXIS_WIDTH_MISMATCH' WHEN d.height <> o.height THEN 'AXIS_HEIGHT_MISMATCH' ELSE 'EXPLICIT_AXES_MATCH' END AS reason FROM items d JOIN items o USING (project_id, ord) WHERE d.side = 'DESIGN' AND o.side = 'ORDER'",
    "item_pairs": """WITH v AS (SELECT p_partkey, p_partkey AS k, p_size + 10 AS s, p_partkey % 12 AS w, p_name || ' panel' AS named FROM part),
        t AS (SELECT p_partkey, ['B36-' || k || 'TD', 'B36' || k || 'TD', 'CAB-' || s || '-L', 'BASE' || k, 'SB' || s, NULL, NULL, 'W' || k, 'W' || k, 'W' || s, 'b' || k || '  butt', 'BFHC' || s][w + 1] AS s1,
          ['b36 ' || k || 'td', 'B36 ' || k || 'TD', 'CAB-' || s || '-R', 'WALL' || k, 'SB' || s || ' BUTT', NULL, NULL, NULL, 'X77', 'V' || (s + 60), 'B' || k || ' BUTT', 'BPFHC' || s][w + 1] AS s2,
          CASE w WHEN 5 THEN named WHEN 9 THEN 'WALL DOOR BASE' WHEN 11 THEN 'HUTCH COLUMN BASE' END AS t1, CASE w WHEN 5 THEN upper(named) WHEN 9 THEN 'WALL DOOR BASE' WHEN 11 THEN 'HUTCH COLUMN BASE' END AS t2, CASE w WHEN 8 THEN 'w' || k END AS sub FROM v),
        n AS (SELECT *, upper(regexp_replace(trim(s1), '\\s+', ' ', 'g')) AS n1, upper(regexp_replace(trim(s2), '\\s+', ' ', 'g')) AS n2, regexp_replace(upper(s1), '[^A-Z0-9]', '', 'g') AS c1, regexp_replace(upper(s2), '[^A-Z0-9]', '', 'g') AS c2 FROM t)
        SELECT p_partkey, CASE WHEN upper(sub) = c1 THEN 'EXPLICIT_SUBSTITUTION' WHEN s1 IS NULL AND s2 IS NULL THEN CASE WHEN upper(t1) = upper(t2) THEN 'NORMALIZED_EXACT' ELSE 'BOTH_EMPTY' END
          WHEN s1 IS NULL OR s2 IS NULL THEN 'ONE_EMPTY' WHEN n1 = n2 THEN 'EXACT' WHEN c1 = c2 OR list_has_all(string_split(n2, ' '), string_split(n1, ' ')) THEN 'NORMALIZED_EXACT'
          WHEN regexp_extract(n1, '-([LR])$', 1) <> regexp_extract(n2, '-([LR])$', 1) THEN 'ORIENTATION_MISMATCH'
          WHEN t1 = t2 THEN CASE WHEN regexp_extract(n1, '[0-9]+') = regexp_extract(n2, '[0-9]+') THEN 'MANUFACTURER_VARIANT' ELSE 'DIMENSION_CONFLICT' END ELSE 'NO_MATCH' END AS match FROM n""",
    "spec_and_finish": _aliases_sql(),
    "quantities": """WITH t AS (SELECT l_orderkey, l_linenumber, CAST(CAST(trunc(l_quantity) AS INT) AS VARCHAR) AS n, l_partkey % 7 AS w FROM lineitem)
        SELECT l_orderkey, l_linenumber, CASE WHEN w < 5 THEN CAST(n AS INT) END AS quantity FROM t""",
    "scope": f"WITH {ITEMS_SQL} SELECT item_id FROM items i WHERE side = 'DESIGN' AND EXISTS (SELECT 1 FROM items j WHERE j.project_id = i.project_id AND side <> 'DESIGN' AND finish IS NOT NULL) AND (ord = 1 OR NOT EXISTS (SELECT 1 FROM items j WHERE j.project_id = i.project_id AND side <> 'DESIGN' AND split_part(j.finish, ' ', 1) = i.finish))",
    "match_groups": f"{_GROUPS} SELECT project_id, design_id, order_id, ack_id, {_STATUS} AS status FROM pairs",
    "contested_groups": f"WITH {groups_sql()} SELECT project_id, design_id, order_id, ack_id, status FROM g",
    "contested_differences": f"""WITH {groups_sql()}, f AS (SELECT string_split(unnest(found), '/') AS x FROM g)
        SELECT x[1] AS field, x[2] AS introduced_at, x[3] AS severity, count(*) AS n FROM f GROUP BY ALL""",
    "match_status_counts": f"{_GROUPS} SELECT {_STATUS} AS status, count(*) AS n FROM pairs GROUP BY 1",
    "differences": f"{_ALL} SELECT project_id, design_id, order_id, ack_id, field, design_value, order_value, ack_value, introduced_at, severity FROM f",
    "final_state": f"{_FINAL} SELECT * FROM g",
    "difference_summary": f"{_ALL} SELECT count(*) AS open, count(*) FILTER (severity = 'Critical') AS critical, count(*) FILTER (severity = 'Warning') AS warning, 0::BIGINT AS info, 0::BIGINT AS high FROM f",
    "field_summary": f"{_ALL} SELECT field, count(*) AS n, 2 AS worst FROM f WHERE field <> 'item_presence' GROUP BY field",
    "project_progress": f"""{_FINAL}, k AS (SELECT project_id, count(*) AS groups, count(*) FILTER (status = 'MATCHED') AS matched, count(*) FILTER (status IN ('MISSING', 'EXTRA')) AS critical FROM g GROUP BY 1)
        SELECT *, CAST(floor(matched * 100 / groups) AS INT) AS share, CASE WHEN floor(matched * 100 / groups) >= 90 AND critical = 0 THEN 'good' WHEN floor(matched * 100 / groups) >= 70 THEN 'fair' ELSE 'poor' END AS verdict FROM k""",
}
QUERIES = [
    sku_normalize, size_parse, classify_parts, units_aggregate, views_resolved, code_pairs, size_pairs, item_pairs, spec_and_finish, quantities, scope,
    match_groups, contested_groups, contested_differences, match_status_counts, differences, final_state, difference_summary, field_summary, project_progress,
]
