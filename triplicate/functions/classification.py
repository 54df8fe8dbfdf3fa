"""The category of an item by ordered rules over its description, code and size; the first rule that holds decides."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from triplicate.functions.text import known, normalize_sku, normalize_text, sku_tokens

#: For each rule in order, its category, its confidence and the phrases that a description holds as whole words.
DESCRIPTION_RULES = (
    ("COMMERCIAL_CHARGE", 0.99, (
        "freight", "surcharge", "tariff", "shipping", "handling", "delivery fee", "fuel surcharge", "upcharge", "non charge",
        "non-charge",
    )),
    ("ARCHITECTURAL_ANNOTATION", 0.98, (
        "wall opening", "window", "door opening", "door frame", "room dimension", "ceiling height", "soffit", "bulkhead",
        "pass thru", "column", "beam", "electrical", "plumbing", "rough opening", "drywall", "stud", "framing", "casing",
        "floor plan", "drawing note", "elevation note", "mantel", "alcove", "hood ledge", "hood surround", "hood mantel",
        "alcove hood", "ledge",
    )),
    ("PANEL", 0.95, (
        "end panel", "finished end", "refrigerator panel", "dishwasher panel", "island panel", "decorative panel",
        "wainscot panel", "panel skin", "side panel", "back panel", "base end panel", "wall end panel", "tall end panel",
        "dishwasher end", "dishwasher ep", "appliance panel", "appliance pnl", "framed appliance", "deluxe back panel",
    )),
    ("FILLER", 0.95, (
        "filler", "flr", "overlay filler", "fluted filler", "base filler", "wall filler", "tall filler", "column filler",
        "corner filler", "fill strip",
    )),
    ("MOLDING", 0.95, (
        "molding", "moulding", "crown molding", "crown", "scribe molding", "scribe", "light rail", "toe kick", "base shoe",
        "valance", "decorative trim", "outside corner molding", "inside corner molding", "batten", "fascia", "trim",
        "hutch mld", "hutch molding", "hutch mould", "base hutch", "starter molding", "starter mld",
    )),
    ("CABINET", 0.95, (
        "base tray cab", "tray cab", "tray cabinet", "base cabinet", "wall cabinet", "tall cabinet", "stacked wall cabinet",
        "stacked wall", "sink base cabinet", "drawer base cabinet", "blind base cabinet", "utility cabinet", "oven cabinet",
        "pantry cabinet", "corner base cabinet",
    )),
    ("ACCESSORY", 0.95, (
        "rollout", "roll out", "roll-out", "tray divider", "rollout tray", "roll out tray", "lazy susan", "trash pullout",
        "waste basket", "cutlery divider", "spice rack", "spice pullout", "organizer", "stemware holder", "wine rack",
        "corbel", "decorative leg", "post", "knob", "pull", "hardware", "touch up kit", "touch-up", "hinge", "bracket",
        "shelf kit", "repair kit", "touch-up kit", "touchup kit", "mullion", "mull front", "mull-front",
    )),
    ("CABINET", 0.95, (
        "base cab", "wall cab", "tall cab", "utility cab", "sink base cab", "drawer base cab", "blind base cab", "cabinet",
        "vanity", "drawer base", "sink base", "corner base", "corner wall", "pantry", "blind base", "blind wall",
        "diagonal corner", "lazy susan cabinet", "tray base",
    )),
    ("APPLIANCE", 0.98, (
        "refrigerator", "fridge", "dishwasher", "range", "cooktop", "microwave", "micro hood", "mw hood", "range hood",
        "hood", "wall oven", "double oven", "oven", "disposal", "trash compactor", "wine cooler", "beverage center",
        "ice maker", "cooker", "ventilation", "blower", "sink", "faucet", "appliance", "freezer", "cook top",
    )),
)

#: Of moldings' phrases, one that counts where a space stands before it and a word before that.
MOLDING_MARK = "[A-Z0-9_] MLD\\b"

#: For each rule in order, its category, its confidence and the patterns that a whole code has.
CODE_RULES = (
    ("COMMERCIAL_CHARGE", 0.98, (".*(FREIGHT|TARIFF|SURCHARGE|SHIPPING|DELIVERY|UPCHARGE|NONCHG|NONCHARGE).*",)),
    ("APPLIANCE", 0.92, (
        "^(REF|FRIDGE|DW|DISH|RNG|RANGE|MW|MICROWAVE|HOOD|OV|OVN|OVEN|COOK|AP|APPL|SINK|FAUCET|ELX)[\\.\\-_0-9A-Z]*$",
        "^(GR|PWS|WS|PRO|ICB|BI|MIE|WOLF|SUB|MONO|ZEPH|THERM)[0-9]+.*$",
        ".*[\\.\\-_](REF|DW|DISH|RNG|RANGE|MW|HOOD|OVEN|OVN|SINK|APPL)[\\.\\-_0-9A-Z]*$",
    )),
    ("ARCHITECTURAL_ANNOTATION", 0.92, (
        "^(WALL|WIN|WINDOW|DR|DOOR|ROOM|CLG|HT|ELEC|PLUMB|ARCH|OPENING|PASS)[.\\-_0-9A-Z]*$",
        ".*(AHSDX|MNTLDX|MWTLDX|CLME|SMCRN|MANTEL|LEDGE|SOFFIT|BULKHEAD|HEADER).*",
        "^(RO|DIM|NOTE)[.\\-_][0-9A-Z]*$",
    )),
    ("FILLER", 0.90, ("^(BF|WF|TF)[0-9]+[A-Z0-9]*$", "^(FLR|FIL|FILLER|FF)[0-9]*[A-Z0-9]*$", ".*FILLER.*")),
    ("PANEL", 0.90, ("^(EP|BEP|WEP|REP|TEP|PNL|PANEL|FSKIN|DEP|DLEP|FAP|DBP|DLBP)[0-9]*[A-Z0-9]*$", ".*PANEL.*")),
    ("MOLDING", 0.90, ("^(SCM|CM|TK|LR|VAL|SHOE|TRIM|MOLD|MLD|BM|QR)[0-9]*[A-Z0-9]*$", "^(VALANCE|TOEKICK|CROWN)[0-9]*[A-Z0-9]*$")),
    ("ACCESSORY", 0.90, (
        "^(ROT|TD|TP|CR|LEG|POST|CRB|TUK|WR|SR|SBK)[0-9]*[A-Z0-9]*$",
        "^(PULLOUT|ORGANIZER)[0-9]*[A-Z0-9]*$",
        "^(BFH|WFH|TFH)[0-9A-Z_.-]*$",
    )),
    ("CABINET", 0.92, (
        "^(B|BT|SB|DB|CB|PB|BBC|BLB|VB|VSB|VDB|3DB|4DB)[0-9]+.*$",
        "^(W|WST|WW|WDC|WBC|WTC|WCR)[0-9]+.*$",
        "^(T|U|PC|UTIL|OC|OVC|DOC|TOC)[0-9]+.*$",
        "^(D|DD)[0-9]+.*$",
        "^(CAB|CABINET)[0-9]+.*$",
    )),
)

#: Tokens of a code that give its category where no pattern does; the first such token decides.
TOKEN_RULES = {
    "FILLER": ("FILLER", "FLR", "BF", "WF", "TF"),
    "PANEL": ("PANEL", "BEP", "WEP", "REP", "TEP"),
    "MOLDING": ("CROWN", "SCM", "TOEKICK", "TK", "VALANCE", "VAL", "SHOE", "TRIM"),
    "ACCESSORY": ("ROT", "ROLLOUT", "DIVIDER", "ORGANIZER", "CORBEL"),
    "APPLIANCE": ("REF", "FRIDGE", "DW", "DISH", "RANGE", "RNG", "MW", "HOOD", "OVEN", "SINK"),
}
TOKEN_CONFIDENCE = 0.85
#: Least width, height and depth of what may be a cabinet by its size alone.
ENVELOPE, ENVELOPE_CONFIDENCE = (9, 12, 12), 0.70
UNKNOWN_CONFIDENCE = 0.40
#: A description of this form tells of a display, not of the item.
DISPLAY_HEADER = "(?i)^\\s*display\\s+[0-9]+\\s*[–—-]"


def phrases_pattern(category: str, phrases: tuple[str, ...]) -> str:
    """One alternation for all phrases of a rule."""
    pattern = "\\b(?:" + "|".join(re.escape(p.upper()).replace("\\ ", " ").replace("\\-", "-") for p in phrases) + ")\\b"
    return f"{pattern}|{MOLDING_MARK}" if category == "MOLDING" else pattern


def codes_pattern(patterns: tuple[str, ...]) -> str:
    return "|".join(f"(?:{p if p.startswith('^') else '^' + p})" for p in patterns)


def classify(sku: Column, description: Column, size: Column | None = None) -> Column:
    """A struct of category, confidence and rule (which step decided)."""
    code = F.coalesce(normalize_sku(sku), F.lit(""))
    text = F.coalesce(normalize_text(description), F.lit(""))
    return known({"code": code, "text": text}, lambda x: known({"code": x["code"], "text": F.when(x["text"].rlike(DISPLAY_HEADER), "").otherwise(x["text"])}, lambda y: _by_rules(y["code"], y["text"], size)))


def _by_rules(code: Column, text: Column, size: Column | None) -> Column:
    """The first rule that holds, for a normalized code and description."""

    def made(category: str, confidence: float, rule: str) -> Column:
        return F.expr(f"named_struct('category', '{category}', 'confidence', double({confidence}), 'rule', '{rule}')")

    said = ruled = None
    for category, confidence, phrases in DESCRIPTION_RULES:
        hit, then = text.rlike(phrases_pattern(category, phrases)), made(category, confidence, "description")
        said = F.when(hit, then) if said is None else said.when(hit, then)
    for category, confidence, patterns in CODE_RULES:
        hit, then = code.rlike(codes_pattern(patterns)), made(category, confidence, "code")
        ruled = F.when(hit, then) if ruled is None else ruled.when(hit, then)
    of_token = F.expr("map(" + ", ".join(f"'{t}', '{category}'" for category, tokens in TOKEN_RULES.items() for t in tokens) + ")")
    kinds = F.filter(F.transform(sku_tokens(code), lambda t: F.try_element_at(of_token, t)), lambda c: c.isNotNull())
    by_token = F.get(F.transform(F.slice(kinds, 1, 1), lambda c: F.struct(c.alias("category"), F.lit(TOKEN_CONFIDENCE).alias("confidence"), F.lit("token").alias("rule"))), F.lit(0))
    unknown = F.when((code == "") & (text == ""), made("UNKNOWN", 0.0, "empty"))
    if size is not None:
        w, h, d = ENVELOPE
        fits = (size["width"] >= w) & (size["height"] >= h) & (size["depth"] >= d)
        unknown = unknown.when(fits, made("CABINET", ENVELOPE_CONFIDENCE, "size"))
    # Nothing is sought in an empty text or code.
    by_code = F.when(code != "", F.coalesce(ruled, by_token))
    return F.coalesce(F.when(text != "", said), by_code, unknown, made("UNKNOWN", UNKNOWN_CONFIDENCE, "none"))
