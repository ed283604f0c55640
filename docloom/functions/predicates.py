"""Predicates and classes as column expressions (operators B02-B06, B13-B26)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import bind, code_number, item_code, strip

_ = F.lit


def text_or_empty(c: Column) -> Column:
    return F.coalesce(c, _(""))


# Phrases that tell the two portal families apart.
GEM = r"(?i)\b(?:gem\.gov\.in|government\s+e[-\s]?marketplace|\bgem\b|bid\s*number|gem\s*bid|catalogue\s*id|category\s*id|ministry\s*/\s*department|buyer\s*details)\b"
IREPS = r"(?i)\b(?:ireps|nit\s*header|western\s*rly|eastern\s*rly|northern\s*rly|southern\s*rly|tender\s+document|advertised\s*value|period\s+of\s+completion|schedule\s*\(\s*\)\s*[A-Z]|description\s*:-)\b"


def portal(c: Column) -> Column:
    """Gem, ireps or generic by counts of phrases in the first 12,000 characters."""
    sample = F.substring(text_or_empty(c), 1, 12_000)
    gem, ireps = F.regexp_count(sample, _(GEM)), F.regexp_count(sample, _(IREPS))
    return F.when((gem >= 2) & (gem > ireps), "gem").when(ireps >= 2, "ireps").when(gem >= 1, "gem").otherwise("generic")


def placeholder(c: Column) -> Column:
    """A value that says there is none."""
    return F.lower(strip(text_or_empty(c))).isin("", "-", "--", "na", "n/a", "nil", "none", "null", "tbd", "not applicable", ".")


def list_serial(c: Column) -> Column:
    """Digits from 1 to 999 (leading zeros allowed)."""
    t = strip(text_or_empty(c))
    return t.rlike(r"^0*[1-9]\d{0,2}$")


def number(c: Column) -> Column:
    """Digits and commas with optional decimals, blanks aside, no sign."""
    return F.regexp_replace(text_or_empty(c), r"\s+", "").rlike(r"^[\d,]+(?:\.\d+)?$")


def prefixed_code(c: Column) -> Column:
    """One to six letters and one to five digits."""
    return strip(text_or_empty(c)).rlike(r"^[A-Za-z]{1,6}\d{1,5}$")


def letter_code(c: Column) -> Column:
    return strip(text_or_empty(c)).rlike(r"^[A-Za-z]$")


def breakup_schedule(c: Column) -> Column:
    """The title of an item's breakup."""
    return text_or_empty(c).rlike(r"(?i)\bbreak\s*up\b")


def ns_schedule(c: Column) -> Column:
    """The title of a non-schedule-rate part."""
    return text_or_empty(c).rlike(r"(?i)\bNS\b|non[-\s]*(?:sor|schedule)")


def code_belongs(code: Column, wanted: Column, s_no: Column) -> Column:
    """The same code, or digits that equal the serial or the number of the wanted prefixed code."""
    a, b = item_code(code), item_code(wanted)
    return F.coalesce((a == b) | a.rlike(r"^\d+$") & ((a == item_code(s_no)) | (a == code_number(wanted))), _(False))


def codes_conflict(a: Column, b: Column) -> Column:
    """Both are set and differ, case aside."""
    x, y = F.upper(item_code(a)), F.upper(item_code(b))
    return F.coalesce(x != y, _(False))


POINTER = r"(?i)please\s+see|see\s+(?:item\s+)?break\s*up|see\s+annexure|refer\s+annexure"
JUNK_FIRST = r"(?i)^(?:s\.?no\.?|item\s*code|item\s*qty|qty\s*unit|unit\s*rate|basic\s*value|bidding\s*unit|description\s*:?-?|i\s*/\s*we\s+the|a\)\s*technical|b\)\s*financial|c\)\s*avail|\(a\)|\(b\)|\(c\)|schedule\s*total|grand\s*total)\b"
JUNK_LAST = r"(?i)^(?:s\.?no\.?|item\s*code|item\s*qty|description\s*:?-?|i\s*/\s*we\s+the|a\)\s*technical|b\)\s*financial|c\)\s*avail|\(a\)|\(b\)|\(c\)|technical|financial|availability|schedule\s*total|grand\s*total|meaning\s+of\s+similar)\b"
HEADER_WORDS = ["item code", "item qty", "qty unit", "unit rate", "basic value", "amount", "bidding unit", "description", "item title", "item details", "catalogue id"]


def footer(item: dict[str, Column]) -> Column:
    """A page footer or header that was read as an item."""
    f = {k: text_or_empty(v) for k, v in item.items()}
    return (
        f["item_code"].rlike(r"(?i)tender\s*no|^no\s*:|closing\s*date")
        | f["description"].rlike(r"(?i)tender\s*no\s*:|closing\s*date\s*/?\s*time")
        | F.concat(f["qty_unit"], _(" "), f["amount"]).rlike(r"(?i)\b(?:ime|time)\s*:")
        | (strip(f["description"]) == "") & f["bidding_unit"].rlike(r"\d{1,2}/\d{4}")
        | f["item_qty"].rlike(r"^\s*-")
    )


def valid_item(item: dict[str, Column]) -> Column:
    """What the extraction passes accept."""
    desc, sno = strip(text_or_empty(item["description"])), strip(text_or_empty(item["s_no"]))
    qty, money = number(item["item_qty"]), number(item["unit_rate"]) | number(item["amount"])
    code = text_or_empty(item["item_code"]) != ""
    has_desc, has_sno = F.length(desc) > 3, sno.rlike(r"^\d+$")
    bad = footer(item) | (sno != "") & ~sno.rlike(r"^0*[1-9]\d*$") | desc.rlike(JUNK_FIRST) | text_or_empty(item["item_code"]).rlike(POINTER)
    gem = has_desc & has_sno & F.lower(text_or_empty(item["schedule"])).startswith("gem")
    return ~bad & (gem | qty & (money | has_desc | code) | has_desc & (qty | money | code | has_sno))


def clause_or_junk(c: Column) -> Column:
    """Contract language instead of a product."""
    t = text_or_empty(c)
    return (F.length(strip(t)) < 4) | t.rlike(CLAUSE) | t.rlike(r"^\d+\.\d+\s+\w")


# Phrases of declarations and clauses.
CLAUSE = (
    r"(?i)meaning\s+of\s+similar\s*works|similar\s*works|i\s*/\s*we\s+(?:the|hereby|understand|also)|technical\s+bid|financial\s+bid|tenderer\s+must\s+have|contractual\s+turnover|"
    r"downloaded\s+the\s+tender|indian\s+railway\s+website|forged\s*/?\s*false|contents\s+of\s+the\s+certificate|relevant\s+annexure\s+is\s+to\s+be\s+submitted|^\d+\.\d+\s+(?:meaning|scope|general|definition|similar)"
)
# Phrases of civil work, and product words that speak against it.
WORK = (
    r"(?i)re-?instatement|excavation\s+of|refilling\s+(?:of\s+)?(?:the\s+)?trench|repairing\s+to\s+original\s+state|payment\s+(?:will|wifi|shall)\s+be\s+made|pro-?rata\s+basis|work\s+includes|shall\s+be\s+done\s+as\s+per|alongside\s+the\s+track|all\s+kinds?\s+of\s+soil|"
    r"clearing\s+of\s+route|cable\s+trench\s+as\s+per|headway\s+above|while\s+track\s+crossing|minimum\s+depth\s+will\s+be\s+taken|extant\s+practice|instructions\s+of\s+railway\s+engineer|conforming\s+to\s+distances\s+as\s+per\s+cable\s+route"
)
WORK_LEAD = r"(?i)^(?:re-?instatement|excavation|refilling|dismantling|clearing|trenching|earthwork|backfilling|repairing)\b"
SUPPLY = r"(?i)\b(?:cable|relay|switch|panel|module|transformer|battery|charger|signal|point\s+machine|axle\s+counter|led|display|rack|connector|terminal|fuse|breaker|ips|ups|modem|router|antenna|camera|sensor|meter|gauge|clamp|bracket|housing|card|pcb|processor|server|printer|scanner|wire|conductor|joint\s+kit|hdpe|gi\s+pipe|ofc|fibre|fiber)\b"


def work_description(c: Column) -> Column:
    """A paragraph of civil work, judged by phrases, length and lead words."""
    t = text_or_empty(c)
    hits = F.regexp_count(t, _(WORK))
    n, supply = F.length(t), F.substring(t, 1, 160).rlike(SUPPLY)
    lead = t.rlike(WORK_LEAD) & ~supply
    special = t.rlike(r"(?i)^(?:excavation\s+of\s+(?:cable\s+)?trench\b|re-?instatement\s+of\s+(?:platform|track|road|surface))")
    return (n >= 280) & (hits >= 1) | (hits >= 2) & (n >= 160) | (hits >= 1) & (n >= 500) | lead | special


def valid_row(item: dict[str, Column]) -> Column:
    """What the sanitiser accepts; not the same as B15."""
    desc, sno = text_or_empty(item["description"]), strip(text_or_empty(item["s_no"]))
    qty, money = number(item["item_qty"]), number(item["unit_rate"]) | number(item["amount"])
    code = text_or_empty(item["item_code"]) != ""
    has_desc, has_sno = F.length(desc) > 3, sno.rlike(r"^\d+$")
    short = F.length(strip(desc)) <= 3
    bad = footer(item) | short & ~(qty & money) | (desc != "") & (desc.rlike(JUNK_LAST) | clause_or_junk(desc) | F.lower(desc).isin(HEADER_WORDS)) | text_or_empty(item["item_code"]).rlike(POINTER)
    gem = has_desc & has_sno & F.lower(text_or_empty(item["schedule"])).contains("gem")
    loose = ~has_sno & ~(qty & (money | has_desc)) & ~(has_desc & (qty | money | code))
    return ~bad & (gem | ~loose & (qty & (money | has_desc | code) | has_desc & (money | qty | has_sno)))


def grounded(name: Column, desc: Column, share: float = 0.7) -> Column:
    """The name stands in the description, or enough of its words of over two letters do (as substrings)."""

    def stands(x: Column) -> Column:
        n, d = x["n"], x["d"]
        words = F.filter(F.split(n, r"\s+"), lambda w: F.length(w) > 2)
        enough = bind(words, lambda ws: (F.size(ws) > 0) & (F.size(F.filter(ws, lambda w: d.contains(w))) / F.greatest(F.size(ws), _(1)) >= share))
        return F.coalesce((n != "") & (d != "") & (d.contains(n) | enough), _(False))

    return bind(F.struct(F.lower(strip(name)).alias("n"), F.lower(desc).alias("d")), stands)


def real_spec(c: Column) -> Column:
    """A specification number and not a shard of a word."""
    t = strip(text_or_empty(c))
    return (F.length(t) >= 8) & t.rlike(r"\d") & ~t.rlike(r"(?i)^(?:ific(?:ation)?s?|tion|ified|specified|contractor|specn\.?|spec)$") & ~t.rlike(r"(?i)^RDSO/SPN/?$")


def route(message: Column, has_products: Column) -> Column:
    """Fix if products are loaded and the message is no greeting, else chat."""
    hello = F.lower(strip(text_or_empty(message))).rlike(r"^(?:hi|hii+|hello|hey|thanks?|thank you|ok(?:ay)?|good (?:morning|afternoon|evening)|bye|help)[\s!.]*$")
    return F.when(has_products & ~hello, "fix").otherwise("chat")


def failure_kind(c: Column) -> Column:
    """Timeout, quota, or error."""
    t = F.lower(text_or_empty(c))
    return F.when(t.contains("timeout") | t.contains("timed out"), "timeout").when(t.contains("429") | t.contains("quota") | t.contains("rate limit"), "quota").otherwise("error")


# How the lines of the classes that start with words of their own begin, in order.
LINE_HEADS = {
    "total": r"(?:schedule\s+)?(?:grand\s+)?total\b",
    "schedule": r"schedule\b",
    "breakup": r"(?:\d+\.\s*)?item\s+breakup\b",
    "bid": r"(?:above\s*/?|below\s*/?\s*p?|ar|par|above\s*/\s*below\s*/\s*par|rs\.?|inr)$",
    "chrome": r"(?:tender\s+no\s*:|closing\s+date|page\s+\d+|run\s+date|\d+\s+par$|\[\[PAGE:\d+\]\])",
    "description": r"(?:[A-Za-z]{0,6}\d{1,5}\s+)?description\s*[:\-–]",
}
ANY_HEAD = f"(?i)^(?:{'|'.join(LINE_HEADS.values())})"


def line_class(c: Column) -> Column:
    """One class for each line of a schedule text; the first that fits wins."""
    return stripped_class(strip(text_or_empty(c)))


def stripped_class(t: Column) -> Column:
    """B13 of a stripped line that is not null.  One expression tells most lines from those with a head of their own."""
    starts = lambda k: t.rlike(f"(?i)^{LINE_HEADS[k]}")
    headed = (
        F.when(starts("total"), "total")
        .when(starts("schedule") & ~t.rlike(r"(?i)item\s+qty|s\.no"), "schedule")
        .when(starts("breakup"), "breakup").when(starts("bid"), "bid").when(starts("chrome"), "chrome").when(starts("description"), "description")
    )
    plain = F.when(t.rlike(r"^\d{1,4}$"), "serial").when(t.rlike(r"(?i)\bat\s*par\b|(?:\d[\d,]*\.\d{2}\s+){2,}"), "priced").otherwise("text")
    return F.when(t == "", "blank").when(t.rlike(ANY_HEAD), F.coalesce(headed, plain)).otherwise(plain)
