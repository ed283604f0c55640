"""Item descriptions and product names as column expressions.

Everything is built-in functions.  A result that is used several times is bound once (:func:`bind`), so expressions grow with
the number of steps and not with their product.
"""

from __future__ import annotations

import re as re_
from collections.abc import Callable, Iterable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from .predicates import clause_or_junk
from .text import before_chrome, bind, collapse, consecutive, nullif_empty, strip

re = F.regexp_replace

# Words that letter-spaced text is cut into.
WORDS = (
    "specification", "specifications", "installation", "transportation", "commissioning", "accessories", "consolidating", "including", "includes", "following", "apparatus", "provision", "necessary", "insulated",
    "polythene", "regulating", "excavation", "refilling", "equipment", "materials", "location", "detector", "complete", "suitable", "crossing", "blowing", "drawing", "fixing", "paging", "thermal", "imager", "pocket",
    "trench", "latest", "without", "through", "throughout", "ramming", "supply", "wiring", "inner", "outer", "pair", "self", "talk", "back", "cable", "clamps", "earth", "work", "site", "after", "before", "does", "not",
    "the", "this", "that", "with", "from", "and", "for", "per", "dia", "box", "new", "main", "tail", "also", "into", "onto", "road", "track", "axle",
)
# Acronyms and two-letter words in letter-spaced text.
ACRONYMS = ("SQMM", "HDPE", "RDSO", "IRS", "DWC", "RCC", "PBT", "FRP", "PVC", "LED", "IPS", "ASM", "OFC", "VHF", "FMS", "UTP", "CAT", "GI", "CT")
SHORT = ("to", "or", "in", "on", "by", "of", "as", "no", "it", "at", "an", "if", "is", "be", "so", "we")
# Units that follow a real number, words before one, and word shards.
UNITS = (
    "pair", "pairs", "core", "cores", "quad", "quads", "sqmm", "mm", "cm", "m", "meter", "meters", "metre", "metres", "mtr", "mtrs", "kg", "kgs", "volt", "volts", "v", "kv", "kw", "hp", "amp", "amps", "amperes", "mhz",
    "ghz", "gb", "tb", "mb", "way", "ways", "port", "ports", "pin", "pins", "channel", "channels", "strand", "strands", "inch", "inches", "nos", "no", "number", "numbers", "digit", "digits", "slot", "slots", "shelf",
    "shelves", "rack", "racks", "ton", "tons", "tonne", "tonnes", "litre", "litres", "ltr", "ltrs", "unit", "units", "percent", "degree", "degrees", "c", "f", "ohm", "ohms", "ah", "va", "kva", "var", "kvar", "hz", "khz",
)
LEADS = ("is", "irs", "rdso", "bs", "iec", "en", "iso", "sem", "drg", "drawing", "spec", "specification", "no", "ref", "cat", "part", "table", "fig", "figure", "type")
SHARDS = ("th", "wh", "sh", "ch", "br", "cl", "cr", "dr", "fr", "gl", "gr", "pl", "pr", "sc", "sk", "sl", "sm", "sn", "sp", "st", "sw", "tr")
# Scope verbs of work descriptions.
VERBS = (
    "supply", "installation", "testing", "commissioning", "manufacture", "transportation", "wiring", "design", "provision", "execution", "hiring", "appointment", "erection", "fabrication", "delivery", "maintenance",
    "repair", "replacement", "upgradation", "upgrading", "setting", "fixing", "laying", "providing", "procurement", "construction", "deployment", "integration", "calibration", "overhauling", "servicing", "supervision",
    "programming",
)
# Scope verbs that may also start a product's name.
NAME_VERBS = ("setting", "fixing", "upgrading", "deployment")
# Repairs of split words and numbers, in order.
REPAIRS = (
    (r"\b([A-Za-z]{2,}ffi)\s+([a-z]{2,})\b|\b([A-Za-z]{2,}f[fil])\s+([a-z]{2,})\b", "$1$2$3$4"),
    (r"\b(f[fil])\s+([a-z]{2,})\b", "$1$2"),
    (r"(?i)\b(as\s+per)(?:\s+\1)+\b", "$1"),
    (r"([A-Z0-9_\-.]+/\d+)\s+(\d+)\b", "$1$2"),
    (r"(\b\d+)\.\s+(\d+)\b", "$1.$2"),
    (r"(\b\d+)\s+\.(\d+)\b", "$1.$2"),
    (r"(\b[a-zA-Z0-9]+)\.\(([A-Za-z])", "$1. ($2"),
    (r"\b([a-z]{3,})([A-Z][a-z]{3,})\b", "$1 $2"),
)
#: What a text holds if the repair of spaced words or one of these changes it.
TO_REPAIR = r"(?<!\S)[A-Za-z0-9./-]\s+[A-Za-z0-9./-](?!\S)|(?i:\s(?:ing|ed)\b|\b[a-z]\s+[a-z]\b)|f[fil]\s|[Pp][Ee][Rr]\s+[Aa][Ss]\s|/\d+\s+\d|\d\.\s+\d|\d\s+\.\d|\.\([A-Za-z]|[a-z]{3}[A-Z][a-z]{3}"
# What ends a product's name, and what follows it.
FLUFF = (
    r"(?i)\s*(?:and\s+all\s+other\s+accessories|along\s+with\s+(?:its\s+)?(?:base|back[- ]?box|power)|with\s+all\s+(?:required\s+)?(?:fittings\s+and\s+)?accessories|as\s+per\s+(?:RDSO|IRS|IS|SEM|Drg)|inspection\s*:|"
    r"inspection\s+charges\s*:|payment\s+terms?\s*:|make\s*[-:]|or\s+similar|for\s+testing\s+of|of\s+medium\s+size\b|the\s+weight\s+of\s+the\s+agent\b|this\s+work\s+involves\b|this\s+includes\b|complete\s+with\s+all\b|"
    r"including\s+all\s+(?:the\s+)?accessories\b|with\s+auto\s+dialer\b|expandable\s+up\s*to\b|\[\[PAGE:)"
)
TAIL = r"(?i)(?:\.\s*|\s+)(?:inspection\s*:|as\s+per\s+|conforming\s+to\s+|suitable\s+for\s+|to\s+suit\s+|make\s*:|model\s*:|spec(?:ification)?\.?\s*(?:no\.?)?\s*[A-Z0-9/])"
NEXT_ROW = r"(?i)\s+(?:[A-Za-z]{1,6}\d{1,5}|\d{1,18})\s+[\d,]+\.\d{2}\s+(?:Numbers?|Nos?\.?|Metres?|Meters?|Mtrs?|Sets?|Each|Kgs?|Units?|Job|Days?|Cum|Sqm|Rmt|Ton|Litre|Stations?)\s+[\d,]+\.\d{2}.*$"
SEPARATORS = (", with ", " with ", " including ", " complete ")
LEAST_CUT, MAX_NAME, PASSES, WHOLE = 8, 140, 5, 0.82


def chain(c: Column, steps: Iterable[Callable[[Column], Column]]) -> Column:
    """The steps one after the other; a step that uses its input several times binds it itself."""
    return reduce(lambda x, step: step(x), steps, c)


def any_of(words: Iterable[str]) -> str:
    return "|".join(sorted(words, key=lambda w: (-len(w), w)))


def by_letter(words: Iterable[str]) -> str:
    """The alternatives of :func:`any_of` in its order, told apart by the first letter where they begin with one."""
    words = sorted(words, key=lambda w: (-len(w), w))
    first = {w: w[0].lower() for w in words if w[:1].isascii() and w[:1].isalpha() and w[1:2] not in ("?", "*", "{") and "|" not in re_.sub(r"\([^()]*\)", "", w)}
    letters = sorted(set(first.values()))
    some = lambda c: "|".join(w for w in words if first.get(w, c) == c)
    out = [f"(?=[{c}{c.upper()}])(?:{some(c)})" for c in letters]
    other = some("")
    return "|".join([*out, f"(?![{''.join(letters)}{''.join(letters).upper()}])(?:{other})"] if other else out)


def pieces(c: Column, pattern: str, f: Callable[[Column], Column]) -> Column:
    """c with f applied to every match of the pattern (one group around all of it)."""
    cut = F.split(re(c, pattern, "\u0001$1\u0001"), "\u0001")
    return F.array_join(F.transform(cut, lambda p, i: F.when(i % 2 == 1, f(p)).otherwise(p)), "")


_KNOWN, _SHORT, _ACRONYM = any_of(WORDS), any_of(SHORT), any_of(ACRONYMS)


def _word(run: Column) -> Column:
    """A run of letters as words: known ones from its start on, capitals, and a short one at its end."""
    cut = re(run, rf"\G((?i:{_KNOWN})|(?i:{_SHORT})(?=$|(?i:{_KNOWN}|{_SHORT}))|[A-Z]{{2,6}})", "$1 ")
    cut = re(cut, rf"(?<=[A-Za-z])((?i:{_SHORT}))$", " $1")
    whole = ~run.rlike("^[A-Za-z]+$") | (F.length(run) == 1) | run.rlike("^[A-Z]{1,5}$")
    return F.when(run.rlike(f"^(?:{_ACRONYM})+$") & (F.length(run) >= 4), strip(re(run, f"({_ACRONYM})", "$1 "))).when(whole, run).otherwise(strip(cut))


def _spelt(run: Column) -> Column:
    def words(r: Column) -> Column:
        parts = F.transform(F.regexp_extract_all(r, F.lit(r"(\d+(?:\.\d+)?|[A-Za-z]+|[./-]+)"), F.lit(1)), _word)
        return F.when(r.rlike(r"^[\d./-]+$"), r).otherwise(re(F.array_join(parts, " "), r"\s+([./])\s+", "$1"))

    return bind(re(run, r"\s+", ""), words)


def repair_spaced(c: Column) -> Column:
    """Letter-spaced text as words."""
    pairs = "|".join(rf"(?<=\b{w[0]})\s+(?={w[1]}\b)" for w in SHORT)
    return chain(
        strip(re(c, r"\s+", " ")),
        [
            lambda t: pieces(t, r"(?<!\S)([A-Za-z0-9./-](?:\s+[A-Za-z0-9./-](?!\S))+)", _spelt),
            lambda t: re(t, r"(?i)\b([a-z]{2,})\s+(ing|ed)\b", "$1$2"),
            lambda t: re(t, f"(?i){pairs}", ""),
        ],
    )


def drop_chrome(c: Column) -> Column:
    """Before the first page header, without runs of consecutive serials."""
    return collapse(pieces(before_chrome(c), r"(?<![A-Za-z0-9.])(\d{1,3}(?:\s+\d{1,3})+)(?![A-Za-z0-9.])", lambda p: F.when(consecutive(p), "").otherwise(p)))


def drop_stray_number(c: Column, s_no: Column, code: Column) -> Column:
    """Without the item's own serial or code number between two words, and without a leading ``Item n:``."""
    bare = lambda c, shape: re(F.regexp_extract(F.coalesce(c, F.lit("")), shape, 1), r"^0+(?=\d)", "")
    own = F.array_remove(F.array(bare(s_no, r"^\s*(\d{1,4})\s*$"), bare(code, r"(\d{1,4})")), "")
    padded = lambda x: F.concat(F.when(F.length(x) < 3, F.concat(F.lit("0{0,"), (3 - F.length(x)).cast("string"), F.lit("}"))).otherwise(""), x)
    after = rf"\s+(?!(?i:{any_of(UNITS)})(?![A-Za-z]))"
    free = rf"(?<!\b(?i:{any_of(LEADS)})\.?)\s+(?:"

    def without(t: Column, n: Column) -> Column:
        number = lambda before, behind, to: lambda x: re(x, F.concat(F.lit(before + free), n, F.lit(")" + after + behind)), F.lit(to))
        lead = F.concat(F.lit(r"(?i)^\s*(?:item\s+(?:"), n, F.lit(r")\s*(?:\([^)]*\))?\s*[:\-–]?|(?:"), n, F.lit(r")\s*(?:description\s*)?[:\-–])\s*"))
        return chain(
            re(t, lead, F.lit("")),
            [
                number(rf"(?<![A-Za-z])((?i:{any_of(SHARDS)}))", r"(?=[A-Za-z])", "$1"),
                number(r"(?<![A-Za-z0-9])([A-Za-z0-9]{1,3})", r"(?=[A-Za-z]{1,2}(?![A-Za-z]))", "$1"),
                number(r"([A-Za-z0-9,;:).'\"])", r"(?=[A-Za-z])", "$1 "),
            ],
        )

    def may_stand(x: Column) -> Column:
        """Whether the text may hold such a number: between blanks, or at its start, zeros before it allowed."""
        t = F.concat(F.translate(x["t"], "\t\n\x0b\f\r", " " * 5), F.lit(" "))
        holds = lambda n: t.contains(F.concat(F.lit(" "), n, F.lit(" "))) | t.contains(F.concat(F.lit("0"), n, F.lit(" "))) | t.startswith(n)
        return (F.size(x["own"]) > 0) & (F.exists(x["own"], holds) | F.substring(t, 1, 1).isin("0", "i", "I"))

    # an expression with a row's number in it is compiled for that row alone: only where the number may stand
    held = F.struct(strip(c).alias("t"), own.alias("own"), F.array_join(F.transform(own, padded), "|").alias("n"))
    plain = bind(held, lambda x: F.when(may_stand(x), without(x["t"], x["n"])).otherwise(x["t"]))
    return bind(strip(re(plain, r"(?i)^\s*item\s+\d{1,4}\s*(?:\([^)]*\))?\s*[:\-–]\s*", "")), lambda t: F.coalesce(collapse(t), t))


def clean_item(c: Column, s_no: Column, code: Column) -> Column:
    """Spacing, ligatures, repeated phrases, split numbers, page chrome, stray numbers; null if nothing is left."""
    fix = lambda p, to: lambda t: re(t, p, to)
    repaired = lambda t: F.when(t.rlike(TO_REPAIR), chain(repair_spaced(t), [fix(p, to) for p, to in REPAIRS])).otherwise(t)
    fixed = bind(strip(re(F.coalesce(collapse(c), F.lit("")), r"\s+", " ")), repaired)
    return nullif_empty(bind(drop_chrome(fixed), lambda t: drop_stray_number(t, s_no, code)))


def normal_description(c: Column, s_no: Column | None = None, code: Column | None = None) -> Column:
    """A description without page marks, label, quotes and the next row's amounts."""
    none = F.lit(None).cast("string")
    t = chain(
        strip(re(strip(c), r"\[\[PAGE:\d+\]\]", " ")),
        [lambda x: strip(re(x, r"(?i)^description\s*[:\-–]\s*", "")), lambda x: strip(re(x, r"^[-–— \"'/]+", "")), lambda x: re(re(x, r"(?i)\bo\s+f\b", "of"), NEXT_ROW, "")],
    )
    return clean_item(t, none if s_no is None else s_no, none if code is None else code)


# ---- names ----
def strip_scope(c: Column, extra: tuple[str, ...] = ()) -> Column:
    """Without the scope phrases at its start, however many follow each other."""
    v = any_of({*VERBS, *extra})
    listed = rf"(?:(?:{v})\s*[,/&]\s*)+(?:(?:{v})\s*)+(?:(?:&|and)\s*)?(?:commissioning\s+)?(?:of\s+)?"
    return strip(re(c, rf"(?i)^(?:(?:{listed}|(?:{v})\s+(?:and|&)\s+(?:{v})\s+of\s+|(?:{v})\s+of\s+)\s*)+", ""))


def _end(c: Column, marks: str = ".,;") -> Column:
    return strip(F.rtrim(strip(c), F.lit(marks)))


def _until(pattern: str) -> Callable[[Column], Column]:
    """The text before the first match, if that leaves LEAST_CUT characters."""
    at = lambda t: F.regexp_instr(t, F.lit(pattern))
    return lambda c: bind(c, lambda t: F.when(at(t) > LEAST_CUT, _end(F.substring(t, F.lit(1), at(t) - 1))).otherwise(t))


def _first_sentence(c: Column) -> Column:
    def keep(t: Column) -> Column:
        first, rest = F.substring_index(t, ". ", 1), re(t, r"^.*?\. ", "")
        return F.when(t.contains(". ") & (F.length(first) >= LEAST_CUT) & (rest.rlike("(?i)^inspection") | (F.length(rest) > 80)), strip(first)).otherwise(t)

    return bind(c, keep)


def _shortened(c: Column) -> Column:
    def cut(t: Column) -> Column:
        at = F.coalesce(*[F.when(F.locate(s, F.lower(t), 21).between(21, MAX_NAME + 1), F.locate(s, F.lower(t), 21)) for s in SEPARATORS])
        return F.when(F.length(t) <= MAX_NAME, t).otherwise(_end(F.coalesce(F.substring(t, F.lit(1), at - 1), re(F.substring(t, 1, MAX_NAME), r"\s+\S*$", ""))))

    return bind(c, cut)


def finish_name(c: Column) -> Column:
    """Without quantity suffix, fluff, tail, second sentence, surplus length and an open bracket; null if empty."""
    edge = lambda t: F.trim(t, F.lit(" .,;"))
    count = lambda t, mark: F.regexp_count(t, F.lit(mark))
    return nullif_empty(
        chain(
            strip(re(c, r"(?i)\s*\(\s*\d+\s*nos?\.?\s*(?:each\s+)?(?:for\s+\d+\s*months?)?\s*\)\s*$", "")),
            [
                _until(FLUFF),
                _until(TAIL),
                _first_sentence,
                _shortened,
                edge,
                lambda c: bind(c, lambda t: F.when(count(t, r"\(") > count(t, r"\)"), _end(re(t, r"\([^(]*$", ""))).otherwise(t)),
                lambda t: _end(re(t, r"(?i)(\s+for\s+.+?)\s+with\s+back[- ]?box(?:es)?\s*$", "$1")),
            ],
        )
    )


_LEAD = rf"(?i)^(?:(?:{any_of(v for v in VERBS if v not in NAME_VERBS)})[\s,/&]+)+"


def checked_name(full: Column, name: Column, extra: tuple[str, ...] = ()) -> Column:
    """A name (given, or else out of the normal description) that is neither a clause nor led by scope words.

    The given name is tidied until it stays (``PASSES`` rounds do); the description's own name stands in for one that still
    has a scope lead or is ``WHOLE`` of the description and longer.
    """
    return bind(_own_name(full, extra, lambda own: name), lambda x: _checked(full, x, extra))


def _own_name(full: Column, extra: tuple[str, ...], name: Callable[[Column], Column]) -> Column:
    """The description's own name, what finishing leaves of it, and the name that is given it."""
    return bind(finish_name(strip_scope(full, extra)), lambda own: F.struct(own.alias("own"), finish_name(own).alias("again"), name(own).alias("name")))


def _checked(full: Column, given_: Column, extra: tuple[str, ...]) -> Column:
    """I24 of :func:`_own_name`'s struct.  Most given names are the own one, which is finished once."""
    name, own = given_["name"], given_["own"]
    finished = lambda t: F.coalesce(F.when(t == own, given_["again"]).otherwise(finish_name(t)), t)
    tidy = lambda t: bind(strip(re(strip_scope(t, extra), _LEAD, "")), finished)
    # a name that stays is not tidied again
    once = lambda s, _: F.when(s["t"].eqNullSafe(s["before"]), s).otherwise(F.struct(tidy(s["t"]).alias("t"), s["t"].alias("before")))
    start = F.struct(strip(name).alias("t"), F.lit(None).cast("string").alias("before"))
    given = F.when(~clause_or_junk(name), F.aggregate(F.sequence(F.lit(1), F.lit(PASSES)), start, once, lambda s: s["t"]))

    def pick(x: Column) -> Column:
        mine, theirs = x["own"], x["given"]
        scoped = theirs.rlike(_LEAD) & ~mine.rlike(_LEAD)
        long = (F.length(theirs) >= WHOLE * F.length(full)) & (F.length(mine) < F.length(theirs))
        return F.when(mine.isNotNull() & (scoped | long), mine).otherwise(theirs)

    best = bind(F.struct(own.alias("own"), given.alias("given")), pick)
    best = bind(best, lambda t: F.trim(finished(t), F.lit(" .,;")))
    usable = bind(best, lambda t: F.when(~clause_or_junk(t) & ~t.rlike(_LEAD), t))
    return F.when(name.isNull(), F.when(~clause_or_junk(full), own)).otherwise(usable)


def product_name(full: Column, learned: Column | None = None, extra: tuple[str, ...] = (), rest: Column | None = None) -> Column:
    """I22 of a normal description: a learned name, the rest after a learned prefix, else what the scope grammar leaves."""
    known = [*([] if learned is None else [learned]), *([] if rest is None else [finish_name(rest)])]
    names = _own_name(full, extra, lambda own: F.coalesce(*known, own))
    return F.when(full.isNotNull(), bind(names, lambda x: F.when(x["name"].isNotNull(), _checked(full, x, extra))))
