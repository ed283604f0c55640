"""Rule matching by required literals and prefix lookup by trie keys, against every rule on every text."""

import random
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from docloom.operators import names
from docloom.operators.rules import match_rules, required

SHAPES = [
    (r"closing\s*date", [["closing"], ["date"]]), (r"(?:item|part)\s*P-0155\b", [["item", "part"], ["p-0155"]]), (r"S-7\b|supplier\s+7", [["s-7", "supplier"]]), (r"\d{2}x?", []),
    (r"ab+c?d", [["ab"], ["d"]]), (r"[abc]foo[^\]x]bar", [["foo"], ["bar"]]), (r"(?<!to )make", [["make"]]), (r"\p{L}+abc", [["abc"]]), (r"a|", []), (r"(", []), (r"\x41bc", []), (r"(?i)Ab", [["ab"]]), (r"(?x)a b", []),
]


@pytest.mark.parametrize("pattern,want", SHAPES)
def test_required_literals(pattern, want):
    assert required(pattern) == want


atoms = st.sampled_from(["a", "b", "ab", "[ab]", "(?:a|bb)", "(?:ab|ba)", "(?:aab)?", "b*", "a+", "ba{2}", "(?:b{0,1}a)", r"\w", "(a(?:b|ab))"])
patterns = st.lists(atoms, min_size=1, max_size=5).map("".join) | st.tuples(*[st.lists(atoms, min_size=1, max_size=3).map("".join)] * 2).map("|".join)


@settings(max_examples=400, deadline=None)
@given(patterns, st.lists(st.text("abAB ", max_size=12), max_size=8))
def test_matches_hold_required_literals(pattern, texts):
    for t in texts:
        if re.search(pattern, t, re.I):
            assert all(any(x in t.lower() for x in choice) for choice in required(pattern))


def test_rules_equal_nested_loop(spark):
    rng = random.Random(3)
    words = ["tender", "closing", "date", "value", "INR", "no", "42", "x9", "earnest", "money", "é"]
    texts = [(k, " ".join(rng.choices(words, k=rng.randint(0, 12)))) for k in range(80)] + [(900, None), (901, "")]
    pats = [r"closing\s+date", r"tender\s*(?:no|value)", r"x\d", r"\d\d", r"earnest|money", "é", "inr", r"(?:value)?\s*42", "nothing"]
    rules = [(f"f{k % 3}", k, p) for k, p in enumerate(pats)] + [("f0", 0, pats[0]), ("f1", None, "tender"), ("f2", 5, None)]
    want = {}
    for d, t in texts:
        for f, k, p in sorted((r for r in rules if r[2]), key=lambda r: (r[1] is not None, r[1] or 0)):
            if t is not None and re.search(p, t, re.I | re.A):
                want.setdefault((d, f), p)
    df, r = spark.createDataFrame(texts, "doc_id int, text string"), spark.createDataFrame(rules, "field string, priority int, pattern string")
    for block in (3, 50_000):
        assert {(x.doc_id, x.field): x.pattern for x in match_rules(df, r, block=block).collect()} == want
    assert match_rules(df, r.limit(0)).count() == 0 and match_rules(df.limit(0), r).count() == 0


def test_prefixes_equal_expressions(spark):
    rng = random.Random(8)
    words = ["supply", "of", ",", "&", "fit", "fitting", "kit", "a.b", "x(1)"]
    say = lambda n: re.sub(r"x", "X", rng.choice([" ", "  "]).join(rng.choices(words, k=n)))
    prefixes = [(say(rng.randint(1, 4)), k) for k in range(60)] + [("", 60), (" ", 61)]
    items = [(k, say(rng.randint(0, 7))) for k in range(150)] + [(500, None), (501, prefixes[0][0])]
    table = spark.createDataFrame(prefixes, "prefix string, list_pos int")
    pattern = {r.prefix: r.p for r in table.select("prefix", names.prefix_pattern(table["prefix"]).alias("p")).collect()}

    def rest(t, longest):
        found = []
        for p, k in prefixes:
            m = re.match(pattern[p], (t or "").strip()) if p.strip() else None
            if m and t.strip()[m.end() :].strip():
                found.append((-len("\u0001".join(re.findall(names.TOKEN, p))) if longest else 0, k, t.strip()[m.end() :].strip()))
        return min(found)[2] if found else None

    df = spark.createDataFrame(items, "id int, description string")
    for longest in (False, True):
        got = {r.id: r.rest for r in names.prefix_rest(df, table, longest=longest).collect()}
        assert got == {k: rest(t, longest) for k, t in items}
    assert [r.rest for r in names.prefix_rest(df.limit(1), table.limit(0)).collect()] == [None]


def test_plan_does_not_grow_with_prefixes(spark):
    df = spark.createDataFrame([(1, "supply of x")], "id int, description string")
    plan = lambda n: len(names.prefix_rest(df, spark.range(n).selectExpr("concat('p', id) as prefix", "id as list_pos"))._jdf.queryExecution().optimizedPlan().toString())
    assert abs(plan(2000) - plan(2)) < 200
