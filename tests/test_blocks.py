"""Line passes over blocks equal the passes over whole documents."""

import random

import pytest

from docloom.operators import items
from docloom.operators.blocks import parse_items_blocked

LINES = [
    "Schedule () A-Supply 1.00", "Schedule Total 5.00", "2. Item Breakup", "[[PAGE:3]]", "Tender No: 9", "", "7", "12", "NS4", "Description:- some words", "NS9 Description:-", "Above/", "free words here",
    "1 2.00 Nos 3.00 4.00 AT Par 5.00 Above/", "2.00 Nos 3.00 4.00 AT Par 5.00", "3 10001 2.00", "Nos 3.00 4.00", "AT Par 5.00", "NS4 2.00 Nos 3.00 4.00 AT Par 5.00", "A 2.00 Numbers 3.00 4.00 AT Par 5.00", "more text",
]


def documents():
    rng = random.Random(5)
    out = {}
    for k in range(60):
        n = rng.choice([0, 1, 5, 40, 200])
        weights = [rng.random() ** 2 + 0.05 for _ in LINES]
        out[f"d{k}"] = rng.choices(LINES, weights, k=n)
    # an item longer than a block, with and without an end
    out["long"] = ["Schedule A-x", LINES[13], "Description:- begin", *[f"word {k} " + "x" * 50 for k in range(300)], "Schedule Total", "gone"]
    out["open"] = ["Schedule A-x", LINES[13], *["filler"] * 90, "5", *["filler"] * 30, "NS7", "Description:- late", "end of it"]
    return rng, out


@pytest.mark.parametrize("size", [3, 7, 4096])
def test_blocks_equal_whole(spark, size):
    rng, docs = documents()
    whole, pieces = [], []
    for d, lines in docs.items():
        cuts = sorted(rng.sample(range(len(lines) + 1), k=min(len(lines), rng.choice([0, 1, 4]))))
        cuts = [0, *[c for c in cuts if 0 < c < len(lines)], len(lines)]
        texts = ["\n".join(lines[a:b]) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
        pieces += [(d, k, t) for k, t in enumerate(texts)]
        whole.append((d, "\n".join(texts)))
    want = items.parse_items(spark.createDataFrame(whole, "doc_id string, text string"))
    got = parse_items_blocked(spark.createDataFrame(pieces, "doc_id string, piece_no int, text string"), size=size)
    key = lambda df: sorted(map(repr, (r.asDict(recursive=True) for r in df.collect())))
    assert want.columns == got.columns
    assert len(key(want)) > 100
    assert key(got) == key(want)


def test_no_rows_and_nulls(spark):
    assert parse_items_blocked(spark.createDataFrame([], "doc_id string, piece_no int, text string")).count() == 0
    got = parse_items_blocked(spark.createDataFrame([("a", 0, None), ("a", 1, "Schedule A-x\n" + LINES[13])], "doc_id string, piece_no int, text string"))
    assert [(r.s_no, r.source_pos) for r in got.collect()] == [("1", 14)]
