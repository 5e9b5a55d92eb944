import random

import pytest

from steppe.llm.decontaminate import decontaminate, drop_contaminated

from .conftest import prose, words


def shingles(text, n=3):
    w = words(text)
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else {tuple(w)} if w else set()


@pytest.fixture(scope="module")
def tables(spark):
    rng = random.Random(3)
    items = [(i, prose(rng, rng.choice([2, 5, 9, 14, 30, 60, 130]), 3000)) for i in range(80)]
    docs = []
    for i in range(150):
        text = prose(rng, rng.choice([3, 50, 400, 6000]), 3000)
        if i % 2:
            w = items[rng.randrange(80)][1].split(" ")
            for _ in range(rng.choice([0, 0, 1, 2])):
                w[rng.randrange(len(w))] = "changed"
            at = rng.randrange(len(text))
            text = f"{text[:at]} {' '.join(w)} {text[at:]}".replace("\n", " ")
        docs.append((i, text))
    items += [(None, "a b c d"), (900, None), (901, ""), (902, "!!"), (3, items[3][1])]
    docs += [(None, items[0][1]), (500, None), (501, ""), (502, items[0][1].upper()), (502, items[0][1].upper()), (503, items[1][1])]
    return spark.createDataFrame(docs, "doc_id long, text string").withColumnsRenamed({}).selectExpr("*", "'x' as item_id", "1 as containment"), spark.createDataFrame(items, "item_id long, text string").selectExpr("*", "'y' as doc_id"), docs, items


def brute(docs, items):
    out = {}
    for d, t in docs:
        own = shingles(t)
        for i, x in items:
            s = shingles(x)
            if d is not None and i is not None and s and own and len(s & own) / len(s) >= 0.6:
                out[d, i] = len(s & own) / len(s)
    return out


@pytest.mark.parametrize("limit", [64 << 20, 20_000])
def test_recall_and_precision_against_brute_force(tables, limit):
    docs, items, d, i = tables
    rows = decontaminate(docs, items, limit=limit).collect()
    got, want = {(r.doc_id, r.item_id): r.containment for r in rows}, brute(d, i)
    assert len(rows) == len(got) and len(want) > 40
    assert got.keys() <= want.keys() and all(got[p] == pytest.approx(want[p]) for p in got)
    assert len(got) >= 0.95 * len(want)


def test_contaminated_documents_go(tables):
    docs, items, d, i = tables
    left = drop_contaminated(docs, items)
    assert left.columns == docs.columns
    found = {r.doc_id for r in decontaminate(docs, items).collect()}
    assert sorted(r.doc_id for r in left.where("doc_id is not null").collect()) == sorted(x for x, _ in d if x is not None and x not in found)


def test_nothing(tables, empty):
    docs, items, *_ = tables
    assert decontaminate(empty, items).count() == 0 and decontaminate(docs, items.limit(0)).count() == 0
    assert drop_contaminated(docs, items.limit(0)).count() == docs.count() and drop_contaminated(empty, items).count() == 0


def test_items_that_repeat_themselves_or_are_tiny(spark):
    """They are found by their shingles, exactly, and don't add to the bands of the others."""
    from steppe.llm.decontaminate import Items

    rng = random.Random(9)
    items = [(1, "la " * 600), (2, "one two three"), (3, "x y " * 80 + "z"), (4, prose(rng, 20, 3000)), (5, "one two")]
    docs = [(1, f"{prose(rng, 300, 3000)} la la la {prose(rng, 50, 3000)}"), (2, "la la"), (3, f"{prose(rng, 50, 3000)} one two three"), (4, f"a x y x y z {prose(rng, 90, 3000)}"), (5, items[3][1]), (6, "one two"), (7, "one two four")]
    rows = decontaminate(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()
    assert {(r.doc_id, r.item_id) for r in rows} == set(brute(docs, items)) and len(rows) >= 5
    import numpy as np
    import pyarrow as pa

    index = Items(np.arange(5), pa.array([t for _, t in items]), 3, 0.6, 0.002)
    assert max(len(b) for _, b in index.partitions) < 60
