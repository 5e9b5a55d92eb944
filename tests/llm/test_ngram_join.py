import random
from itertools import combinations

import duckdb
import numpy as np
import pytest

from steppe.llm import ngram_join, queries
from steppe.llm.ngram_join import components, divide_skip, keep_one_of_each_group, linked_documents, matches, ngram_jaccard_join, similar_sets

from .conftest import words


def grams(text, n):
    w = words(text)
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else {tuple(w)} if w else set()


def brute(rows, n, t):
    sets = {i: grams(x, n) for i, x, *_ in rows if i is not None and grams(x, n)}
    out = {}
    for a, b in combinations(sorted(sets), 2):
        j = len(sets[a] & sets[b]) / len(sets[a] | sets[b])
        if j >= t:
            out[a, b] = j
    return out


@pytest.mark.parametrize(("n", "t"), [(3, 0.5), (1, 0.3)])
def test_join_finds_exactly_what_brute_force_finds(docs, rows, n, t):
    got = {(r.doc_a, r.doc_b): r.jaccard for r in ngram_jaccard_join(docs, n, t).collect()}
    want = brute(rows, n, t)
    assert got.keys() == want.keys() and len(want) > 10
    assert all(got[p] == pytest.approx(want[p]) for p in want)


def test_join_of_nothing(empty):
    out = ngram_jaccard_join(empty)
    assert out.columns == ["doc_a", "doc_b", "jaccard"] and out.count() == 0
    assert keep_one_of_each_group(empty).count() == 0


def test_divide_skip_against_brute_force():
    rng = random.Random(5)
    for t in (0.3, 0.5, 0.8):
        sets = [set(rng.sample(range(60), rng.randrange(1, 40))) for _ in range(60)]
        sets += [set(list(s)[: rng.randrange(1, len(s) + 1)]) for s in sets]
        got = set(zip(*(x.tolist() for x in divide_skip([np.array(sorted(s), dtype=np.uint64) for s in sets], np.array([len(s) for s in sets]), t)), strict=True))
        want = {(i, j, len(a & b)) for (i, a), (j, b) in combinations(enumerate(sets), 2) if len(a & b) / len(a | b) >= t}
        assert got == want


def test_one_of_each_group_stays(docs, rows):
    kept = keep_one_of_each_group(docs)
    assert kept.columns == docs.columns
    got = sorted((r.doc_id for r in kept.collect()), key=lambda x: (x is None, x))
    group = {i: i for i, *_ in rows if i is not None}
    for _ in group:
        for a, b in brute(rows, 3, 0.5):
            group[a] = group[b] = min(group[a], group[b])
    want = [i for i in group if group[i] == i] + [None, None]
    assert got == sorted(want, key=lambda x: (x is None, x))


def test_components(spark):
    edges = [(i, i + 1) for i in range(0, 40)] + [(100, 7), (200, 201), (202, 201)]
    got = {r.set_key: r.component for r in components(spark.createDataFrame(edges, "set_a long, set_b long")).collect()}
    assert got == {**{i: 0 for i in range(41)}, 100: 0, 200: 200, 201: 200, 202: 200}


def test_texts_under_one_id_go_one_by_one(spark):
    texts = {x: " ".join(f"{x}{i}" for i in range(30)) for x in "abc"}
    rows = [(1, texts["a"] + " end"), (3, texts["a"]), (3, texts["b"]), (3, texts["c"]), (5, texts["b"] + " end"), (5, texts["b"] + " end")]
    kept = keep_one_of_each_group(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(tuple(r) for r in kept) == sorted([rows[0], rows[2], rows[3]])


def test_a_hot_group_is_dealt_into_blocks(spark):
    """Two hundred near copies in groups of a few sets each: the same pairs, and links that connect them all."""
    rng = random.Random(4)
    base = [f"w{i}" for i in range(120)]
    rows = []
    for i in range(200):
        w = list(base)
        w[rng.randrange(120)] = f"x{i}"
        rows.append((i, " ".join(w)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    whole = similar_sets(docs)[1].collect()
    dealt = similar_sets(docs, group_bytes=20_000)[1].collect()
    key = lambda found: sorted((min(r.set_a, r.set_b), max(r.set_a, r.set_b), round(r.jaccard, 9)) for r in found)
    assert len(whole) == 200 * 199 // 2 and key(whole) == key(dealt)
    for limit in (32 << 20, 20_000):
        links = similar_sets(docs, links=True, group_bytes=limit)[1]
        assert 199 <= links.count() < 40 * 200 and components(links).where("component is not null").select("component").distinct().count() == 1


@pytest.mark.parametrize("name", ["__id", "__gone_id", "__gone", "mark", "_mark", "gone", "Place", "key", "component"])
def test_columns_may_have_any_names(spark, name):
    text = " ".join(f"w{i}" for i in range(30))
    docs = spark.createDataFrame([(1, text, "x"), (2, text + " end", "y"), (3, "other", "z"), (3, "other", "z"), (None, text, "n"), (None, text, "n")], f"doc_id long, text string, `{name}` string")
    kept = keep_one_of_each_group(docs)
    assert kept.columns == docs.columns
    assert sorted(map(str, kept.collect())) == sorted(map(str, docs.where("doc_id = 1 or doc_id is null").collect() + docs.where("doc_id = 3").limit(1).collect()))


def classes(rows, n, t):
    """(doc_id, class_id, links) of each document with an id, one for each of its sets of n-grams."""
    nodes = sorted({(i, tuple(sorted(grams(x, n)))) for i, x, *_ in rows if i is not None})
    root, links = list(range(len(nodes))), [0] * len(nodes)
    edges = [(a, b) for (a, (_, x)), (b, (_, y)) in combinations(enumerate(nodes), 2) if x and y and len({*x} & {*y}) >= t * len({*x} | {*y}) - 1e-9]
    for a, b in edges:
        links[a] += 1
        links[b] += 1
    for _ in nodes:
        for a, b in edges:
            root[a] = root[b] = min(root[a], root[b])
    return sorted((i, nodes[root[k]][0], links[k]) for k, (i, _) in enumerate(nodes))


def listed(df):
    return sorted((r.doc_id, r.class_id, r.links) for r in df.collect())


@pytest.mark.parametrize(("n", "t", "group_bytes"), [(3, 0.5, 32 << 20), (1, 0.3, 32 << 20), (1, 0.3, 2000), (3, 0.5, 2000)])
def test_every_document_has_its_class_and_the_number_of_its_links(docs, rows, n, t, group_bytes):
    got = linked_documents(docs, n, t, group_bytes)
    assert got.dtypes == [("doc_id", "bigint"), ("class_id", "bigint"), ("links", "bigint")]
    assert listed(got) == classes(rows, n, t)


def test_rows_are_as_many_as_documents(spark, tmp_path):
    """Copies, near copies, texts under one id, null and wordless texts: a row each, as in the SQL."""
    rng = random.Random(11)
    base = [f"w{i}" for i in range(60)]
    rows = [(i, " ".join(base)) for i in range(40)]
    for i in range(40, 80):
        w = list(base)
        for _ in range(rng.randrange(1, 9)):
            w[rng.randrange(60)] = f"x{rng.randrange(10**6)}"
        rows.append((i, " ".join(w)))
    rows += [(-5, " ".join(base)), (3, "a b c d e"), (3, "a b c d e"), (90, "a b c d e f"), (91, ""), (92, None), (92, None), (93, "?!"), (None, " ".join(base)), (94, "one"), (95, "One!")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    got = listed(queries.op1_ngram_jaccard_join(spark, str(tmp_path)))
    db = duckdb.connect()
    db.sql(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    assert got == sorted(db.sql(queries.ORACLE_SQL["op1_ngram_jaccard_join"]).fetchall()) == classes(rows, 3, 0.5)
    assert len(got) == 88
    assert listed(linked_documents(docs, group_bytes=4000)) == got


def test_link_counts_of_a_hot_group(spark):
    """Near copies that meet in many groups and blocks: each link counts once."""
    rng = random.Random(4)
    base = [f"w{i}" for i in range(120)]
    rows = []
    for i in range(150):
        w = list(base)
        for _ in range(rng.choice([1, 3, 9, 14])):
            w[rng.randrange(120)] = f"x{rng.randrange(10**6)}"
        rows += [(1000 - 2 * i - k, " ".join(w)) for k in range(1 + i % 2)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    want = classes(rows, 3, 0.5)
    assert len({x[2] for x in want}) > 5
    for limit in (32 << 20, 30_000):
        assert listed(linked_documents(docs, group_bytes=limit)) == want


@pytest.mark.parametrize("sided", [False, True])
def test_product_finds_what_merging_finds(monkeypatch, sided):
    rng = random.Random(6)
    core = rng.sample(range(10**6), 80)
    sets = [set(rng.sample(core, rng.randrange(30, 81))) | set(rng.sample(range(2000), 12)) for _ in range(300)] + [set(rng.sample(range(2000), 40)) for _ in range(100)]
    rng.shuffle(sets)
    grams_ = [np.array(sorted(s), dtype=np.uint64) for s in sets]
    sizes, side = np.array([len(s) for s in sets]), np.array([i % 3 == 0 for i in range(400)])
    for t in (0.3, 0.5, 0.7):
        found = []
        for pair, merged in ((0, 10**9), (10**9, 0)):
            monkeypatch.setattr(ngram_join, "_PAIR", pair)
            monkeypatch.setattr(ngram_join, "_MERGED", merged)
            found.append({(min(x, int(y)), max(x, int(y)), int(o)) for x, other, overlap in matches(grams_, sizes, t, side=side if sided else None) for y, o in zip(other, overlap, strict=True)})
        want = {(i, j, len(a & b)) for (i, a), (j, b) in combinations(enumerate(sets), 2) if len(a & b) >= t * len(a | b) - 1e-9 and (not sided or side[i] != side[j])}
        assert found == [want, want] and want


def test_sets_much_alike_are_not_merged_list_by_list(monkeypatch):
    """Entries merged grow with the square of the sets times their n-grams: for near copies no list is merged."""
    rng = random.Random(9)
    sets = [np.array(sorted({*range(300)} - {rng.randrange(300)} | {1000 + i}), dtype=np.uint64) for i in range(400)]
    merged = []
    monkeypatch.setattr(ngram_join, "_merged", lambda lists, m, x: merged.append(len(lists)) or (np.zeros(0, np.int64), np.zeros(0, np.int64)))
    a, _, _ = divide_skip(sets, np.full(400, 300), 0.5)
    assert len(a) == 400 * 399 // 2 and not merged
