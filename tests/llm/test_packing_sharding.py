import hashlib
import itertools
import random
from collections import Counter, defaultdict
from fractions import Fraction

import numpy as np
import pytest

from steppe.llm.packing import best_fit_decreasing, fillings, lower_bound, pack, pack_documents
from steppe.llm.sharding import interleave, with_shards


def optimum(lengths, capacity):
    """Least number of bins, by trying all placements."""
    lengths = sorted(lengths, reverse=True)
    best = [len(lengths)]

    def place(i, rooms):
        if len(rooms) >= best[0]:
            return
        if i == len(lengths):
            best[0] = len(rooms)
            return
        for r in set(rooms):
            if r >= lengths[i]:
                k = rooms.index(r)
                place(i + 1, [*rooms[:k], r - lengths[i], *rooms[k + 1 :]])
        place(i + 1, [*rooms, capacity - lengths[i]])

    place(0, [])
    return best[0]


def test_bin_completion_finds_the_optimum_of_small_cases():
    rng = random.Random(2)
    better = 0
    for _ in range(60):
        x = np.array([rng.randrange(10, 60) for _ in range(9)])
        bins = pack(x, 100)
        assert sorted(sum(bins, [])) == list(range(9)) and all(x[b].sum() <= 100 for b in bins)
        assert len(bins) == optimum(x.tolist(), 100)
    for _ in range(20):
        x = np.array([rng.randrange(15, 50) for _ in range(60)])
        bins, greedy = pack(x, 100), best_fit_decreasing(x, 100)
        assert sorted(sum(bins, [])) == list(range(60)) and all(x[b].sum() <= 100 for b in bins)
        assert lower_bound(x, 100) <= len(bins) <= len(greedy)
        better += len(bins) < len(greedy)
    assert better


def test_search_closes_in_on_the_bound_where_best_fit_does_not():
    rng = np.random.default_rng(1)
    for low, high, n, gap in ((400, 1100, 600, 0.03), (300, 1000, 600, 0.03)):
        x = rng.integers(low, high, n)
        bins, greedy, bound = pack(x, 2048), best_fit_decreasing(x, 2048), lower_bound(x, 2048)
        assert sorted(sum(bins, [])) == list(range(n)) and all(x[b].sum() <= 2048 for b in bins)
        assert bound < len(bins) < len(greedy) and len(bins) <= (1 + gap) * bound


def test_fillings_are_undominated():
    found = fillings([50, 30, 20, 10], [1, 1, 1, 1], 60, 60)
    assert (0, [0, 3]) in found
    assert all(w == 60 - sum([50, 30, 20, 10][j] for j in c) for w, c in found)
    assert (10, [0]) not in found and (20, [1, 3]) not in found


def test_no_filling_is_left_out():
    sizes, left = list(range(40, 10, -1)), [1] * 30
    found = fillings(sizes, left, 100, 0)
    exact = [(0, list(c)) for k in range(1, 9) for c in itertools.combinations(range(30), k) if sum(sizes[j] for j in c) == 100]
    assert len(found) > 6 and set(map(str, found)) <= set(map(str, exact))
    for _, c in exact:  # one that isn't found has a larger item in place of some of its own
        assert (0, c) in found or any(sizes[a] + sizes[b] in sizes and sizes.index(sizes[a] + sizes[b]) not in c for a, b in itertools.combinations(c, 2))


def test_a_bin_may_take_hundreds_of_documents():
    x = np.array([7] * 8 + [5] * 808)
    bins = pack(x, 2048)
    assert sorted(sum(bins, [])) == list(range(len(x))) and all(x[b].sum() <= 2048 for b in bins)
    assert len(best_fit_decreasing(x, 2048)) == 3 and len(bins) == 2


@pytest.mark.parametrize("capacity", [2048, 64])
def test_every_word_has_one_place(docs, rows, capacity):
    out = pack_documents(docs, capacity, group=20).collect()
    want = Counter()
    for i, text, *_ in rows:
        want[i] += len((text or "").split())
    got, bins = Counter(), defaultdict(list)
    for r in out:
        got[r.doc_id] += r.n_words
        bins[r.bin_id].append((r.bin_offset, r.n_words))
    assert got == +want
    for own in bins.values():
        own.sort()
        assert [a for a, _ in own] == list(itertools.accumulate([n for _, n in own], initial=0))[:-1]
        assert sum(n for _, n in own) <= capacity
    for i, n in want.items():
        if i is not None and i != 77:
            pieces = sorted((r.start_word, r.n_words) for r in out if r.doc_id == i)
            assert sum(x for _, x in pieces) == n and [a for a, _ in pieces] == [k * capacity for k in range(len(pieces))]


def test_a_length_column_and_nothing(spark, empty):
    from pyspark.sql import functions as F

    df = spark.createDataFrame([(i, 7) for i in range(100)] + [(500, None), (501, 0), (502, -3)], "doc_id long, size int")
    out = pack_documents(df.withColumn("text", F.lit("x")), 10, length=F.col("size"))
    assert out.count() == 100 and out.select("bin_id").distinct().count() == 100
    assert pack_documents(empty).count() == 0


def manifest(rows, shards, seed):
    by = defaultdict(list)
    for i, _, _, s in rows:
        by[s].append((hashlib.md5(f"{seed}|{'null' if i is None else i}".encode()).hexdigest(), i is not None, i or 0, i))
    order = []
    for s, own in by.items():
        for k, (h, a, b, i) in enumerate(sorted(own), 1):
            order.append((Fraction(2 * k - 1, 2 * len(own)), s is not None, s or "", h, a, b, i, s))
    order.sort(key=lambda x: x[:6])
    out = []
    for at, x in enumerate(order):
        shard = at * shards // len(order)
        out.append((x[6], x[7], shard, at - -(-shard * len(order) // shards)))
    return out


@pytest.mark.parametrize(("shards", "digits"), [(5, 1), (64, 3), (200, 2)])
def test_shards_are_those_of_brute_force(docs, rows, shards, digits):
    key = lambda r: tuple((x is None, x or 0) if not isinstance(x, str) else (False, x) for x in r)
    got = [(r.doc_id, r.source, r.shard, r.position) for r in interleave(docs, shards, "s", digits).collect()]
    want = manifest(rows, shards, "s")
    assert sorted(map(str, got)) == sorted(map(str, want))


def test_shards_match_the_mixture(spark):
    rows = [(i, "x", "en", "big" if i % 10 else f"s{i % 7}") for i in range(3000)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    whole = Counter(r[3] for r in rows)
    for shard in range(8):
        own = Counter(r.source for r in interleave(df, 8).where(f"shard = {shard}").collect())
        assert sum(own.values()) == 375
        assert all(abs(own[s] - whole[s] / 8) <= len(whole) for s in whole)
    assert with_shards(df, 8).count() == 3000


def test_no_rows(empty):
    assert interleave(empty).count() == 0


def test_every_row_has_one_place(docs):
    out = with_shards(docs, 5)
    assert out.columns == [*[c for c in docs.columns if c != "shard"], "shard", "position"]
    key = lambda df: sorted((str(r.doc_id), str(r.text), str(r.source)) for r in df.collect())
    assert key(out) == key(docs)
    place = lambda df: sorted((str(r.doc_id), str(r.source), r.shard, r.position) for r in df.collect())
    assert place(out) == place(interleave(docs, 5))
