from collections import defaultdict

import pytest

from steppe.llm.substring import agreements, drop_repeats, maximal_repeats, repeats

from .conftest import words


def texts_of(rows):
    return sorted({(i, x) for i, x, *_ in rows if i is not None and x})


def links(rows, least):
    """(text, place, text before, place) for every run of words and the document before that has it."""
    docs = [(i, words(x)) for i, x in texts_of(rows)]
    at = defaultdict(list)
    for t, (i, w) in enumerate(docs):
        for p in range(len(w) - least + 1):
            at[tuple(w[p : p + least])].append((i, t, p))
    out = set()
    for places in at.values():
        for i, t, p in places:
            before = [x for x in places if x[0] < i]
            if before:
                last = max(x[0] for x in before)
                out.add((t, p, *min((docs[x[1]][1] and x[1], x[2]) for x in before if x[0] == last)))
    return docs, out


def brute(rows, least):
    """The matches of linked places, a word at a time."""
    docs, linked = links(rows, least)
    out = set()
    for t, p, o, q in linked:
        a, b = docs[t][1], docs[o][1]
        n = least
        while p and q and a[p - 1] == b[q - 1]:
            p, q, n = p - 1, q - 1, n + 1
        while p + n < len(a) and q + n < len(b) and a[p + n] == b[q + n]:
            n += 1
        out.add((docs[t][0], p, n, docs[o][0], q))
    return out


def test_repeats_are_those_of_brute_force(docs, rows):
    for least, seed in ((50, 20), (12, 4)):
        got = [tuple(r) for r in repeats(docs, least, seed).collect()]
        assert len(got) == len(set(got))
        assert set(got) == brute(rows, least)


def test_a_match_is_as_long_as_its_pair_agrees(spark):
    """Neither a passage of an earlier document nor a holder between two documents cuts a match short."""
    w = [f"w{i}" for i in range(100)]
    rows = [(1, " ".join(["a", *w[:60], "b"])), (2, " ".join(["c", *w, "d"])), (3, " ".join(["e", *w, "f"])), (4, " ".join(["g", *w[20:75], "h"])), (5, " ".join(["i", *w, "j"]))]
    got = {tuple(r) for r in repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert {(2, 1, 60, 1, 1), (3, 1, 100, 2, 1), (4, 1, 55, 3, 21), (5, 1, 100, 3, 1), (5, 21, 55, 4, 1)} == got == brute(rows, 50)


def test_agreements():
    words_ = b"a b c d "
    assert agreements(words_, words_, 3, 3, 4) == [(3, 7)] and agreements(words_, words_, 0, 0, 5) == []
    assert agreements(b"a b c d ", b"b c x ", 0, 1, 2) == [(1, 3)]
    assert agreements(b"a b x c d ", b"a b y c d ", 0, 0, 2) == [(0, 2), (3, 5)] and agreements(b"", b"", 0, 2, 1) == []


def test_passage_stays_only_where_it_is_first(docs, rows):
    cut = drop_repeats(docs)
    assert cut.schema == docs.schema
    got = {r.doc_id: r for r in cut.collect() if r.doc_id is not None}
    gone = defaultdict(set)
    for i, p, n, *_ in brute(rows, 50):
        gone[i] |= set(range(p, p + n))
    for i, text, *_ in rows:
        if i is None:
            continue
        left = [w for k, w in enumerate(words(text)) if k not in gone[i]]
        if left or not text or not gone[i]:
            if text is None or not gone[i]:
                if words(text) or not text:
                    assert got[i].text == text
            else:
                assert words(got[i].text) == left and got[i].n_chars == len(got[i].text)
        else:
            assert i not in got
    assert sum(r.doc_id is None for r in cut.collect()) == 2


@pytest.mark.parametrize("name", ["__cuts", "cuts", "CUT_ID", "__cut_id", "cut_key", "key", "asked", "seeds"])
def test_columns_may_have_any_names(spark, name):
    passage = " ".join(f"p{i}" for i in range(60))
    rows = spark.createDataFrame([(1, passage, "x"), (2, f"own {passage}", "y")], f"doc_id long, text string, `{name}` string")
    cut = drop_repeats(rows)
    assert cut.columns == rows.columns and sorted(map(tuple, cut.collect())) == [(1, passage, "x"), (2, "own ", "y")]


def test_nothing(empty):
    assert repeats(empty).count() == 0 and drop_repeats(empty).count() == 0


def test_cutting_keeps_the_rest_of_the_text(spark):
    passage = " ".join(f"p{i}" for i in range(60))
    rows = [(1, f"İlk — {passage}. Son"), (2, f"“Ara” {passage}, İKİNCİ metin"), (3, passage.upper())]
    got = {r.doc_id: r.text for r in drop_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: rows[0][1], 2: "“Ara” İKİNCİ metin"}


def classes(rows, least):
    """Maximal repeats by trying all lengths: (n_words, places) of each."""
    docs = sorted({(i, x) for i, x, *_ in rows if i is not None and x})
    docs = [(i, words(x)) for i, x in docs]
    at, out, n = [(t, p) for t, (_, w) in enumerate(docs) for p in range(len(w) - least + 1)], set(), least
    while at:
        places = defaultdict(list)
        for t, p in at:
            if p + n <= len(docs[t][1]):
                places[tuple(docs[t][1][p : p + n])].append((t, p))
        places = [x for x in places.values() if len({docs[t][0] for t, _ in x}) > 1]
        for own in places:
            before = {docs[t][1][p - 1] if p else t for t, p in own}
            after = {docs[t][1][p + n] if p + n < len(docs[t][1]) else t for t, p in own}
            edge = any(isinstance(x, int) for x in before), any(isinstance(x, int) for x in after)
            if (edge[0] or len(before) > 1) and (edge[1] or len(after) > 1):
                out.add((n, frozenset((docs[t][0], p) for t, p in own)))
        at, n = [x for own in places for x in own], n + 1
    return out


def found(df, least, seed):
    by = defaultdict(set)
    got = [tuple(r) for r in maximal_repeats(df, least, seed).collect()]
    assert len(got) == len(set(got))
    for k, n, i, p in got:
        by[k, n].add((i, p))
    assert len({k for k, _ in by}) == len(by)
    return {(n, frozenset(x)) for (_, n), x in by.items()}


def test_maximal_repeats_are_those_of_brute_force(spark, docs, rows):
    for least, seed in ((50, 20), (12, 4)):
        want = classes(rows, least)
        assert len(want) > 3 and found(docs, least, seed) == want
    two = [(1, "a b c d e f g"), (1, "x b c d e y"), (2, "a b c d e z"), (3, "q b c d e f"), (3, "q b c d e f")]
    assert found(spark.createDataFrame(two, "doc_id long, text string"), 3, 2) == classes(two, 3)


def test_a_passage_of_an_earlier_document_does_not_cut_a_repeat(spark):
    w = [f"w{i}" for i in range(80)]
    rows = [(1, " ".join(["a", *w[10:70], "b"])), (2, " ".join(["c", *w, "d"])), (3, " ".join(["e", *w, "f"]))]
    got = found(spark.createDataFrame(rows, "doc_id long, text string"), 50, 20)
    assert got == {(60, frozenset({(1, 1), (2, 11), (3, 11)})), (80, frozenset({(2, 1), (3, 1)}))}


def test_no_maximal_repeats(empty):
    assert maximal_repeats(empty).count() == 0


def test_cuts_are_of_one_text(spark):
    passage, other = " ".join(f"p{i}" for i in range(60)), " ".join(f"q{i}" for i in range(70))
    rows = [(1, passage), (3, f"own {passage}"), (3, other)]
    got = sorted(tuple(r) for r in drop_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == [(1, passage), (3, "own "), (3, other)]
