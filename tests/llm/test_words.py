import random

import numpy as np
import pyarrow as pa

from steppe.llm.words import Words, gram_sets, ngrams, rolling, runs_rank

from .conftest import words


def texts(w):
    return [[bytes(w.data[w.start[i] : w.end[i]]).decode() for i in range(w.first[d], w.first[d + 1])] for d in range(len(w))]


def test_words_are_runs_of_letters_and_digits():
    given = ["Hello, World_1! x", None, "", "...", "Äpfel—und “Öl” ×2", "a b　c", "ß"]
    w = Words(pa.array(given))
    assert texts(w) == [["hello", "world_1", "x"], [], [], [], ["äpfel", "und", "öl", "2"], ["a", "b", "c"], ["ß"]]
    assert w.counts.tolist() == [3, 0, 0, 0, 4, 3, 1]
    assert w.hash[0] != w.hash[1] and Words(pa.array(["HELLO"])).hash[0] == w.hash[0]


def test_words_do_not_span_texts_and_slices_work():
    a = pa.array(["skip", "ab", "cd", "", "ef gh"])
    assert texts(Words(a.slice(1))) == [["ab"], ["cd"], [], ["ef", "gh"]]
    assert texts(Words(pa.chunked_array([a.slice(0, 2), a.slice(3)]))) == [["skip"], ["ab"], [], ["ef", "gh"]]
    assert len(Words(pa.array([], type=pa.string()))) == 0


def test_original_and_lower_case_have_the_same_words():
    given = pa.array(["İstanbul DİYOR Ki", "ẞ K Å", "A—B"])
    assert Words(given).counts.tolist() == Words(given, lower=False).counts.tolist()


def test_grams_agree_with_python():
    rng = random.Random(1)
    given = [" ".join(rng.choice("abcde") for _ in range(rng.randrange(12))) for _ in range(60)]
    w = Words(pa.array(given))
    for n in (1, 2, 3, 5):
        g, at = ngrams(w.hash, w.first, n)
        owner = np.searchsorted(w.first, at, side="right") - 1
        sets, first = gram_sets(w, n)
        names = {}
        for d, t in enumerate(given):
            x = words(t)
            want = [tuple(x[i : i + n]) for i in range(len(x) - n + 1)] if len(x) >= n else [tuple(x)] if x else []
            got = g[owner == d].tolist()
            assert len(got) == len(want)
            for a, b in zip(want, got, strict=True):
                assert names.setdefault(a, b) == b
            assert first[d + 1] - first[d] == len(set(want))
        assert len(set(names.values())) == len(names)


def test_rolling_hash_depends_on_the_run_only():
    w = Words(pa.array(["a b c d x a b c d y"])).hash
    r = rolling(w, 4)
    assert r[0] == r[5] and len(set(r.tolist())) == len(r) - 1
    assert len(rolling(w, 11)) == 0


def test_runs_rank():
    assert runs_rank(np.array([1, 1, 2, 2, 2]), np.array([0, 0, 0, 1, 1])).tolist() == [0, 1, 0, 0, 1]
    assert runs_rank(np.zeros(0), np.zeros(0)).tolist() == []
