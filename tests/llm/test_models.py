import random

import numpy as np
import pyarrow as pa
import pytest

from steppe.llm import fingerprint, quality, toxicity
from steppe.llm.words import Words, mix

from .conftest import edited, prose, words


@pytest.fixture(scope="module")
def corpus(spark):
    """Documents of which some are rude and some are shouted junk, with labels for most."""
    rng = random.Random(9)
    docs, labels = [], []
    for i in range(1500):
        text = prose(rng, rng.randrange(20, 120), 800)
        toxic, good = i % 6 == 0, i % 5 != 0
        if not good:
            text = " ".join(w.upper() + "!!" for w in text.split())
        if toxic:
            w = text.split(" ")
            for _ in range(1 + len(w) // 15):
                w.insert(rng.randrange(len(w)), rng.choice(["vile", "brute", "rotten", "dunce"]))
            text = " ".join(w)
        docs.append((i, text))
        labels.append((i, int(good), int(toxic)))
    return spark.createDataFrame(docs, "doc_id long, text string").repartition(4).cache(), spark.createDataFrame(labels[:1000], "doc_id long, quality int, toxic int"), labels[1000:]


def test_toxicity_on_held_out_documents(corpus):
    docs, labels, held = corpus
    got = {r.doc_id: r.toxic for r in toxicity.toxicity(docs, labels).collect()}
    right = [got[i] == bool(t) for i, _, t in held]
    caught = [got[i] for i, _, t in held if t]
    assert np.mean(right) > 0.97 and np.mean(caught) > 0.9
    left = toxicity.drop_toxic(docs, labels)
    assert left.columns == docs.columns
    assert sorted(r.doc_id for r in left.collect()) == sorted(i for i, t in got.items() if not t)


def test_weights_are_sparse(corpus):
    docs, labels, _ = corpus
    at, value, _ = toxicity.train(docs, labels)
    assert 0 < len(at) == len(value) < 2000


def test_quality_on_held_out_documents(corpus):
    docs, labels, held = corpus
    got = {r.doc_id: r.keep for r in quality.quality(docs, labels).collect()}
    assert np.mean([got[i] == bool(g) for i, g, _ in held]) > 0.95
    assert np.mean([got[i] for i, g, _ in held if g]) > 0.97


@pytest.mark.parametrize("scored", [toxicity.toxicity, quality.quality])
def test_odd_rows_are_scored(docs, rows, labels, empty, scored):
    out = scored(docs, labels)
    got = out.collect()
    assert sorted(str(r.doc_id) for r in got) == sorted(str(r[0]) for r in rows)
    assert all(0 <= r[1] <= 1 for r in got)
    assert not any(r[2] for r in got if r.doc_id in (71, 72))
    assert scored(empty, labels).count() == 0
    bare = scored(docs, labels.limit(0)).collect()
    assert {r[1] for r in bare} == {0.5}
    assert not any(r.asDict().get("toxic") for r in bare)


def test_dropping_keeps_odd_rows(docs, rows, labels, empty):
    assert toxicity.drop_toxic(docs, labels.limit(0)).count() == len(rows)
    assert toxicity.drop_toxic(empty, labels).count() == 0


def test_scoring_counts_a_feature_once():
    dense = np.zeros(2**toxicity.BITS, np.float32)
    w = Words(pa.array(["rude"]))
    dense[int(w.hash[0] >> np.uint64(64 - toxicity.BITS))] = 2
    p = toxicity.score_texts(pa.array(["rude", "rude, rude rude!", "fine", None]), dense, -1.0, toxicity.BITS)
    assert p[0] == p[1] == pytest.approx(1 / (1 + np.exp(-1))) and p[2] == p[3]


def test_same_features_for_a_text_in_any_batch():
    texts = ["ab", "", "x y z w", None, "q", "Ünï çödé ünï"]
    many, w = quality.Features(pa.array(texts)), toxicity.features(Words(pa.array(texts)))
    for i, t in enumerate(texts):
        one = quality.Features(pa.array([t], type=pa.string()))
        assert sorted(many.of(i)) == sorted(one.of(0)) and (len(one.of(0)) > 0) == bool(t)
        for (p, o), (q, _) in zip(w, toxicity.features(Words(pa.array([t], type=pa.string()))), strict=True):
            assert p[o == i].tolist() == q.tolist()


def test_character_runs_are_of_words_and_of_characters():
    """As many features as counted by hand: words, pairs, and runs of 3 and 4 of <word>, whatever the bytes of a letter."""
    for text in ("abc de", "жук ёж", "汉字汉字 x", "same same same"):
        w = text.split()
        runs = sum(max(0, len(x) + 2 - n + 1) for x in w for n in (3, 4))
        assert len(quality.Features(pa.array([text])).of(0)) == len(w) + len(w) - 1 + runs
    pair = quality.Features(pa.array(["la la", "ho ho", "la ho"])).pair
    assert pair[0] == pair[1] != pair[2]


def test_means_are_those_of_all_features():
    texts = ["ab", "", "x y z w ab ab", None, "Ünï çödé " * 30]
    value = np.random.default_rng(1).normal(size=2**quality.BITS).astype(np.float32)
    f = quality.Features(pa.array(texts))
    assert np.allclose(f.means(value), [value[f.of(i)].astype(float).mean() if len(f.of(i)) else 0 for i in range(5)])


def test_ftrl_is_that_of_a_plain_loop():
    """Weights by the book, one coordinate at a time (McMahan et al., 2013, algorithm 1)."""
    rng = random.Random(6)
    examples = [sorted(rng.sample(range(40), rng.randrange(1, 12))) for _ in range(300)]
    labels = [int(bool({1, 2, 3} & set(x))) for x in examples]
    at, value, bias = toxicity.ftrl([np.array(x, dtype=np.int32) for x in examples], np.array(labels, dtype=float), bits=6, epochs=3)
    z, n = {}, {}

    def weight(i):
        if abs(z.get(i, 0.0)) <= toxicity.L1:
            return 0.0
        sign = 1 if z[i] > 0 else -1
        return -(z[i] - sign * toxicity.L1) / ((toxicity.BETA + n[i] ** 0.5) / toxicity.ALPHA + toxicity.L2)

    for _ in range(3):
        for x, y in zip(examples, labels, strict=True):
            w = {i: weight(i) for i in [*x, "bias"]}
            g = 1 / (1 + np.exp(-sum(w.values()))) - y
            for i in w:
                sigma = ((n.get(i, 0.0) + g * g) ** 0.5 - n.get(i, 0.0) ** 0.5) / toxicity.ALPHA
                z[i] = z.get(i, 0.0) + g - sigma * w[i]
                n[i] = n.get(i, 0.0) + g * g
    want = {i: weight(i) for i in range(40) if weight(i)}
    assert want and dict(zip(at.tolist(), value.tolist(), strict=True)) == pytest.approx(want, rel=1e-5) and bias == pytest.approx(weight("bias"))


def test_vectors_are_trained_as_by_a_plain_loop():
    """The same steps with lists of floats, each along the gradient of the loss."""
    rng = random.Random(2)
    examples = [quality.shares(np.array([rng.randrange(64) for _ in range(rng.randrange(1, 30))], dtype=np.int32)) for _ in range(40)]
    labels = np.array([rng.randrange(2) for _ in examples])
    got, bias = quality.train_vectors(examples, labels, bits=6, dim=4, epochs=2, rate=0.5, vector_rate=3.0)
    order = np.random.default_rng(11)
    v = order.uniform(-1 / 4, 1 / 4, (64, 4)).astype(np.float32).astype(float).tolist()
    w, b, step = [[0.0, 0.0] for _ in range(4)], [0.0, 0.0], 0
    for _ in range(2):
        for i in order.permutation(len(examples)):
            at, share = examples[i][0].tolist(), examples[i][1].tolist()
            left, step = 1 - step / 80, step + 1
            hidden = [sum(s * v[a][d] for a, s in zip(at, share, strict=True)) for d in range(4)]
            e = [np.exp(sum(hidden[d] * w[d][c] for d in range(4)) + b[c]) for c in (0, 1)]
            p = [x / sum(e) - (c == labels[i]) for c, x in enumerate(e)]
            back = [w[d][0] * p[0] + w[d][1] * p[1] for d in range(4)]
            for d in range(4):
                for c in (0, 1):
                    w[d][c] -= 0.5 * left * hidden[d] * p[c]
            b = [b[c] - 0.5 * left * p[c] for c in (0, 1)]
            for a, s in zip(at, share, strict=True):
                v[a] = [v[a][d] - 3.0 * left * s * back[d] for d in range(4)]
    want = [sum(v[a][d] * (w[d][1] - w[d][0]) for d in range(4)) for a in range(64)]
    assert np.allclose(got, want, atol=1e-4) and bias == pytest.approx(b[1] - b[0], abs=1e-4)


def test_samples_are_bounded(spark):
    """An id repeated a hundred thousand times, and texts that are too long, don't add to what is trained on."""
    docs = spark.range(100_000).selectExpr("1L as doc_id", "'again and again' as text").union(spark.createDataFrame([(i, f"text {i} " * (i % 7 * 100)) for i in range(2, 200)] + [(1, "another"), (300, "x" * 5000), (None, "n")], "doc_id long, text string"))
    labels = spark.createDataFrame([(i, 1, 0) for i in range(301)] + [(1, 0, 1), (None, 1, 1)], "doc_id long, quality int, toxic int")
    got = toxicity.labelled(docs, labels, "toxic", 50, longest=4000).collect()
    assert len(got) <= 50 and len({(r.h, r.text) for r in got}) == len(got) and max(len(r.text) for r in got) <= 4000
    whole = toxicity.labelled(docs, labels, "toxic", 1000, longest=4000).collect()
    assert sorted(r.text for r in whole if r.y) == ["again and again", "another"] and "x" * 5000 not in {r.text for r in whole}
    small = toxicity.labelled(docs, labels, "toxic", 1000, limit=10_000, longest=4000).collect()
    assert 0 < sum(len(r.text) for r in small) <= 10_000 and {r.text for r in small} < {r.text for r in whole}


def brute_signature(text, k, length, size):
    """Order MinHash by the book, with the same hash functions."""
    w = [int(h) for h in Words(pa.array([text])).hash]
    if not w:
        return None
    from steppe.llm.words import ngrams

    kmer = [int(g) for g in ngrams(np.array(w, dtype=np.uint64), np.array([0, len(w)]), k)[0]]
    seen, keys = {}, []
    for g in kmer:
        c = seen.get(g, 0)
        seen[g] = c + 1
        keys.append(int(mix(np.array([(g + c * 0x9E3779B97F4A7C15) % 2**64], dtype=np.uint64))[0]))
    out = []
    for f in fingerprint.multipliers(size).tolist():
        order = sorted(range(len(kmer)), key=lambda i: keys[i] * f % 2**64)[:length]
        h = len(order)
        for i in sorted(order):
            h = int(mix(np.array([(h * 0x9E3779B97F4A7C15 + kmer[i]) % 2**64], dtype=np.uint64))[0])
        out.append(h - 2**64 if h >= 2**63 else h)
    return out


def test_signatures_are_those_of_brute_force(docs, rows, empty):
    texts = {i: t for i, t, *_ in rows if i is not None and i < 78}
    for k, length, size in ((3, 2, 32), (1, 3, 5)):
        got = {r.doc_id: r.signature for r in fingerprint.fingerprints(docs, k, length, size).collect()}
        for i, t in texts.items():
            assert got[i] == brute_signature(t, k, length, size), i
        assert got[72] is None and got[73] is None
    assert fingerprint.fingerprints(docs).count() == len(rows)
    assert fingerprint.fingerprints(empty).count() == 0


def test_signatures_of_very_long_texts_in_slices():
    rng = np.random.default_rng(2)
    kmer = rng.integers(0, 2**63, 5000, dtype=np.uint64)
    kmer[2500:] = kmer[:2500]
    key = fingerprint.occurrence_keys(kmer, np.zeros(5000, np.int64))
    factors = fingerprint.multipliers(16)
    for length in (1, 2, 5):
        assert fingerprint.signature(kmer, key, factors, length, 64).tolist() == fingerprint.signature(kmer, key, factors, length, 10**6).tolist()
    long = rng.integers(0, 2**63, 5_000_000, dtype=np.uint64)
    assert len(fingerprint.signature(long, mix(long), fingerprint.multipliers(32), 2)) == 32


def test_signatures_fall_with_the_edit_distance_and_see_order(spark):
    rng = random.Random(4)
    a = prose(rng, 300, 3000)
    w = a.split(" ")
    moved = " ".join(w[150:] + w[:150])
    given = [(0, a), (1, edited(rng, a, 0.01)), (2, edited(rng, a, 0.1)), (3, edited(rng, a, 0.5)), (4, moved)]
    s = {r.doc_id: np.array(r.signature) for r in fingerprint.fingerprints(spark.createDataFrame(given, "doc_id long, text string"), size=256).collect()}
    share = [(s[0] == s[i]).mean() for i in range(5)]
    assert share[0] == 1 > share[1] > share[2] > share[3]
    assert 0.3 < share[4] < 0.7  # a plain MinHash would hardly see the move
    assert len(words(a)) == 300
