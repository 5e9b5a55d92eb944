import random
from itertools import combinations

import pytest

import corpus_pipeline
from steppe.llm import queries

from .conftest import prose, words
from .test_decontaminate import brute as leaks
from .test_ngram_join import brute as similar
from .test_substring import brute as repeated


@pytest.fixture(scope="module")
def folder(spark, docs, rows, labels, tmp_path_factory):
    """Documents with odd rows and clashing columns, their labels, and a benchmark of which some items leaked."""
    rng = random.Random(8)
    home = tmp_path_factory.mktemp("sf")
    extra = docs.schema
    leak = prose(rng, 30, 3000).replace("\n", " ")
    more = [(200 + i, f"{prose(rng, 50, 3000)} {leak} {prose(rng, 50, 3000)}", "en", "s0", 0, *["clash"] * (len(extra) - 5)) for i in range(3)]
    docs.union(spark.createDataFrame(more, extra)).repartition(2).write.parquet(str(home / "documents.parquet"))
    labels.write.parquet(str(home / "labels.parquet"))
    items = [(1, leak), (2, prose(rng, 20, 3000)), (3, None)]
    spark.createDataFrame(items, "item_id long, text string").write.parquet(str(home / "benchmark.parquet"))
    return str(home), items


def test_every_stage_does_its_part(spark, folder):
    home, items = folder
    docs = spark.read.parquet(f"{home}/documents.parquet")
    seen = {}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, home)
        if k < 4:
            assert out.columns == docs.columns
        path = f"{home}/stage{k}"
        out.write.parquet(path)
        seen[name] = docs, spark.read.parquet(path)
        docs = seen[name][1]
    assert list(seen) == ["toxicity", "ngram_jaccard_join", "substring_dedup", "decontamination", "best_fit_packing"]
    pairs = {n: ([(r.doc_id, r.text) for r in a.collect()], b) for n, (a, b) in seen.items()}
    text = lambda df: sorted((str(r.doc_id), str(r.text)) for r in df.collect())

    given, kept = pairs["ngram_jaccard_join"]
    ids = {i for i, _ in given if i is not None}
    group = {i: i for i in ids}
    edges = similar([(i, t) for i, t in given], 3, 0.5)
    for _ in ids:
        for a, b in edges:
            group[a] = group[b] = min(group[a], group[b])
    assert sorted(r.doc_id for r in kept.where("doc_id is not null").collect()) == sorted(i for i in ids if group[i] == i)

    given, cut = pairs["substring_dedup"]
    gone = {}
    for i, p, n, *_ in repeated(given, 50):
        gone.setdefault(i, set()).update(range(p, p + n))
    left = {i: [w for k, w in enumerate(words(t)) if k not in gone.get(i, ())] for i, t in given if i is not None and t}
    assert {r.doc_id: words(r.text) for r in cut.collect() if r.doc_id is not None and r.text} == {i: w for i, w in left.items() if w or not gone.get(i)}

    given, clean = pairs["decontamination"]
    bad = {d for d, _ in leaks([(i, t) for i, t in given if t is not None], [(i, t) for i, t in items if t is not None])}
    assert bad and text(clean) == sorted((str(i), str(t)) for i, t in given if i not in bad)

    given, packed = pairs["best_fit_packing"]
    assert packed.agg({"n_words": "sum"}).first()[0] == sum(len(t.split()) for _, t in given if t)


def test_run_is_its_stages(spark, folder):
    home, _ = folder
    out = corpus_pipeline.run(spark, home)
    want = spark.read.parquet(f"{home}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES:
        want = stage(spark, want, home)
    key = lambda df: sorted((str(r.doc_id), r.start_word, r.n_words) for r in df.collect())
    assert key(out) == key(want) and corpus_pipeline.ORACLE_SQL is None


def test_one_query_for_each_operator():
    assert [n for n in range(1, 11) if any(q.startswith(f"op{n}_") for q in queries.QUERIES)] == list(range(1, 11))
    assert set(queries.ORACLE_SQL) <= set(queries.QUERIES)
    assert len(list(combinations(queries.QUERIES, 2))) == 45
