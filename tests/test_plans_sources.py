import hashlib
import json

import pytest
from pyspark.sql import functions as F

from steppe import sources, streaming
from steppe.operators import segment as S
from steppe.plans import Pipeline, Stage, choose_backend, default_registry, options_for, resolve

CATALOG = {
    "tur": {"name": "Turkish", "scripts": {"available": ["Latn"], "primary": "Latn"}, "processors": {"Latn": {"tokenize": {"default": "rule", "backends": {"rule": {"type": "rule", "license": "Apache-2.0"}}}, "pos": {"default": None, "backends": {"b": {}, "a": {}}}}}},
    "kaz": {"name": "Kazakh", "scripts": {"available": ["Cyrl", "Latn"], "primary": "Cyrl"}, "processors": {"Cyrl": {"pos": {"default": "x", "backends": {"x": {}}}}, "Latn": {"pos": {"default": "w", "backends": {"w": {}}}, "ner": {"backends": {"n": {}}}}}},
}


def test_catalog(spark, tmp_path):
    path = tmp_path / "catalog.json"
    path.write_text(json.dumps(CATALOG))
    c = sources.read_catalog(spark, str(path)).cache()
    assert [(r.lang, r.name, r.processors) for r in sources.list_languages(c).collect()] == [("kaz", "Kazakh", ["ner", "pos"]), ("tur", "Turkish", ["pos", "tokenize"])]
    assert [(r.processor, r.backends) for r in sources.list_processors(c, "kaz").collect()] == [("ner", ["n"]), ("pos", ["w", "x"])]
    assert {r.processor for r in sources.available_for(c, "kaz", "Latn").collect()} == {"pos", "ner"}
    assert {r.backend for r in sources.available_for(c, "kaz", "Arab").collect()} == {"x"}


def test_text_and_conllu_files(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.txt").write_text("Bir iki.\nÜç.", encoding="utf-8")
    docs = sources.read_texts(spark, str(tmp_path / "in"))
    assert docs.count() == 1 and docs.first().text == "Bir iki.\nÜç."
    done = S.tokenize(docs).withColumn("lang", F.lit("tur")).withColumn("script", F.lit("Latn"))
    sources.write_documents(done, str(tmp_path / "out"))
    back = sources.read_conllu(spark, str(tmp_path / "out" / "part*")).first()
    assert (back.lang, back.script, [len(s.words) for s in back.sentences]) == ("tur", "Latn", [3, 2])
    sources.write_documents(done, str(tmp_path / "json"), "json")
    assert [len(s) for s in json.loads(spark.read.text(str(tmp_path / "json"), wholetext=True).first().value)] == [3, 2]
    with pytest.raises(ValueError, match="unknown format"):
        sources.write_documents(done, str(tmp_path / "x"), "xml")


def test_checksums(spark):
    df = spark.createDataFrame([("a", bytearray(b"x"), hashlib.sha256(b"x").hexdigest()), ("b", bytearray(b"y"), None)], "path string, content binary, sha string")
    assert sources.verified(df, F.col("sha")).count() == 2
    with pytest.raises(Exception, match="checksum"):
        sources.verified(df.withColumn("sha", F.lit("0")), F.col("sha")).collect()


def test_stages_resolve_in_order():
    reg = default_registry()
    reg.stages["depparse"] = {}  # the first backend counts
    reg.register("depparse", "x", Stage(lambda *a: None, requires=("tokenize", "pos")))
    assert resolve(["depparse"], reg) == ["tokenize", "pos", "depparse"]
    assert resolve(["zz", "mwt", "tokenize", "zz"], reg) == ["tokenize", "mwt", "zz"]
    assert options_for("morph", {"morph_backend": "x", "morph_a": 1, "morph_neural_b": 2, "pos_c": 3}) == {"a": 1, "neural_b": 2}
    assert choose_backend("tokenize", "Arab", {}, None, reg) == "rule_arabic"
    assert choose_backend("pos", "Latn", {"pos_backend": "q"}, None, reg) == "q"
    assert choose_backend("pos", "Latn", {}, CATALOG["tur"]["processors"]["Latn"], reg) == "b"
    with pytest.raises(ValueError, match="no backend"):
        choose_backend("sentiment", "Latn", {}, None, reg)
    with pytest.raises(ValueError, match="no backend"):
        reg.get("tokenize", "nope")


def test_pipeline(spark):
    docs = spark.createDataFrame([(1, "Korkutata geldi."), (2, "12"), (3, None)], "doc_id long, text string")
    p = Pipeline("tur", ["mwt", "tokenize"])
    out = {r.doc_id: r for r in p(docs).collect()}
    assert out[1].script == out[2].script == "Latn" and out[1].log == ["tokenize:regex", "mwt:rules"]
    assert [w.text for w in out[1].sentences[0].words] == "Korkut ata geldi .".split()
    assert out[3].sentences is None
    assert p.process(docs).where("doc_id = 1").first().output.startswith("# lang = tur\n# script = Latn\n\n# text = Korkutata geldi.\n1-2\tKorkutata")
    assert json.loads(p.process(docs, "json").where("doc_id = 1").first().output)[0][0]["text"] == "Korkut"
    assert p.license_info() == {"tokenize": None, "mwt": None}
    for bad in (lambda: Pipeline("xxx", []), lambda: Pipeline("tur", [], script="Arab"), lambda: p.process(docs, "xml"), lambda: Pipeline("tur", [], transliterate_to="Cyrl")):
        with pytest.raises(ValueError):
            bad()


def test_bridge_and_back(spark):
    reg = default_registry()
    lemma = lambda df: df.withColumn("sentences", F.transform("sentences", lambda s: s.withField("words", F.transform(s["words"], lambda w: w.withField("lemma", F.lower(w["text"]))))))
    reg.register("lemma", "low", Stage(lambda *a: lemma, requires=("tokenize",), license="MIT"))
    docs = spark.createDataFrame([(1, "Қала ұлы.")], "doc_id long, text string")
    p = Pipeline("kaz", ["lemma"], script="Cyrl", transliterate_to="Latn", transliterate_back=True, registry=reg, lemma_backend="low")
    r = p(docs).first()
    assert r.text == "Қала ұлы." and [w.text for w in r.sentences[0].words][0] == "Qala" and r.sentences[0].words[0].lemma == "қала"
    assert p.license_info()["lemma"] == "MIT"


def test_stream_equals_batch(spark, tmp_path):
    rows = [(i, f"Doc {i}. Two words? Дa") for i in range(20)]
    spark.createDataFrame(rows, "doc_id long, text string").repartition(4).write.parquet(str(tmp_path / "in"))
    batch = spark.read.parquet(str(tmp_path / "in"))
    streaming.run_available(streaming.read_stream(spark, str(tmp_path / "in"), batch.schema, 1), S.tokenize, str(tmp_path / "out"), str(tmp_path / "state"))
    got, want = spark.read.parquet(str(tmp_path / "out")), S.tokenize(batch)
    assert sorted(map(str, got.collect())) == sorted(map(str, want.select(got.columns).collect()))


def test_windowed_scripts_drop_late_documents(spark, tmp_path):
    for k, rows in enumerate([[("2024-01-01 00:01:00", "abc"), ("2024-01-01 00:02:00", "абв")], [("2024-01-01 05:00:00", "abc")], [("2024-01-01 05:01:00", "abc")], [("2024-01-01 00:03:00", "late"), ("2024-01-01 09:00:00", "абв")]]):
        spark.createDataFrame(rows, "t string, text string").selectExpr("cast(t as timestamp) ts", "text").coalesce(1).write.mode("append").parquet(str(tmp_path / "in" / f"b={k}"))
    schema = "ts timestamp, text string, b int"
    from pyspark.sql.types import _parse_datatype_string

    stream = streaming.read_stream(spark, str(tmp_path / "in"), _parse_datatype_string(schema), 1)
    streaming.run_available(stream, streaming.scripts_by_window, str(tmp_path / "out"), str(tmp_path / "state"))
    got = {(str(r.start), r.script): r.documents for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got[("2024-01-01 00:00:00", "Latn")] == 1 and got[("2024-01-01 00:00:00", "Cyrl")] == 1


def _tagger():
    return lambda sentences: [[{"head": str(i), "deprel": "dep", "upos": "X"} for i, _ in enumerate(s)] for s in sentences]


def test_all_processors_are_registered(spark):
    from steppe import plans as P

    known = P.default_registry().stages
    assert set(known) == {"tokenize", "mwt", "morph", "morph_neural", "pos", "feats", "lemma", "morphemes", "depparse", "ner", "embeddings", "translate"}
    for name in set(known) - {"tokenize", "mwt"}:
        with pytest.raises(ValueError, match=f"{name} needs the option {name}_"):
            P.Pipeline("tur", [name])
    assert P.Pipeline("tur").names == ["tokenize", "mwt"]


def test_a_pipeline_with_models_and_tables(spark):
    from steppe import plans as P

    docs = spark.createDataFrame([(1, "Ali geldi. Ev var!"), (2, ""), (3, None)], "doc_id long, text string")
    analyses = spark.createDataFrame([("geldi", "gel<v><past><p3>", 0.0), ("ev", "ev<n><nom>", 0.0)], "surface string, raw string, weight double")
    suffixes = spark.createDataFrame([("past", 0, "VSND", {"B": "dı", "F": "di"})], "key string, ord int, context string, forms map<string,string>")
    pipe = P.Pipeline("tur", ["morph", "depparse", "embeddings", "translate", "morphemes"], morph_analyses=analyses, depparse_factory=_tagger, morphemes_suffixes=suffixes,
                      embeddings_factory=lambda: lambda texts: [[3.0, 4.0] for _ in texts], translate_factory=lambda: lambda texts: [t.upper() for t in texts])
    assert pipe.names == ["tokenize", "morph", "morphemes", "depparse", "embeddings", "translate"]
    got = {r.doc_id: r for r in pipe(docs).collect()}
    words = [w for s in got[1].sentences for w in s.words]
    assert [(w.text, w.lemma, w.upos) for w in words if w.text in ("geldi", "Ev")] == [("geldi", "gel", "VERB"), ("Ev", "ev", "NOUN")]
    assert [w.head for w in words] == [0, 1, 2, 0, 1, 2] and got[1].translation == "ALI GELDI.\nEV VAR!"
    assert got[1].doc_embedding == pytest.approx([0.6, 0.8]) and got[1].morphemes[0][1][0].surface == "gel"
    assert got[2].sentences == [] and got[3].sentences is None and len(got[1].log) == 6
    with pytest.raises(Exception, match="lacks sentences"):
        P.Pipeline("tur", ["depparse"], strict=True, depparse_factory=_tagger)(docs.where("doc_id = 2")).collect()


def test_sql_functions(spark):
    from steppe import plans as P

    assert len(P.register_sql(spark)) == 8
    assert tuple(spark.sql("SELECT steppe_turkic_lower('DIŞ İYİ'), steppe_strip_marks('kış'), steppe_is_numeric('1,5'), steppe_is_punctuation('a')").first()) == ("dış iyi", "kıs", True, False)


def test_subwords_and_tags_of_words(spark):
    from steppe.operators import neural as N
    from steppe.operators import spans as E

    row = spark.createDataFrame([([[0.0], [1.0], [2.0], [3.0], [9.0]], [None, 0, 0, 2, None])], "v array<array<double>>, w array<int>")
    assert row.select(N.align_subwords(F.col("v"), F.col("w")).alias("x")).first().x == [[1.0], None, [3.0]]
    row = spark.createDataFrame([(["B-PER", "O"], [(1, 2), (3, None), (4, None)])], "tags array<string>, tokens array<struct<id_start:int,id_end:int>>")
    assert row.select(N.spread_tags(F.col("tags"), F.col("tokens")).alias("x")).first().x == ["B-PER", "I-PER", "O", "O"]
    words = [(1, "Ali", None, None, "B-PER"), (2, "Bey", 4, 7, "I-PER"), (3, "x", 8, 9, "I-LOC"), (4, "y", 9, 10, "O"), (5, "z", 1, 2, "I-LOC"), (6, "Ev", 3, 5, "B-LOC")]
    nested = spark.createDataFrame([(1, [words])], "doc_id long, s array<array<struct<id:int,text:string,start_char:int,end_char:int,tag:string>>>")
    plain = spark.createDataFrame([(1, 0, *w) for w in words], "doc_id long, sent_id int, id int, text string, start_char int, end_char int, tag string")
    rows = E.span_rows(nested, "doc_id", sentences="s")
    assert sorted(map(tuple, rows.collect())) == sorted(map(tuple, E.spans(plain, "doc_id", "sent_id").collect()))


def test_nothing_is_shuffled(spark, tmp_path):
    from steppe.operators import conllu as C
    from steppe.operators import segment as S

    spark.createDataFrame([(1, "A b. C d!")], "doc_id long, text string").write.parquet(str(tmp_path / "d"))
    docs = spark.read.parquet(str(tmp_path / "d"))
    tokenized = S.tokenize(docs)
    written = tokenized.select("doc_id", C.to_conllu(F.col("sentences")).alias("content"))
    for df in (S.word_offsets(docs, "doc_id"), C.conllu_lines(written), C.parse_conllu(written), C.dependency_rows(tokenized, "doc_id")):
        assert "Exchange" not in df._jdf.queryExecution().executedPlan().toString()


def test_a_cluster_must_name_its_shared_folder():
    from types import SimpleNamespace

    from steppe import streaming

    def session(master, where=None):
        nothing = SimpleNamespace(get=lambda *a: None)
        return SimpleNamespace(conf=SimpleNamespace(get=lambda *a: where), sparkContext=SimpleNamespace(getConf=lambda: nothing, getCheckpointDir=lambda: None, master=master))

    assert streaming.shared_folder(session("local[4]")) and streaming.shared_folder(session("yarn", "hdfs:///x")) == "hdfs:///x"
    for master in ("yarn", "local-cluster[2,1,1024]", "spark://host:7077"):
        with pytest.raises(ValueError):
            streaming.shared_folder(session(master))
