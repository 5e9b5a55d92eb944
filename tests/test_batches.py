"""Steps over whole batches give what the nested expressions give, with no shuffle of words and no nested columns."""

import pytest
from pyspark.sql import functions as F

from steppe import queries as Q
from steppe.operators import conllu as C
from steppe.operators import morphology as M
from steppe.operators import segment as S
from steppe.operators import spans as P

SF = "/root/testdata/sf0.001"
TEXTS = [
    "Der the. Que?! (the) ... end", "   lead in\r\nthe. \n\nNext  one!\x1cthe", "", None, "   ", "\U00010400\U00010428 ş.ç é, “x” \"q\\\" ...", "a", ".", "... !!", "x.\ty.z? \x85q r e.g. A.)",
    "the the the", "Ünder Abcdefghij klmnopqrstu Bcd. longlonglong Word", "'Tis \x01\x1b c. «Wort» Don't", "No end\r", "a​b ﻿c. 　d",
]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string").repartition(2).cache()


def same(a, b):
    order = lambda df: sorted(map(repr, (tuple(r) for r in df.collect())))
    assert order(a) == order(b)


def plan(spark, name):
    return Q.QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", ["conllu_parse", "unknown_fallback", "mwt_mine", "conllu_lines", "doc_json", "mwt_expand", "bio_spans", "dependency_triples", "word_offsets"])
def test_words_are_made_by_the_batch(spark, name):
    """Not an expression within lambdas for each word, whose running totals copy what they have so far."""
    text = plan(spark, name)
    assert "MapInArrow" in text and "array_append" not in text and "regexp_extract_all" not in text


def test_word_offsets_as_tokenized(spark, docs):
    same(S.word_offsets(docs, "doc_id"), S.words(S.tokenize(docs), "doc_id").select("doc_id", "sent_id", "id", "text", F.coalesce(F.col("upos") == "PUNCT", F.lit(False)), "start_char"))


def test_documents_as_written_by_expressions(spark, docs):
    nested = S.tokenize(docs)
    same(C.conllu_documents(docs, "doc_id", lang="en", script="Latn"), nested.select("doc_id", C.to_conllu(F.col("sentences"), F.lit("en"), F.lit("Latn"))))
    read = C.parse_conllu(C.conllu_documents(docs, "doc_id"))
    same(C.parse_conllu(docs, "text", source=C.conllu_source()), read)
    same(C.conllu_lines(docs, "text", source=C.conllu_source()), C.conllu_lines(C.conllu_documents(docs, "doc_id")))


def test_json_as_written_by_expressions(spark, docs):
    nested = S.tokenize(docs).select("doc_id", C.to_json(F.col("sentences")).alias("json"))
    same(C.json_documents(docs, "doc_id"), nested)
    kind = "array<array<struct<id:int,text:string,upos:string>>>"
    read = nested.select("doc_id", F.from_json("json", kind).alias("s")).withColumn("w", F.flatten("s"))
    size = lambda c: F.when(F.col("s").isNotNull(), F.size(c).cast("long"))
    same(C.json_counts(nested, "doc_id"), read.select("doc_id", size("s"), size("w"), size(F.filter("w", lambda w: w["upos"] == "PUNCT"))))


def test_multiword_tokens_as_expanded_by_expressions(spark, docs):
    rules = spark.createDataFrame(Q._RULES, "surface string, pieces array<string>")
    nested = S.expand_multiword(S.tokenize(docs), rules)
    same(C.conllu_documents(docs, "doc_id", rules=S.rules_of(rules)), nested.select("doc_id", C.to_conllu(F.col("sentences"))))
    same(S.expanded_words(docs, rules, "doc_id").select("doc_id", "sent_id", "id", "text", "start_char"), S.words(nested, "doc_id").select("doc_id", "sent_id", "id", "text", "start_char"))
    words = C.parse_conllu(nested.select("doc_id", C.to_conllu(F.col("sentences")).alias("content")))
    same(S.tokens(words, "doc_id").where("is_mwt").select("doc_id", "sent_id", "id_start", "id_end", "text"), S.tokens(nested, "doc_id").where("is_mwt").select("doc_id", "sent_id", "id_start", "id_end", "text"))


def test_conllu_texts_without_words_are_carried_on(spark):
    line = "1\tx" + "\t_" * 8
    content = f"\n# text = a = b\n\n\n{line}\n\n{line}\n\n# text = c\n# text =  d \n{line}\nshort\tline\n\n\n# text = lost"
    df = spark.createDataFrame([(1, content), (2, line), (3, None)], "doc_id long, content string")
    got = sorted((r.doc_id, r.sent_id, r.line, r.known_text) for r in C.conllu_lines(df).collect())
    assert got == [(1, 0, 0, "a = b"), (1, 1, 1 << 32, None), (1, 2, (2 << 32) + 2, "d"), (2, 0, 0, None)]
    assert [(r.doc_id, r.text, len(r.sentences)) for r in C.parse_conllu(df).orderBy("doc_id").collect()] == [(1, "a = b\n\nx\n\nd", 3), (2, "x", 1), (3, "", 0)]


def test_spans_as_found_by_expressions(spark, docs):
    import pyarrow as pa

    # S and E on odd and even lengths: spans of all kinds, within their sentence.
    tags = lambda w: pa.array([("S-A", "E-B", "O", "I-C", None)[n % 5] for n in w.length.tolist()], pa.string())
    n = lambda w: F.length(w["text"]) % 5
    tag = lambda w: F.when(n(w) == 0, "S-A").when(n(w) == 1, "E-B").when(n(w) == 2, "O").when(n(w) == 3, "I-C")
    word = lambda w: F.struct(*[w[f].alias(f) for f in ("id", "text", "start_char", "end_char")], P.bioes_to_bio(tag(w)).alias("tag"))
    nested = S.tokenize(docs).select("doc_id", F.transform("sentences", lambda s: F.transform(s["words"], word)).alias("s"))
    want = P.span_rows(nested, "doc_id", sentences="s").withColumn("word_ids", F.array_join(F.col("word_ids").cast("array<string>"), " "))
    assert want.count() > 2
    same(P.tagged_spans(docs, tags, "doc_id"), want)


def test_dependencies_of_a_batch(spark, docs):
    import numpy as np
    import pyarrow as pa

    from steppe.operators import batches as B

    def rows(texts):
        w = B.words(texts)
        head = (w.id * 7) % 5 - 1
        return B.dependencies(w, head, pa.array(np.where(w.id % 3 == 0, None, "d"), pa.string()))

    made = B.mapped(docs, ("doc_id",), "text", "sent_id int, id int, text string, deprel string, head int, head_text string", rows)
    word = lambda w: w.withField("head", (w["id"] * 7) % 5 - 1).withField("deprel", F.when(w["id"] % 3 != 0, "d"))
    nested = S.tokenize(docs).withColumn("sentences", F.transform("sentences", lambda s: s.withField("words", F.transform(s["words"], word))))
    same(made, C.dependency_rows(nested, "doc_id"))


def test_forms_are_counted_without_a_window(spark, docs):
    from steppe.functions import text as T

    w = M.sentence_context(S.words(S.tokenize(docs), "doc_id"), "doc_id", "sent_id")
    form = F.when(F.col("text").rlike("^[A-Z][A-Za-z]*$"), "A").when(F.col("text").rlike("^[a-z][A-Za-z]*$"), "a").otherwise(F.col("text"))
    same(M.counted_forms(docs), w.groupBy(form, F.coalesce("initial", F.lit(False))).agg(F.count("*")))
    none = F.array().cast("array<struct<upos:string,feats:string>>")
    upos = lambda *form: F.coalesce(M.fallback(F.col("text"), F.col("initial"), none, *form)["upos"], F.lit("X"))
    each = w.groupBy(upos()).agg(F.count("*"))
    same(M.counted_forms(docs).withColumn("form", T.lookup_form(F.col("text"))).groupBy(upos(F.col("form"))).agg(F.sum("n")), each)
    assert "Window" not in plan(spark, "unknown_fallback")


def test_nearest_is_no_product_of_partitions(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        text = plan(spark, "cosine_topk")
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" in text
