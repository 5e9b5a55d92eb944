import re

import pytest
from pyspark.sql import functions as F

from steppe.operators import conllu as C
from steppe.operators import morphemes as H
from steppe.operators import morphology as M
from steppe.operators import neural as N
from steppe.operators import segment as S
from steppe.operators import spans as P
from steppe.operators import vectors as V
from steppe.resources import table

TEXTS = [
    "  A.  B c. Men bardım, ok? Boladi! ... (Hi) Korkutata geldi.", "", None, "   ", "one\nline. two\nlines", "No stop", 'Quote: "x".) end!!! "', "a.b c.d. e", "Soru mu ? Evet .",
    " nbsp x. y z", "!?", "x" * 5000 + ". " + "y " * 3000,
]


def reference_tokens(text):
    """Sentences and words by regular expressions and a running offset."""
    out, offset = [], 0
    for s in filter(None, (p.strip() for p in re.split(r"(?<=[!.?])\s+", text))):
        own = []
        for m in re.finditer(r"\S+", s):
            d = re.match(r"""^(.*?)([!,.:;?"')\]}]+)$""", m[0])
            stem, marks = (d[1], d[2]) if d and d[1] else (m[0], "")
            at = offset + m.start()
            own.append((stem, None, at, at + len(stem)))
            own += [(c, "PUNCT", at + len(stem) + i, at + len(stem) + i + 1) for i, c in enumerate(marks)]
        out.append(own)
        offset += len(s) + 1
    return out


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string").withColumn("sentences_", F.lit("clash"))


def test_tokens_and_offsets(spark, docs):
    done = S.tokenize(docs)
    got = {}
    for r in S.words(done, "doc_id").collect():
        got.setdefault(r.doc_id, {}).setdefault(r.sent_id, []).append((r.id, (r.text, r.upos, r.start_char, r.end_char)))
    for i, t in enumerate(TEXTS):
        want = reference_tokens(t) if t is not None else []
        mine = [[w for _, w in sorted(got.get(i, {})[k])] for k in sorted(got.get(i, {}))]
        assert mine == want, i
    assert [r.n for r in done.orderBy("doc_id").select(F.size("sentences").alias("n")).collect()][2] in (-1, None)
    texts = {r.doc_id: r.n for r in docs.select("doc_id", F.transform(S.split_sentences(F.col("text")), lambda s: F.size(S.token_texts(s))).alias("n")).collect()}
    assert all(texts[i] == [len(s) for s in reference_tokens(t)] for i, t in enumerate(TEXTS) if t is not None)


def test_true_starts(spark, docs):
    for r in docs.select("text", S.true_sentence_starts(F.col("text")).alias("at"), S.split_sentences(F.col("text")).alias("s")).where("text is not null").collect():
        assert len(r["at"]) == len(r.s) and all(r.text[a:].startswith(s) for a, s in zip(r["at"], r.s, strict=True))


def test_arabic_script(spark):
    df = spark.createDataFrame([(1, "سـلام، دنيا! من: آ‌ب؟ بس۔ نه")], "doc_id long, text string")
    got = [(r.sent_id, r.text, r.upos, r.start_char, r.end_char) for r in S.words(S.tokenize_by_script(df, "Arab"), "doc_id").orderBy("sent_id", "id").collect()]
    want = ["سلام", "،", "دنيا", "!", "من:", "ا", "ب", "؟", "بس۔", "نه"]
    assert [g[1] for g in got] == want and [g[2] for g in got] == ["PUNCT" if w in "،!؟" else None for w in want]
    assert [g[0] for g in got] == [0, 0, 0, 0, 1, 1, 1, 1, 2, 3] and got[0][3:] == (0, 4) and got[5][3:] == (16, 17)


def test_multiword_expansion(spark, docs):
    rules = table(spark, "mwt").where("lang = 'tur'").select("surface", F.split("pieces", " ").alias("pieces"))
    done = S.expand_multiword(S.tokenize(docs.where("doc_id = 0")), rules)
    got = [(r.id, r.text, r.start_char, r.end_char) for r in S.words(done, "doc_id").where("sent_id = 5").orderBy("id").collect()]
    assert got == [(1, "(Hi", 36, 39), (2, ")", 39, 40), (3, "Korkut", 41, 50), (4, "ata", 41, 50), (5, "geldi", 51, 56), (6, ".", 56, 57)]
    assert [(r.id_start, r.id_end, r.text) for r in S.tokens(done, "doc_id").where("is_mwt").collect()] == [(3, 4, "Korkutata")]
    assert S.expand_multiword(docs, rules.limit(0)) is docs


B = "\t_" * 8
CONLLU = f"""# lang = tur
# script = Latn

# text = Evdeki kedi
1-2\tEvdeki{B}
1\tEv\tev\tNOUN\t_\tCase=Loc\t2\tnmod\t_\t_
2\tki\tki\tADP\t_\t_\t3\tcase\t_\tScript=Latn
2.1\tghost{B}
3\tkedi\tkedi\tNOUN\t_\t_\t0\troot\t_\tSpaceAfter=No|Script=Latn


x y
4-x\tbad{B}
1\tTek\t_\t_\t_\t_\tzero\t_\t_\t_
"""


def test_conllu_parse(spark):
    df = spark.createDataFrame([(1, CONLLU), (2, ""), (3, CONLLU.replace("\n", "\r\n"))], "doc_id long, content string")
    got = {r.doc_id: r for r in C.parse_conllu(df).collect()}
    assert got[2].sentences == [] and got[2].text == ""
    assert got[1].sentences == got[3].sentences
    d = got[1]
    assert (d.lang, d.script, d.text) == ("tur", "Latn", "Evdeki kedi\n\nTek")
    first, second = d.sentences
    assert [(t.id_start, t.id_end, t.text) for t in first.tokens] == [(1, 2, "Evdeki"), (3, None, "kedi")]
    assert [(w.id, w.text, w.lemma, w.head, w.script) for w in first.words] == [(1, "Ev", "ev", 2, None), (2, "ki", "ki", 3, "Latn"), (3, "kedi", "kedi", 0, "Latn")]
    assert second.words[0].head is None and second.words[0].lemma is None


def test_conllu_write(spark):
    df = spark.createDataFrame([(1, CONLLU)], "doc_id long, content string")
    out = C.parse_conllu(df).select(C.to_conllu(F.col("sentences"), F.col("lang"), F.col("script")).alias("x")).first().x
    assert out.startswith(f"# lang = tur\n# script = Latn\n\n# text = Evdeki kedi\n1-2\tEvdeki{B}\n1\tEv\tev\tNOUN\t_\tCase=Loc\t2\tnmod\t_\t_\n")
    assert "3\tkedi\tkedi\tNOUN\t_\t_\t0\troot\t_\tSpaceAfter=No|Script=Latn|Script=Latn\n\n# text = Tek" in out and out.endswith("\n\n")
    none = spark.createDataFrame([(1, "")], "doc_id long, content string")
    assert C.parse_conllu(none).select(C.to_conllu(F.col("sentences"), F.lit("x")).alias("x")).first().x == "# lang = x\n\n\n\n"


def test_split_documents(spark):
    given = ["# newdoc id = 1\n1\tA\n# newdoc\n\n", "plain", "\n# newdoc x"]
    got = [r.x for r in spark.createDataFrame([(i, g) for i, g in enumerate(given)], "i int, c string").orderBy("i").select(C.split_documents(F.col("c")).alias("x")).collect()]
    assert got == [[" id = 1\n1\tA\n"], ["plain"], [" x"]]


def test_dependencies(spark):
    words = C.parse_conllu(spark.createDataFrame([(1, CONLLU)], "doc_id long, content string"))
    rows = [(r.text, r.deprel, r.head_text) for r in C.dependencies(S.words(words, "doc_id"), "doc_id").orderBy("id").collect()]
    assert rows == [("Ev", "nmod", "ki"), ("ki", "case", "kedi"), ("kedi", "root", None)]
    nested = words.select(C.sentence_dependencies(F.col("sentences")[0]).alias("d")).first().d
    assert [(d.text, d.deprel, d.head_text) for d in nested] == rows


def test_mining_takes_the_most_frequent_split(spark):
    block = lambda a, b: f"1-2\tXY{B}\n1\t{a}{B}\n2\t{b}{B}\n\n"
    df = spark.createDataFrame([(1, block("X", "Y")), (2, block("x", "y") + block("x", "y"))], "doc_id long, content string")
    assert [tuple(r) for r in C.mine_multiword_rules(C.conllu_lines(df), "doc_id").collect()] == [("XY", ["x", "y"], 2)]


def test_spans(spark):
    tags = ["I-A", "B-A", "I-B", "O", "B-C", "B-D", "I-D", None]
    df = spark.createDataFrame([(1, i + 1, f"w{i}", i * 3, None if i == 6 else i * 3 + 2, t) for i, t in enumerate(tags)], "s int, id int, text string, start_char int, end_char int, tag string")
    got = [(r.span, r.type, r.text, r.start_char, r.end_char, r.word_ids) for r in P.spans(df, "s").orderBy("span").collect()]
    assert got == [(1, "A", "w1 w2", 3, 8, [2, 3]), (2, "C", "w4", 12, 14, [5]), (3, "D", "w5 w6", 15, 17, [6, 7])]
    given = ["S-PER", "E-PER", "B-A-B", "O", "X-Y", "PER", None, "I-Q"]
    got = [r.x for r in spark.createDataFrame(list(enumerate(given)), "i int, t string").orderBy("i").select(P.bioes_to_bio(F.col("t")).alias("x")).collect()]
    assert got == ["B-PER", "I-PER", "B-A-B", "O", "O", "O", "O", "I-Q"]


def test_question_particle_and_final_position(spark):
    analyses = spark.createDataFrame([("geldi", "gel<v><past>", 0.0), ("geldi", "geldi<n>", 0.0)], "surface string, raw string, weight double")
    lexicon = table(spark, "lexicon").where("lang = 'tur'")
    docs = spark.createDataFrame([(1, "geldi ev"), (2, "geldi mi"), (3, "ev geldi !"), (4, "geldi ?")], "doc_id long, text string")
    got = {r.doc_id: r.upos for r in M.annotate(S.words(S.tokenize(docs), "doc_id"), analyses, lexicon, "tur", "doc_id", "sent_id").where("text = 'geldi'").collect()}
    assert got == {1: "NOUN", 2: "VERB", 3: "VERB", 4: "VERB"}


def test_bridge_to_the_script_of_the_analyses(spark):
    from steppe.functions.translit import transliterate

    analyses = spark.createDataFrame([("мектеп", "мектеп<n><nom>", 0.0)], "surface string, raw string, weight double")
    words = S.words(S.tokenize(spark.createDataFrame([(1, "mektep")], "doc_id long, text string")), "doc_id")
    to, back = (lambda c: transliterate(c, "kaz", "Latn", "Cyrl")), (lambda c: transliterate(c, "kaz", "Cyrl", "Latn"))
    r = M.annotate(words, analyses, table(spark, "lexicon").where("lang = 'kaz'"), "kaz", "doc_id", "sent_id", to_model=to, from_model=back).first()
    assert (r.lemma, r.upos, r.feats) == ("mektep", "NOUN", "Case=Nom")


def test_unknown_tags_and_generation(spark):
    row = spark.range(1).select(M.unknown_tags(F.array(F.lit("dat"), F.lit("foo")), "tur").alias("a"), M.unknown_tags(F.array(F.lit("dat")), "ota").alias("b")).first()
    assert (row.a, row.b) == (["foo"], ["dat"])
    analyses = spark.createDataFrame([("evde", "ev<n><loc>", 1.0), ("evte", "ev<n><loc>", 0.5)], "surface string, raw string, weight double")
    asked = spark.createDataFrame([(1, "ev", ["n", "loc"]), (2, "ev", ["n"])], "id int, lemma string, tags array<string>")
    assert {r.id: r.surface for r in M.generate(asked, analyses).collect()} == {1: "evte", 2: None}


def test_vectors(spark):
    df = spark.createDataFrame([(1, [3.0, 4.0]), (2, [0.0, 0.0])], "vec_id long, embedding array<double>")
    got = {r.vec_id: r.v for r in df.select("vec_id", V.l2_normalize(F.col("embedding")).alias("v")).collect()}
    assert got == {1: [0.6, 0.8], 2: [0.0, 0.0]}
    pooled = spark.range(1).select(V.mean_pool(F.array(F.array(F.lit(1.0), F.lit(2.0)), F.array(F.lit(3.0), F.lit(6.0)), F.array(F.lit(9.0), F.lit(9.0))), F.array(F.lit(1), F.lit(1), F.lit(0))).alias("v")).first().v
    assert pooled == [2.0, 4.0]
    labels = spark.createDataFrame([("a", [1.0, 0.0]), ("b", [0.0, 1.0]), ("c", [1.0, 1.0])], "label string, weights array<double>")
    before = V.top_languages(df.where("vec_id = 1"), labels, 5, ["b", "a", "zz"], "before", keep=("vec_id",)).collect()
    after = V.top_languages(df.where("vec_id = 1"), labels, 5, ["b", "a"], "after", keep=("vec_id",)).collect()
    assert [r.label for r in before] == [r.label for r in after] == ["b", "a"]
    assert sum(r.p for r in before) == pytest.approx(1) and sum(r.p for r in after) < 0.1
    with pytest.raises(ValueError, match="none of the labels"):
        V.top_languages(df, labels, 1, ["zz"])


def test_model_backends(spark):
    docs = S.tokenize(spark.createDataFrame([(1, "Bir iki. Üç."), (2, None)], "doc_id long, text string"))

    def tagger():
        return lambda sentences: [[{"upos": "NUM" if w[0].isupper() else "X", "head": 0} for w in s[:1]] for s in sentences]

    done = N.annotate_sentences(docs, tagger, ("upos", "head"))
    got = [(r.text, r.upos, r["head"]) for r in S.words(done, "doc_id").orderBy("sent_id", "id").collect()]
    assert got == [("Bir", "NUM", 0), ("iki", None, None), (".", "PUNCT", None), ("Üç", "NUM", 0), (".", "PUNCT", None)]

    def encoder():
        return lambda texts: [[float(len(t)), 0.0] for t in texts]

    r = N.embed(docs.where("doc_id = 1"), encoder, normalize=False).first()
    assert r.doc_embedding == [12.0, 0.0] and r.sentence_embeddings == [[8.0, 0.0], [3.0, 0.0]]
    r = N.translate(docs.where("doc_id = 1"), lambda: lambda texts: [t.upper() for t in texts]).first()
    assert r.translation == "BIR IKI.\nÜÇ."


def test_decoding_and_routing(spark):
    arcs = F.array(F.array(F.lit(0.1), F.lit(0.9)), F.array(F.lit(0.5), F.lit(0.5)))
    r = spark.range(1).select(N.decode_heads(arcs).alias("h"), N.decode_feats(F.array(F.lit(0.9), F.lit(0.2), F.lit(0.6)), F.array(F.lit("C"), F.lit("B"), F.lit("A"))).alias("f"), N.argmax(F.array(F.lit(0.1), F.lit(0.7)), N.UPOS[:2]).alias("u")).first()
    assert (r.h, r.f, r.u) == ([1, 0], "A|C", "ADP")
    assert N.route("sah") == ("ba", "Cyrl") and N.route("gag", "morph") == ("tr", "Latn") and len(N.UPOS) == 17 and len(N.DEPRELS) == 37
    with pytest.raises(ValueError, match="does not know"):
        N.route("gag")


def test_sounds_and_stems():
    cy, la = H.sounds("Cyrl"), H.sounds("Latn")
    assert [H.harmony(w, cy) for w in ("бала", "мектеп", "")] == ["B", "F", "B"]
    assert [H.harmony(w, la, 4) for w in ("ev", "okul", "göz", "kız", "")] == ["FU", "BR", "FR", "BU", "BU"]
    assert [H.char_class(c, cy) for c in "арнбп1"] == list("VSNDTT")
    seg = H.Segmenter({}, "tur", "Latn")
    assert seg.stem_end("kitabı", "kitap") == 5 and seg.stem_end("İstanbul'da", "İstanbul") == 8 and seg.stem_end("geldim", "gelmek", "VERB") == 3 and seg.stem_end("xyz", "abc") == 1
    assert H.strip_infinitive("бару") == "бар" and H.strip_infinitive("у") == "у" and H.lower("IİÇ") == "ıiç"


def test_segmentation_by_tags_and_greedily():
    from steppe.queries import _SUFFIXES

    own = {}
    for key, _, context, forms in _SUFFIXES:
        own.setdefault(key, []).append((context, forms))
    seg = H.Segmenter(own, "kaz", "Cyrl")
    assert seg.segment("балалар", "бала", "NOUN", None, ["n", "pl", "nom"]) == ([("бала", "STEM"), ("лар", "PLUR")], "tags")
    assert seg.segment("балаларда", "бала", "NOUN", "_", ["n"]) == ([("бала", "STEM"), ("лар", "PLUR"), ("да", "LOC")], "tags")
    assert seg.segment("балаxx", "бала", "NOUN", "Case=Dat", None)[0] == [("бала", "STEM"), ("xx", "?")]
    assert seg.segment("барды мен", "бару", "VERB", "Tense=Past|Person=3", None) == ([("бар", "STEM"), ("ды", "PST.3SG"), ("мен", "1SG")], "features")
    assert seg.segment("а", None, None, None, None)[1] == "skip" and seg.segment("ата", None, None, None, None)[1] == "none"
