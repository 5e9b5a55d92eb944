"""Model backends: taggers, parsers, encoders and translators that run in Python workers.

No model comes with this library.  A backend is a factory that is called once in each worker and returns a
function from a list of sentences (each a list of words, or a text) to a list of results;
sentences are handed over in batches.  What comes before and after a model is done here: routing of languages,
decoding of scores, alignment of words by position, pooling.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

UPOS = tuple("ADJ ADP ADV AUX CCONJ DET INTJ NOUN NUM PART PRON PROPN PUNCT SCONJ SYM VERB X".split())
_DEPRELS = "acl advcl advmod amod appos aux case cc ccomp clf compound conj cop csubj dep det discourse dislocated expl fixed flat goeswith iobj list mark nmod nsubj nummod obj obl orphan parataxis punct reparandum root vocative xcomp"
DEPRELS = tuple(_DEPRELS.split())

#: Trained languages of the shared models: code -> (code of the embedding, script).
_TRAINED = {"tur": ("tr", "Latn"), "aze": ("az", "Latn"), "uzb": ("uz", "Latn"), "tuk": ("tm", "Latn"), "kaz": ("kk", "Cyrl"), "kir": ("ky", "Cyrl"), "bak": ("ba", "Cyrl"), "tat": ("tt", "Cyrl"), "uig": ("ug", "Arab"), "ota": ("ota", "Arab")}
#: Languages that borrow an embedding: for the parser, and for the morphological model.
_PARSER_PROXY = {"kaa": ("uz", "Latn"), "kum": ("tt", "Cyrl"), "sah": ("ba", "Cyrl"), "krc": ("tt", "Cyrl"), "nog": ("tt", "Cyrl")}
_MORPH_PROXY = {k: (v, s) for v, s, own in (("tr", "Latn", "crh gag klj"), ("ba", "Cyrl", "kjh sah tyv chv alt atv"), ("tt", "Cyrl", "kum krc nog"), ("uz", "Latn", "kaa")) for k in own.split()}


def route(lang: str, model: str = "parser") -> tuple[str, str]:
    """(embedding, script) that a shared model uses for a language; ``ValueError`` if it can't."""
    known = _TRAINED | (_PARSER_PROXY if model == "parser" else _MORPH_PROXY)
    if lang not in known:
        raise ValueError(f"the {model} model does not know {lang}")
    return known[lang]


def _worker(factory: Callable[[], Callable], result: T.DataType, batch: int):
    """An Arrow function over arrays of words or texts that keeps one model for each worker process."""

    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = factory()
        for s in parts:
            given = [None if x is None else (x if isinstance(x, str) else list(x)) for x in s]
            real, out = [i for i, x in enumerate(given) if x is not None], [None] * len(given)
            for at in range(0, len(real), batch):
                own = real[at : at + batch]
                for i, r in zip(own, model([given[i] for i in own]), strict=True):
                    out[i] = r
            yield pd.Series(out, dtype=object)

    run.__annotations__ = {"parts": Iterator[pd.Series], "return": Iterator[pd.Series]}
    # So that its result is kept as a column of its own: merged into the lambdas that use it, it couldn't be evaluated.
    return F.pandas_udf(run, result).asNondeterministic()


def predict(x: Column, factory: Callable[[], Callable], result: T.DataType, batch: int = 32) -> Column:
    return _worker(factory, result, batch)(x)


def argmax(scores: Column, names: tuple[str, ...] | None = None) -> Column:
    """Place (from 0) of the largest score, the first of equal ones, or its name."""
    at = F.array_position(scores, F.array_max(scores)).cast("int") - 1
    return at if names is None else F.get(F.array(*map(F.lit, names)), at)


def decode_heads(arcs: Column) -> Column:
    """Head of each word from its scores over the root and all words (array<array<double>>): no tree is enforced."""
    return F.transform(arcs, lambda scores: argmax(scores))


def decode_feats(p: Column, names: Column, threshold: float = 0.5) -> Column:
    """Features whose probability exceeds the threshold, sorted and joined; "_" without any."""
    kept = F.array_sort(F.transform(F.filter(F.arrays_zip(p.alias("p"), names.alias("n")), lambda z: z["p"] > threshold), lambda z: z["n"]))
    return F.when(F.size(kept) > 0, F.array_join(kept, "|")).otherwise(F.lit("_"))


def annotate_sentences(docs: DataFrame, factory: Callable[[], Callable], fields: tuple[str, ...], sentences: str = "sentences", batch: int = 32) -> DataFrame:
    """Set fields of the words from a model that gives a list of dicts for each sentence.

    Results are matched to words by position; words beyond the results keep what they have.
    """
    kinds = {"head": T.IntegerType()}
    result = T.ArrayType(T.ArrayType(T.StructType([T.StructField(f, kinds.get(f, T.StringType())) for f in fields])))

    def all_sentences():
        model = factory()

        def run(documents: list[list[list[str]]]) -> list:
            flat = [list(s) for d in documents for s in d]
            found, out, at = [r for i in range(0, len(flat), batch) for r in model(flat[i : i + batch])], [], 0
            for d in documents:
                out.append(found[at : at + len(d)])
                at += len(d)
            return out

        return run

    texts = F.transform(sentences, lambda s: F.transform(s["words"], lambda w: w["text"]))
    with_results = docs.withColumn("__r", predict(texts, all_sentences, result))

    def merge(word: Column, given: Column) -> Column:
        for f in fields:
            word = word.withField(f, F.when(given.isNotNull(), given[f]).otherwise(word[f]))
        return word

    merged = F.transform(sentences, lambda s, i: s.withField("words", F.transform(s["words"], lambda w, j: merge(w, F.get(F.get(F.col("__r"), i), j)))))
    return with_results.withColumn(sentences, merged).drop("__r")


def embed(docs: DataFrame, factory: Callable[[], Callable], text: str = "text", sentences: str = "sentences", normalize: bool = True) -> DataFrame:
    """Add doc_embedding, of the whole text, and sentence_embeddings; a document without sentences has one of its whole text."""
    vector = T.ArrayType(T.DoubleType())
    texts = F.transform(sentences, lambda s: s["text"])
    texts = F.when(F.size(texts) > 0, texts).otherwise(F.array(F.col(text)))

    def one():
        model = factory()
        return lambda given: [_unit(v) if normalize else list(v) for v in model(list(given))]

    def many():
        model = one()
        return lambda documents: [model(list(d)) for d in documents]

    return docs.withColumn("doc_embedding", predict(F.col(text), one, vector)).withColumn("sentence_embeddings", predict(texts, many, T.ArrayType(vector)))


def _unit(v) -> list[float]:
    """As vectors.l2_normalize, in the worker: Spark doesn't evaluate the result of a worker within a lambda."""
    norm = max(sum(float(x) ** 2 for x in v) ** 0.5, 1e-12)
    return [float(x) / norm for x in v]


def translate(docs: DataFrame, factory: Callable[[], Callable], sentences: str = "sentences") -> DataFrame:
    """Add sentence_translations and translation, the sentences' joined by line ends."""

    def many():
        model = factory()
        return lambda documents: [model(list(d)) for d in documents]

    found = predict(F.transform(sentences, lambda s: s["text"]), many, T.ArrayType(T.StringType()))
    return docs.withColumn("sentence_translations", found).withColumn("translation", F.array_join("sentence_translations", "\n"))


def resolve_translation_code(value: Column, codes: DataFrame, docs: DataFrame, strict: bool = False) -> DataFrame:
    """Add translation_code: a code with an underscore if it is known, else the default of an ISO 639-3 code; null (or an error) otherwise."""
    full = codes.select(F.col("code").alias("__k"), F.col("code").alias("__full")).distinct()
    short = codes.where("is_default = 1").groupBy(F.col("iso3").alias("__k2")).agg(F.min("code").alias("__short"))
    out = docs.withColumn("__v", value).join(full, F.col("__v") == F.col("__k"), "left").join(short, F.col("__v") == F.col("__k2"), "left")
    code = F.when(F.col("__v").contains("_"), F.col("__full")).otherwise(F.col("__short"))
    if strict:
        code = F.coalesce(code, F.raise_error(F.concat(F.lit("no translation code for "), F.coalesce("__v", F.lit("null")))))
    return out.withColumn("translation_code", code).drop("__v", "__k", "__full", "__k2", "__short")


def align_subwords(vectors: Column, word_ids: Column) -> Column:
    """The vector of each word's first sub-word: ``word_ids`` has the place (from 0) of each sub-word's word, null for special ones.

    A word without a sub-word of its own, as where the encoder cut the sentence, has a null vector.
    """
    n = F.coalesce(F.array_max(word_ids), F.lit(-1)) + 1
    first = lambda i: F.array_position(word_ids, i).cast("int")
    return F.when(n > 0, F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.when(first(i) > 0, F.try_element_at(vectors, first(i))))).otherwise(F.slice(vectors, 1, 0))


def spread_tags(tags: Column, tokens: Column) -> Column:
    """Tags of a sentence's words from those of its tokens (array<struct<id_start,id_end>>): a multi-word token's words share its tag.

    Of a B tag the words after the first have the I tag; tokens beyond the tags are O, and so are those with a null tag.
    """
    def own(t: Column, k: Column) -> Column:
        tag = F.coalesce(F.get(tags, k), F.lit("O"))
        n = F.coalesce(t["id_end"], t["id_start"]) - t["id_start"] + 1
        inside = F.when(tag.startswith("B-"), F.concat(F.lit("I-"), F.substring(tag, 3, 1 << 20))).otherwise(tag)
        return F.concat(F.array(tag), F.array_repeat(inside, n - 1))

    return F.flatten(F.transform(tokens, own))
