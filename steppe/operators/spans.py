"""Entity spans from tags."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import let
from . import batches as B
from .segment import running


def bioes_to_bio(tag: Column) -> Column:
    """S becomes B, E becomes I; anything without a prefix and a label is O."""
    prefix, label = F.regexp_extract(tag, "^([BIES])-", 1), F.regexp_extract(tag, "(?s)^[BIES]-(.*)$", 1)
    return F.when(prefix.isin("B", "S"), F.concat(F.lit("B-"), label)).when(prefix.isin("I", "E"), F.concat(F.lit("I-"), label)).otherwise(F.lit("O"))


def spans(words: DataFrame, *sentence: str, tag: str = "tag") -> DataFrame:
    """Rows (sentence, span, type, text, start_char, end_char, word_ids), span counted from 1 in the sentence.

    ``words`` has id, text, start_char, end_char and a BIO tag.  B opens a span, I goes on with
    the open one whatever its type, or is ignored without one; the end is the last one known.
    """
    w = Window.partitionBy(*sentence).orderBy("id")
    begins = F.col(tag).startswith("B-")
    breaks = begins | ~F.coalesce(F.col(tag).startswith("I-"), F.lit(False))
    marked = words.withColumn("__b", F.coalesce(begins, F.lit(False))).withColumn("__run", F.sum(F.when(breaks, 1).otherwise(0)).over(w))
    own = Window.partitionBy(*sentence, "__run").orderBy("id")
    inside = marked.withColumn("__open", F.first("__b").over(own)).where("__open")
    ordered = lambda c: F.transform(F.array_sort(F.collect_list(F.struct("id", F.col(c).alias("v")))), lambda x: x["v"])
    found = inside.groupBy(*sentence, "__run").agg(
        F.min_by(F.substring(tag, 3, 1 << 20), "id").alias("type"),
        F.array_join(ordered("text"), " ").alias("text"),
        F.coalesce(F.min_by("start_char", "id"), F.lit(0)).alias("start_char"),
        F.coalesce(F.max_by("end_char", F.when(F.coalesce(F.col("end_char"), F.lit(0)) != 0, F.col("id"))), F.lit(0)).alias("end_char"),
        F.array_sort(F.collect_list("id")).alias("word_ids"),
    )
    number = F.row_number().over(Window.partitionBy(*sentence).orderBy("__run"))
    return found.select(*sentence, number.alias("span"), "type", "text", "start_char", "end_char", "word_ids")


def sentence_spans(words: Column, tag: str = "tag") -> Column:
    """The spans of :func:`spans` within one sentence, without a shuffle: array<struct<type,text,start_char,end_char,word_ids>>.

    ``words`` is an array of struct<id,text,start_char,end_char,tag> in order.
    """
    # A letter for each word: what follows a B up to the next B begins with the span.
    letter = lambda w: F.when(w[tag].startswith("B-"), "B").when(w[tag].startswith("I-"), "I").otherwise("O")
    codes = F.array_join(F.transform(words, letter), "", "O")
    pieces = F.split(codes, "(?=B)")
    placed = let(pieces, lambda ps: F.arrays_zip(ps.alias("p"), running(F.transform(ps, F.length)).alias("at")))

    def span(z: Column) -> Column:
        own = F.slice(words, z["at"] + 1, F.length(F.regexp_extract(z["p"], "^BI*", 0)))
        ends = lambda ws: F.filter(F.transform(ws, lambda w: w["end_char"]), lambda e: F.coalesce(e, F.lit(0)) != 0)
        made = lambda ws: F.struct(
            F.substring(ws[0][tag], 3, 1 << 20).alias("type"),
            F.array_join(F.transform(ws, lambda w: w["text"]), " ").alias("text"),
            F.coalesce(ws[0]["start_char"], F.lit(0)).alias("start_char"),
            F.coalesce(F.try_element_at(ends(ws), F.lit(-1)), F.lit(0)).alias("end_char"),
            F.transform(ws, lambda w: w["id"]).alias("word_ids"),
        )
        return let(own, made)

    return F.transform(F.filter(placed, lambda z: z["p"].startswith("B")), span)


def span_rows(docs: DataFrame, *keep: str, sentences: str, tag: str = "tag") -> DataFrame:
    """Rows (keep, sent_id, span from 1, type, text, start_char, end_char, word_ids) of documents whose ``sentences`` are arrays of tagged words."""
    numbered = lambda ws, i: F.transform(sentence_spans(ws, tag), lambda x, k: F.struct(i.alias("sent_id"), (k + 1).alias("span"), *[x[n].alias(n) for n in ("type", "text", "start_char", "end_char", "word_ids")]))
    return docs.select(*keep, F.inline(F.flatten(F.transform(sentences, numbered))))


def tagged_spans(docs: DataFrame, tags: Callable[[B.Words], pa.Array], *keep: str, text: str = "text") -> DataFrame:
    """The rows of :func:`span_rows` for texts whose words ``tags`` gives tags (BIO or BIOES), a batch at a time, but with word_ids joined by spaces."""

    def rows(texts: pa.Array) -> tuple[np.ndarray, list[pa.Array]]:
        w = B.words(texts)
        forms = pc.fill_null(tags(w), "O").dictionary_encode()
        known = forms.dictionary.to_pylist()
        code = np.array([(1 if x[0] in "BS" else 2) if x[:1] in set("BISE") and x[1:2] == "-" else 0 for x in known], np.int64)
        indices = np.asarray(forms.indices)
        begin, end, number = B.bio(code[indices] if len(indices) else indices, w)
        n = end - begin
        first = np.concatenate(([0], np.cumsum(n)))
        inside = np.repeat(begin, n) + B.ranks(first[:-1], int(first[-1]))
        label = pa.array([x[2:] for x in known], pa.string()).take(pa.array(indices[begin]))
        last = w.start[end - 1] + w.length[end - 1]
        sent = w.sent[begin]
        ids = B.int32(w.id[inside]).cast(pa.string())
        return w.doc[sent], [B.int32(w.number[sent]), B.int32(number), label, B.joined(w.text.take(pa.array(inside)), first, " "), B.int32(w.start[begin]), B.int32(last), B.joined(ids, first, " ")]

    return B.mapped(docs, keep, text, "sent_id int, span int, type string, text string, start_char int, end_char int, word_ids string", rows)


def entities(docs: DataFrame, *keep: str, sentences: str = "sentences") -> DataFrame:
    """The entities of annotated documents: the spans of the BIO tags in ``ner`` of their words."""
    tagged = F.transform(sentences, lambda s: F.transform(s["words"], lambda w: F.struct(w["id"].alias("id"), w["text"].alias("text"), w["start_char"].alias("start_char"), w["end_char"].alias("end_char"), w["ner"].alias("tag"))))
    return span_rows(docs.select(*keep, tagged.alias("tagged_words")), *keep, sentences="tagged_words")
