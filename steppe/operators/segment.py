"""Sentences, tokens and words of documents, as nested columns.

``sentences`` is an array of struct<text, tokens, words>; offsets count characters.  Offsets follow the
convention that one character separates sentences: they are exact unless a text begins with
white space or separates sentences by more; :func:`true_sentence_starts` gives exact ones.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import let
from . import batches as B

#: White space: Unicode's, and the four separators that Java leaves out.
_S = r"[\s\x1C-\x1F]"
_NOT_S = r"[^\s\x1C-\x1F]"
_TRAILING = r"""^(.*?)([")\]}'!,.:;?]+)$"""
_MARKS = tuple(".,:;!?\"')]}")
_ARABIC_PUNCT = "،؛؟!.()«»“”'\"" + r"\[\]"

WORD = (
    "struct<id:int,text:string,lemma:string,upos:string,xpos:string,feats:string,head:int,deprel:string,deps:string,"
    "misc:string,ner:string,start_char:int,end_char:int,script:string>"
)
TOKEN = "struct<id_start:int,id_end:int,text:string,start_char:int,end_char:int>"


def strip(x: Column) -> Column:
    """Without white space at either end (Spark's trim knows only spaces)."""
    return F.regexp_replace(x, f"(?U)^{_S}+|{_S}+$", "")


def split_sentences(text: Column, enders: str = ".!?") -> Column:
    """Sentences: split after an ender followed by white space, trimmed, empty ones dropped."""
    return F.filter(F.transform(F.split(text, f"(?U)(?<=[{enders}]){_S}+"), strip), lambda s: s != "")


def running(lengths: Column) -> Column:
    """Running total of the lengths before each element."""
    zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("starts"))
    return F.aggregate(
        lengths,
        zero,
        lambda acc, n: F.struct((acc["at"] + n).alias("at"), F.array_append(acc["starts"], acc["at"]).alias("starts")),
        lambda acc: acc["starts"],
    )


def _piece(text: Column, punct: bool) -> Column:
    return F.struct(text.alias("text"), F.lit(punct).alias("punct"))


def _pieces(token: Column) -> Column:
    """A token and its trailing punctuation marks, one by one: array<struct<text,punct>>."""

    def split(stem: Column) -> Column:
        marks = F.split(F.substring(token, F.length(stem) + 1, F.length(token)), "(?!$)")
        return F.when(stem != "", F.concat(F.array(_piece(stem, False)), F.transform(marks, lambda c: _piece(c, True)))).otherwise(F.array(_piece(token, False)))

    # Most tokens end in a letter, and need no regular expression.
    return F.when(F.substring(token, -1, 1).isin(*_MARKS), let(F.regexp_extract(token, _TRAILING, 1), split)).otherwise(F.array(_piece(token, False)))


def _arabic_pieces(token: Column) -> Column:
    """Runs of punctuation and of anything else within a token, wherever they are."""
    runs = F.regexp_extract_all(token, F.lit(f"([{_ARABIC_PUNCT}]+|[^{_ARABIC_PUNCT}]+)"), F.lit(1))
    return F.transform(runs, lambda r: F.struct(r.alias("text"), r.rlike(f"^[{_ARABIC_PUNCT}]+$").alias("punct")))


def token_texts(sentence: Column) -> Column:
    """Words of a sentence as array<struct<text,punct>>, without offsets: the cheap form, for counting."""
    return F.flatten(F.transform(F.regexp_extract_all(sentence, F.lit(f"(?U)({_NOT_S}+)"), F.lit(1)), _pieces))


def word_offsets(docs: DataFrame, *keep: str, text: str = "text") -> DataFrame:
    """A row for each word: the kept columns, sent_id from 0, id, text, punct and start_char, as :func:`tokenize` and :func:`words` have them."""

    def rows(texts: pa.Array) -> tuple[np.ndarray, list[pa.Array]]:
        w = B.words(texts)
        return w.at, [B.int32(w.number[w.sent]), B.int32(w.id), w.text, pa.array(w.punct), B.int32(w.start)]

    return B.mapped(docs, keep, text, "sent_id int, id int, text string, punct boolean, start_char int", rows)


def _word(i: Column, text: Column, punct: Column, start: Column) -> Column:
    # Nulls of the right type from the start: casting the struct would copy every word.
    null, number = F.lit(None).cast("string"), F.lit(None).cast("int")
    fields = {
        "id": i + 1, "text": text, "lemma": F.when(punct, text), "upos": F.when(punct, F.lit("PUNCT")), "xpos": null, "feats": null, "head": number,
        "deprel": null, "deps": null, "misc": null, "ner": null, "start_char": start, "end_char": start + F.length(text), "script": null,
    }
    return F.struct(*[v.alias(k) for k, v in fields.items()])


def _sentence(text: Column, offset: Column, space: str, not_space: str, pieces) -> Column:
    """struct<text,tokens,words> of one sentence whose first character is at the offset."""
    # Alternating runs cover the sentence, so that their lengths give every offset.
    runs = F.regexp_extract_all(text, F.lit(f"(?U)({space}+|{not_space}+)"), F.lit(1))
    gap = lambda r: F.array(F.struct(r.alias("text"), F.lit(None).cast("boolean").alias("punct")))
    parts = F.flatten(F.transform(runs, lambda r: F.when(r.rlike(f"(?U)^{space}"), gap(r)).otherwise(pieces(r))))

    def placed(parts: Column) -> Column:
        starts = running(F.transform(parts, lambda p: F.length(p["text"])))
        real = F.filter(F.arrays_zip(parts.alias("p"), starts.alias("at")), lambda z: z["p"]["punct"].isNotNull())
        return F.transform(real, lambda z, i: _word(i, z["p"]["text"], z["p"]["punct"], offset + z["at"]))

    def build(words: Column) -> Column:
        token = lambda w: F.struct(w["id"].alias("id_start"), F.lit(None).cast("int").alias("id_end"), w["text"].alias("text"), w["start_char"].alias("start_char"), w["end_char"].alias("end_char"))
        return F.struct(text.alias("text"), F.transform(words, token).alias("tokens"), words.alias("words"))

    return let(let(parts, placed), build)


def _annotated(sentences: Column, space: str, not_space: str, pieces) -> Column:
    def build(sentences: Column) -> Column:
        offsets = running(F.transform(sentences, lambda s: F.length(s) + 1))
        return F.transform(F.arrays_zip(sentences.alias("s"), offsets.alias("at")), lambda z: _sentence(z["s"], z["at"], space, not_space, pieces))

    return F.when(sentences.isNotNull(), let(sentences, build))


def tokenize(docs: DataFrame, text: str = "text", out: str = "sentences") -> DataFrame:
    """Add the annotated sentences of texts in scripts that separate words by spaces; null texts have null."""
    return docs.withColumn(out, _annotated(split_sentences(F.col(text)), _S, _NOT_S, _pieces))


def normalize_arabic(text: Column) -> Column:
    """Without kashida and with plain alef."""
    return F.regexp_replace(F.translate(text, "ـ", ""), "[أإآٱ]", "ا")


def tokenize_arabic(docs: DataFrame, text: str = "text", out: str = "sentences") -> DataFrame:
    """Add the annotated sentences of texts in Arabic script; offsets are those of the normalised text."""
    space, not_space = r"[\s\x1C-\x1F\x{200C}]", r"[^\s\x1C-\x1F\x{200C}]"
    return docs.withColumn(out, _annotated(split_sentences(normalize_arabic(F.col(text)), ".!?؟۔"), space, not_space, _arabic_pieces))


def tokenize_by_script(docs: DataFrame, script: str, text: str = "text", out: str = "sentences") -> DataFrame:
    """The tokenizer for the script of the model."""
    return (tokenize_arabic if script == "Arab" else tokenize)(docs, text, out)


def true_sentence_starts(text: Column, enders: str = ".!?") -> Column:
    """Exact offsets of the sentences that :func:`split_sentences` finds, as array<int>."""
    runs = F.split(text, f"(?U)(?<=[{enders}])(?={_S})")
    zipped = F.arrays_zip(runs.alias("r"), running(F.transform(runs, F.length)).alias("at"))
    lead = lambda r: F.length(r) - F.length(F.regexp_replace(r, f"(?U)^{_S}+", ""))
    return F.transform(F.filter(zipped, lambda z: strip(z["r"]) != ""), lambda z: z["at"] + lead(z["r"]))


def rules_of(rules: DataFrame) -> dict[str, list[str]]:
    """The words of each surface in a table of rules (surface, pieces array<string>); of two rows of a surface, the last in order of pieces wins."""
    return {r["surface"]: r["pieces"] for r in rules.select("surface", "pieces").orderBy("surface", "pieces").collect()}


def expanded_words(docs: DataFrame, rules: DataFrame, *keep: str, text: str = "text") -> DataFrame:
    """The words of :func:`expand_multiword`, a row for each: the kept columns, sent_id from 0, id, text, punct and start_char."""
    known = rules_of(rules)

    def rows(texts: pa.Array) -> tuple[np.ndarray, list[pa.Array]]:
        w, _ = B.expanded(B.words(texts), known)
        return w.at, [B.int32(w.number[w.sent]), B.int32(w.id), w.text, pa.array(w.punct), B.int32(w.start)]

    return B.mapped(docs, keep, text, "sent_id int, id int, text string, punct boolean, start_char int", rows)


def expand_multiword(docs: DataFrame, rules: DataFrame, sentences: str = "sentences") -> DataFrame:
    """Replace tokens that have a rule by its words, renumbering the sentence.

    ``rules`` has (surface, pieces array<string>) with one row for a surface; where there are two, the last in
    order of pieces wins.  The words of an expanded token share its offsets and have no other
    annotation; matching is exact and heeds case.  The rules of a language are few, and are
    looked up in a map that every row carries as a constant.
    """
    known = rules_of(rules)
    if not known:
        return docs
    lookup = F.create_map(*[x for k in sorted(known) for x in (F.lit(k), F.array(*map(F.lit, known[k])))])

    def words_of(token: Column, words: Column) -> Column:
        def build(pieces: Column) -> Column:
            made = F.transform(pieces, lambda p, i: _word(i, p, F.lit(False), token["start_char"]).withField("end_char", token["end_char"]))
            own = F.when(pieces.isNotNull(), made).otherwise(F.array(F.element_at(words, token["id_start"])))
            return F.struct(token.alias("token"), own.alias("words"), pieces.isNotNull().alias("rule"))

        return let(F.try_element_at(lookup, token["text"]), build)

    def renumber(sentence: Column) -> Column:
        return let(F.transform(sentence["tokens"], lambda t: words_of(t, sentence["words"])), lambda parts: place(sentence, parts))

    def place(sentence: Column, parts: Column) -> Column:
        placed = F.arrays_zip(parts.alias("p"), running(F.transform(parts, lambda p: F.size(p["words"]))).alias("at"))
        end = lambda z: F.when(z["p"]["rule"], z["at"] + F.size(z["p"]["words"]))
        tokens = F.transform(placed, lambda z: z["p"]["token"].withField("id_start", z["at"] + 1).withField("id_end", end(z)))
        words = F.transform(F.flatten(F.transform(parts, lambda p: p["words"])), lambda w, i: w.withField("id", i + 1))
        return F.struct(sentence["text"].alias("text"), tokens.alias("tokens"), words.alias("words"))

    return docs.withColumn(sentences, F.transform(F.col(sentences), renumber))


_WORD_FIELDS = tuple(f.split(":")[0] for f in WORD[7:-1].split(","))
_TOKEN_FIELDS = tuple(f.split(":")[0] for f in TOKEN[7:-1].split(","))


def _rows(docs: DataFrame, keep: tuple[str, ...], sentences: str, array: str, fields: tuple[str, ...]) -> DataFrame:
    # inline, not explode: pruning the fields of an exploded struct would evaluate the sentences once for each field.
    each = F.transform(sentences, lambda s, i: F.transform(s[array], lambda w: F.struct(i.alias("sent_id"), *[w[f].alias(f) for f in fields])))
    return docs.select(*keep, F.inline(F.flatten(each)))


def words(docs: DataFrame, *keep: str, sentences: str = "sentences") -> DataFrame:
    """A row for each word: the kept columns, sent_id from 0 and the fields of the word."""
    return _rows(docs, keep, sentences, "words", _WORD_FIELDS)


def tokens(docs: DataFrame, *keep: str, sentences: str = "sentences") -> DataFrame:
    """A row for each token: the kept columns, sent_id from 0, the fields of the token and is_mwt."""
    return _rows(docs, keep, sentences, "tokens", _TOKEN_FIELDS).withColumn("is_mwt", F.col("id_end").isNotNull())
