"""CoNLL-U in both directions, and what is read off annotated sentences."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyarrow.json import ParseOptions, ReadOptions, read_json
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import batches as B
from .segment import TOKEN, WORD

_NAMES = ("form", "lemma", "upos", "xpos", "feats", "head", "deprel", "deps", "misc")


def conllu_line(w: Column) -> Column:
    """The ten fields of a word; null and empty ones are underscores, the script goes into misc."""
    blank = lambda c: F.when(c.isNull() | (c == ""), F.lit("_")).otherwise(c)
    script = F.when(w["script"].isNotNull() & (w["script"] != ""), F.concat(F.lit("Script="), w["script"]))
    misc = F.when(script.isNull(), blank(w["misc"])).when(blank(w["misc"]) == "_", script).otherwise(F.concat(w["misc"], F.lit("|"), script))
    fields = [w["id"].cast("string"), w["text"], *[blank(w[n]) for n in ("lemma", "upos", "xpos", "feats")], F.coalesce(w["head"].cast("string"), F.lit("_")), blank(w["deprel"]), blank(w["deps"]), misc]
    return F.concat_ws("\t", *fields)


def sentence_conllu(s: Column) -> Column:
    """The block of a sentence: its text, and each token with its words."""
    last = lambda t: F.coalesce(t["id_end"], t["id_start"])
    span = lambda t: F.when(t["id_end"].isNotNull(), F.array(F.concat(t["id_start"].cast("string"), F.lit("-"), t["id_end"].cast("string"), F.lit("\t"), t["text"], F.lit("\t_" * 8))))
    own = lambda t: F.transform(F.slice(s["words"], t["id_start"], last(t) - t["id_start"] + 1), conllu_line)
    lines = F.flatten(F.transform(s["tokens"], lambda t: F.concat(F.coalesce(span(t), F.array().cast("array<string>")), own(t))))
    # A line end in the text would end the comment.
    return F.array_join(F.concat(F.array(F.concat(F.lit("# text = "), F.regexp_replace(s["text"], r"[\r\n]+", " "))), lines), "\n")


def to_conllu(sentences: Column, lang: Column | None = None, script: Column | None = None) -> Column:
    """A document in CoNLL-U: the header, a blank line, and the blocks separated by blank lines."""
    lang, script = (F.lit(None).cast("string") if c is None else c for c in (lang, script))
    head = [F.when(c != "", F.concat(F.lit(f"# {n} = "), c)) for n, c in (("lang", lang), ("script", script))]
    header = F.concat_ws("\n", *head)
    body = F.array_join(F.transform(sentences, sentence_conllu), "\n\n")
    return F.concat(F.when(header != "", F.concat(header, F.lit("\n\n"))).otherwise(F.lit("")), body, F.lit("\n\n"))


def to_json(sentences: Column) -> Column:
    """A document as a JSON array of sentences, each an array of words with eight fields, nulls included."""
    fields = ("id", "text", "lemma", "upos", "xpos", "feats", "head", "deprel")
    word = lambda w: F.struct(*[w[n].alias(n) for n in fields])
    return F.to_json(F.transform(sentences, lambda s: F.transform(s["words"], word)), {"ignoreNullFields": "false"})


#: What makes the texts that a function reads from those of the column it is given, a batch at a time.
Source = Callable[[pa.Array], pa.Array]


def conllu_source(lang: str = "", script: str = "", rules: dict[str, list[str]] | None = None) -> Source:
    """Texts to CoNLL-U, as :func:`conllu_documents` has it: what is written is read in the same worker, and no batch of it is held."""
    return lambda texts: (lambda w: B.written(texts, *(B.expanded(w, rules) if rules else (w, None)), lang, script))(B.words(texts))


def json_source() -> Source:
    """Texts to JSON, as :func:`json_documents` has it."""
    return lambda texts: B.as_json(texts, B.words(texts))


def conllu_documents(docs: DataFrame, *keep: str, text: str = "text", lang: str = "", script: str = "", rules: dict[str, list[str]] | None = None) -> DataFrame:
    """The kept columns and ``content``: :func:`to_conllu` of texts as :func:`segment.tokenize` and, with rules, :func:`segment.expand_multiword` have them, without nested columns."""
    made = conllu_source(lang, script, rules)
    return B.mapped(docs, keep, text, "content string", lambda texts: (None, [made(texts)]))


def json_documents(docs: DataFrame, *keep: str, text: str = "text") -> DataFrame:
    """The kept columns and ``json``: :func:`to_json` of texts as :func:`segment.tokenize` has them, without nested columns."""
    made = json_source()
    return B.mapped(docs, keep, text, "json string", lambda texts: (None, [made(texts)]))


def json_counts(docs: DataFrame, *keep: str, json: str = "json", source: Source | None = None) -> DataFrame:
    """The kept columns and the sentences, words and words with the part of speech PUNCT that are read in JSON of :func:`to_json`; nulls for null."""

    kind = pa.schema([("s", pa.list_(pa.list_(pa.struct([("id", pa.int32()), ("text", pa.string()), ("upos", pa.string())]))))])

    def rows(texts: pa.Array) -> tuple[None, list[pa.Array]]:
        texts = source(texts) if source else texts
        lines = [b'{"s":' + (b"null" if x is None else x.replace(b"\n", b" ")) + b"}\n" for x in texts.cast(pa.binary()).to_pylist()]
        options = ReadOptions(use_threads=False, block_size=max(map(len, lines)) + (1 << 20))
        s = read_json(pa.BufferReader(b"".join(lines)), options, ParseOptions(explicit_schema=kind, unexpected_field_behavior="ignore"))["s"].combine_chunks()
        sentences = s.flatten()
        words = sentences.flatten()
        own = np.concatenate(([0], np.cumsum(np.asarray(pc.fill_null(pc.list_value_length(s), 0), dtype=np.int64))))
        first = np.concatenate(([0], np.cumsum(np.asarray(pc.fill_null(pc.list_value_length(sentences), 0), dtype=np.int64))))[own]
        punct = np.concatenate(([0], np.cumsum(np.asarray(pc.fill_null(pc.equal(pc.struct_field(words, "upos"), "PUNCT"), False), dtype=np.int64))))[first]
        return None, [pa.array(np.diff(x), mask=np.asarray(pc.is_null(s))) for x in (own, first, punct)]

    return B.mapped(docs, keep, json, "sentences bigint, words bigint, punct bigint", rows)


def split_documents(content: Column) -> Column:
    """The documents of a file: parts between "# newdoc" marks, without blank ones; the whole without marks."""
    parts = F.filter(F.split(content, "# newdoc"), lambda p: p.rlike(r"(?U)\S"))
    return F.when(content.contains("# newdoc"), parts).otherwise(F.array(content))


_FIELDS = ("sent_id", "line", "id", *_NAMES, "mwt_start", "mwt_end", "mwt_text", "script", "known_text")
_TYPES = {n: "string" for n in _FIELDS} | dict.fromkeys(("sent_id", "id", "head", "mwt_start", "mwt_end"), "int") | {"line": "bigint"}


def conllu_lines(docs: DataFrame, content: str = "content", *, keep: tuple[str, ...] = ("doc_id",), fields: tuple[str, ...] = _FIELDS, source: Source | None = None) -> DataFrame:
    """The word lines of CoNLL-U texts: keep, sent_id, line, and the columns of a word, or those of them named in ``fields``.

    Lines without ten fields, ids of empty nodes and other ids that aren't numbers are skipped.
    A line a-b opens a multi-word token: words of its sentence from a to b carry mwt_start, mwt_end and mwt_text.
    An underscore is null; a head that isn't a number is null.  ``Script=`` is read from misc, which keeps it.
    A sentence is what lies between blank lines, and is counted from 0 if it has words; its text is that of the last
    comment in it, or of blocks without words before it.  ``line`` orders the lines of a text.
    Each text is read within its row: nothing is shuffled.  With a source, what it makes of the column is read.
    """

    def rows(texts: pa.Array) -> tuple[np.ndarray, list[pa.Array]]:
        r = B.read(source(texts) if source else texts)
        own = r.names()
        return r.at, [own[n]() for n in fields]

    return B.mapped(docs, keep, content, ", ".join(f"{n} {_TYPES[n]}" for n in fields), rows)


def parse_conllu(docs: DataFrame, content: str = "content", *, keep: tuple[str, ...] = ("doc_id",), source: Source | None = None) -> DataFrame:
    """Documents of CoNLL-U texts: keep, sentences (as of the tokenizers, without offsets), text, lang and script.

    A sentence's text is its comment's, or else its words joined by spaces; a document's text is
    that of its sentences, joined by blank lines.  Each text is read within its row.
    """

    def rows(texts: pa.Array) -> tuple[None, list[pa.Array]]:
        r = B.read(source(texts) if source else texts)
        f = {n: make() for n, make in r.names().items()}
        m = len(r.sent)
        null = {n: pa.nulls(m, pa.int32()) for n in ("start_char", "end_char")}
        word = {n: f[n] for n in ("id", "lemma", "upos", "xpos", "feats", "head", "deprel", "deps", "misc", "script")} | {"text": f["form"], "ner": pa.nulls(m, pa.string())} | null
        names = [x.split(":")[0] for x in WORD[7:-1].split(",")]
        words = pa.ListArray.from_arrays(B.int32(r.first), pa.StructArray.from_arrays([word[n] for n in names], names))
        # A token stands where its last word does.
        real = pc.or_(pc.is_null(f["mwt_start"]), pc.fill_null(pc.equal(f["id"], f["mwt_end"]), False))
        token = {"id_start": pc.coalesce(f["mwt_start"], f["id"]), "id_end": f["mwt_end"], "text": pc.coalesce(f["mwt_text"], f["form"])} | null
        at = np.concatenate(([0], np.cumsum(np.asarray(real, dtype=np.int64))))[r.first]
        tokens = pa.ListArray.from_arrays(B.int32(at), pa.StructArray.from_arrays([x.filter(real) for x in token.values()], list(token)))
        text = pc.if_else(pc.fill_null(pc.not_equal(r.known, ""), False), r.known, B.joined(f["form"], r.first, " "))
        first = np.searchsorted(r.doc, np.arange(len(texts) + 1))
        sentences = pa.ListArray.from_arrays(B.int32(first), pa.StructArray.from_arrays([text, tokens, words], ["text", "tokens", "words"]))

        def comment(name: str) -> pa.Array:
            place, said = r.comments
            own = np.asarray(pc.starts_with(said, f"# {name} = "))
            last = dict(zip(place[own].tolist(), said.filter(pa.array(own)).to_pylist(), strict=True))
            return pa.array([last[i].split(" = ", 1)[1].strip(" ") if i in last else None for i in range(len(texts))], pa.string())

        return None, [B.joined(text, first, "\n\n"), comment("lang"), comment("script"), sentences]

    return B.mapped(docs, keep, content, f"text string, lang string, script string, sentences array<struct<text:string,tokens:array<{TOKEN}>,words:array<{WORD}>>>", rows)


def dependencies(words: DataFrame, *keys: str) -> DataFrame:
    """Rows (keys, sent_id, id, text, deprel, head, head_text) of a table of words; the root has a null head_text.

    Words without a head or relation are left out.  Heads are looked up by equality in a self join: for
    sentences that are still nested, :func:`dependency_rows` needs none.
    """
    own = words.where(F.col("head").isNotNull() & F.col("deprel").isNotNull()).select(*keys, "sent_id", "id", "text", "deprel", "head")
    heads = words.select(*keys, "sent_id", F.col("id").alias("head"), F.col("text").alias("head_text"))
    return own.join(heads, [*keys, "sent_id", "head"], "left").select(*keys, "sent_id", "id", "text", "deprel", "head", "head_text")


def dependency_rows(docs: DataFrame, *keep: str, sentences: str = "sentences") -> DataFrame:
    """The rows of :func:`dependencies` from nested sentences whose words are numbered from 1 in order, without a shuffle."""

    def own(s: Column, i: Column) -> Column:
        head = lambda w: F.when(w["head"] > 0, F.try_element_at(s["words"], w["head"])["text"])
        row = lambda w: F.struct(i.alias("sent_id"), w["id"].alias("id"), w["text"].alias("text"), w["deprel"].alias("deprel"), w["head"].alias("head"), head(w).alias("head_text"))
        return F.transform(F.filter(s["words"], lambda w: w["head"].isNotNull() & w["deprel"].isNotNull()), row)

    return docs.select(*keep, F.inline(F.flatten(F.transform(sentences, own))))


def sentence_dependencies(sentence: Column) -> Column:
    """The same within a nested sentence, without a join: array<struct<head_text,deprel,text>>."""
    own = F.filter(sentence["words"], lambda w: w["head"].isNotNull() & w["deprel"].isNotNull())
    head = lambda w: F.when(w["head"] > 0, F.try_element_at(sentence["words"], w["head"]))
    return F.transform(own, lambda w: F.struct(head(w)["text"].alias("head_text"), w["deprel"].alias("deprel"), w["text"].alias("text")))


def mine_multiword_rules(lines: DataFrame, *keys: str) -> DataFrame:
    """The most frequent split of every multi-word token: (surface, pieces, count), by surface.

    ``lines`` is the result of :func:`conllu_lines`; of splits as frequent, the one seen first wins.
    """
    spans = lines.where(F.col("mwt_start").isNotNull()).groupBy(*keys, "sent_id", "mwt_start", "mwt_end", "mwt_text")
    pieces = spans.agg(F.transform(F.array_sort(F.collect_list(F.struct("line", "form"))), lambda x: x["form"]).alias("pieces"), F.min("line").alias("line"), F.max("id").alias("last"))
    pieces = pieces.where("last = mwt_end")
    order = F.struct(*keys, "line")
    counted = pieces.groupBy(F.col("mwt_text").alias("surface"), "pieces").agg(F.count("*").alias("count"), F.min(order).alias("first"))
    best = Window.partitionBy("surface").orderBy(F.desc("count"), "first")
    return counted.withColumn("rank", F.row_number().over(best)).where("rank = 1").select("surface", "pieces", "count").orderBy("surface")


def add_lexicon_types(lexicon: DataFrame, more: DataFrame) -> DataFrame:
    """The lexicon with those further entries whose (lang, type) it lacks."""
    return lexicon.unionByName(more.join(lexicon.select("lang", "type").distinct(), ["lang", "type"], "left_anti"))
