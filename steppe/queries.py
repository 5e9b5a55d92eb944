"""A query for each operator, over the tables of a folder, and the SQL that gives the same result."""

from __future__ import annotations

import posixpath
import uuid
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import streaming
from .functions import scripts as X
from .functions import text as T
from .functions import translit as R
from .operators import batches as B
from .operators import conllu as C
from .operators import morphemes as H
from .operators import morphology as M
from .operators import neural as N
from .operators import segment as S
from .operators import spans as P
from .operators import vectors as V
from .plans import default_registry, resolve
from .resources import rows, table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def _query(sql: str | None = None):
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def _docs(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select(*(columns or ("doc_id", "text")))
    # A session on one machine deals the rows to its cores, as it reads a file of one row group by one task; a cluster reads tables as they lie.
    local = spark.sparkContext.master.startswith("local[")
    return docs.repartition(spark.sparkContext.defaultParallelism) if local else docs


def _worded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents that have words."""
    return _docs(spark, sf_dir).where(F.col("text").rlike(r"(?U)[^\s\x1C-\x1F]"))


def _quoted(x: object) -> str:
    return "NULL" if x is None else "'" + x.replace("'", "''") + "'" if isinstance(x, str) else str(x)


def _values(names: str, data: list[tuple]) -> str:
    """SQL of a literal table."""
    return f"SELECT * FROM (VALUES {', '.join('(' + ', '.join(map(_quoted, r)) + ')' for r in data)}) AS t({names})"


# Sentences and tokens in DuckDB, whose regular expressions have no look-behind.
_SENTENCES = r"""
    l AS (SELECT doc_id, list_filter(list_transform(string_split(regexp_replace(text, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)),
                 lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')), lambda x: x <> '') AS l FROM documents WHERE text IS NOT NULL),
    s AS (SELECT doc_id, CAST(unnest(range(len(l))) AS INTEGER) AS sent_id, unnest(l) AS s FROM l)"""
_STEM = r"""'^(.*?)([")\]}''!,.:;?]+)$'"""
_PIECES = rf"""CASE WHEN regexp_extract(t, {_STEM}, 1) <> ''
    THEN list_concat([{{'t': regexp_extract(t, {_STEM}, 1), 'p': false}}], list_transform(string_split(regexp_extract(t, {_STEM}, 2), ''), lambda c: {{'t': c, 'p': true}}))
    ELSE [{{'t': t, 'p': false}}] END"""
_WORDS = rf"""{_SENTENCES},
    f AS (SELECT doc_id, sent_id, flatten(list_transform(regexp_extract_all(s, '\S+'), lambda t: {_PIECES})) AS f FROM s),
    u AS (SELECT doc_id, sent_id, CAST(unnest(range(1, len(f) + 1)) AS INTEGER) AS id, unnest(f) AS x FROM f),
    w AS (SELECT doc_id, sent_id, id, x.t AS text, x.p AS punct FROM u)"""


def _words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, sent_id, id, text, punct) without offsets: explode late, a sentence at a time."""
    sentences = _docs(spark, sf_dir).select("doc_id", F.posexplode(S.split_sentences(F.col("text"))).alias("sent_id", "s"))
    return sentences.select("doc_id", "sent_id", F.posexplode(S.token_texts(F.col("s"))).alias("i", "x")).select("doc_id", "sent_id", (F.col("i") + 1).alias("id"), "x.text", "x.punct")


@_query(f"WITH {_SENTENCES} SELECT doc_id, sent_id, s AS sentence FROM s")
def sentence_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _docs(spark, sf_dir).select("doc_id", F.posexplode(S.split_sentences(F.col("text"))).alias("sent_id", "sentence"))


@_query(f"WITH {_WORDS} SELECT doc_id, sent_id, id, text, punct FROM w")
def tokenize(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _words(spark, sf_dir)


_LATIN = "[A-Za-zªµºÀ-ÖØ-öø-ɏḀ-ỿ]"


@_query(
    f"""WITH {_WORDS},
    c AS (SELECT doc_id, count(*) AS words, count(*) FILTER (punct) AS punct FROM w GROUP BY doc_id),
    n AS (SELECT doc_id, len(l) AS sentences FROM l)
    SELECT lang, count(*) AS documents, CAST(sum(coalesce(sentences, 0)) AS BIGINT) AS sentences, CAST(sum(coalesce(words, 0)) AS BIGINT) AS words,
           CAST(sum(coalesce(punct, 0)) AS BIGINT) AS punct, CAST(sum(len(regexp_extract_all(text, '{_LATIN}'))) AS BIGINT) AS latin,
           CAST(count(*) FILTER (regexp_matches(text, '{_LATIN}')) AS BIGINT) AS latin_documents
    FROM documents LEFT JOIN c USING (doc_id) LEFT JOIN n USING (doc_id) GROUP BY lang"""
)
def token_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per language: documents, sentences, words, punctuation, Latin letters, documents in Latin script.  One narrow shuffle of counts."""
    docs = _docs(spark, sf_dir, "lang", "text").withColumn("s", S.split_sentences(F.col("text")))
    n = F.transform("s", lambda s: F.size(F.regexp_extract_all(s, F.lit(r"(?U)([^\s\x1C-\x1F]+)"), F.lit(1))))
    # A token with a stem adds one word for each trailing mark: count those marks without building the words.
    marks = F.transform("s", lambda s: F.regexp_count(F.regexp_replace(s, r"""(?U)(?<![^\s\x1C-\x1F])[.,:;!?"'\)\]\}]+(?![^\s\x1C-\x1F])""", "x"), F.lit(r"""(?U)[.,:;!?"'\)\]\}](?=[.,:;!?"'\)\]\}]*(?:[\s\x1C-\x1F]|$))""")))
    add = lambda x: F.aggregate(x, F.lit(0).cast("long"), lambda a, b: a + b)
    each = docs.select("lang", F.size("s").alias("sentences"), add(marks).alias("punct"), (add(n) + add(marks)).alias("words"), X.script_count(F.col("text"), "Latn").alias("latin"), (X.detect_script(F.col("text")) == "Latn").alias("is_latin"))
    total = lambda c: F.sum(F.coalesce(c, F.lit(0)).cast("long")).alias(c)
    return each.groupBy("lang").agg(F.count("*").alias("documents"), total("sentences"), total("words"), total("punct"), total("latin"), F.count(F.when(F.col("is_latin"), 1)).alias("latin_documents"))


@_query(f"WITH {_WORDS} SELECT text AS mark, count(*) AS n FROM w WHERE punct GROUP BY text")
def punct_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _words(spark, sf_dir).where("punct").groupBy(F.col("text").alias("mark")).agg(F.count("*").alias("n"))


_PLACED = rf"""{_SENTENCES},
    o AS (SELECT *, coalesce(sum(length(s) + 1) OVER (PARTITION BY doc_id ORDER BY sent_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS base FROM s),
    r AS (SELECT doc_id, sent_id, base, unnest(range(len(x))) AS i, unnest(x) AS run FROM (SELECT *, regexp_extract_all(s, '\s+|\S+') AS x FROM o)),
    q AS (SELECT *, base + coalesce(sum(length(run)) OVER (PARTITION BY doc_id, sent_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS pos FROM r),
    z AS (SELECT doc_id, sent_id, i, pos, list_transform([run], lambda t: {_PIECES})[1] AS p FROM q WHERE NOT regexp_matches(run, '^\s')),
    y AS (SELECT doc_id, sent_id, i, pos, unnest(range(len(p))) AS k, unnest(p) AS x FROM z),
    w AS (SELECT doc_id, sent_id, CAST(row_number() OVER (PARTITION BY doc_id, sent_id ORDER BY i, k) AS INTEGER) AS id, x.t AS text, x.p AS punct,
          CAST(pos + CASE WHEN k = 0 THEN 0 ELSE length(first_value(x.t) OVER (PARTITION BY doc_id, sent_id, i ORDER BY k)) + k - 1 END AS INTEGER) AS start_char FROM y)"""


@_query(f"WITH {_PLACED} SELECT doc_id, sent_id, id, text, start_char FROM w")
def word_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.word_offsets(_docs(spark, sf_dir), "doc_id").select("doc_id", "sent_id", "id", "text", "start_char")


@_query(f"SELECT doc_id, len(regexp_extract_all(text, '{_LATIN}')) AS latin, CAST(0 AS BIGINT) AS cyrillic FROM documents")
def script_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.col("text")
    return _docs(spark, sf_dir).select("doc_id", X.script_count(text, "Latn").cast("long").alias("latin"), X.script_count(text, "Cyrl").cast("long").alias("cyrillic"))


@_query(f"SELECT doc_id, CASE WHEN regexp_matches(text, '{_LATIN}') THEN 'Latn' END AS script FROM documents")
def script_detect(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _docs(spark, sf_dir).select("doc_id", X.detect_script(F.col("text")).alias("script"))


_MIXED = [
    (0, "Salom дўстим, qalaysiz?", [("Salom ", "Latn"), ("дўстим, ", "Cyrl"), ("qalaysiz?", "Latn")]),
    (1, "123 !?", []),
    (2, "12 сәлем دنيا x", [("сәлем ", "Cyrl"), ("دنيا ", "Arab"), ("x", "Latn")]),
    (3, "\U00010c34\U00010c35 ok", [("\U00010c34\U00010c35 ", "Orkh"), ("ok", "Latn")]),
    (4, "", []),
    (5, "аb", [("а", "Cyrl"), ("b", "Latn")]),
]


@_query(_values("id, part, segment, script", [(i, k, s, c) for i, _, own in _MIXED for k, (s, c) in enumerate(own)]))
def script_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    given = spark.createDataFrame([(i, t) for i, t, _ in _MIXED], "id int, text string")
    return given.select("id", F.posexplode(X.script_segments(F.col("text"))).alias("part", "x")).select("id", "part", F.col("x.text").alias("segment"), "x.script")


@_query(_values("id, script", [(0, "Latn"), (1, None), (2, "Cyrl"), (3, "Orkh"), (4, None), (5, "Cyrl")]))
def script_detect_mixed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.createDataFrame([(i, t) for i, t, _ in _MIXED], "id int, text string").select("id", X.detect_script(F.col("text")).alias("script"))


@_query(_values("lang, script", [("kaz", "Cyrl"), ("tur", None)]))
def script_for_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    known = table(spark, "lang_script").where(F.col("lang").isin("kaz", "tur")).groupBy("lang").agg(F.collect_set("script").alias("available"))
    return known.select("lang", X.script_for_language(F.lit("сәлем"), F.col("available")).alias("script"))


@_query("SELECT doc_id, replace(replace(text, 'I', 'ı'), 'İ', 'i') AS text FROM documents")
def turkish_i(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _docs(spark, sf_dir).select("doc_id", T.turkish_i(F.col("text")).alias("text"))


@_query("SELECT doc_id, lower(replace(replace(text, 'I', 'ı'), 'İ', 'i')) AS text FROM documents")
def turkic_lower(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _docs(spark, sf_dir).select("doc_id", T.turkic_lower(F.col("text")).alias("text"))


@_query("SELECT doc_id, nfc_normalize(text) AS text FROM documents")
def normalize_nfc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _docs(spark, sf_dir).select("doc_id", T.nfc(F.col("text")).alias("text"))


@_query("SELECT doc_id, strip_accents(text) AS text FROM (SELECT doc_id, regexp_replace(text, '[^\\x{0}-\\x{24F}]', '', 'g') AS text FROM documents)")
def strip_marks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _docs(spark, sf_dir).select("doc_id", T.strip_marks(F.regexp_replace("text", r"[^\x{0}-\x{24F}]", "")).alias("text"))


@_query(rf"WITH {_WORDS} SELECT text, count(*) AS n FROM w WHERE regexp_matches(text, '^[0-9.,/%+-]*[0-9][0-9.,/%+-]*$') GROUP BY text")
def numeric_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _words(spark, sf_dir).where(T.is_numeric(F.col("text"))).groupBy("text").agg(F.count("*").alias("n"))


def _translate_sql(lang: str, source: str, target: str) -> str:
    """The rewriting of a table of single characters as nested SQL functions."""
    own = {k: v for k, v in R.expanded(R.mapping(lang, source, target)).items() if k != v}
    short = {k: v for k, v in own.items() if len(v) == 1}
    out = f"translate(text, {_quoted(''.join(short))}, {_quoted(''.join(short.values()))})"
    for k, v in own.items():
        if len(v) != 1:  # no output of such a table is a key with a longer output
            out = f"replace({out}, {_quoted(k)}, {_quoted(v)})"
    return out


@_query(f"SELECT doc_id, {_translate_sql('aze', 'Latn', 'CTS')} AS text FROM documents")
def translit_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _docs(spark, sf_dir).select("doc_id", R.transliterate(F.col("text"), "aze", "Latn", "CTS").alias("text"))


def _greedy(text: str, own: dict[str, str]) -> str:
    """Longest match from left to right, a character at a time: what the expressions must agree with."""
    out, i = "", 0
    while i < len(text):
        for n in (4, 3, 2, 1):
            part = text[i : i + n]
            if len(part) == n and (part in own or part.lower() in own):
                value = own[part] if part in own else own[part.lower()]
                if part not in own and part[0].isupper():
                    value = value[:1].upper() + value[1:]
                out, i = out + value, i + n
                break
        else:
            out, i = out + text[i], i + 1
    return out


#: Directions with rules of their own, and what they make of a text.
_SPECIAL = {
    ("uzb", "Cyrl", "Latn"): ("Етти ел Оеда мен Эела шанхай", "Yetti yel Oyeda men Eyela shanxay"),
    ("tuk", "Cyrl", "Latn"): ("Ел ишиек мен объект", "Ýel işiýek men obýekt"),
    ("tuk", "Latn", "Cyrl"): ("Ýer ýel", "Ер ел"),
    ("uzb", "Latn", "Cyrl"): ("o‘zbek gʻoz", "ўзбек ғоз"),
    ("uig", "Latn", "Arab"): ("salam radio", "سالام رادىئو"),
    ("uig", "Arab", "Latn"): ("سالام", "salam"),
    ("uig", "Arab", "Cyrl"): ("سالام", "салам"),
    ("uig", "Cyrl", "Arab"): ("салам", "سالام"),
    ("uig", "Cyrl", "Latn"): ("шаң", "shang"),
    ("uig", "Latn", "Cyrl"): ("Shang", "шаң"),
    ("uig", "Arab", "CTS"): ("سالام", "salam"),
    ("uig", "CTS", "Arab"): ("salam", "سالام"),
    ("uig", "Latn", "CTS"): ("Ching", "çiñ"),
    ("uig", "CTS", "Latn"): ("çiñ", "ching"),
}


def _translit_cases() -> list[tuple[str, str, str, str, str]]:
    out = [(*pair, *case) for pair, case in _SPECIAL.items()]
    for pair in R.pairs():
        if pair not in _SPECIAL:
            own = R.mapping(*pair)
            given = " ".join([*sorted(own), *(k.title() for k in sorted(own)), *(k.upper() for k in sorted(own)), "".join(sorted(own, reverse=True)), "Xyz 12"])
            out.append((*pair, given, _greedy(given, own)))
    return sorted(out)


@_query(_values("lang, source, target, result", [(a, b, c, e) for a, b, c, _, e in _translit_cases()]))
def translit_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every direction of every language, over the keys of its table in all cases."""
    given = spark.createDataFrame([x[:4] for x in _translit_cases()], "lang string, source string, target string, text string")
    key = lambda a, b, c: (F.col("lang") == a) & (F.col("source") == b) & (F.col("target") == c)
    # A branch of the union for each direction: one long choice in a column would be compiled as a whole.
    out = None
    for pair in R.pairs():
        own = given.where(key(*pair)).select("lang", "source", "target", R.transliterate(F.col("text"), *pair).alias("result"))
        out = own if out is None else out.union(own)
    return out


@_query(f"WITH {_WORDS} SELECT doc_id, sent_id, id, text AS form, CASE WHEN punct THEN 'PUNCT' END AS upos FROM w")
def conllu_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents written as CoNLL-U and read again."""
    return C.conllu_lines(_docs(spark, sf_dir), "text", source=C.conllu_source("en", "Latn"), fields=("sent_id", "id", "form", "upos"))


@_query(f"WITH {_SENTENCES} SELECT doc_id, string_agg(regexp_replace(s, '[\\r\\n]+', ' ', 'g'), chr(10) || chr(10) ORDER BY sent_id) AS text, 'en' AS lang, 'Latn' AS script, count(*) AS sentences FROM s GROUP BY doc_id")
def conllu_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.parse_conllu(_worded(spark, sf_dir), "text", source=C.conllu_source("en", "Latn")).select("doc_id", "text", "lang", "script", F.size("sentences").cast("long").alias("sentences"))


@_query(f"WITH {_WORDS} SELECT doc_id, count(DISTINCT sent_id) AS sentences, count(*) AS words, count(*) FILTER (punct) AS punct FROM w GROUP BY doc_id")
def doc_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents written as JSON and read again."""
    return C.json_counts(_worded(spark, sf_dir), "doc_id", json="text", source=C.json_source())


@_query(
    f"""WITH {_WORDS} SELECT doc_id, sent_id, id, text, CASE WHEN id > 1 THEN 'dep' ELSE 'root' END AS deprel, CAST(id - 1 AS INTEGER) AS head,
    lag(text) OVER (PARTITION BY doc_id, sent_id ORDER BY id) AS head_text FROM w QUALIFY id > 1 OR NOT punct"""
)
def dependency_triples(spark: SparkSession, sf_dir: str) -> DataFrame:
    # The head of a word is the word before it.
    def rows(texts: pa.Array) -> tuple[np.ndarray, list[pa.Array]]:
        w = B.words(texts)
        head = w.id - 1
        return B.dependencies(w, head, pc.if_else(pa.array(head > 0), "dep", pc.if_else(pa.array(w.punct), pa.scalar(None, pa.string()), "root")))

    return B.mapped(_docs(spark, sf_dir), ("doc_id",), "text", "sent_id int, id int, text string, deprel string, head int, head_text string", rows)


_RULES = [("the", ["th", "e"]), ("der", ["d", "e", "r"]), ("Que", ["Q", "ue"])]
_RULES_SQL = "r AS (SELECT * FROM (VALUES ('the', ['th', 'e']), ('der', ['d', 'e', 'r']), ('Que', ['Q', 'ue'])) AS t(surface, pieces))"


def _rules(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(_RULES, "surface string, pieces array<string>")


@_query(
    f"""WITH {_WORDS}, {_RULES_SQL},
    e AS (SELECT doc_id, sent_id, id, unnest(coalesce(pieces, [text])) AS text, unnest(range(coalesce(len(pieces), 1))) AS k FROM w LEFT JOIN r ON text = surface)
    SELECT doc_id, sent_id, CAST(row_number() OVER (PARTITION BY doc_id, sent_id ORDER BY id, k) AS INTEGER) AS id, text FROM e"""
)
def mwt_expand(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.expanded_words(_docs(spark, sf_dir), _rules(spark), "doc_id").select("doc_id", "sent_id", "id", "text")


@_query(f"WITH {_WORDS}, {_RULES_SQL} SELECT surface, array_to_string(pieces, '+') AS pieces, count(*) AS n FROM w JOIN r ON text = surface GROUP BY ALL")
def mwt_mine(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rules recovered from a treebank that was written with them."""
    source = C.conllu_source(rules=S.rules_of(_rules(spark)))
    found = C.mine_multiword_rules(C.conllu_lines(_docs(spark, sf_dir), "text", source=source, fields=("sent_id", "line", "id", "form", "mwt_start", "mwt_end", "mwt_text")), "doc_id")
    return found.select("surface", F.array_join("pieces", "+").alias("pieces"), F.col("count").alias("n"))


_LEXICON = [("der", "DET", "PronType=Art", 0), ("the", "DET", "Definite=Def", 0), ("the", "X", "_", 1), ("que", "SCONJ", "_", 0), ("and", "CCONJ", "_", 0)]


@_query(
    f"""WITH {_WORDS}, x AS ({_values("form, upos, feats, ord", _LEXICON)})
    SELECT x.upos AS upos, x.feats AS feats, count(*) AS n FROM w JOIN x ON lower(w.text) = x.form AND ord = 0 GROUP BY ALL"""
)
def lexicon_tag(spark: SparkSession, sf_dir: str) -> DataFrame:
    lexicon = spark.createDataFrame(_LEXICON, "form string, upos string, feats string, ord int")
    tagged = M.with_lexicon(_words(spark, sf_dir), lexicon).where("lexicon is not null")
    return tagged.select(F.col("lexicon")[0].alias("e")).groupBy("e.upos", "e.feats").agg(F.count("*").alias("n"))


@_query(_values("lang, type, form", [("tur", "greeting", "merhaba")]))
def lexicon_antijoin(spark: SparkSession, sf_dir: str) -> DataFrame:
    known = table(spark, "lexicon").select("lang", "type", "form")
    more = spark.createDataFrame([("tur", "greeting", "merhaba"), ("tur", "pronoun_personal", "ben")], "lang string, type string, form string")
    return C.add_lexicon_types(known, more).where("type = 'greeting' or form = 'unheard'")


_READINGS = [
    (0, "қала<n><loc><pl>", 0.25, "қала", "n", "loc pl"),
    (1, "^geldi/gel<v><past><p3>$", 0.0, "gel", "v", "past p3"),
    (2, "x\tev@P.X@<n>", 1.0, "ev", "n", ""),
    (3, "plain", 0.0, None, None, None),
    (4, "<n>", 0.0, None, None, None),
    (5, " ab<np> ", 2.0, "ab", "np", ""),
]


@_query(_values("id, lemma, pos, feats", [(r[0], *r[3:]) for r in _READINGS]))
def fst_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    given = spark.createDataFrame([r[:3] for r in _READINGS], "id int, raw string, weight double")
    return given.select("id", M.parse_reading(F.col("raw"), F.col("weight")).alias("r")).select("id", "r.lemma", "r.pos", F.array_join("r.feats", " ").alias("feats"))


_TAGS = [
    (0, "tur", "px1sg dat", "Case=Dat|Number[psor]=Sing|Person[psor]=1"),
    (1, "tur", "ifi p3 sg", "Evident=Nfh|Number=Sing|Person=3"),
    (2, "kaz", "evid ind foo", "Evident=Nfh|PronType=Ind"),
    (3, "chv", "prl ter cvb", "Case=Prol|Case=Ter|VerbForm=Conv"),
    (4, "sah", "sg par", "Case=Par|Number=Sing"),
    (5, "ota", "dat sg", "_"),
    (6, "uzb", "cvb", "_"),
]


@_query(_values("id, feats", [(i, f) for i, _, _, f in _TAGS]))
def ud_feats(spark: SparkSession, sf_dir: str) -> DataFrame:
    given = spark.createDataFrame([x[:3] for x in _TAGS], "id int, lang string, tags string")
    tags = F.split("tags", " ")
    feats = F.coalesce(*[F.when(F.col("lang") == lang, M.ud_feats(tags, lang)) for lang in sorted({x[1] for x in _TAGS})])
    return given.select("id", feats.alias("feats"))


_FEATS = [
    (0, "NOUN", "Tense=Past|Case=Dat|Number=Sing", "Case=Dat|Number=Sing"),
    (1, "VERB", "Case=Dat", "_"),
    (2, "FOO", "Z=1|A=2", "Z=1|A=2"),
    (3, "CCONJ", "Case=Dat", "_"),
    (4, "PRON", "_", "_"),
    (5, "ADV", "PronType=Dem|Degree=Cmp", "Degree=Cmp|PronType=Dem"),
]


@_query(_values("id, feats", [(i, f) for i, _, _, f in _FEATS]))
def feat_whitelist(spark: SparkSession, sf_dir: str) -> DataFrame:
    given = spark.createDataFrame([x[:3] for x in _FEATS], "id int, upos string, feats string")
    return given.select("id", M.allowed_feats(F.col("upos"), F.col("feats")).alias("feats"))


_ANALYSES = [
    ("geldi", "gel<v><past><p3>", 0.0), ("geldi", "geldi<n><nom>", 0.0), ("yaz", "yaz<v><imp>", 0.0), ("yaz", "yaz<n><nom>", 0.0), ("ali", "ali<adj>", 1.0), ("ali", "Ali<np>", 1.0),
    ("güzel", "güzel<adj>", 0.5), ("güzel", "güzel<adv>", 0.4), ("ev", "ev<n><nom>", 0.0),
]


@_query(
    _values(
        "sent_id, id, text, lemma, upos, feats",
        [
            (0, 1, "Ali", "Ali", "PROPN", "_"), (0, 2, "güzel", "güzel", "ADV", "_"), (0, 3, "yaz", "yaz", "NOUN", "Case=Nom"), (0, 4, "geldi", "gel", "VERB", "Person=3|Tense=Past"), (0, 5, ".", ".", "PUNCT", "_"),
            (1, 1, "EV", "ev", "NOUN", "Case=Nom"), (1, 2, "12", "12", "NUM", "NumType=Card"), (1, 3, "Ankara'da", "Ankara", "PROPN", "_"), (1, 4, "xyz", "xyz", "X", "_"), (1, 5, "?", "?", "PUNCT", "_"),
        ],
    )
)
def disambiguate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.createDataFrame([(1, "Ali güzel yaz geldi. EV 12 Ankara'da xyz?")], "doc_id long, text string")
    words = S.words(S.tokenize(docs), "doc_id")
    found = M.annotate(words, spark.createDataFrame(_ANALYSES, "surface string, raw string, weight double"), table(spark, "lexicon").where("lang = 'tur'"), "tur", "doc_id", "sent_id")
    return found.select("sent_id", "id", "text", "lemma", "upos", "feats")


@_query(
    rf"""WITH {_WORDS},
    p AS (SELECT *, regexp_matches(text, '^\pP+$') AS is_punct FROM w),
    i AS (SELECT *, coalesce(min(CASE WHEN NOT is_punct THEN id END) OVER (PARTITION BY doc_id, sent_id) = id, false) AS initial FROM p),
    c AS (SELECT *, regexp_matches(text, '^[^\pL]*(\p{{Lu}}|\p{{Ll}})') AND regexp_matches(text, '^\p{{Lu}}') AS name FROM i)
    SELECT upos, count(*) AS n FROM (SELECT CASE WHEN is_punct THEN 'PUNCT'
        WHEN regexp_matches(text, '^[0-9.,/%+-]*[0-9][0-9.,/%+-]*$') THEN 'NUM'
        WHEN name AND regexp_matches(text, '^[^'']+''+\pL{{1,4}}$') THEN 'PROPN'
        WHEN len(list_filter(string_split(text, '-'), lambda x: x <> '')) = 2 AND contains(text, '-')
             AND lower(list_filter(string_split(text, '-'), lambda x: x <> '')[1]) = lower(list_filter(string_split(text, '-'), lambda x: x <> '')[2]) THEN 'ADV'
        WHEN name AND NOT initial THEN 'PROPN' ELSE 'X' END AS upos FROM c) GROUP BY upos"""
)
def unknown_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Part of speech of every word of the documents when no analysis is known."""
    w = M.counted_forms(_docs(spark, sf_dir)).withColumns({"punct": T.is_punctuation(F.col("text")), "form": T.lookup_form(F.col("text"))})
    none = F.array().cast("array<struct<upos:string,feats:string>>")
    upos = F.when(F.col("punct"), F.lit("PUNCT")).otherwise(F.coalesce(M.fallback(F.col("text"), F.col("initial"), none, F.col("form"))["upos"], F.lit("X")))
    return w.select(upos.alias("upos"), "n").groupBy("upos").agg(F.sum("n").alias("n"))


@_query(
    f"""WITH {_PLACED},
    t AS (SELECT *, CASE WHEN punct THEN 'O' WHEN regexp_matches(text, '^[A-Z]') THEN 'B-CAP' WHEN length(text) > 8 THEN 'I-CAP' ELSE 'O' END AS tag FROM w),
    g AS (SELECT *, sum(CASE WHEN tag LIKE 'I-%' THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id, sent_id ORDER BY id) AS run FROM t),
    k AS (SELECT doc_id, sent_id, run, string_agg(text, ' ' ORDER BY id) AS text, min(start_char) AS start_char, max(start_char + length(text)) AS end_char,
                 string_agg(CAST(id AS VARCHAR), ' ' ORDER BY id) AS word_ids FROM g GROUP BY ALL HAVING min_by(tag, id) LIKE 'B-%')
    SELECT doc_id, sent_id, CAST(row_number() OVER (PARTITION BY doc_id, sent_id ORDER BY run) AS INTEGER) AS span, 'CAP' AS type, text, start_char, CAST(end_char AS INTEGER) AS end_char, word_ids FROM k"""
)
def bio_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans of a capitalised word and the long words after it, tagged as a BIOES tagger would."""

    def tags(w: B.Words) -> pa.Array:
        return pc.if_else(pa.array(w.punct), "O", pc.if_else(pa.array((w.code >= ord("A")) & (w.code <= ord("Z"))), "S-CAP", pc.if_else(pa.array(w.length > 8), "E-CAP", "O")))

    return P.tagged_spans(_docs(spark, sf_dir), tags, "doc_id")


_EDITS = [(0, "Geldim", "-3+mek", "gelmek"), (1, "EV", "0", "ev"), (2, "kitap", "-0+lar", "kitaplar"), (3, "ab", "<unk>", "ab"), (4, "abc", "-9+x", "x"), (5, "evler", "-3", "ev")]


@_query(_values("id, lemma", [(i, x) for i, _, _, x in _EDITS]))
def edit_lemma(spark: SparkSession, sf_dir: str) -> DataFrame:
    given = spark.createDataFrame([x[:3] for x in _EDITS], "id int, word string, script string")
    return given.select("id", T.apply_edit_script(F.col("word"), F.col("script")).alias("lemma"))


@_query(_values("id, ids", [(0, "352 98 0 0"), (1, "0 0 0 0"), (2, "98 99 100 101")]))
def char_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    given = spark.createDataFrame([(0, "şa"), (1, ""), (2, "abcdef")], "id int, word string")
    return given.select("id", F.array_join(F.transform(T.char_ids(F.col("word"), 4), lambda x: x.cast("string")), " ").alias("ids"))


_VARIANTS = [(0, "Ev", "Ev ev"), (1, "Ankara’da", "Ankara’da ankara’da Ankara'da ankara'da"), (2, "kış", "kış kıs"), (3, "a–b", "a–b a-b")]


@_query(_values("id, variants", [(i, v) for i, _, v in _VARIANTS]))
def lookup_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    given = spark.createDataFrame([x[:2] for x in _VARIANTS], "id int, word string")
    return given.select("id", F.array_join(T.lookup_variants(F.col("word")), " ").alias("variants"))


@_query("SELECT DISTINCT CASE WHEN lang = 'uzb' THEN '__label__uzn_Latn' ELSE '__label__' || lang || '_Latn' END AS label FROM (SELECT lang FROM documents UNION SELECT 'uzb')")
def language_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    langs = _docs(spark, sf_dir, "lang").union(spark.createDataFrame([("uzb",)], "lang string")).distinct()
    return langs.select(T.language_label(F.col("lang"), F.lit("Latn")).alias("label"))


_CODES = [("tuk", "tuk_Latn"), ("kaz", "kaz_Cyrl"), ("tur_Latn", "tur_Latn"), ("xx_Latn", None), ("zzz", None), ("eng", "eng_Latn")]


@_query(_values("value, translation_code", _CODES))
def translation_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    given = spark.createDataFrame([(v,) for v, _ in _CODES], "value string")
    return N.resolve_translation_code(F.col("value"), table(spark, "nllb"), given)


def _embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding", "label")


_NORM = "sqrt(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE) * CAST(x AS DOUBLE))))"


@_query(f"SELECT vec_id, round(CAST(embedding[1] AS DOUBLE) / greatest({_NORM}, 1e-12), 6) AS first, round({_NORM}, 4) AS norm FROM embeddings")
def l2_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = F.col("embedding")
    return _embeddings(spark, sf_dir).select("vec_id", F.round(V.l2_normalize(e)[0], 6).alias("first"), F.round(F.sqrt(V.dot(e, e)), 4).alias("norm"))


_UNIT = f"list_transform(embedding, lambda x: CAST(x AS DOUBLE) / {_NORM.replace('lambda x', 'lambda y').replace('CAST(x', 'CAST(y')})"


@_query(
    f"""WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e, {_NORM} AS n FROM embeddings),
    c AS (SELECT a.vec_id AS vec_id, b.vec_id AS near_id, list_inner_product(a.e, b.e) / (a.n * b.n) AS cosine FROM v a, v b WHERE a.vec_id < 20)
    SELECT vec_id, near_id, CAST(row_number() OVER (PARTITION BY vec_id ORDER BY cosine DESC, near_id) AS INTEGER) AS rank, round(cosine, 4) AS cosine
    FROM c QUALIFY rank <= 5"""
)
def cosine_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five nearest of all vectors for a given set of query vectors, those of vec_id below 20, as in the SQL."""
    e = _embeddings(spark, sf_dir)
    near = V.nearest(e.where("vec_id < 20"), e.withColumnRenamed("vec_id", "near_id"), 5, "vec_id", "near_id")
    return near.select("vec_id", "near_id", "rank", F.round("cosine", 4).alias("cosine"))


@_query(
    """WITH d AS (SELECT vec_id, label, unnest(embedding) AS x, unnest(range(len(embedding))) AS i FROM embeddings),
    c AS (SELECT label, i, avg(CAST(x AS DOUBLE)) AS m FROM d GROUP BY label, i),
    z AS (SELECT vec_id, c.label AS label, sum(CAST(x AS DOUBLE) * m) AS z FROM d JOIN c USING (i) GROUP BY vec_id, c.label),
    p AS (SELECT vec_id, label, exp(z - max(z) OVER (PARTITION BY vec_id)) AS e FROM z),
    q AS (SELECT vec_id, label, e / sum(e) OVER (PARTITION BY vec_id) AS p FROM p)
    SELECT vec_id, CAST(row_number() OVER (PARTITION BY vec_id ORDER BY p DESC, CAST(label AS VARCHAR)) AS INTEGER) AS rank, CAST(label AS VARCHAR) AS label, round(p, 4) AS p FROM q QUALIFY rank <= 2"""
)
def centroid_softmax_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The two most probable labels of each vector, with the labels' centroids as weights."""
    e = _embeddings(spark, sf_dir)
    means = e.select("label", F.posexplode("embedding").alias("i", "x")).groupBy("label", "i").agg(F.avg(F.col("x").cast("double")).alias("m"))
    weights = means.groupBy(F.col("label").cast("string").alias("label")).agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "m"))), lambda x: x["m"]).alias("weights"))
    return V.top_languages(e.select("vec_id", "embedding"), weights, 2, keep=("vec_id",)).select("vec_id", "rank", "label", F.round("p", 4).alias("p"))


_SUFFIXES = [
    ("pl", 0, "VS", {"B": "лар", "F": "лер"}), ("pl", 1, "ND", {"B": "дар", "F": "дер"}), ("pl", 2, "T", {"B": "тар", "F": "тер"}),
    ("px1sg", 0, "V", {"B": "м", "F": "м"}), ("px1sg", 1, "SNDT", {"B": "ым", "F": "ім"}), ("loc", 0, "VSND", {"B": "да", "F": "де"}), ("loc", 1, "T", {"B": "та", "F": "те"}),
    ("dat", 0, "VSND", {"B": "ға", "F": "ге"}), ("dat", 1, "T", {"B": "қа", "F": "ке"}), ("past", 0, "VSND", {"B": "ды", "F": "ді"}), ("past", 1, "T", {"B": "ты", "F": "ті"}), ("p1sg", 0, "VSNDT", {"B": "м", "F": "м"}),
]
_MORPHEMES = [
    (0, "мектептерде", "мектеп", "NOUN", "Case=Loc|Number=Plur", "мектеп:STEM тер:PLUR де:LOC"),
    (1, "балаға", "бала", "NOUN", "Case=Dat", "бала:STEM ға:DAT"),
    (2, "бардым", "бару", "VERB", "Number=Sing|Person=1|Tense=Past", "бар:STEM ды:PST м:1SG"),
    (3, "12", None, None, None, "12:STEM"),
    (4, "үй", None, None, None, "үй:STEM"),
]


@_query(_values("id, morphemes", [(r[0], r[5]) for r in _MORPHEMES]))
def morpheme_segment(spark: SparkSession, sf_dir: str) -> DataFrame:
    suffixes = H.suffix_rows(spark.createDataFrame(_SUFFIXES, "key string, ord int, context string, forms map<string,string>"))
    given = spark.createDataFrame([r[:5] for r in _MORPHEMES], "id int, word string, lemma string, upos string, feats string")
    found = H.segment(F.col("word"), F.col("lemma"), F.col("upos"), F.col("feats"), F.lit(None).cast("array<string>"), suffixes, "kaz", "Cyrl")
    return given.select("id", F.array_join(F.transform(found["morphemes"], lambda m: F.concat(m["surface"], F.lit(":"), m["label"])), " ").alias("morphemes"))


_RESOLVED = [("depparse", "tokenize depparse"), ("mwt tokenize", "tokenize mwt"), ("custom tokenize", "tokenize custom")]


@_query(_values("requested, resolved", _RESOLVED))
def pipeline_resolve(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .plans import Stage

    registry = default_registry()
    registry.register("depparse", "fake", Stage(lambda lang, script, options: lambda df: df, requires=("tokenize",)))
    return spark.createDataFrame([(r, " ".join(resolve(r.split(), registry))) for r, _ in _RESOLVED], "requested string, resolved string")


@_query(f"SELECT lang, script, is_primary FROM ({_values('lang, script, is_primary', [(r['lang'], r['script'], int(r['is_primary'])) for r in rows('lang_script')])})")
def language_scripts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, "lang_script").select("lang", "script", "is_primary")


@_query(
    f"""WITH {_WORDS}, d AS (SELECT doc_id, count(DISTINCT sent_id) AS sentences, count(*) AS words FROM w GROUP BY doc_id)
    SELECT doc_id, coalesce(sentences, 0) AS sentences, coalesce(words, 0) AS words FROM documents LEFT JOIN d USING (doc_id) WHERE text IS NOT NULL"""
)
def stream_tokenize(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents as a stream of files, tokenized by the same expressions and written exactly once."""
    schema = spark.read.parquet(f"{sf_dir}/documents.parquet").schema
    home = posixpath.join(streaming.shared_folder(spark), f"stream-{uuid.uuid4().hex}")

    def counts(stream: DataFrame) -> DataFrame:
        s = S.split_sentences(F.col("text"))
        words = F.aggregate(F.transform(s, lambda x: F.size(S.token_texts(x))), F.lit(0), lambda a, b: a + b)
        return stream.where("text is not null").select("doc_id", F.size(s).cast("long").alias("sentences"), words.cast("long").alias("words"))

    # A stream reads folders; the files of one table are picked by name, whether the table is a file or a folder.
    stream = spark.readStream.schema(schema).option("pathGlobFilter", "*.parquet").parquet(f"{sf_dir}/documents.parquet*")
    streaming.run_available(stream, counts, posixpath.join(home, "out"), posixpath.join(home, "state"))
    return spark.read.parquet(posixpath.join(home, "out"))


__all__ = ["ORACLE_SQL", "QUERIES"]
