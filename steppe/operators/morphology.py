"""Morphological annotation from an analysis table.

Transducers are external; what they give is a table of analyses (lang, surface, raw, weight), which
joins like any other.  Choosing a reading, falling back for unknown words, and mapping tags to
Universal Dependencies are native expressions.

A reading is struct<lemma,pos,feats array<string>,weight double,raw>.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from . import batches as B

_PARTS = "ADJ=adj ADP=post ADV=adv AUX=vaux CCONJ=cnjcoo DET=det INTJ=ij NOUN=n NUM=num PART=part PRON=prn PROPN=np PUNCT=punct SCONJ=cnjsub SYM=sym VERB=v"
_POS = {tag: upos for upos, tag in (x.split("=") for x in _PARTS.split())}
_FEATS = """Aspect: perf=Perf prog=Prog
Case: abl=Abl acc=Acc dat=Dat equ=Equ gen=Gen ins=Ins loc=Loc nom=Nom
Clusivity: excl=Excl incl=Incl
Degree: comp=Cmp sup=Sup
Gender: f=Fem m=Masc n=Neut
Mood: cond=Cnd imp=Imp neces=Nec opt=Opt
Number: du=Dual pl=Plur sg=Sing
PartType: qst=Int
Person: p1=1 p2=2 p3=3
Polarity: neg=Neg
PronType: dem=Dem ind=Ind int=Int pers=Prs rel=Rel
Reflex: refl=Yes
Tense: aor=Aor fut=Fut past=Past pres=Pres
VerbForm: ger=Ger inf=Inf part=Part
Voice: pass=Pass rcp=Rcp rfl=Rfl"""
#: Further tags: of the languages whose evidential is "ifi", of the others, and of single ones.
_IFI = "azb aze crh gag tuk tur uig uzb".split()
_EVID = "alt bak chv kaa kaz kir kjh krc kum nog sah tat tyv".split()
_OWN = {"chv": dict(ter="Case=Ter", prl="Case=Prol"), "sah": dict(par="Case=Par")}
_VERB = "Aspect Clusivity Evident Mood Number Person Polarity Tense VerbForm Voice"
_NOUN = "Case Gender Number Number[psor] Person[psor]"
_PRON = "Case Number Person PronType Reflex"
_ALLOWED = dict.fromkeys("CCONJ INTJ PUNCT SCONJ SYM X".split(), "") | dict.fromkeys(("AUX", "VERB"), _VERB) | dict.fromkeys(("NOUN", "PROPN"), _NOUN) | dict.fromkeys(("DET", "PRON"), _PRON)
_ALLOWED |= dict(ADJ="Case Degree Gender Number", ADP="AdpType Case", ADV="AdvType Degree Polarity PronType", NUM="Case Gender NumType Number", PART="PartType Polarity")


def tag_map(lang: str) -> dict[str, str]:
    """Features of the tags of a language; empty for languages without a mapping.

    The tag "ind" is an indefinite pronoun type, never a mood, and that of third persons is the same for one and several owners.
    """
    if lang not in _IFI + _EVID:
        return {}
    out = {}
    for line in _FEATS.split("\n"):
        name, own = line.split(": ")
        out |= {tag: f"{name}={value}" for tag, value in (x.split("=") for x in own.split())}
    for person in "123":
        for tag, number in (("sg", "Sing"), ("pl", "Plur")):
            out[f"px{person}{tag}"] = f"Number[psor]={number}|Person[psor]={person}"
    out["px3sp"] = out["px3sg"]
    out |= {"ifi": "Evident=Nfh"} if lang in _IFI else dict(cvb="VerbForm=Conv", evid="Evident=Nfh")
    return out | _OWN.get(lang, {})


def _lookup(table: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for k in sorted(table) for x in (k, table[k])])


def ud_pos(pos: Column) -> Column:
    """Universal part of speech of a tag, X if it has none."""
    return F.coalesce(F.try_element_at(_lookup(_POS), pos), F.lit("X"))


def ud_feats(tags: Column, lang: str) -> Column:
    """Universal features of tags, sorted and joined; those of unknown tags are left out; "_" without any."""
    table = tag_map(lang)
    if not table:
        return F.lit("_")
    found = F.filter(F.transform(tags, lambda t: F.try_element_at(_lookup(table), t)), lambda f: f.isNotNull())
    return F.when(F.size(found) > 0, F.array_join(F.array_sort(found), "|")).otherwise(F.lit("_"))


def unknown_tags(tags: Column, lang: str) -> Column:
    """Tags that have no feature, in order."""
    known = sorted(tag_map(lang))
    return F.filter(tags, lambda t: ~t.isin(*known)) if known else tags


def allowed_feats(upos: Column, feats: Column) -> Column:
    """The features that the part of speech may have, sorted; "_" without any; all of them if it isn't a universal one."""
    given = F.split(feats, r"\|")
    allowed = _lookup({k: f"|{v.replace(' ', '|')}|" for k, v in _ALLOWED.items()})
    names = F.try_element_at(allowed, upos)
    kept = F.array_sort(F.filter(given, lambda f: f.contains("=") & names.contains(F.concat(F.lit("|"), F.substring_index(f, "=", 1), F.lit("|")))))
    chosen = F.when(F.size(kept) > 0, F.array_join(kept, "|")).otherwise(F.lit("_"))
    return F.when(feats.isNull() | feats.isin("", "_"), F.lit("_")).when(names.isNull(), feats).otherwise(chosen)


def parse_reading(raw: Column, weight: Column) -> Column:
    """The reading in a transducer's output string; null without a lemma or tags."""
    clean = F.regexp_replace(raw, r"(?U)^\s+|\s+$", "")
    clean = F.element_at(F.split(clean, "\t"), -1)
    clean = F.when(clean.rlike(r"(?s)^\^.*\$$") & (F.length(clean) > 1), F.regexp_replace(clean, r"(?s)^\^(.*)\$$", "$1")).otherwise(clean)
    clean = F.regexp_replace(F.element_at(F.split(clean, "/"), -1), "@[^@]+@", "")
    lemma, tags = F.regexp_extract(clean, "^([^<]+)", 1), F.regexp_extract_all(clean, F.lit("<([^>]+)>"), F.lit(1))
    reading = F.struct(lemma.alias("lemma"), F.try_element_at(tags, F.lit(1)).alias("pos"), F.slice(tags, 2, F.greatest(F.size(tags) - 1, F.lit(0))).alias("feats"), weight.cast("double").alias("weight"), raw.alias("raw"))
    return F.when((lemma != "") & (F.size(tags) > 0), reading)


def lookup(words: DataFrame, analyses: DataFrame, *keys: str, surface: str = "text") -> DataFrame:
    """Add ``readings``: those of the first form of the word (see functions.text.lookup_variants) that has any, else an empty array.

    ``analyses`` has (surface, raw, weight) of one language.  ``keys`` identify a word.
    """
    parsed = analyses.select(F.col("surface").alias("__v"), parse_reading(F.col("raw"), F.col("weight")).alias("__r")).where("__r is not null")
    known = parsed.groupBy("__v").agg(F.collect_list("__r").alias("__readings"))
    forms = words.select(*keys, F.posexplode(T.lookup_variants(F.col(surface))).alias("__rank", "__v"))
    best = forms.join(known, "__v").groupBy(*keys).agg(F.min_by("__readings", "__rank").alias("readings"))
    return words.join(best, list(keys), "left").withColumn("readings", F.coalesce("readings", F.array().cast(best.schema["readings"].dataType)))


def sentence_context(words: DataFrame, *sentence: str) -> DataFrame:
    """Add punct, final (last word that isn't punctuation), initial (the first) and before_question.

    The word that follows is the next one that isn't punctuation.
    """
    w = words.withColumn("punct", T.is_punctuation(F.col("text")))
    whole = Window.partitionBy(*sentence)
    after = whole.orderBy("id").rowsBetween(1, Window.unboundedFollowing)
    real = F.when(~F.col("punct"), F.col("id"))
    following = F.first(F.when(~F.col("punct"), F.col("text")), ignorenulls=True).over(after)
    return w.select("*", (F.max(real).over(whole) == F.col("id")).alias("final"), (F.min(real).over(whole) == F.col("id")).alias("initial"), F.coalesce(T.is_question_particle(following), F.lit(False)).alias("before_question"))


def counted_forms(docs: DataFrame, text: str = "text") -> DataFrame:
    """(text, initial, n): how often each word of the texts begins its sentence, as in :func:`sentence_context`, and how often it doesn't.

    For parts of speech by :func:`fallback` without a lexicon.  It treats words of ASCII letters alone alike, but for the case of the
    first: they are counted as A and a.  Each chunk of texts counts its words before they are shuffled, and no sentence is.
    """

    def rows(texts: pa.Array) -> tuple[np.ndarray, list[pa.Array]]:
        w = B.words(texts, marks=True)
        real = np.flatnonzero(w.marks < w.length)
        sent = w.sent[real]
        initial = np.zeros(len(w.sent), np.int64)
        initial[real[np.concatenate(([True], sent[1:] != sent[:-1]))] if len(real) else real] = 1
        kinds = np.bincount((w.code[w.plain] <= ord("Z")) * 2 + initial[w.plain], minlength=4)
        forms = w.text.filter(pa.array(~w.plain)).dictionary_encode()
        key, n = np.unique(np.asarray(forms.indices).astype(np.int64) * 2 + initial[~w.plain], return_counts=True)
        text = pa.concat_arrays([pa.array(["a", "a", "A", "A"]), forms.dictionary.take(pa.array(key >> 1))])
        n = np.concatenate((kinds, n)).astype(np.int64)
        used = pa.array(n > 0)
        out = [text, pa.array(np.concatenate(([0, 1, 0, 1], key % 2)) == 1), pa.array(n)]
        return np.zeros(int((n > 0).sum()), np.int64), [x.filter(used) for x in out]

    return B.mapped(docs, (), text, "text string, initial boolean, n bigint", rows).groupBy("text", "initial").agg(F.sum("n").alias("n"))


_FINITE = "aor fut ifi past pres".split()
_MOODS = "cond imp ind neces opt".split()
_VERBAL = [*_FINITE, *_MOODS, *"cvb ger inf part pass prog rcp".split()]
_CASES = "abl acc dat equ gen ins loc nom".split()
_ORDER = {tag: i for i, tag in enumerate("v vaux n np adj adv prn det".split())}


def context_score(reading: Column, text: Column, final: Column, before_question: Column, lexicon_upos: Column) -> Column:
    """How well a reading suits its place: the higher the better."""
    pos, feats = reading["pos"], reading["feats"]
    has = lambda tags: F.arrays_overlap(feats, F.array(*map(F.lit, tags)))
    points = lambda when, n: F.when(when, n).otherwise(0)
    verb, upper = pos.isin("v", "vaux"), T.starts_upper(text)
    return (
        F.when(final, points(verb, 3) + points(pos.isin("n", "np"), -2) + points(has(_FINITE), 1)).otherwise(points(verb & has(_FINITE + _MOODS) & ~before_question, -2))
        + points(pos.isin(*"adj adv det n np num prn".split()) & has(_VERBAL), -3)
        + points(verb & has(_CASES) & ~F.array_contains(feats, "part"), -1)
        + points(upper & (pos == "np"), 1)
        + points(upper & verb & F.array_contains(feats, "imp"), -2)
        + points(F.coalesce(F.array_contains(lexicon_upos, ud_pos(pos)), F.lit(False)), 2)
    )


def best_reading(readings: Column, text: Column, final: Column, before_question: Column, lexicon_upos: Column) -> Column:
    """The reading of the least weight; then of the best score, the first part of speech, the fewest tags, the first place."""
    priority = lambda r: F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in _ORDER.items() for x in kv]), r["pos"]), F.lit(99))
    keyed = F.transform(
        readings,
        lambda r, i: F.struct(
            F.coalesce(r["weight"], F.lit(0.0)).alias("w"), (-context_score(r, text, final, before_question, lexicon_upos)).alias("s"), priority(r).alias("p"), F.size(r["feats"]).alias("n"), i.alias("i")
        ),
    )
    return F.when(F.size(readings) > 0, F.get(readings, F.array_min(keyed)["i"]))


def fallback(text: Column, initial: Column, lexicon: Column, form: Column | None = None) -> Column:
    """struct<lemma,upos,feats> for a word without readings, or null.

    In this order: numbers; a capitalised word with a short ending after an apostrophe; a
    doubled word with a hyphen; a capitalised word that doesn't begin its sentence; the
    first lexicon entry (array<struct<upos,feats>>).  ``form`` is a column with the word's lookup form, where
    the caller has it: it is used in many places.
    """
    made = lambda lemma, upos, feats="_": F.struct(lemma.alias("lemma"), F.lit(upos).alias("upos"), F.lit(feats).alias("feats"))
    form = T.lookup_form(text) if form is None else form
    name = T.is_cased(text) & T.starts_upper(text)
    stem, ending = F.regexp_extract(form, "(?s)^([^']+)'(.*)$", 1), F.regexp_extract(form, "(?s)^([^']+)'(.*)$", 2)
    parts = F.filter(F.split(T.plain_hyphens(form), "-"), lambda p: p != "")
    # Null where they aren't two: normal forms are found for every row, ahead of the choice.
    left, right = (F.when(F.size(parts) == 2, F.get(parts, F.lit(k))) for k in (0, 1))
    entry = F.get(lexicon, F.lit(0))
    return (
        F.when(text.isNull() | (text == ""), None)
        .when(T.is_numeric(text), made(text, "NUM", "NumType=Card"))
        .when(name & ending.rlike(r"^\p{L}{1,4}$"), made(stem, "PROPN"))
        .when(T.plain_hyphens(form).contains("-") & (F.size(parts) == 2) & (T.lexeme_key(left) == T.lexeme_key(right)), made(F.lower(left), "ADV"))
        .when(name & ~initial, made(form, "PROPN"))
        .when(entry.isNotNull(), F.struct(F.lower(text).alias("lemma"), entry["upos"].alias("upos"), entry["feats"].alias("feats")))
    )


def with_lexicon(words: DataFrame, lexicon: DataFrame, text: str = "text", bridge=None) -> DataFrame:
    """Add ``lexicon``: the entries of the lower-cased word as array<struct<upos,feats>>, in order; null without any.

    ``lexicon`` has (form, upos, feats, ord) of one language, a few hundred rows.  ``bridge`` takes a
    column to the lexicon's script, for words that aren't found as they are.
    """
    entries = lexicon.groupBy(F.col("form").alias("__form")).agg(F.array_sort(F.collect_list(F.struct("ord", "upos", "feats"))).alias("__e"))
    entries = entries.select("__form", F.transform("__e", lambda e: F.struct(e["upos"].alias("upos"), e["feats"].alias("feats"))).alias("lexicon"))
    out = words.join(entries, F.lower(F.col(text)) == F.col("__form"), "left").drop("__form")
    if bridge is None:
        return out
    more = entries.withColumnsRenamed({"__form": "__form2", "lexicon": "__lexicon2"})
    return out.join(more, F.lower(bridge(F.col(text))) == F.col("__form2"), "left").withColumn("lexicon", F.coalesce("lexicon", "__lexicon2")).drop("__form2", "__lexicon2")


def annotate(words: DataFrame, analyses: DataFrame, lexicon: DataFrame, lang: str, *sentence: str, to_model=None, from_model=None) -> DataFrame:
    """Lemma, upos and feats of words (the sentence's columns, id, text, upos, ...) from analyses.

    ``to_model`` and ``from_model`` take a column to the script of the analyses and a lemma back.
    Punctuation is its own lemma; a word that nothing is known of is its own lemma with X and "_".
    """
    w = sentence_context(words, *sentence)
    if "lexicon" not in w.columns:
        w = with_lexicon(w, lexicon, bridge=to_model)
    w = w.withColumn("__surface", to_model(F.col("text")) if to_model else F.col("text"))
    w = lookup(w, analyses, *sentence, "id", surface="__surface")
    upos_of = F.transform("lexicon", lambda e: e["upos"])
    punct = F.col("punct") | F.coalesce(F.col("upos") == "PUNCT", F.lit(False))
    w = w.withColumn("__best", best_reading(F.col("readings"), F.col("text"), F.col("final"), F.col("before_question"), upos_of))
    w = w.withColumn("__other", F.when(F.col("__best").isNull(), fallback(F.col("text"), F.coalesce("initial", F.lit(False)), F.col("lexicon"))))
    lemma = from_model(F.col("__best.lemma")) if from_model else F.col("__best.lemma")
    pos = ud_pos(F.col("__best.pos"))
    known = F.col("__best").isNotNull()
    out = {
        "lemma": F.when(punct, F.col("text")).when(known, lemma).otherwise(F.coalesce("__other.lemma", "text")),
        "upos": F.when(punct, F.lit("PUNCT")).when(known, pos).otherwise(F.coalesce(F.col("__other.upos"), F.col("upos"), F.lit("X"))),
        "feats": F.when(punct, F.lit("_")).when(known, allowed_feats(pos, ud_feats(F.col("__best.feats"), lang))).otherwise(F.coalesce(F.col("__other.feats"), F.col("feats"), F.lit("_"))),
    }
    return w.withColumns(out).drop("punct", "final", "initial", "before_question", "lexicon", "readings", "__surface", "__best", "__other")


def generate(requests: DataFrame, analyses: DataFrame, *keys: str) -> DataFrame:
    """The surface form of (keys, lemma, tags array<string>): that of the least weight, the first by spelling of equal ones, or null."""
    form = F.concat(F.col("lemma"), F.array_join(F.transform("tags", lambda t: F.concat(F.lit("<"), t, F.lit(">"))), ""))
    best = analyses.groupBy(F.col("raw").alias("__raw")).agg(F.min(F.struct("weight", "surface"))["surface"].alias("surface"))
    return requests.withColumn("__raw", form).join(best, "__raw", "left").drop("__raw")
