"""Segmentation of words into morphemes by suffix tables.

The suffix table comes from the user: (key, ord, context, forms), where context lists the classes of
the character before the suffix for which the entry holds (V vowel, S liquid, N nasal, D voiced, T voiceless)
and forms are given by vowel harmony, either B/F (back, front) or BU/FU/BR/FR (with rounding).

Matching consumes a word from left to right with a state, which expressions over arrays can't do
without quadratic copying, so the operator is one Arrow-vectorised function.
"""

from __future__ import annotations

import json
from collections.abc import Iterable
from dataclasses import dataclass
from functools import cache, lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import ArrayType, StringType, StructField, StructType

SCHEMA = StructType(
    [StructField("morphemes", ArrayType(StructType([StructField("surface", StringType()), StructField("label", StringType())]))), StructField("source", StringType())]
)


#: (surface, label) of each morpheme.
Morphemes = list[tuple[str, str]]


@dataclass(frozen=True)
class Sounds:
    """Vowels and consonants of a script; whatever isn't Latin is treated as Cyrillic."""

    back: frozenset[str]
    front: frozenset[str]
    liquid: frozenset[str]
    nasal: frozenset[str]
    voiced: frozenset[str]

    @property
    def vowels(self) -> frozenset[str]:
        return self.back | self.front


def _both(x: str) -> frozenset[str]:
    return frozenset(x) | frozenset(x.upper())


_SOUNDS = {
    "Latn": Sounds(frozenset("aouAOUāĀıI"), frozenset("eöüEÖÜəƏiİ"), _both("rly"), _both("mnñňŋ"), _both("bdgğjvz")),
    "Cyrl": Sounds(_both("аоұыуӑ"), _both("еөүіэĕӳ"), _both("рлй"), _both("мнң"), _both("бвгғджз")),
}
_ROUND = _both("оөұүoöuü")

LABELS = dict(
    pair.split("=")
    for pair in (
        "abl=ABL acc=ACC aor=AOR attr=ATTR caus=CAUS cond=COND coop=RECIP dat=DAT equ=EQU evid=EVID fut=FUT gen=GEN imp=IMP ins=INS loc=LOC ly=ADJ lyk=NMLZ neces=NEC neg=NEG "
        "neg_aor=NEG.AOR neg_pres=NEG.PRS neg_prog=NEG.PROG opt=OPT p1pl=1PL p1sg=1SG p2pl=2PL p2sg=2SG p3pl=3PL p3sg=3SG pass=PASS past=PST pl=PLUR prc_pres=PTCP.PRS pres=PRS prog=PROG "
        "px1pl=POSS.1PL px1sg=POSS.1SG px2pl=POSS.2PL px2sg=POSS.2SG px2sg_frm=POSS.2SG.FRM px3pl=POSS.3PL px3sg=POSS.3SG px3sp=POSS.3SG shi=AGT siz=PRIV subst=SUBST "
        "gna_perf=CVB.PRF gna_impf=CVB.IPFV prc_perf=PTCP.PST prc_impf=PTCP.IPFV prc_fut=PTCP.FUT inf=INF ger=GER ger_past=GER.PST cop=COP qst=Q"
    ).split()
)
#: Tags without a morpheme of their own, and those whose key isn't their name.
_SILENT = frozenset("abbr adj adv cnjadv cnjcoo cnjsub det ij ind n nom np num part post prn sg v vaux".split())
_KEYS = {f"p{n}": f"p{n}sg" for n in "123"}
_TAGS = frozenset("abl acc aor attr caus cond coop cop dat equ evid fut gen ger ger_past gna_impf gna_perf imp inf ins loc ly lyk neces neg opt p1 p2 p3 pass past pl prc_fut prc_impf prc_perf pres px1pl px1sg px2pl px2sg px2sg_frm px3pl px3sg px3sp qst shi siz subst".split())
#: Suffixes in the order in which they follow a noun or a verb, each with the features that call for it.
_NOUN_ORDER = """pl Number=Plur
px1sg Number[psor]=Sing Person[psor]=1; px2sg Number[psor]=Sing Person[psor]=2; px3sg Number[psor]=Sing Person[psor]=3
px1pl Number[psor]=Plur Person[psor]=1; px2pl Number[psor]=Plur Person[psor]=2; px3pl Number[psor]=Plur Person[psor]=3
px1pl Poss=Yes Person=1; px2pl Poss=Yes Person=2; px3pl Poss=Yes Person=3
px1sg Poss=Yes Person=1; px2sg Poss=Yes Person=2; px3sg Poss=Yes Person=3
px1sg Number=Sing Person=1; px2sg Number=Sing Person=2; px3sg Number=Sing Person=3
acc Case=Acc; dat Case=Dat; loc Case=Loc; abl Case=Abl; gen Case=Gen; ins Case=Ins; equ Case=Equ"""
_VERB_ORDER = """pass Voice=Pass; caus Voice=Cau; coop Voice=Rcp
neg_pres Polarity=Neg Tense=Pres; neg_aor Polarity=Neg Tense=Aor; neg_prog Polarity=Neg Aspect=Prog; neg Polarity=Neg
gna_perf VerbForm=Conv; prc_perf VerbForm=Part; inf VerbForm=Inf; ger VerbForm=Ger
prog Aspect=Prog; past Tense=Past; pres Tense=Pres; fut Tense=Fut; aor Tense=Aor
evid Aspect=Perf; evid Evidentiality=Fh; imp Mood=Imp; opt Mood=Opt; cond Mood=Cnd; neces Mood=Nec
p1pl Number=Plur Person=1; p2pl Number=Plur Person=2; p3pl Number=Plur Person=3; p1sg Number=Sing Person=1; p2sg Number=Sing Person=2
p3sg Person=3; p1sg Person=1; p2sg Person=2; pl Number=Plur"""


@cache
def _order(verb: bool) -> list[tuple[str, frozenset[str]]]:
    items = [x.split() for line in (_VERB_ORDER if verb else _NOUN_ORDER).split("\n") for x in line.split(";")]
    return [(key, frozenset(need)) for key, *need in items]


#: Final consonants that change before a vowel.
def _changes(x: str) -> dict[str, str]:
    return dict(x.split())


_OGHUZ, _KIPCHAK = _changes("pb td çc kg"), _changes("пб кг")
ALTERNATIONS = dict.fromkeys(("crh", "gag", "tuk"), _OGHUZ) | dict.fromkeys(("bak", "kir", "tat"), _KIPCHAK)
ALTERNATIONS |= dict(aze=_OGHUZ | _changes("ky"), tur=_OGHUZ | _changes("kğ"), kaz=_KIPCHAK | _changes("қғ"), uzb=_changes("kg pb"))
_INFINITIVES = ("maq mək mak mek moq maa mää макъ мекъ уу үү ыу еү".split(), "у ү ю".split())
_NEGATIVES = "маст мест meýar meýär бай бей пай пей бас бес пас пес май мей мәй мый may mey маз мез maz məz мір мир mir mır meer ма ме мо мө ma me mo mö mə".split()
_APOSTROPHES = ("'", "’")


def lower(x: str) -> str:
    """Small letters with the Turkic pairs of i, character by character."""
    return "".join({"I": "ı", "İ": "i"}.get(c) or (c.lower() if len(c.lower()) == 1 else c) for c in x)


def sounds(script: str) -> Sounds:
    return _SOUNDS.get(script, _SOUNDS["Cyrl"])


def char_class(c: str, s: Sounds) -> str:
    for name, own in (("V", s.vowels), ("S", s.liquid), ("N", s.nasal), ("D", s.voiced)):
        if c in own:
            return name
    return "T"


def harmony(text: str, s: Sounds, ways: int = 2) -> str:
    """Of the last vowel: B or F, with U or R after it in four ways; back and unrounded without any vowel."""
    last = next((c for c in reversed(text) if c in s.vowels), None)
    side = "F" if last in s.front and last not in s.back else "B"
    return side if ways == 2 else side + ("R" if last in _ROUND else "U")


class Segmenter:
    """Segmentation for a language by one suffix table: key -> [(context, forms by harmony)]."""

    def __init__(self, table: dict[str, list[tuple[str, dict[str, str]]]], lang: str, script: str) -> None:
        self.table, self.lang, self.sounds = table, lang, sounds(script)

    def forms(self, key: str, before: str) -> Iterable[str]:
        """The forms that a suffix may have after a text, in table order."""
        kind = char_class(before[-1:], self.sounds)
        for context, forms in self.table.get(key, ()):
            if kind in context:
                yield forms.get(harmony(before, self.sounds, 4 if "BU" in forms else 2), "")

    def resolve(self, key: str, before: str) -> str | None:
        return next(iter(self.forms(key, before)), None)

    def longest(self, forms: Iterable[str], rest: str) -> str:
        fitting = [f for f in forms if f and lower(rest).startswith(lower(f))]
        return rest[: max(map(len, fitting))] if fitting else ""

    def any_form(self, key: str) -> list[str]:
        return [f for _, forms in self.table.get(key, ()) for f in forms.values()]

    def stem_end(self, word: str, lemma: str, upos: str = "") -> int:
        """Where suffixes begin: at an apostrophe, after the lemma, after its changed final, or where they part."""
        for a in _APOSTROPHES:
            if word.find(a) >= 0:
                if word.find(a) > 0:
                    return word.find(a)
                break
        verb, surface = upos in ("VERB", "AUX"), lower(word)
        if verb:
            lemma = strip_infinitive(lemma)
            for n in _NEGATIVES:
                small = lower(lemma)
                if small.endswith(n) and len(small) > len(n) and surface.startswith(small[: -len(n)]):
                    lemma = lemma[: -len(n)]
                    break
        base, vowels = lower(lemma), _SOUNDS["Latn"].vowels | _SOUNDS["Cyrl"].vowels
        if surface.startswith(base):
            end = len(lemma)
            linking = verb and base and base[-1] not in vowels and end < len(word) - 1 and surface[end] in "ыіı"
            return end + 1 if linking and surface[end + 1] not in vowels else end
        changed = ALTERNATIONS.get(self.lang, {}).get(base[-1:])
        if changed and surface.startswith(base[:-1] + changed):
            return len(lemma)
        common = next((i for i, (a, b) in enumerate(zip(surface, base, strict=False)) if a != b), min(len(surface), len(base)))
        return max(common, 1)

    def by_tags(self, word: str, end: int, tags: list[str]) -> Morphemes:
        """Consume the suffixes that transducer tags name; what is left is consumed greedily."""
        out, before, rest = [(word[:end], "STEM")], word[:end], word[end:]
        for tag in tags:
            if rest and tag in _TAGS and tag not in _SILENT:
                key = _KEYS.get(tag, tag)
                form = self.resolve(key, before)
                found = rest[: len(form)] if form and lower(rest).startswith(lower(form)) else self.longest(self.any_form(key), rest)
                if found:
                    out.append((found, LABELS.get(key, key.upper())))
                    before, rest = before + found, rest[len(found) :]
        return out + self.greedy(rest)

    def by_features(self, word: str, end: int, upos: str, feats: str) -> Morphemes:
        """Consume the suffixes that universal features call for; what is left is consumed greedily."""
        out, before, rest = [(word[:end], "STEM")], word[:end], word[end:]
        if not feats or feats == "_":
            return out + ([(rest, "?")] if rest else [])
        given, mark = set(feats.split("|")), ""
        if rest[:1] in _APOSTROPHES and rest:
            mark, rest = rest[0], rest[1:]
        used: set[str] = set()
        for key, need in _order(upos in ("VERB", "AUX")):
            if rest and key not in used and need <= given:
                found = self.longest(self.forms(key, before), rest)
                if found:
                    out.append((mark + found, LABELS.get(key, key.upper())))
                    mark, before, rest = "", before + found, rest[len(found) :]
                    used |= {key, *key.split("_")} if key.startswith("neg_") else {key}
        return out + (self.greedy(mark + rest) if rest else [])

    def greedy(self, rest: str) -> Morphemes:
        """Longest suffix first, in table order among equals; a rest that nothing matches is one "?"."""
        out, mark = [], ""
        if rest and rest[0] in _APOSTROPHES:
            mark, rest = rest[0], rest[1:]
        while rest:
            best, name = "", ""
            for key in self.table:
                for form in self.any_form(key):
                    left = len(rest) - len(form)
                    lone = len(form) < 2 and left > 0 and key not in ("pres", "aor", "dat", "loc")
                    crumb = left == 1 and lower(rest[-1]) not in "мнкрпmntk"
                    if form and len(form) > len(best) and not lone and not crumb and lower(rest).startswith(lower(form)):
                        best, name = rest[: len(form)], key
            if not best:
                return [*out, (mark + rest, "?")]
            out.append((mark + best, LABELS.get(name, name.upper())))
            mark, rest = "", rest[len(best) :]
        return out

    def segment(self, word: str, lemma: str | None, upos: str | None, feats: str | None, tags: list[str] | None) -> tuple[Morphemes, str]:
        """(morphemes, source): from tags, else from features, else the word as one stem.

        A word of several parts is segmented in its first; the others are labelled as personal pronouns.
        """
        if " " in word and word.split():
            first, *more = word.split()
            found, source = self.segment(first, lemma, upos, feats, tags)
            return found + [(p, _PRONOUNS.get(p, "?")) for p in more], source
        if len(word) < 2 or not sum(map(str.isalpha, word)):
            return [(word, "STEM")], "skip"
        if lemma is None:
            return [(word, "STEM")], "none"
        pos = upos or ""
        if tags is not None:
            return relabel(self.by_tags(word, self.stem_end(word, lemma, pos), tags), pos, feats or "_"), "tags"
        found = self.by_features(word, self.stem_end(word, lemma, pos), pos, feats or "_")
        if pos in ("NOUN", "ADJ") and len(found) > 1:
            unknown, infinitive = sum(b == "?" for _, b in found), lower(lemma).endswith(tuple(_INFINITIVES[0][:7]))
            if unknown or infinitive:
                other = self.by_features(word, self.stem_end(word, lemma, "VERB"), "VERB", feats or "_")
                left = sum(b == "?" for _, b in other)
                if left < unknown or (left == unknown and infinitive):
                    found, pos = other, "VERB"
        return relabel(found, pos, feats or "_"), "features"


_PRONOUNS = dict(x.split("=") for x in "бис=1PL мен=1SG олар=3PL ол=3SG сен=2SG силер=2PL".split())
_TENSES = frozenset("PST PRS AOR FUT EVID PROG NEG.AOR NEG.PRS NEG.PROG PTCP.PST PTCP.PRS PTCP.FUT CVB.PRF CVB.IPFV GER GER.PST".split())
_PERSONS = frozenset("1SG 2SG 3SG 1PL 2PL 3PL".split())
_CASE_OF = [(f"Case={c.title()}", c) for c in "DAT LOC ABL GEN ACC INS".split()]


def strip_infinitive(lemma: str) -> str:
    small = lower(lemma)
    for least, endings in enumerate(_INFINITIVES):
        for e in endings:
            if small.endswith(e) and len(small) > len(e) + least:
                return lemma[: -len(e)]
    return lemma


def relabel(found: Morphemes, upos: str, feats: str) -> Morphemes:
    """Correct labels by their neighbours and the features of the word."""
    if len(found) <= 1:
        return found
    given = set((feats or "_").split("|")) - {"_", ""}
    surface, label = [s for s, _ in found], [b for _, b in found]
    verb = upos in ("VERB", "AUX")
    if verb:
        tense = negative = fused = False
        for i, b in enumerate(label):
            negative |= b.startswith("NEG")
            fused |= b.startswith("NEG.")
            tense |= b in _TENSES
            if b.startswith("POSS."):
                label[i] = b[5:]
            elif b == "PLUR" and tense:
                label[i] = "3PL"
            elif b == "ACC":
                if negative and not tense:
                    label[i], tense = "PST", True
                elif fused or tense:
                    label[i] = "3SG"
            elif b == "INS" and (tense or negative):
                label[i] = "1SG"
        third = "Person=3" in given
        if not _PERSONS & set(label) and label[-1] in ("PST", "PRS", "AOR") and ((third and "Number=Plur" not in given) or (not third and "Number=Sing" in given)):
            label[-1] += ".3SG"
        for i, b in enumerate(label):
            if b == "EVID":
                after = label[i + 1] if i + 1 < len(label) else None
                if "VerbForm=Part" in given or after is None or after in (_PERSONS | {"PLUR"}) - {"3SG"}:
                    label[i] = "PTCP.PST"
                    if after == "3PL" and "VerbForm=Part" not in given:
                        label[i + 1] = "PLUR"
    for i, b in enumerate(label):
        if b == "?" and surface[i][:1] in _APOSTROPHES:
            label[i] = next((c for f, c in _CASE_OF if f in given), b)
    if not verb and (label[-1].startswith("POSS.") and label[-1] != "POSS.2SG.FRM" or label[-1] in "ABL ACC COND DAT EQU GEN INS LOC".split()):
        label[-1] = next((c for f, c in [("Case=Gen", "GEN"), *_CASE_OF] if f in given and c != label[-1]), label[-1])
    return list(zip(surface, label, strict=True))


def suffix_rows(table: DataFrame) -> str:
    """A suffix table (key, ord, context, forms map) as a constant for the workers; it has a few hundred rows."""
    out: dict[str, list] = {}
    for r in sorted(table.select("key", "ord", "context", "forms").collect(), key=lambda r: r["ord"]):
        out.setdefault(r["key"], []).append((r["context"], dict(r["forms"])))
    return json.dumps(out)


@lru_cache(maxsize=16)
def _segmenter(rows: str, lang: str, script: str) -> Segmenter:
    return Segmenter(json.loads(rows), lang, script)


def segment(word: Column, lemma: Column, upos: Column, feats: Column, tags: Column, rows: str, lang: str, script: str) -> Column:
    """struct<morphemes array<struct<surface,label>>, source> of each word; null for null words."""

    @pandas_udf(SCHEMA)
    def run(w: pd.Series, a: pd.Series, b: pd.Series, c: pd.Series, d: pd.Series) -> pd.DataFrame:
        own = _segmenter(rows, lang, script)
        found = [(None, None) if x is None else own.segment(x, y, p, f, None if t is None else list(t)) for x, y, p, f, t in zip(w, a, b, c, d, strict=True)]
        return pd.DataFrame({"morphemes": [None if m is None else [{"surface": s, "label": n} for s, n in m] for m, _ in found], "source": [s for _, s in found]})

    return F.when(word.isNotNull(), run(word, lemma, upos, feats, tags))


def segment_sentences(words: Column, rows: str, lang: str, script: str) -> Column:
    """Morphemes of nested words (array<array<struct<text,lemma,upos,feats>>>): array<array<array<struct<surface,label>>>>."""

    @pandas_udf("array<array<array<struct<surface:string,label:string>>>>")
    def run(docs: pd.Series) -> pd.Series:
        own = _segmenter(rows, lang, script)
        one = lambda w: [{"surface": s, "label": n} for s, n in own.segment(w["text"], w["lemma"], w["upos"], w["feats"], None)[0]]
        return docs.map(lambda d: None if d is None else [[one(w) for w in s] for s in d])

    return run(words)


def segment_text(text: Column, rows: str, lang: str, script: str) -> Column:
    """Morphemes of the words of a text that stand between white space, without annotation: each word as one stem."""
    from .segment import strip

    none = F.lit(None).cast("string")
    words = F.filter(F.split(strip(text), r"(?U)\s+"), lambda w: w != "")
    made = F.transform(words, lambda w: F.struct(w.alias("text"), none.alias("lemma"), none.alias("upos"), none.alias("feats")))
    return F.get(segment_sentences(F.array(made), rows, lang, script), F.lit(0))
