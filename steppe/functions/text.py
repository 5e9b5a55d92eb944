"""Unicode helpers and token predicates.

Everything is a native expression but for the normal forms, which Spark lacks: those are
Arrow-vectorised functions.
"""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import StringType

ZERO_WIDTH = "​‌‍﻿"
APOSTROPHES = "’‘ʼʻʹ`´ˊˋ′ʽ"
HYPHENS = "‐‑‒–—―"
QUESTION_PARTICLES = tuple("ba be ma me mi mu my mü mı pa pe ба бе до ду дуо дë ма ме мо мы мү па пе по".split())



@pandas_udf(StringType())
def nfc(s: pd.Series) -> pd.Series:
    """Normal form C."""
    return s.map(lambda x: unicodedata.normalize("NFC", x), na_action="ignore")


@pandas_udf(StringType())
def nfkc(s: pd.Series) -> pd.Series:
    """Normal form KC."""
    return s.map(lambda x: unicodedata.normalize("NFKC", x), na_action="ignore")


def _drop_combining(x: str) -> str:
    return "".join(c for c in unicodedata.normalize("NFKD", x) if not unicodedata.combining(c))


def _drop_marks(x: str) -> str:
    return unicodedata.normalize("NFC", "".join(c for c in unicodedata.normalize("NFD", x) if unicodedata.category(c) != "Mn"))


@pandas_udf(StringType())
def strip_diacritics(s: pd.Series) -> pd.Series:
    """Compatibility decomposition without its combining characters; dotless i stays."""
    return s.map(_drop_combining, na_action="ignore")


@pandas_udf(StringType())
def strip_marks(s: pd.Series) -> pd.Series:
    """Canonical decomposition without non-spacing marks, composed again."""
    return s.map(_drop_marks, na_action="ignore")


def turkish_i(x: Column) -> Column:
    """Dotted and dotless capital I to their small letters, and nothing else."""
    return F.translate(x, "Iİ", "ıi")


def turkic_lower(x: Column) -> Column:
    """Small letters with the Turkic pairs of i."""
    return F.lower(turkish_i(x))


def lookup_form(x: Column) -> Column:
    """Form under which a word is looked up: NFKC, no zero-width characters, plain single apostrophes and none at the end."""
    plain = F.translate(F.translate(nfkc(x), ZERO_WIDTH, ""), APOSTROPHES, "'" * len(APOSTROPHES))
    one = F.regexp_replace(plain, "'+", "'")
    return F.when((F.length(one) > 1) & F.endswith(one, F.lit("'")), F.regexp_replace(one, "'+$", "")).otherwise(one)


def plain_hyphens(x: Column) -> Column:
    return F.translate(x, HYPHENS, "-" * len(HYPHENS))


def lookup_variants(x: Column) -> Column:
    """Forms to look a word up by, in order, without empty and repeated ones."""
    form = plain_hyphens(lookup_form(x))
    bare = strip_marks(form)
    return F.filter(F.array_distinct(F.array(x, F.lower(x), form, F.lower(form), bare, F.lower(bare))), lambda v: v != "")


def lexeme_key(x: Column) -> Column:
    return F.lower(strip_marks(plain_hyphens(lookup_form(x))))


def is_punctuation(x: Column) -> Column:
    return F.coalesce(x.rlike(r"^\p{P}+$"), F.lit(False))


def is_numeric(x: Column) -> Column:
    """At least one digit, and otherwise only separators and signs."""
    return F.coalesce(x.rlike(r"^[\p{Nd}.,/\-%+]*\p{Nd}[\p{Nd}.,/\-%+]*$"), F.lit(False))


def is_cased(x: Column) -> Column:
    """Whether the first letter has a case."""
    letter = F.regexp_extract(x, r"(\p{L})", 1)
    return F.coalesce(F.lower(letter) != F.upper(letter), F.lit(False))


def starts_upper(x: Column) -> Column:
    return F.coalesce(x.rlike(r"^\p{Lu}"), F.lit(False))


def is_question_particle(x: Column) -> Column:
    return F.coalesce(F.lower(x).isin(*QUESTION_PARTICLES), F.lit(False))


def apply_edit_script(word: Column, script: Column) -> Column:
    """Lemma from an edit script: "0" keeps the lower-cased word, "-n+suffix" cuts n characters and adds the suffix.

    "<unk>" gives the lower-cased word.  A script that isn't of these forms gives null.
    """
    base = nfc(F.lower(word))
    cut = F.abs(F.regexp_extract(script, r"^-?(\d+)", 1).try_cast("int"))
    add = F.regexp_extract(script, r"^-?\d+\+(?s:(.*))$", 1)
    kept = F.substring(base, F.lit(1), F.greatest(F.length(base) - cut, F.lit(0)))
    return F.when(script.isin("0", "<unk>"), base).when(cut.isNotNull(), F.concat(kept, add))


def char_ids(word: Column, longest: int = 32, vocabulary: int = 512) -> Column:
    """Ids of the first characters of a word: 1 and the code point modulo vocabulary - 1; padded with 0."""
    chars = F.slice(F.filter(F.split(word, ""), lambda c: c != ""), 1, longest)
    ids = F.transform(chars, lambda c: F.ascii(c) % (vocabulary - 1) + 1)
    return F.concat(ids, F.array_repeat(F.lit(0), F.lit(longest) - F.size(ids)))


def language_label(lang: Column, script: Column) -> Column:
    """Label of a language and script in language identification models."""
    return F.concat(F.lit("__label__"), F.when(lang == "uzb", F.lit("uzn")).otherwise(lang), F.lit("_"), script)
