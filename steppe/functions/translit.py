"""Transliteration between the scripts of a language, as native column expressions.

The tables are greedy longest-match rewritings: at each place the longest key wins, as it stands or in
lower case; in the latter case an initial capital is carried over.  Before they reach Spark, the keys
are expanded with their case variants, so that one exact lookup does.  A table whose keys are all
single characters becomes ``translate`` plus a ``replace`` for each longer output; others split
the text with one regular expression and look the pieces up.
"""

from __future__ import annotations

import itertools
from functools import cache

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..resources import rows

#: Private-use characters that stand for letters whose reading depends on their neighbours.
_SOFT, _CAPITAL_SOFT = "\U000f0000", "\U000f0001"
_SPARE = 0xF0100


@cache
def _lower_of() -> dict[str, list[str]]:
    """Characters by the small letter that they have."""
    out: dict[str, list[str]] = {}
    for cp in range(0x80, 0x1E944):
        c = chr(cp)
        if c.lower() != c:
            out.setdefault(c.lower(), []).append(c)
    for cp in range(0x41, 0x5B):
        out.setdefault(chr(cp).lower(), []).append(chr(cp))
    return out


def pairs() -> list[tuple[str, str, str]]:
    """All (language, source, target) that have a table."""
    return sorted({(r["lang"], r["source"], r["target"]) for r in rows("translit")})


def mapping(lang: str, source: str, target: str) -> dict[str, str]:
    """The table of a language and direction; ``ValueError`` if there is none."""
    own = [r for r in rows("translit") if (r["lang"], r["source"], r["target"]) == (lang, source, target)]
    if not own:
        raise ValueError(f"no transliteration from {source} to {target} for {lang}")
    return {r["graph"]: r["out"] for r in own if r["graph"]}


def expanded(table: dict[str, str]) -> dict[str, str]:
    """The table with all case variants of its keys."""
    out: dict[str, str] = {}
    for key, value in table.items():
        for chars in itertools.product(*[[c, *_lower_of().get(c, [])] for c in key]):
            variant = "".join(chars)
            if variant.lower() == key and variant not in out:
                capital = variant[0].isupper()
                out[variant] = value[:1].upper() + value[1:] if capital and value else value
    return out | table


def rewrite(text: Column, table: dict[str, str]) -> Column:
    """Greedy longest-match rewriting by an expanded table."""
    table = {k: v for k, v in table.items() if k != v or len(k) > 1}
    if not table:
        return text
    if all(len(k) == 1 for k in table):
        single = {k: v for k, v in table.items() if len(v) <= 1}
        longer = {k: v for k, v in table.items() if len(v) > 1}
        marks = {k: chr(_SPARE + i) for i, k in enumerate(longer)}
        kept = [k for k, v in single.items() if v]
        gone = [k for k, v in single.items() if not v]
        source = "".join(kept) + "".join(longer) + "".join(gone)
        out = F.translate(text, source, "".join(single[k] for k in kept) + "".join(marks.values()))
        for k, v in longer.items():
            out = F.replace(out, F.lit(marks[k]), F.lit(v))
        return out
    quoted = lambda k: "".join(f"\\x{{{ord(c):x}}}" for c in k)
    several = sorted((k for k in table if len(k) > 1), key=lambda k: (-len(k), k))
    firsts = "".join(quoted(c) for c in sorted({k[0] for k in table}))
    pattern = "(" + "|".join([*map(quoted, several), f"[{firsts}]", f"[^{firsts}]+"]) + ")"
    lookup = F.create_map(*[F.lit(x) for k in sorted(table) for x in (k, table[k])])
    return F.array_join(F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(1)), lambda z: F.coalesce(F.try_element_at(lookup, z), z)), "")


def _soft_e(text: Column, after: str) -> Column:
    """Mark each Cyrillic e that begins a word or follows one of the characters."""
    small = F.regexp_replace(text, rf"(?<!\p{{L}})е|(?<=[{after}])е", _SOFT)
    return F.regexp_replace(small, rf"(?<![\p{{L}}{_SOFT}])Е|(?<=[{after}])Е" + (f"|(?<={_SOFT})Е" if "е" in after else ""), _CAPITAL_SOFT)


def _e_as(soft: str) -> dict[str, str]:
    """The readings of plain and marked e."""
    return dict(zip(f"еЕ{_SOFT}{_CAPITAL_SOFT}", ("e", "E", soft, soft.capitalize()), strict=True))


_AFTER_UZB = "аАеЕёЁиИйЙоОуУўЎыЫэЭюЮяЯьЬъЪ"
_AFTER_TUK = "иИөӨүҮәӘъЪ"

# Uyghur: the same letters in Arabic, Common Turkic and Cyrillic spelling, in the order in which they are replaced.
_UIG = """ا a а
ە e ә
ب b б
پ p п
ت t т
ج c җ
چ ç ч
خ x х
د d д
ر r р
ز z з
ژ j ж
س s с
ش ş ш
ف f ф
ڭ ñ ң
لا la ла
ل l л
م m м
ھ h һ
و o о
ۇ u у
ۆ ö ө
ۈ ü ү
ۋ v в
ې é е
ى i и
ي y й
ق q қ
ك k к
گ g г
ن n н
غ ğ ғ"""
_ARAB, _COMMON, _CYRL = zip(*(line.split() for line in _UIG.split("\n")), strict=True)
_HAMZA = "ئ"
_VOWELS, _CONSONANTS, _ARAB_VOWELS = "aeéiouöü", "bptcçxdrzjsşfñlmhvyqkgnğ", "اەېىوۇۆۈ"


def _chain(text: Column, steps: list[tuple[str, str]]) -> Column:
    for a, b in steps:
        text = F.replace(text, F.lit(a), F.lit(b))
    return text


def _swap(text: Column, source: tuple[str, ...], target: tuple[str, ...]) -> Column:
    return _chain(text, list(zip(source, target, strict=True)))


def _latin_to_common(text: Column) -> Column:
    return _chain(text, [("j", "c"), ("ng", "ñ"), ("n'g", "ng"), ("'ng", "ñ"), ("ch", "ç"), ("zh", "j"), ("sh", "ş"), ("'gh", "ğ"), ("gh", "ğ"), ("w", "v")])


def _common_to_latin(text: Column) -> Column:
    apart = [(a + b, f"{a}'{b}") for a, b in ("ng", "sh", "ch", "zh", "gh")] + [("nğ", "n'gh")]
    return _chain(text, [*apart, ("ñ", "ng"), ("j", "zh"), ("c", "j"), ("ç", "ch"), ("ş", "sh"), ("ğ", "gh"), ("v", "w")])


def _arab_to_common(text: Column, keep: bool) -> Column:
    """To Common Turkic; the sign between vowels is kept as an apostrophe or dropped."""
    text = _swap(text, _ARAB, _COMMON)
    text = F.regexp_replace(text, rf"(?<=[^{_VOWELS}{_CONSONANTS}]|^){_HAMZA}", "")
    if not keep:
        text = F.regexp_replace(text, rf"([{_VOWELS}]){_HAMZA}", "$1")
    return F.replace(text, F.lit(_HAMZA), F.lit("'"))


def _common_to_arab(text: Column) -> Column:
    """To Arabic letters, with the sign before every vowel that no consonant precedes."""
    text = F.regexp_replace(text, rf"(?<=[^{_CONSONANTS}]|^)([{_VOWELS}])", f"{_HAMZA}$1")
    text = F.replace(_swap(text, _COMMON, _ARAB), F.lit("'"), F.lit(""))
    return F.regexp_replace(text, rf"(?U)(^|-|\s|[{_ARAB_VOWELS}])([{_ARAB_VOWELS}])", f"$1{_HAMZA}$2")


_JOINED = [("ya", "я"), ("yu", "ю")]
_APART = [(b, a) for a, b in _JOINED]
_UYGHUR = {
    ("Latn", "Arab"): lambda t: _common_to_arab(_latin_to_common(F.lower(t))),
    ("Arab", "Latn"): lambda t: _common_to_latin(F.lower(_arab_to_common(t, keep=True))),
    ("Arab", "Cyrl"): lambda t: _swap(_chain(_arab_to_common(t, keep=True), _JOINED), _COMMON, _CYRL),
    ("Cyrl", "Arab"): lambda t: _common_to_arab(_chain(_swap(t, _CYRL, _COMMON), _APART)),
    ("Cyrl", "Latn"): lambda t: _common_to_latin(_chain(_swap(t, _CYRL, _COMMON), _APART)),
    ("Latn", "Cyrl"): lambda t: _swap(_chain(_latin_to_common(F.lower(t)), _JOINED), _COMMON, _CYRL),
    ("Arab", "CTS"): lambda t: _arab_to_common(t, keep=False),
    ("CTS", "Arab"): _common_to_arab,
    ("Latn", "CTS"): lambda t: _latin_to_common(F.lower(t)),
    ("CTS", "Latn"): lambda t: _common_to_latin(F.lower(t)),
}


def transliterate(text: Column, lang: str, source: str, target: str) -> Column:
    """The text in the target script; null stays null.  ``ValueError`` if the direction has no table."""
    table = mapping(lang, source, target)
    if lang == "uig" and (source, target) in _UYGHUR:
        return _UYGHUR[source, target](text)
    if (lang, source, target) == ("uzb", "Cyrl", "Latn"):
        return rewrite(_soft_e(text, _AFTER_UZB), expanded(table) | _e_as("ye"))
    if (lang, source, target) == ("tuk", "Cyrl", "Latn"):
        drop = dict.fromkeys("ъЪьЬ", "")
        return rewrite(_soft_e(text, _AFTER_TUK), expanded(table) | drop | _e_as("ýe"))
    if (lang, source, target) == ("uzb", "Latn", "Cyrl"):
        variants = "‘’ʻʼʹ`"
        text = F.translate(text, variants, "'" * len(variants))
    table = expanded(table)
    if (lang, source, target) == ("tuk", "Latn", "Cyrl"):
        table |= {"ýe": "е", "ýE": "е", "Ýe": "Е", "ÝE": "Е"}
    return rewrite(text, table)


__all__ = ["expanded", "mapping", "pairs", "rewrite", "transliterate"]
