import random
import re
import unicodedata

import pytest
from pyspark.sql import functions as F

from steppe.functions import let
from steppe.functions import scripts as X
from steppe.functions import text as T
from steppe.functions import translit as R
from steppe.queries import _SPECIAL, _greedy
from steppe.resources import rows, table


def column(spark, values, f):
    given = spark.createDataFrame(list(enumerate(values)), "i int, x string")
    return [r.y for r in given.select("i", f(F.col("x")).alias("y")).orderBy("i").collect()]


def script_of(c):
    if unicodedata.category(c)[0] in "NPZSC":
        return None
    blocks = {"Latn": [(0x41, 0x24F), (0x1E00, 0x1EFF)], "Cyrl": [(0x400, 0x52F), (0x2DE0, 0x2DFF), (0xA640, 0xA69F)], "Arab": [(0x600, 0x6FF), (0x750, 0x77F), (0x8A0, 0x8FF), (0xFB50, 0xFDFF), (0xFE70, 0xFEFF)], "Orkh": [(0x10C00, 0x10C4F)]}
    return next((s for s, own in blocks.items() if any(a <= ord(c) <= b for a, b in own)), None)


def dominant(x):
    seen = [s for s in map(script_of, x) if s]
    return max(dict.fromkeys(seen), key=seen.count) if seen else None


def segments(x):
    out = []
    for c in x:
        s = script_of(c)
        if out and (s is None or s == out[-1][1]):
            out[-1][0] += c
        elif s:
            out.append([c, s])
    return [tuple(o) for o in out]


@pytest.fixture(scope="module")
def mixed():
    rng = random.Random(1)
    letters = "abzßıİéӘқғабвюدنيائ\U00010c34\U00010c02ªº×ّʻ1 2.,!\n"
    return ["".join(rng.choice(letters) for _ in range(rng.randrange(25))) for _ in range(300)] + ["", "аb", "bа", None]


def test_scripts_agree_with_a_character_loop(spark, mixed):
    assert column(spark, mixed, X.detect_script) == [None if x is None else dominant(x) for x in mixed]
    got = column(spark, mixed, X.script_segments)
    assert [[tuple(s) for s in g] for g, x in zip(got, mixed, strict=True) if x is not None] == [segments(x) for x in mixed if x is not None]


def test_script_must_suit_the_language(spark):
    known = F.array(F.lit("Latn"), F.lit("CTS"))
    assert column(spark, ["abc", "абв", "12"], lambda x: X.script_for_language(x, known)) == ["Latn", None, None]
    with pytest.raises(Exception, match="script not known"):
        column(spark, ["абв"], lambda x: X.script_for_language(x, known, strict=True))


@pytest.mark.parametrize("pair", [p for p in R.pairs() if p not in _SPECIAL][::4] + [("kaz", "Latn", "Cyrl"), ("ota", "Latn", "CTS")] if ("ota", "Latn", "CTS") in R.pairs() else [p for p in R.pairs() if p not in _SPECIAL][::4])
def test_tables_agree_with_greedy_matching(spark, pair):
    own = R.mapping(*pair)
    rng = random.Random(str(pair))
    letters = [*own, *(k.upper() for k in own), *(k.title() for k in own), *"xyz ,.İıЯ1ß"]
    texts = ["".join(rng.choice(letters) for _ in range(rng.randrange(20))) for _ in range(150)]
    assert column(spark, texts, lambda x: R.transliterate(x, *pair)) == [_greedy(t, own) for t in texts]


def test_turkmen_and_uzbek_e_by_the_letter(spark):
    rng = random.Random(3)
    texts = ["".join(rng.choice("еЕаиъьшнг бьЕ.ғӨү") for _ in range(rng.randrange(15))) for _ in range(200)]

    def by_letter(x, lang, after, soft):
        own = R.mapping(lang, "Cyrl", "Latn")
        out = []
        i = 0
        while i < len(x):
            two = x[i : i + 2]
            if len(two) == 2 and lang == "uzb" and (two in own or two.lower() in own):
                out.append(_greedy(two, own))
                i += 2
                continue
            c = x[i]
            if c in "еЕ":
                first = i == 0 or not x[i - 1].isalpha() or x[i - 1] in after
                v = soft if first else "e"
                out.append(v if c == "е" else v[0].upper() + v[1:])
            elif lang == "tuk" and c in "ъЪьЬ":
                pass
            else:
                out.append(_greedy(c, own))
            i += 1
        return "".join(out)

    for lang, after, soft in (("uzb", "аАеЕёЁиИйЙоОуУўЎыЫэЭюЮяЯьЬъЪ", "ye"), ("tuk", "иИөӨүҮәӘъЪ", "ýe")):
        assert column(spark, texts, lambda x, lang=lang: R.transliterate(x, lang, "Cyrl", "Latn")) == [by_letter(t, lang, after, soft) for t in texts]


def test_directions_without_a_table(spark):
    assert len(R.pairs()) == 57
    with pytest.raises(ValueError, match="no transliteration"):
        R.mapping("tur", "Latn", "Cyrl")
    assert column(spark, [None, ""], lambda x: R.transliterate(x, "kaz", "Cyrl", "Latn")) == [None, ""]


def test_unicode_helpers(spark):
    given = ["Çağrı İĞDIR", "éﬁ", None, "", "ı"]
    assert column(spark, given, T.nfc) == [None if x is None else unicodedata.normalize("NFC", x) for x in given]
    assert column(spark, given, T.strip_diacritics) == ["Cagrı IGDIR", "efi", None, "", "ı"]
    assert column(spark, given, T.strip_marks) == ["Cagrı IGDIR", "eﬁ", None, "", "ı"]
    assert column(spark, ["IĞDIR İI"], T.turkish_i) == ["ığDıR iı".replace("ğ", "Ğ")]
    assert column(spark, ["IĞDIR İI"], T.turkic_lower) == ["ığdır iı"]


def test_lookup_forms(spark):
    assert column(spark, ["a​b’’c'", "'", "ﬁ", None], T.lookup_form) == ["ab'c", "'", "fi", None]
    assert column(spark, ["Ş–X", ""], T.lookup_variants) == [["Ş–X", "ş–x", "Ş-X", "ş-x", "S-X", "s-x"], []]
    assert column(spark, ["Kış–"], T.lexeme_key) == ["kıs-"]


def test_predicates(spark):
    given = ["...", "a.", "", None, "1,5%", "-", "١٢", "1a", "Ev", "ев", "ا", "!Ev", "МЫ"]
    assert column(spark, given, T.is_punctuation) == [True, False, False, False, False, True, False, False, False, False, False, False, False]
    assert column(spark, given, T.is_numeric) == [x in ("1,5%", "١٢") for x in given]
    assert column(spark, given, T.is_cased) == [bool(x and re.search(r"[^\W\d_]", x) and (c := re.search(r"[^\W\d_]", x)[0]).lower() != c.upper()) for x in given]
    assert column(spark, given, T.starts_upper) == [x in ("Ev", "МЫ") for x in given]
    assert column(spark, given, T.is_question_particle) == [x == "МЫ" for x in given]


def test_let_and_labels(spark):
    assert column(spark, ["ab", None], lambda x: let(F.upper(x), lambda y: F.concat(y, y))) == ["ABAB", None]
    assert column(spark, ["uzb", "kaz"], lambda x: T.language_label(x, F.lit("Cyrl"))) == ["__label__uzn_Cyrl", "__label__kaz_Cyrl"]


def test_reference_tables(spark):
    assert table(spark, "lang_script").select("lang").distinct().count() == 24
    assert len({(r["surface"], r["lang"]) for r in rows("mwt")}) == len(rows("mwt"))
    assert all(r["code"].count("_") == 1 for r in rows("nllb"))
