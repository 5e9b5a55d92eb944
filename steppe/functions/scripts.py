"""Which script a text is written in, as native column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import let

#: Letters and marks of each script, by Unicode block, as Java character classes.
CLASSES = {
    "Latn": r"[[\p{L}\p{M}]&&[\x{41}-\x{24F}\x{1E00}-\x{1EFF}]]",
    "Cyrl": r"[[\p{L}\p{M}]&&[\x{400}-\x{52F}\x{2DE0}-\x{2DFF}\x{A640}-\x{A69F}]]",
    "Arab": r"[[\p{L}\p{M}]&&[\x{600}-\x{6FF}\x{750}-\x{77F}\x{8A0}-\x{8FF}\x{FB50}-\x{FDFF}\x{FE70}-\x{FEFF}]]",
    "Orkh": r"[[\p{L}\p{M}]&&[\x{10C00}-\x{10C4F}]]",
}
_ANY = "[" + "".join(c for c in CLASSES.values()) + "]"


def script_count(text: Column, script: str) -> Column:
    """Number of characters of the script."""
    return F.regexp_count(text, F.lit(CLASSES[script]))


def _before_first(text: Column, script: str) -> Column:
    """Characters before the first one of the script."""
    return F.length(F.regexp_extract(text, f"(?s)^(.*?){CLASSES[script]}", 1))


def detect_script(text: Column) -> Column:
    """The script of most characters, of those with as many the one that comes first; null without any."""

    def best(counts: Column) -> Column:
        # Where two scripts are equally frequent, and only there, it matters which comes first.
        most = F.array_max(counts)
        tie = F.size(F.filter(counts, lambda n: n == most)) > 1
        first = [F.when(counts[i] == most, F.struct(F.when(tie, _before_first(text, s)).alias("first"), F.lit(s).alias("script"))) for i, s in enumerate(CLASSES)]
        return F.when(most > 0, F.array_min(F.filter(F.array(*first), lambda c: c.isNotNull()))["script"])

    return let(F.array(*[script_count(text, s) for s in CLASSES]), best)


def script_segments(text: Column) -> Column:
    """Runs of one script as array<struct<text,script>>.

    Other characters belong to the run before them; those before the first run are left out.
    """
    alternatives = []
    for s, own in CLASSES.items():
        others = "".join(c for t, c in CLASSES.items() if t != s)
        alternatives.append(f"{own}(?:(?![{others}])(?s:.))*+")
    found = F.regexp_extract_all(text, F.lit("(" + "|".join(alternatives) + ")"), F.lit(1))
    name = lambda seg: F.coalesce(*[F.when(seg.rlike("^" + c), F.lit(s)) for s, c in CLASSES.items()])
    return F.transform(found, lambda seg: F.struct(seg.alias("text"), name(seg).alias("script")))


def script_for_language(text: Column, available: Column, strict: bool = False) -> Column:
    """The detected script if it is among the available ones, else null (or an error if strict)."""
    script = detect_script(text)
    if not strict:
        return F.when(F.array_contains(available, script), script)
    return F.when(F.array_contains(available, script), script).otherwise(F.raise_error(F.concat(F.lit("script not known for the language: "), F.coalesce(script, F.lit("none")))))
