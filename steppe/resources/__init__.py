"""Linguistic reference tables, kept as tab-separated files beside this module.

``translit``: (lang, source, target, out, graph); ``lang_script``: (lang, script, is_primary,
direction, fst_script, ord); ``lexicon``: (form, lang, type, upos, feats, ord, lemma);
``mwt``: (surface, lang, origin, pieces); ``nllb``: (code, iso3, is_default).
"""

from __future__ import annotations

from functools import cache
from importlib import resources

from pyspark.sql import DataFrame, SparkSession


@cache
def rows(name: str) -> list[dict[str, str]]:
    text = resources.files(__name__).joinpath(f"{name}.tsv").read_text(encoding="utf-8")
    head, *lines = text.rstrip("\n").split("\n")
    names = head.split("\t")
    return [dict(zip(names, line.split("\t"), strict=True)) for line in lines]


_INTS = {"is_primary", "ord", "is_default"}


def table(spark: SparkSession, name: str) -> DataFrame:
    """A reference table as a DataFrame: a few thousand rows at most, fixed with the release."""
    data = rows(name)
    names = list(data[0])
    schema = ", ".join(f"`{n}` {'int' if n in _INTS else 'string'}" for n in names)
    return spark.createDataFrame([tuple(int(r[n]) if n in _INTS else r[n] for n in names) for r in data], schema)
