"""Stages that compose into one lazy plan over a table of documents."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as text_functions

from ..functions.scripts import detect_script
from ..functions.translit import pairs, transliterate
from ..operators.conllu import to_conllu, to_json
from ..operators.morphemes import segment_sentences, suffix_rows
from ..operators.morphology import annotate
from ..operators.neural import annotate_sentences, embed, translate
from ..operators.segment import expand_multiword, tokenize_by_script
from ..operators.segment import words as word_rows
from ..resources import rows, table

ORDER = tuple("script_detect transliterate tokenize mwt morph morph_neural pos feats lemma morphemes depparse ner embeddings translate sentiment transliterate_back".split())
#: Steps of the pipeline itself, which have no backend.
_IMPLICIT = frozenset(x for x in ORDER if x.startswith(("script", "translit")))


@dataclass(frozen=True)
class Stage:
    """A backend of a processor: builds a function from DataFrame to DataFrame from (lang, script, options).

    The tables that it reads and writes have doc columns and ``sentences``; it appends its name to ``log``.
    """

    build: Callable[[str, str, dict], Callable[[DataFrame], DataFrame]]
    requires: tuple[str, ...] = ()
    license: str | None = None


@dataclass
class Registry:
    """Backends by processor and name; the first registered one is the default."""

    stages: dict[str, dict[str, Stage]] = field(default_factory=dict)

    def register(self, processor: str, backend: str, stage: Stage) -> None:
        self.stages.setdefault(processor, {})[backend] = stage

    def get(self, processor: str, backend: str | None = None) -> Stage:
        own = self.stages.get(processor, {})
        if not own or (backend is not None and backend not in own):
            raise ValueError(f"no backend {backend or ''} for {processor}; there are {sorted(own)}")
        return own[backend] if backend is not None else next(iter(own.values()))


def resolve(requested: list[str], registry: Registry) -> list[str]:
    """The requested processors and what they require, in canonical order.

    Requirements are taken one level deep, from the first registered backend.  Names without a
    canonical place follow in the order requested; unknown ones stay and fail when they are built.
    """
    needed = set(requested)
    for name in requested:
        if registry.stages.get(name):
            needed |= set(registry.get(name).requires)
    ordered = [p for p in ORDER if p in needed]
    return ordered + [p for p in dict.fromkeys(requested) if p not in ordered]


def options_for(processor: str, options: dict) -> dict:
    """Options named ``{processor}_x``, as x; the choice of backend isn't one."""
    prefix = f"{processor}_"
    return {k[len(prefix) :]: v for k, v in options.items() if k.startswith(prefix) and k != f"{processor}_backend"}


def choose_backend(processor: str, script: str, options: dict, catalog: dict | None, registry: Registry) -> str:
    """The option, else the catalog's default, else its first, else the rule tokenizer, else the first registered."""
    known = (catalog or {}).get(processor, {})
    if options.get(f"{processor}_backend"):
        return options[f"{processor}_backend"]
    if known.get("default") or known.get("backends"):
        return known.get("default") or next(iter(known["backends"]))
    if processor == "tokenize":
        return "rule_arabic" if script == "Arab" else "rule"
    own = registry.stages.get(processor)
    if not own:
        raise ValueError(f"no backend for {processor}")
    return next(iter(own))


def logged(df: DataFrame, entry: str) -> DataFrame:
    return df.withColumn("log", F.array_append("log", F.lit(entry)))


def _tokenizer(kind: str):
    def build(lang: str, script: str, options: dict):
        name = "tokenize:arabic_script" if kind == "Arab" else "tokenize:regex"
        return lambda df: logged(tokenize_by_script(df, kind), name)

    return build


def _multiword(lang: str, script: str, options: dict):
    def run(df: DataFrame) -> DataFrame:
        rules = table(df.sparkSession, "mwt").where(F.col("lang") == lang).select("surface", F.split("pieces", " ").alias("pieces"))
        return logged(expand_multiword(df, rules), "mwt:rules")

    return run


def _needed(options: dict, name: str, processor: str):
    if options.get(name) is None:
        raise ValueError(f"{processor} needs the option {processor}_{name}")
    return options[name]


def _by_position(df: DataFrame, found: DataFrame, key: str, fields: tuple[str, ...]) -> DataFrame:
    """Set fields of the nested words from a table of words (key, sent_id, id, fields)."""
    of_sentence = found.groupBy(F.col(key).alias("of_key"), "sent_id").agg(F.array_sort(F.collect_list(F.struct("id", *fields))).alias("ws"))
    of_document = of_sentence.groupBy("of_key").agg(F.map_from_entries(F.collect_list(F.struct("sent_id", "ws"))).alias("found_words"))

    def merged(w, given):
        for f in fields:
            w = w.withField(f, F.coalesce(given[f], w[f]))
        return w

    words = lambda s, i: s.withField("words", F.transform(s["words"], lambda w, j: merged(w, F.get(F.try_element_at(F.col("found_words"), i), j))))
    return df.join(of_document, F.col(key) == F.col("of_key"), "left").withColumn("sentences", F.transform("sentences", words)).drop("of_key", "found_words")


def _analyses(lang: str, script: str, options: dict):
    """Options: ``analyses`` (surface, raw, weight), ``lexicon`` (form, upos, feats, ord; the shipped one of the language by default), ``key`` (doc_id)."""
    analyses, key = _needed(options, "analyses", "morph"), options.get("key", "doc_id")

    def run(df: DataFrame) -> DataFrame:
        lexicon = options.get("lexicon")
        if lexicon is None:
            lexicon = table(df.sparkSession, "lexicon").where(F.col("lang") == lang)
        found = annotate(word_rows(df, key), analyses, lexicon, lang, key, "sent_id")
        return logged(_by_position(df, found, key, ("lemma", "upos", "feats")), "morph:analyses")

    return run


def _model(processor: str, fields: tuple[str, ...]):
    """A model that sets fields of the words.  Options: ``factory`` (see :mod:`..operators.neural`), ``batch``."""

    def build(lang: str, script: str, options: dict):
        factory = _needed(options, "factory", processor)
        return lambda df: logged(annotate_sentences(df, factory, fields, batch=int(options.get("batch", 32))), f"{processor}:model")

    return build


def _embeddings(lang: str, script: str, options: dict):
    factory = _needed(options, "factory", "embeddings")
    return lambda df: logged(embed(df, factory, normalize=options.get("normalize", True)), "embeddings:model")


def _translation(lang: str, script: str, options: dict):
    factory = _needed(options, "factory", "translate")
    return lambda df: logged(translate(df, factory), "translate:model")


def _morphemes(lang: str, script: str, options: dict):
    """Adds ``morphemes``: for each sentence and word its surfaces and labels.  Option: ``suffixes`` (key, ord, context, forms)."""
    suffixes = _needed(options, "suffixes", "morphemes")

    def run(df: DataFrame) -> DataFrame:
        data = suffix_rows(suffixes)
        words = F.transform("sentences", lambda s: F.transform(s["words"], lambda w: F.struct(w["text"].alias("text"), w["lemma"].alias("lemma"), w["upos"].alias("upos"), w["feats"].alias("feats"))))
        return logged(df.withColumn("morphemes", segment_sentences(words, data, lang, script)), "morphemes:rules")

    return run


def default_registry() -> Registry:
    """Every processor with its backends; those with a model or tables of the user's take them as options."""
    out = Registry()
    out.register("tokenize", "rule", Stage(_tokenizer("Latn")))
    out.register("tokenize", "rule_arabic", Stage(_tokenizer("Arab")))
    out.register("mwt", "neural", Stage(_multiword, requires=("tokenize",)))
    out.register("morph", "analyses", Stage(_analyses, requires=("tokenize",)))
    fields = {"morph_neural": ("lemma", "upos", "feats"), "pos": ("upos", "xpos", "feats"), "feats": ("feats",), "lemma": ("lemma",), "depparse": ("head", "deprel"), "ner": ("ner",)}
    for processor, own in fields.items():
        out.register(processor, "model", Stage(_model(processor, own), requires=("tokenize",)))
    out.register("morphemes", "rules", Stage(_morphemes, requires=("tokenize",)))
    out.register("embeddings", "model", Stage(_embeddings, requires=("tokenize",)))
    out.register("translate", "model", Stage(_translation, requires=("tokenize",)))
    return out


def register_sql(spark: SparkSession, prefix: str = "steppe_") -> list[str]:
    """Make functions known to SQL, as temporary functions of the session; returns their names."""
    for f in (text_functions.nfc, text_functions.nfkc, text_functions.strip_diacritics, text_functions.strip_marks):
        spark.udf.register(f"{prefix}{f.__name__}", f)
    native = {
        "turkish_i": "STRING RETURN translate(x, 'Iİ', 'ıi')",
        "turkic_lower": "STRING RETURN lower(translate(x, 'Iİ', 'ıi'))",
        "is_numeric": r"BOOLEAN RETURN coalesce(regexp_like(x, r'^[\p{Nd}.,/\-%+]*\p{Nd}[\p{Nd}.,/\-%+]*$'), false)",
        "is_punctuation": r"BOOLEAN RETURN coalesce(regexp_like(x, r'^\p{P}+$'), false)",
    }
    for name, body in native.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {prefix}{name}(x STRING) RETURNS {body}")
    return [f"{prefix}{n}" for n in ("nfc", "nfkc", "strip_diacritics", "strip_marks", *native)]


class Pipeline:
    """Processors for a language, applied to a table of documents (doc columns and ``text``) as one lazy plan.

    ``script`` is that of the texts, detected for each document if it isn't given;
    ``transliterate_to`` bridges to the script of the model.  With ``transliterate_back`` lemmas return
    to the original script, and so does the text; words and sentences stay in the model's.
    The result has script, sentences and log besides the documents' columns.  Without ``processors``, all those of the
    catalog are applied, or those that need no model.  With ``strict``, a document without sentences is an error for the stages that need them.
    """

    def __init__(self, lang: str, processors: list[str] | None = None, script: str | None = None, transliterate_to: str | None = None, transliterate_back: bool = False, catalog: dict | None = None, registry: Registry | None = None, strict: bool = False, **options) -> None:
        own = [r for r in rows("lang_script") if r["lang"] == lang]
        if not own:
            raise ValueError(f"unknown language {lang}")
        self.lang, self.options, self.catalog, self.registry = lang, options, catalog, registry or default_registry()
        self.primary = next(r["script"] for r in own if r["is_primary"] == "1")
        if script is not None and script not in {r["script"] for r in own}:
            raise ValueError(f"{lang} is not written in {script}")
        self.script, self.back, source = script, transliterate_back, script or self.primary
        self.bridge = None
        if transliterate_to and transliterate_to != source:
            if (lang, source, transliterate_to) not in pairs():
                raise ValueError(f"no transliteration from {source} to {transliterate_to} for {lang}")
            self.bridge = (source, transliterate_to)
            if transliterate_back and (lang, transliterate_to, source) not in pairs():
                raise ValueError(f"no way back from {transliterate_to} to {source} for {lang}")
        self.model_script = transliterate_to or source
        self.strict = strict
        if processors is None:
            processors = list(catalog) if catalog else ["tokenize", "mwt"]
        self.names = resolve(processors, self.registry)
        self.backends = {}
        self.stages = []
        for name in self.names:
            if name in _IMPLICIT:
                continue
            backend = choose_backend(name, self.model_script, options, catalog, self.registry)
            self.backends[name] = backend
            stage = self.registry.get(name, backend)
            self.stages.append((stage.build(lang, self.model_script, options_for(name, options)), "tokenize" in stage.requires))

    def __call__(self, docs: DataFrame) -> DataFrame:
        out = docs.withColumn("script", F.lit(self.script) if self.script else F.coalesce(detect_script(F.col("text")), F.lit(self.primary))).withColumn("log", F.array().cast("array<string>"))
        if self.bridge:
            out = out.withColumn("__original", F.col("text")).withColumn("text", transliterate(F.col("text"), self.lang, *self.bridge))
        for stage, needs_sentences in self.stages:
            if self.strict and needs_sentences:
                out = out.withColumn("sentences", check_requirements(F.col("sentences")))
            out = stage(out)
        if self.bridge and self.back:
            lemma = lambda w: w.withField("lemma", transliterate(w["lemma"], self.lang, *reversed(self.bridge)))
            out = out.withColumn("sentences", F.transform("sentences", lambda s: s.withField("words", F.transform(s["words"], lemma)))).withColumn("text", F.col("__original"))
        return out.drop("__original")

    def process(self, docs: DataFrame, output_format: str = "conllu") -> DataFrame:
        """The documents' columns and ``output``: CoNLL-U or JSON; ``ValueError`` for other formats."""
        if output_format not in ("conllu", "json"):
            raise ValueError(f"unknown format: {output_format}")
        done = self(docs)
        made = to_conllu(F.col("sentences"), F.lit(self.lang), F.col("script")) if output_format == "conllu" else to_json(F.col("sentences"))
        return done.withColumn("output", made)

    def license_info(self) -> dict[str, str | None]:
        """License of each processor's backend, of the catalog or else of the stage."""
        known = self.catalog or {}
        return {p: known.get(p, {}).get("backends", {}).get(b, {}).get("license") or self.registry.get(p, b).license for p, b in self.backends.items()}


def check_requirements(sentences, needs: tuple[str, ...] = ()):
    """The sentences, or an error where there are none, or the first word of the document lacks a field that is needed."""
    first = F.get(F.get(sentences, F.lit(0))["words"], F.lit(0))
    missing = sentences.isNull() | (F.size(sentences) == 0)
    for n in needs:
        missing = missing | first[n].isNull()
    return F.when(missing, F.raise_error(F.lit(f"the document lacks sentences or {needs}")).cast("void")).otherwise(sentences)
