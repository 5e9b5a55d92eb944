"""Words, CoNLL-U and spans of whole Arrow batches, by numpy and Arrow's kernels.

The expressions of the other modules build nested columns, a word at a time; where rows of words are all that is
wanted, the functions here say the same of a batch at once.  Steps are linear in the text, and a task holds a
chunk of texts with its rows, or one longer text.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType, _parse_datatype_string

#: Bytes of text handled at once in a Python worker; a single longer text is handled whole.
CHUNK = 1 << 18
_SPACE, _MARK, _ENDER = 1, 2, 3
_LIMIT = 0x3001  # white space ends before
_KIND = np.zeros(_LIMIT + 1, np.uint8)
_KIND[[c for c in range(_LIMIT) if chr(c).isspace()]] = _SPACE
_KIND[[ord(c) for c in ".,:;!?\"')]}"]] = _MARK
_KIND[[ord(c) for c in ".!?"]] = _ENDER


def mapped(docs: DataFrame, keep: tuple[str, ...], text: str, schema: str, f: Callable[[pa.Array], tuple[np.ndarray | None, list[pa.Array]]]) -> DataFrame:
    """Rows of ``keep`` and of the schema's columns: ``f`` takes texts to the place of each row's text (None: a row for each) and those columns."""
    fields = [*docs.select(*keep).schema.fields, *_parse_datatype_string(schema).fields]
    n, names = len(keep), [x.name for x in fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size = pc.fill_null(pc.binary_length(batch.column(n)), 0)
            total = np.cumsum(np.asarray(size, dtype=np.int64) + 16)
            begin, before = 0, 0
            while begin < batch.num_rows:
                stop = max(begin + 1, int(np.searchsorted(total, before + CHUNK, side="right")))
                part = batch.slice(begin, stop - begin)
                at, made = f(part.column(n))
                own = [part.column(k) if at is None else part.column(k).take(pa.array(at)) for k in range(n)]
                yield pa.RecordBatch.from_arrays([*own, *made], names)
                begin, before = stop, int(total[stop - 1])

    return docs.select(*keep, F.col(text).cast("string").alias("__text")).mapInArrow(run, StructType(fields))


def ranks(first: np.ndarray, total: int) -> np.ndarray:
    """Places from 0 within groups that begin at ``first``."""
    return np.arange(total) - np.repeat(first, np.diff(np.append(first, total)))


def int32(x: np.ndarray) -> pa.Array:
    return pa.array(np.asarray(x).astype(np.int32))


def joined(values: pa.Array, first: np.ndarray, by: str) -> pa.Array:
    """The strings of each group, joined; ``first`` has the groups' beginnings and the end."""
    return pc.binary_join(pa.ListArray.from_arrays(int32(first), values), by)


@dataclass
class Words:
    """The words of texts in order.  Of each sentence: its text's place, number, text and first word; of each word: its sentence and the rest."""

    texts: int
    doc: np.ndarray
    number: np.ndarray
    sentences: pa.Array
    first: np.ndarray  # and the number of words
    sent: np.ndarray
    text: pa.Array
    punct: np.ndarray
    start: np.ndarray
    length: np.ndarray
    code: np.ndarray  # the first character's
    marks: np.ndarray | None  # characters of the word that are punctuation by Unicode
    plain: np.ndarray | None  # whether it has ASCII letters alone

    @property
    def id(self) -> np.ndarray:
        return ranks(self.first[:-1], len(self.sent)) + 1

    @property
    def at(self) -> np.ndarray:
        return self.doc[self.sent]


@cache
def _punctuation() -> np.ndarray:
    """Whether a character is punctuation, of all characters."""
    return np.fromiter((unicodedata.category(chr(c))[0] == "P" for c in range(0x110000)), bool, 0x110000)


def words(texts: pa.Array, marks: bool = False) -> Words:
    """Sentences and words as of :func:`segment.tokenize`; ``marks`` and ``plain`` are found if asked for."""
    own = [b"" if t is None else t for t in texts.cast(pa.binary()).to_pylist()]
    own = [t.decode("utf-8", "replace") for t in own]
    size = np.fromiter(map(len, own), np.int64, len(own))
    whole = "\n".join(own) + "\n"
    raw = np.frombuffer(whole.encode(), np.uint8)
    code = np.frombuffer(whole.encode("utf-32-le"), np.uint32)
    kind = _KIND[np.minimum(code, _LIMIT)]
    real = kind != _SPACE
    before = np.concatenate(([False], real[:-1]))
    start, end = np.flatnonzero(real & ~before), np.flatnonzero(~real & before)
    doc = np.searchsorted(np.cumsum(size + 1), start, side="right")
    # A token is its stem up to the last character that isn't a mark, and each mark after it; one of marks alone is whole.
    last = np.maximum.accumulate(np.where(kind == 0, np.arange(len(code), dtype=np.int32), -1))[end - 1] if len(start) else start
    stem = np.where(last >= start, last + 1, end)
    n = 1 + end - stem
    piece = np.cumsum(n) - n
    total = int(n.sum())
    token, k = np.repeat(np.arange(len(start)), n), ranks(piece, total)
    a = np.where(k == 0, start[token], stem[token] + k - 1)
    b = np.where(k == 0, stem[token], a + 1)
    # A sentence ends where a token does that ends in an ender.
    new = np.concatenate(([True], (kind[end[:-1] - 1] == _ENDER) | (doc[1:] != doc[:-1]))) if len(start) else np.zeros(0, bool)
    opens = np.flatnonzero(new)
    closes = np.append(opens[1:], len(start)) - 1 if len(opens) else opens
    s_start, s_end, s_doc = start[opens], end[closes], doc[opens]
    of_doc = np.searchsorted(s_doc, s_doc)
    reach = np.cumsum(s_end - s_start + 1)
    reach -= s_end - s_start + 1
    base = reach - reach[of_doc]
    sent = (np.cumsum(new) - 1)[token]
    width = 1 + (code >= 0x80).astype(np.int8) + (code >= 0x800) + (code >= 0x10000) if len(raw) != len(code) else None
    if width is None:
        data, length = raw[real], b - a
    else:
        place = np.concatenate(([0], np.cumsum(width, dtype=np.int64)))
        data, length = raw[np.repeat(real, width)], place[b] - place[a]
    offsets = np.concatenate(([0], np.cumsum(length))).astype(np.int32)
    text = pa.StringArray.from_buffers(total, pa.py_buffer(offsets), pa.py_buffer(data))
    count = lambda is_one: (lambda seen: seen[b] - seen[a])(np.concatenate(([0], np.cumsum(is_one, dtype=np.int64))))
    return Words(
        len(own), s_doc, np.arange(len(opens)) - of_doc, pa.array([whole[x:y] for x, y in zip(s_start.tolist(), s_end.tolist(), strict=True)], pa.string()),
        np.append(piece[opens], total), sent, text, k > 0, base[sent] + a - s_start[sent], b - a, code[a], count(_punctuation()[code]) if marks else None,
        count(((code | 32) >= ord("a")) & ((code | 32) <= ord("z"))) == b - a if marks else None,
    )


@dataclass
class Spans:
    """Multi-word tokens, in order: the place of the first word of each, how many it has, and its text."""

    word: np.ndarray
    size: np.ndarray
    text: pa.Array


def expanded(w: Words, rules: dict[str, list[str]]) -> tuple[Words, Spans]:
    """As :func:`segment.expand_multiword`: words that have a rule are replaced by its pieces, which share their place and aren't punctuation."""
    keys = sorted(rules)
    found = np.asarray(pc.fill_null(pc.index_in(w.text, value_set=pa.array(keys, pa.string())), -1))
    sizes = np.array([*[len(rules[x]) for x in keys], 1])
    at = np.concatenate(([0], np.cumsum(sizes[:-1])))
    n = sizes[found]
    begin = np.concatenate(([0], np.cumsum(n)))
    old, k = np.repeat(np.arange(len(n)), n), ranks(begin[:-1], int(begin[-1]))
    ruled = found[old] >= 0
    # Words first, then the pieces of all rules.
    source = pa.concat_arrays([w.text, pa.array([p for x in keys for p in rules[x]], pa.string())])
    text = source.take(pa.array(np.where(ruled, len(w.text) + at[found[old]] + k, old)))
    out = Words(w.texts, w.doc, w.number, w.sentences, begin[w.first], w.sent[old], text, w.punct[old] & ~ruled, w.start[old], w.length[old], w.code[old], None, None)
    hit = np.flatnonzero(found >= 0)
    return out, Spans(begin[hit], n[hit], w.text.take(pa.array(hit)))


def _lines(content: pa.Array, by: str) -> tuple[pa.Array, np.ndarray]:
    """The parts of strings without nulls, and the first part of each string, and the number of parts."""
    parts = pc.split_pattern(content, by)
    first = np.asarray(parts.offsets)
    return parts.values.slice(first[0], first[-1] - first[0]), first - first[0]


def written(texts: pa.Array, w: Words, spans: Spans | None = None, lang: str = "", script: str = "") -> pa.Array:
    """CoNLL-U of tokenized texts, as of :func:`conllu.to_conllu`; null for null texts."""
    blank = pa.scalar("_")
    id = w.id
    upos = pc.if_else(pa.array(w.punct), pa.scalar("PUNCT"), blank)
    lines = pc.binary_join_element_wise(int32(id).cast(pa.string()), w.text, pc.if_else(pa.array(w.punct), w.text, blank), upos, pa.scalar("\t".join("_" * 6)), "\t")
    # A line end in the text would end the comment.
    own = w.sentences
    for kind in ("\r", "\n"):
        if pc.any(pc.match_substring(own, kind)).as_py():
            own = pc.replace_substring_regex(own, r"[\r\n]+", " ")
    groups = [pc.binary_join_element_wise(pa.scalar("# text = "), own, ""), lines]
    place = [w.first[:-1] * 3, np.arange(len(lines)) * 3 + 2]  # comments and spans go before the word
    if spans is not None and len(spans.word):
        a = id[spans.word]
        groups.append(pc.binary_join_element_wise(int32(a).cast(pa.string()), pa.scalar("-"), int32(a + spans.size - 1).cast(pa.string()), pa.scalar("\t"), spans.text, pa.scalar("\t_" * 8), ""))
        place.append(spans.word * 3 + 1)
        more = np.searchsorted(spans.word, w.first)
    else:
        more = 0
    ordered = pa.concat_arrays(groups).take(pa.array(np.argsort(np.concatenate(place), kind="stable")))
    blocks = joined(ordered, w.first + np.arange(len(w.first)) + more, "\n")
    body = joined(blocks, np.searchsorted(w.doc, np.arange(w.texts + 1)), "\n\n")
    header = "\n".join(f"# {n} = {v}" for n, v in (("lang", lang), ("script", script)) if v)
    out = pc.binary_join_element_wise(pa.scalar(f"{header}\n\n" if header else ""), body, pa.scalar("\n\n"), "")
    return pc.if_else(pc.is_valid(texts), out, pa.scalar(None, pa.string()))


_ESCAPES = {"\b": "\\b", "\t": "\\t", "\n": "\\n", "\f": "\\f", "\r": "\\r"}


def as_json(texts: pa.Array, w: Words) -> pa.Array:
    """JSON of tokenized texts, as of :func:`conllu.to_json`; null for null texts."""
    text = pc.replace_substring(pc.replace_substring(w.text, "\\", "\\\\"), '"', '\\"')
    if pc.any(pc.match_substring_regex(text, r"[\x00-\x1f]")).as_py():
        for c in map(chr, range(32)):
            text = pc.replace_substring(text, c, _ESCAPES.get(c, f"\\u{ord(c):04X}"))
    quoted = pc.binary_join_element_wise(pa.scalar('"'), text, pa.scalar('"'), "")
    punct = pa.array(w.punct)
    parts = ['{"id":', int32(w.id).cast(pa.string()), ',"text":', quoted, ',"lemma":', pc.if_else(punct, quoted, pa.scalar("null")), ',"upos":', pc.if_else(punct, pa.scalar('"PUNCT"'), pa.scalar("null")), ',"xpos":null,"feats":null,"head":null,"deprel":null}']
    each = pc.binary_join_element_wise(*[pa.scalar(p) if isinstance(p, str) else p for p in parts], "")
    blocks = pc.binary_join_element_wise(pa.scalar("["), joined(each, w.first, ","), pa.scalar("]"), "")
    out = pc.binary_join_element_wise(pa.scalar("["), joined(blocks, np.searchsorted(w.doc, np.arange(w.texts + 1)), ","), pa.scalar("]"), "")
    return pc.if_else(pc.is_valid(texts), out, pa.scalar(None, pa.string()))


@dataclass
class Read:
    """The word lines of CoNLL-U texts.  Of each sentence: its text's place, number, known text and first word; of each word: its sentence, line and fields."""

    doc: np.ndarray
    number: np.ndarray
    known: pa.Array
    first: np.ndarray  # and the number of words
    sent: np.ndarray
    line: np.ndarray
    fields: Callable[[int], pa.Array]
    span: np.ndarray  # of each word: its place in opened, or -1
    opened: tuple[pa.Array, pa.Array, pa.Array]  # from, to, text
    comments: tuple[np.ndarray, pa.Array]  # text's place and comment

    @property
    def at(self) -> np.ndarray:
        return self.doc[self.sent]

    def names(self) -> dict[str, Callable[[], pa.Array]]:
        """The columns of :func:`conllu.conllu_lines`."""

        def blank(k: int) -> pa.Array:
            x = self.fields(k)
            return pc.if_else(pc.equal(x, "_"), pa.scalar(None, pa.string()), x)

        def head() -> pa.Array:
            x = blank(6)
            if x.null_count == len(x):
                return pa.nulls(len(x), pa.int32())
            x = pc.if_else(pc.match_substring_regex(x, r"^[+-]?[0-9]+$"), x, pa.scalar(None, pa.string()))
            return pc.replace_substring_regex(x, r"^\+", "").cast(pa.int32())

        def script() -> pa.Array:
            x = blank(9)
            if x.null_count == len(x):
                return x
            x = pc.struct_field(pc.extract_regex(x, r"(?:^|\|)Script=(?P<x>[^|]*)"), "x")
            return pc.if_else(pc.equal(x, ""), pa.scalar(None, pa.string()), x)

        span = lambda k: lambda: self.opened[k].take(pa.array(self.span, mask=self.span < 0))
        out = {"sent_id": lambda: int32(self.number[self.sent]), "line": lambda: pa.array((self.number[self.sent].astype(np.int64) << 32) + self.line), "id": lambda: self.fields(0).cast(pa.int32()), "form": lambda: self.fields(1)}
        out |= {n: (lambda k=k: blank(k)) for k, n in ((2, "lemma"), (3, "upos"), (4, "xpos"), (5, "feats"), (7, "deprel"), (8, "deps"), (9, "misc"))}
        return out | {"head": head, "mwt_start": span(0), "mwt_end": span(1), "mwt_text": span(2), "script": script, "known_text": lambda: self.known.take(pa.array(self.sent))}


def read(content: pa.Array) -> Read:
    """The word lines of CoNLL-U texts, as :func:`conllu.conllu_lines` reads them; null texts have none."""
    content = pc.replace_substring(pc.replace_substring(pc.fill_null(content, ""), "\r\n", "\n"), "\r", "\n")
    line, first = _lines(content, "\n")
    doc = np.repeat(np.arange(len(content)), np.diff(first))
    real = np.asarray(pc.binary_length(line)) > 0
    opening = np.zeros(len(line) + 1, bool)
    opening[first] = True
    # A block begins after an empty line, or with its text; one empty line at the beginning of a text belongs to it.
    new = real & (opening[:-1] | ~np.concatenate(([False], real[:-1])))
    begin = np.flatnonzero(new)
    number = np.cumsum(new) - 1
    begin = begin - (opening[np.maximum(begin - 1, 0)] & ~real[np.maximum(begin - 1, 0)] & ~opening[begin])
    hashed = np.zeros(len(line), bool)
    hashed[real] = np.asarray(pc.starts_with(line.filter(pa.array(real)), "#"))

    comment = np.flatnonzero(hashed)
    said = line.take(pa.array(comment))
    texts = np.asarray(pc.starts_with(said, "# text = "))
    held = [x[8:].strip() for x in said.filter(pa.array(texts)).to_pylist()]
    known = np.full(len(begin), -1)
    known[number[comment[texts]]] = np.arange(len(held))

    rows = np.flatnonzero(real & ~hashed)
    cells, cut = _lines(line.take(pa.array(rows)), "\t")
    whole = np.diff(cut) == 10
    rows, cut = rows[whole], cut[:-1][whole]
    ids = cells.take(pa.array(cut))
    is_word = np.asarray(pc.ascii_is_decimal(ids))
    at, cut_word = rows[is_word], cut[is_word]

    other = np.flatnonzero(~is_word)
    other = other[np.asarray(pc.match_substring_regex(ids.take(pa.array(other)), r"^[0-9]+-[0-9]+$"))]
    pair, _ = _lines(ids.take(pa.array(other)), "-")
    opened = (pair[::2].cast(pa.int32()), pair[1::2].cast(pa.int32()), cells.take(pa.array(cut[other] + 1))) if len(other) else (pa.nulls(0, pa.int32()), pa.nulls(0, pa.int32()), pa.nulls(0, pa.string()))

    block = number[at]
    span = np.full(len(at), -1)
    if len(other):
        near = np.searchsorted(rows[other], at) - 1
        mine = (near >= 0) & (number[rows[other]][near] == block)
        id = np.asarray(cells.take(pa.array(cut_word)).cast(pa.int32()))
        inside = (np.asarray(opened[0])[near] <= id) & (id <= np.asarray(opened[1])[near])
        span = np.where(mine & inside, near, -1)

    opens = np.flatnonzero(np.concatenate(([True], block[1:] != block[:-1]))) if len(at) else np.zeros(0, np.int64)
    used = block[opens]
    loose = known >= 0
    loose[used] = False
    if loose.any():
        # A text whose block has no words stands for the next sentence of its document that has none of its own.
        has_words = np.zeros(len(begin), bool)
        has_words[used] = True
        of, carried = doc[begin], -1
        for b in range(len(begin)):
            if b and of[b] != of[b - 1]:
                carried = -1
            carried = known[b] if known[b] >= 0 else carried
            if has_words[b]:
                known[b], carried = carried, -1
    s_doc = doc[begin[used]]
    texts_of = known[used]
    return Read(
        s_doc, np.arange(len(used)) - np.searchsorted(s_doc, s_doc), pa.array(held, pa.string()).take(pa.array(texts_of, mask=texts_of < 0)), np.append(opens, len(at)),
        np.repeat(np.arange(len(used)), np.diff(np.append(opens, len(at)))), at - begin[block], lambda k: cells.take(pa.array(cut_word + k)), span, opened, (doc[comment], said),
    )


def dependencies(w: Words, head: np.ndarray, deprel: pa.Array) -> tuple[np.ndarray, list[pa.Array]]:
    """As :func:`conllu.dependency_rows`, from the number of each word's head and its relation: the texts' places, and sent_id, id, text, deprel, head and head_text."""
    at = np.flatnonzero(np.asarray(pc.is_valid(deprel)))
    own, sent, id = head[at], w.sent[at], w.id[at]
    place = w.first[sent] + own - 1
    known = (own > 0) & (place < w.first[sent + 1])
    return w.doc[sent], [int32(w.number[sent]), int32(id), w.text.take(pa.array(at)), deprel.take(pa.array(at)), int32(own), w.text.take(pa.array(place, mask=~known))]


def bio(codes: np.ndarray, w: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each span of B (1) and the I (2) after it within a sentence: its first word, the end of its words, and its number in the sentence from 1."""
    begin = np.flatnonzero(codes == 1)  # a sentence's first word with 2 has no span to go on with
    stop = np.ones(len(codes) + 1, bool)
    stop[:-1] = codes != 2
    stop[w.first] = True
    stops = np.flatnonzero(stop)
    end = stops[np.searchsorted(stops, begin, side="right")] if len(begin) else begin
    sent = w.sent[begin]
    return begin, end, np.arange(len(begin)) - np.searchsorted(sent, sent) + 1
