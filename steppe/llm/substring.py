"""Substring deduplication by seed and extend.

A *repeat* is a run of at least ``MIN_WORDS`` words that occurs in two documents or more.

1. Seeds: of every document the k-grams of words that winnowing selects (the least hash of each
   window of ``MIN_WORDS - k + 1`` neighbouring ones) are joined on their hash.  Any repeat holds
   a selected k-gram, in all its occurrences.
2. Links: around the seeds that two documents share, every run of ``MIN_WORDS`` words is listed with all
   documents that have it, and each of these is linked with the one before it in the list, by doc_id.
3. Extension: each pair of documents linked at some distance is laid word upon word at that distance,
   and the match is extended both ways as far as the words themselves agree.  What is
   reported has been compared as text; hashes only propose it.

Work and result grow with the number of occurrences, not with the number of pairs of them: a
passage in ten thousand documents gives ten thousand links, of which no document has more than two.

A row is a maximal match of two documents.  :func:`maximal_repeats` also relates places that aren't
neighbours in any list, as classes of all places that hold the same words:  a repeat may begin
only at runs before which different words stand, and end only at runs after which different words stand.
Every stretch from one to the other is a candidate, and those whose own places differ on both sides are kept.
That result isn't linear in the input.
"""

from __future__ import annotations

from collections.abc import Iterator
from operator import eq

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpointed, chunks, fresh, joined, pack48, parts, runs, u64, unpack48
from .words import Words, mix, powers, rolling, within

MIN_WORDS, SEED_WORDS = 50, 20

_PACK = "cls int, keys binary, counts binary, hashes binary, at binary, ref binary, shift binary"
_PACK_ARROW = pa.schema([pa.field("cls", pa.int32()), *(pa.field(n, pa.binary()) for n in ("keys", "counts", "hashes", "at", "ref", "shift"))])


def _table(rows: list[tuple]) -> pa.Table:
    cols = list(zip(*rows, strict=True)) if rows else [[] for _ in _PACK_ARROW]
    return pa.table([pa.array(c, type=f.type) for c, f in zip(cols, _PACK_ARROW, strict=True)], schema=_PACK_ARROW)


def _cls(h: np.ndarray, n: int) -> np.ndarray:
    """Class of a hash, by its top 16 bits; the other 48 travel with it."""
    return (h >> np.uint64(48)).astype(np.int64) * n >> 16


def _blk(doc: np.ndarray, n: int) -> np.ndarray:
    return ((mix(doc.view(np.uint64)) >> np.uint64(40)) % np.uint64(n)).astype(np.int64)


def _packed(part: np.ndarray, n: int, doc: np.ndarray, **arrays: np.ndarray) -> list[tuple]:
    """A row for each part, of parallel arrays; equal documents follow each other and are packed as runs."""
    order = np.argsort(part, kind="stable")
    part, doc = part[order], doc[order]
    arrays = {k: v[order] for k, v in arrays.items()}
    bounds = np.searchsorted(part, np.arange(n + 1))
    rows = []
    for c in np.flatnonzero(bounds[1:] > bounds[:-1]):
        at = slice(int(bounds[c]), int(bounds[c + 1]))
        start, count = runs(doc[at])
        packed = {k: pack48(v[at]) if k == "hashes" else v[at].tobytes() for k, v in arrays.items()}
        rows.append((int(c), doc[at][start].tobytes(), count.astype("<u4").tobytes(), *(packed.get(k) for k in ("hashes", "at", "ref", "shift"))))
    return rows


def _docs_of(table: pa.Table) -> np.ndarray:
    return np.repeat(joined(table.column("keys"), "<i8"), joined(table.column("counts"), "<u4"))


def _sliding(x: np.ndarray, w: int, best: np.ufunc) -> np.ndarray:
    """``best`` of every w neighbours, by doubling."""
    width, y = 1, x
    while width * 2 <= w:
        y = best(y[:-width], y[width:])
        width *= 2
    return y if width == w else best(y[: len(y) - (w - width)], y[w - width :])


def _seeds(w: Words, k: int, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Winnowed k-grams: hash, index of their first word, text."""
    window = least - k + 1
    grams = rolling(w.hash, k)
    if len(grams) < window:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    lowest = _sliding(grams, window, np.minimum)
    # A window counts if all its words lie in one text.
    lowest[~_inside(w, least)[: len(lowest)]] = 0
    pad = np.zeros(window - 1, dtype=np.uint64)
    highest = _sliding(np.concatenate([pad, lowest, pad]), window, np.maximum)
    at = np.flatnonzero((highest == grams) & (grams != 0))
    return grams[at], at, np.searchsorted(w.first, at, side="right") - 1


def _inside(w: Words, length: int) -> np.ndarray:
    """For each word, whether the run of so many words from it lies in its text."""
    left = np.repeat(w.first[1:], w.counts) - np.arange(len(w.hash))
    return left >= length


def _seed_rows(k: int, least: int, n: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches):
            w = Words(batch.column(1))
            h, _, text = _seeds(w, k, least)
            doc = np.asarray(batch.column(0)).astype(np.int64)[text]
            yield from _table(_packed(_cls(h, n), n, doc, hashes=h)).to_batches()

    return run


def _common_seeds(n: int):
    """Seeds of a class -> those of two documents or more, by document block."""

    def run(table: pa.Table) -> pa.Table:
        doc, h = _docs_of(table), unpack48(joined(table.column("hashes"), "u1"))
        order = np.lexsort((doc, h))
        doc, h = doc[order], h[order]
        keep = np.ones(len(h), dtype=bool)
        keep[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
        doc, h = doc[keep], h[keep]
        _, length = runs(h)
        keep = np.repeat(length, length) > 1
        doc, h = doc[keep], h[keep]
        order = np.lexsort((h, doc))
        doc, h = doc[order], h[order]
        # The class fills the bits that 48 leave out.
        ref = h | np.uint64(table.column("cls")[0].as_py() << 48)
        return _table(_packed(_blk(doc, n), n, doc, ref=ref))

    return run


def _by_document(table: pa.Table) -> pa.Table:
    doc, h = _docs_of(table), joined(table.column("ref"), "<u8")
    order = np.lexsort((h, doc))
    doc, h = doc[order], h[order]
    start, length = runs(doc)
    seeds = [h[a : a + b].tobytes() for a, b in zip(start, length, strict=True)]
    return pa.table({"doc_id": pa.array(doc[start]), "seeds": pa.array(seeds, type=pa.binary())})


def _around(w: Words, seeds: list[bytes], k: int, least: int, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """All runs of ``least`` words around the texts' common seeds: hash, index of their first word, text, place in it."""
    h, at, text = _seeds(w, k, least)
    h = (h & np.uint64(2**48 - 1)) | _cls(h, n).astype(np.uint64) << np.uint64(48)
    common = np.zeros(len(h), dtype=bool)
    bounds = np.searchsorted(text, np.arange(len(w) + 1))
    for i, raw in enumerate(seeds):
        own = slice(bounds[i], bounds[i + 1])
        common[own] = np.isin(h[own], np.frombuffer(raw, "<u8"))
    at = at[common]
    mark = np.zeros(len(w.hash) + 1, dtype=np.int64)
    first = np.repeat(w.first[:-1], w.counts)
    np.add.at(mark, np.maximum(at - (least - k), first[at]), 1)
    np.add.at(mark, at + 1, -1)
    inside = (np.cumsum(mark)[:-1] > 0) & _inside(w, least)
    at = np.flatnonzero(inside)
    g = rolling(w.hash, least)[at] if len(at) else np.zeros(0, np.uint64)
    text = np.searchsorted(w.first, at, side="right") - 1
    return g, at, text, (at - first[at]).astype("<u4") if len(at) else np.zeros(0, "<u4")


def _run_rows(k: int, least: int, n: int):
    """Documents with their common seeds -> all runs of ``least`` words around these, by class."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches):
            w = Words(batch.column(1))
            g, _, text, place = _around(w, batch.column(2).to_pylist(), k, least, n)
            doc, key = (np.asarray(batch.column(c)).astype(np.int64)[text] for c in (0, 3))
            yield from _wide(_KEYED, _cls(g, n), n, doc, key, hashes=g, at=place).to_batches()

    return run


def _links(n: int):
    """Runs of a class -> the link of each occurrence with the document before that has the run, by document block."""

    def run(table: pa.Table) -> pa.Table:
        doc, text = _texts_of(table)
        h, at = unpack48(joined(table.column("hashes"), "u1")), joined(table.column("at"), "<u4").astype(np.int64)
        order = np.lexsort((at, text, doc, h))
        doc, text, h, at = doc[order], text[order], h[order], at[order]
        new = np.ones(len(h), dtype=bool)
        new[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
        start = np.flatnonzero(new)
        # Of a document that has the run several times, the first place stands for it.
        before = np.concatenate([start[:1], start[:-1]])
        linked = h[before] == h[start]
        linked[:1] = False
        own = np.cumsum(new) - 1
        keep = linked[own]
        ref = before[own][keep]
        other, other_text, shift = doc[ref], text[ref], at[ref] - at[keep]
        doc, text, at = doc[keep], text[keep], at[keep]
        order = np.lexsort((at, text, doc))
        pair = np.stack([other, other_text], axis=1)[order]
        return _wide(_MATCHES, _blk(doc[order], n), n, doc[order], text[order], at=at[order].astype("<u4"), ref=pair, shift=shift[order].astype("<i4"))

    return run


def _requests(least: int):
    """Links of a block of documents -> the stretches of words to be compared, one row for either document.

    Links that follow one another word by word form a stretch, which all matches of its runs with earlier
    documents lie in.  For each document and distance linked in it the whole stretch is compared.
    """

    def run(table: pa.Table) -> pa.Table:
        doc, text = _texts_of(table)
        at, shift = joined(table.column("at"), "<u4").astype(np.int64), joined(table.column("shift"), "<i4").astype(np.int64)
        ref = joined(table.column("ref"), "<i8").reshape(-1, 2)
        order = np.lexsort((at, text, doc))
        doc, text, at, shift, ref = doc[order], text[order], at[order], shift[order], ref[order]
        same = (doc[1:] == doc[:-1]) & (text[1:] == text[:-1])
        keep = np.ones(len(doc), dtype=bool)  # repeated rows
        keep[1:] = ~(same & (at[1:] == at[:-1]))
        doc, text, at, shift, ref = doc[keep], text[keep], at[keep], shift[keep], ref[keep]
        new = np.ones(len(doc), dtype=bool)
        new[1:] = (doc[1:] != doc[:-1]) | (text[1:] != text[:-1]) | (at[1:] != at[:-1] + 1)
        start = np.flatnonzero(new)
        size = np.diff(np.append(start, len(doc)))
        stretch = np.repeat(start, size)
        last = np.repeat(start + size - 1, size)
        order = np.lexsort((at, shift, ref[:, 1], ref[:, 0], stretch))
        key = np.stack([stretch, ref[:, 0], ref[:, 1], shift], axis=1)[order]
        first = np.flatnonzero(np.concatenate([[True], (key[1:] != key[:-1]).any(axis=1)])) if len(key) else np.zeros(0, np.int64)
        count = np.diff(np.append(first, len(key)))
        marks = at[order]
        begin, end = at[stretch[order[first]]], at[last[order[first]]] + least
        one = order[first]
        asked = [(marks[a : a + c] - b).astype("<u4").tobytes() for a, c, b in zip(first, count, begin, strict=True)]
        # Known by what it compares, so that a task that runs again gives it the same name.
        name = mix(doc[one].view(np.uint64) + mix(text[one].view(np.uint64) + mix(ref[one, 0].view(np.uint64) + mix(ref[one, 1].view(np.uint64) + mix((begin << 32 ^ (shift[one] & 0xFFFFFFFF)).view(np.uint64))))))
        two = lambda a, b: pa.array(np.concatenate([a, b]))
        n = len(one)
        return pa.table(
            {
                "doc_id": two(doc[one], ref[one, 0]),
                "key": two(text[one], ref[one, 1]),
                "pair": two(name.view(np.int64), name.view(np.int64)),
                "start": two(begin, begin + shift[one]),
                "n": two(end - begin, end - begin),
                "asked": pa.array([*asked, *[None] * n], type=pa.binary()),
            }
        )

    return run


def _word_bytes(w: Words) -> tuple[np.ndarray, np.ndarray]:
    """The words of all texts with a space after each, and where each of them begins."""
    length = w.end - w.start
    place = np.concatenate([[0], np.cumsum(length + 1)])
    flat = np.full(int(place[-1]), 32, dtype=np.uint8)
    inside = np.repeat(w.start, length) + within(length)
    flat[np.repeat(place[:-1] - w.start, length) + inside] = w.data[inside]
    return flat, place


def _stretches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents with requests for one of their texts -> the words asked for: what lies outside the text is left out and counted in ``skip``."""
    names = ["pair", "doc_id", "key", "start", "skip", "asked", "words"]
    for batch in chunks(batches):
        batch = batch.filter(pc.equal(batch.column(2), batch.column(4)))
        w = Words(batch.column(1))
        flat, place = _word_bytes(w)
        rows, size = [], 0
        for i, (doc, key, asked) in enumerate(zip(*(batch.column(c).to_pylist() for c in (0, 2, 3)), strict=True)):
            first, count = int(w.first[i]), int(w.counts[i])
            for x in asked:
                low, high = max(0, x["start"]), min(count, x["start"] + x["n"])
                if low >= high:
                    low = high = max(0, min(count, low))
                said = flat[place[first + low] : place[first + high]].tobytes()
                rows.append((x["pair"], doc, key, x["start"], low - x["start"], x["asked"], said))
                size += len(said)
                if size > _SAID_BYTES:
                    yield _said(rows, names)
                    rows, size = [], 0
        if rows:
            yield _said(rows, names)


def _said(rows: list[tuple], names: list[str]) -> pa.RecordBatch:
    types = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.binary()]
    return pa.record_batch([pa.array(c, type=t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)


def agreements(a: bytes, b: bytes, skip_a: int, skip_b: int, least: int) -> list[tuple[int, int]]:
    """Maximal runs of at least so many equal words: (first, end), counted from where neither is skipped."""
    if skip_a == skip_b and a == b:
        n = a.count(b" ")
        return [(skip_a, skip_a + n)] if n >= least else []
    x, y = a.split(b" ")[:-1], b.split(b" ")[:-1]
    low = max(skip_a, skip_b)
    x, y = x[low - skip_a :], y[low - skip_b :]
    edge, length = _spans(np.fromiter(map(eq, x, y), dtype=bool, count=min(len(x), len(y))))
    return [(low + int(e), low + int(e + n)) for e, n in zip(edge, length, strict=True) if n >= least]


def _compare(least: int):
    """Both sides of each request, in order of ``pair``, the asking one first -> the maximal matches that hold a linked run."""
    names = ["doc_id", "start_word", "n_words", "other_doc_id", "other_start_word", "key"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair, one, done = None, None, False
        for batch in batches:
            rows = []
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if row[0] != pair:
                    pair, one, done = row[0], None, False
                if row[5] is not None:
                    one = row
                elif one is not None and not done:  # of repeated rows one counts
                    done = True
                    _, doc, key, start, skip, asked, said = one
                    linked = np.frombuffer(asked, "<u4")
                    for a, b in agreements(said, row[6], skip, row[4], least):
                        i = int(np.searchsorted(linked, a))
                        if i < len(linked) and linked[i] + least <= b:
                            rows.append((doc, start + a, b - a, row[1], row[3] + a, key))
            cols = list(zip(*rows, strict=True)) if rows else [[]] * 6
            yield pa.record_batch([pa.array(c, type=pa.int64()) for c in cols], names=names)

    return run


def _source(docs: DataFrame) -> DataFrame:
    return docs.where(F.col("doc_id").isNotNull() & F.col("text").isNotNull()).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def _marks(source: DataFrame, min_words: int, seed_words: int) -> DataFrame:
    """The documents that share seeds with another, and these seeds."""
    if not 0 < seed_words < min_words:
        raise ValueError("seed_words must be less than min_words")
    n = parts(source.sparkSession)
    seeds = source.select("doc_id", "text").mapInArrow(_seed_rows(seed_words, min_words, n), _PACK)
    common = seeds.groupBy("cls").applyInArrow(_common_seeds(n), _PACK)
    return checkpointed(common.groupBy("cls").applyInArrow(_by_document, "doc_id long, seeds binary"))


def repeats(docs: DataFrame, min_words: int = MIN_WORDS, seed_words: int = SEED_WORDS) -> DataFrame:
    """The maximal matches of every document with the documents before it that have the same words.

    A row (doc_id, start_word, n_words, other_doc_id, other_start_word), all bigint, says that the n_words
    words of doc_id from its word start_word (counted from 0) are also found from word
    other_start_word of other_doc_id, and that the words before and after differ or one of the texts ends there.
    The pairs compared are those linked by a run of min_words words, whose holders are ordered by
    doc_id: each holder is linked, wherever it has the run, with the first place that the holder before it has the run at.
    All matches of a pair at that distance that hold such a run are reported, at full length.  So every
    place that an earlier document has too lies in a row; two documents with a holder of
    every common run of theirs between them have no row of their own.

    Words are as in :mod:`.words`.  Documents with a null id or text, or fewer than min_words
    words, are in no row; repetitions within one document aren't reported.  A row repeated counts once; several texts under one
    id count as that document's text, each with positions of its own.  A text may be of any length: it is compared
    where it has shared runs only.  An empty table gives an empty result.  Other columns are ignored.
    """
    return _repeats(docs, min_words, seed_words).drop("key").distinct()


def _repeats(docs: DataFrame, min_words: int, seed_words: int) -> DataFrame:
    """As :func:`repeats`, with the key of the text that has the match, the hash of the text."""
    n = parts(docs.sparkSession)
    source = _source(docs).withColumn("key", F.xxhash64("text"))
    marked = source.join(_marks(source, min_words, seed_words), "doc_id").select("doc_id", "text", "seeds", "key")
    linked = marked.mapInArrow(_run_rows(seed_words, min_words, n), _KEYED).groupBy("cls").applyInArrow(_links(n), _MATCHES)
    requests = linked.groupBy("cls").applyInArrow(_requests(min_words), "doc_id long, key long, pair long, start long, n long, asked binary")
    asked = requests.groupBy("doc_id", F.col("key").alias("asked_key")).agg(F.collect_list(F.struct("pair", "start", "n", "asked")).alias("asked"))
    # The texts are laid out by doc_id once, for this join and the one above; so it isn't by key too, which the workers look at.
    found = source.join(asked, "doc_id").select("doc_id", "text", "key", "asked", "asked_key")
    said = found.mapInArrow(_stretches, "pair long, doc_id long, key long, start long, skip long, asked binary, words binary")
    sides = said.repartition("pair").sortWithinPartitions("pair", F.col("asked").desc_nulls_last())
    return sides.mapInArrow(_compare(min_words), "doc_id long, start_word long, n_words long, other_doc_id long, other_start_word long, key long")


#: Bytes of words packed at once.
_SAID_BYTES = 4 << 20
_KEYED = "cls int, keys binary, counts binary, hashes binary, at binary"
_MATCHES = "cls int, keys binary, counts binary, at binary, ref binary, shift binary"
_RUNS = "cls int, keys binary, counts binary, hashes binary, at binary, left binary, right binary"
_SIDED = "cls int, keys binary, counts binary, hashes binary, at binary, size binary, left binary, right binary"
_PLACES = "cls int, keys binary, counts binary, at binary, flags binary"
#: Different words stand before a run; after it; no other document goes on from it with the same word.
_BEGINS, _ENDS, _STOPS = 1, 2, 4
#: Candidates packed at once.
_AT_ONCE = 1 << 18


def _wide(schema: str, part: np.ndarray, n: int, doc: np.ndarray, text: np.ndarray, **arrays: np.ndarray) -> pa.Table:
    """As :func:`_packed`, with texts known by (document, key of the text); words are packed in 48 bits."""
    order = np.argsort(part, kind="stable")
    part, key = part[order], np.stack([doc, text], axis=1)[order]
    arrays = {k: v[order] for k, v in arrays.items()}
    bounds = np.searchsorted(part, np.arange(n + 1))
    rows = []
    for c in np.flatnonzero(bounds[1:] > bounds[:-1]):
        at = slice(int(bounds[c]), int(bounds[c + 1]))
        own = key[at]
        start = np.flatnonzero(np.concatenate([[True], (own[1:] != own[:-1]).any(axis=1)]))
        packed = [pack48(v[at]) if v.dtype == np.uint64 else v[at].tobytes() for v in arrays.values()]
        rows.append((int(c), own[start].tobytes(), np.diff(np.append(start, len(own))).astype("<u4").tobytes(), *packed))
    names = [f.split()[0] for f in schema.split(", ")]
    types = [pa.int32(), *[pa.binary()] * (len(names) - 1)]
    return pa.table([pa.array([r[i] for r in rows], type=t) for i, t in enumerate(types)], names=names)


def _texts_of(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    key = np.repeat(joined(table.column("keys"), "<i8").reshape(-1, 2), joined(table.column("counts"), "<u4"), axis=0)
    return key[:, 0], key[:, 1]


def _beside(w: Words, text: np.ndarray, begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The words before and after stretches of words, in 48 bits; 0 where the text begins or ends."""
    words = np.maximum(w.hash & np.uint64(2**48 - 1), np.uint64(1))
    left = np.where(begin > w.first[text], words[begin - 1], np.uint64(0))
    right = np.where(end < w.first[text + 1], words[np.minimum(end, len(words) - 1)], np.uint64(0))
    return left, right


def _differ(side: np.ndarray, start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """For each entry, whether its group can't be extended on this side by one word that all of it has."""
    least = np.minimum.reduceat(side, start)
    return np.repeat((least == 0) | (least != np.maximum.reduceat(side, start)), length)


def _sided_rows(k: int, least: int, n: int):
    """Documents with their common seeds -> all runs of ``least`` words around these and the words beside them, by class."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches):
            w = Words(batch.column(1))
            g, at, text, place = _around(w, batch.column(2).to_pylist(), k, least, n)
            if len(at):
                left, right = _beside(w, text, at, at + least)
                doc, key = (np.asarray(batch.column(c)).astype(np.int64)[text] for c in (0, 3))
                yield from _wide(_RUNS, _cls(g, n), n, doc, key, hashes=g, at=place, left=left, right=right).to_batches()

    return run


def _places(n: int):
    """Runs of a class -> those at which a maximal repeat may begin, end or must stop, by document block."""

    def run(table: pa.Table) -> pa.Table:
        doc, text = _texts_of(table)
        at = joined(table.column("at"), "<u4")
        h, left, right = (unpack48(joined(table.column(c), "u1")) for c in ("hashes", "left", "right"))
        order = np.lexsort((at, text, doc, right, h))
        doc, text, at, h, left, right = (x[order] for x in (doc, text, at, h, left, right))
        # The documents that go on with the same word.
        new = np.ones(len(h), dtype=bool)
        new[1:] = (h[1:] != h[:-1]) | (right[1:] != right[:-1])
        start = np.flatnonzero(new)
        length = np.diff(np.append(start, len(h)))
        alone = np.repeat(doc[start] == doc[start + length - 1], length) | (right == 0)
        start, length = runs(h)
        shared = np.repeat(np.minimum.reduceat(doc, start) != np.maximum.reduceat(doc, start), length)
        flags = _BEGINS * _differ(left, start, length) + _ENDS * _differ(right, start, length) + _STOPS * alone
        keep = shared & (flags > 0)
        doc, text, at, flags = doc[keep], text[keep], at[keep], flags[keep].astype("u1")
        order = np.lexsort((at, text, doc))
        doc, text, at, flags = (x[order] for x in (doc, text, at, flags))
        return _wide(_PLACES, _blk(doc, n), n, doc, text, at=at, flags=flags)

    return run


def _places_of_document(table: pa.Table) -> pa.Table:
    doc, text = _texts_of(table)
    at, flags = joined(table.column("at"), "<u4"), joined(table.column("flags"), "u1")
    order = np.lexsort((at, text, doc))
    doc, text, at, flags = (x[order] for x in (doc, text, at, flags))
    start, length = runs(doc)
    cut = [slice(a, a + b) for a, b in zip(start, length, strict=True)]
    binary = [pa.array([x[c].tobytes() for c in cut], type=pa.binary()) for x in (text, at, flags)]
    return pa.table([pa.array(doc[start]), *binary], names=["doc_id", "texts", "places", "flags"])


def _candidates(least: int, n: int):
    """Documents with their places -> the stretches from a beginning to an end that a repeat may fill, by class."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches):
            w = Words(batch.column(1))
            doc, key = (np.asarray(batch.column(c)).astype(np.int64) for c in (0, 2))
            begins, low, counts, texts, ends = [], [], [], [], []
            n_ends = 0
            for i, (t, p, f) in enumerate(zip(*(batch.column(c).to_pylist() for c in (3, 4, 5)), strict=True)):
                own = np.frombuffer(t, "<i8") == key[i]
                place, flag = np.frombuffer(p, "<u4")[own].astype(np.int64), np.frombuffer(f, "u1")[own]
                place, at = np.unique(place, return_index=True)  # repeated rows
                flag = flag[at]
                begin, end, stop = (place[flag & x > 0] for x in (_BEGINS, _ENDS, _STOPS))
                stop = np.append(stop, w.counts[i])[np.searchsorted(stop, begin)]
                a, b = np.searchsorted(end, begin), np.searchsorted(end, stop, side="right")
                begins.append(begin + w.first[i])
                low.append(a + n_ends)
                counts.append(b - a)
                texts.append(np.full(len(begin), i))
                ends.append(end + w.first[i] + least)
                n_ends += len(end)
            begins, low, counts, texts, ends = (np.concatenate(x) for x in (begins, low, counts, texts, ends))
            if not len(begins):
                continue
            power = powers(len(w.hash) + 1)
            total = np.zeros(len(w.hash) + 1, dtype=np.uint64)
            np.cumsum(w.hash * power[:-1], out=total[1:])
            inverse = powers(len(w.hash) + 1, np.uint64(pow(int(power[1]), -1, 2**64)))
            done = np.cumsum(counts)
            i = 0
            while i < len(begins):
                j = max(i + 1, int(np.searchsorted(done, (done[i - 1] if i else 0) + _AT_ONCE, side="right")))
                c = counts[i:j]
                begin, text = np.repeat(begins[i:j], c), np.repeat(texts[i:j], c)
                end = ends[np.repeat(low[i:j], c) + within(c)]
                i = j
                if not len(begin):
                    continue
                size = end - begin
                g = mix((total[end] - total[begin]) * inverse[begin] + mix(size.view(np.uint64)))
                left, right = _beside(w, text, begin, end)
                yield from _wide(_SIDED, _cls(g, n), n, doc[text], key[text], hashes=g, at=(begin - w.first[text]).astype("<u4"), size=size.astype("<u4"), left=left, right=right).to_batches()

    return run


def _classes(table: pa.Table) -> pa.Table:
    """Candidates of a class -> the maximal repeats of two documents or more, with their places."""
    doc, _ = _texts_of(table)
    at, size = joined(table.column("at"), "<u4"), joined(table.column("size"), "<u4")
    h, left, right = (unpack48(joined(table.column(c), "u1")) for c in ("hashes", "left", "right"))
    order = np.lexsort((at, doc, h))
    doc, at, size, h, left, right = (x[order] for x in (doc, at, size, h, left, right))
    start, length = runs(h)
    shared = np.repeat(doc[start] != doc[start + length - 1], length)
    keep = shared & _differ(left, start, length) & _differ(right, start, length)
    keep[1:] &= (h[1:] != h[:-1]) | (doc[1:] != doc[:-1]) | (at[1:] != at[:-1])  # repeated rows
    # The class fills the bits that 48 leave out.
    repeat = h[keep] | np.uint64(table.column("cls")[0].as_py() << 48)
    return pa.table({"repeat_id": pa.array(repeat.view(np.int64)), "n_words": pa.array(size[keep].astype(np.int64)), "doc_id": pa.array(doc[keep]), "start_word": pa.array(at[keep].astype(np.int64))})


def maximal_repeats(docs: DataFrame, min_words: int = MIN_WORDS, seed_words: int = SEED_WORDS) -> DataFrame:
    """The maximal repeats of at least min_words words, with all places that hold them.

    A row (repeat_id, n_words, doc_id, start_word), all bigint, says that the run of n_words words known as
    repeat_id stands from word start_word (counted from 0) of doc_id.  A run is a repeat if two documents have
    it, and maximal if no word stands before all its places, and none after all of them.  So any two
    places of different documents that hold the same words, taken as far as they agree on both sides, are
    in one repeat of that very length; a repeat within a longer one has its own rows if it has other places too.

    Words and the rows left out are as in :func:`repeats`.
    """
    n = parts(docs.sparkSession)
    source = _source(docs).withColumn("key", F.xxhash64("text"))
    marked = source.join(_marks(source, min_words, seed_words), "doc_id").select("doc_id", "text", "seeds", "key")
    sided = marked.mapInArrow(_sided_rows(seed_words, min_words, n), _RUNS)
    places = sided.groupBy("cls").applyInArrow(_places(n), _PLACES)
    of_document = places.groupBy("cls").applyInArrow(_places_of_document, "doc_id long, texts binary, places binary, flags binary")
    found = source.join(of_document, "doc_id").select("doc_id", "text", "key", "texts", "places", "flags").mapInArrow(_candidates(min_words, n), _SIDED)
    return found.groupBy("cls").applyInArrow(_classes, "repeat_id long, n_words long, doc_id long, start_word long")


def _cutter(where: int, spans: int):
    """Cut the word spans of a column of packed (start, length) pairs out of the text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches):
            texts, cuts = batch.column(where), batch.column(spans).to_pylist()
            rows = np.array([i for i, c in enumerate(cuts) if c], dtype=np.int64)
            out, keep = texts, np.ones(batch.num_rows, dtype=bool)
            if len(rows):
                some = texts.take(pa.array(rows))
                w = Words(some, lower=False)
                new = texts.to_pylist()
                raw = [bytes(w.data[w.origin[i] : w.origin[i + 1]]) for i in range(len(rows))]
                for i, row in enumerate(rows):
                    own = slice(w.first[i], w.first[i + 1])
                    start, end = w.start[own] - w.origin[i], w.end[own] - w.origin[i]
                    gone = np.zeros(len(start) + 1, dtype=np.int64)
                    for c in cuts[row]:
                        if c["s"] < len(start):
                            gone[c["s"]] += 1
                            gone[min(c["s"] + c["n"], len(start))] -= 1
                    gone = np.cumsum(gone)[:-1] > 0
                    keep[row] = not gone.all()
                    edge, length = _spans(gone)
                    pieces, at = [], 0
                    for e, n in zip(edge, length, strict=True):
                        pieces.append(raw[i][at : start[e]])
                        # What follows the last word up to the next one goes with it.
                        at = start[e + n] if e + n < len(start) else len(raw[i])
                    pieces.append(raw[i][at:])
                    new[row] = b"".join(pieces).decode("utf-8", "replace")
                out = pa.array(new, type=texts.type)
            arrays = [out if i == where else c for i, c in enumerate(batch.columns) if i != spans]
            yield pa.record_batch(arrays, names=[x for i, x in enumerate(batch.schema.names) if i != spans]).filter(pa.array(keep))

    return run


def _spans(flag: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    edge = np.flatnonzero(np.diff(np.concatenate([[0], flag.astype(np.int8), [0]])))
    return edge[0::2], edge[1::2] - edge[0::2]


def drop_repeats(docs: DataFrame, min_words: int = MIN_WORDS, seed_words: int = SEED_WORDS) -> DataFrame:
    """The documents without their repeats: each repeated run of words stays in the first document that has it, by doc_id.

    What :func:`repeats` finds in an earlier document is cut.  All rows and columns stay, whatever their names; a document all of
    whose words are cut is dropped, as nothing is left
    of it.  The column n_chars, if there is one, is set anew to the length of the text.
    Rows that :func:`repeats` leaves out stay as they are, and so do empty texts.  Of several texts under one id each is
    cut where it has repeats itself; of repeated rows each is cut.  An empty table gives an empty result.
    """
    own, key, cuts = fresh(docs, "cut_id"), fresh(docs, "cut_key"), fresh(docs, "cuts")
    found = _repeats(docs, min_words, seed_words).groupBy(F.col("doc_id").alias(own), F.col("key").alias(key)).agg(F.collect_list(F.struct(F.col("start_word").alias("s"), F.col("n_words").alias("n"))).alias(cuts))
    same = (F.col("doc_id").cast("long") == F.col(own)) & (F.xxhash64(F.col("text").cast("string")) == F.col(key))
    both = docs.join(found, same, "left").drop(own, key)
    schema = docs.schema
    left = both.mapInArrow(_cutter(both.columns.index("text"), both.columns.index(cuts)), schema)
    if "n_chars" in docs.columns:
        left = left.withColumn("n_chars", F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(F.length("text")).cast(schema["n_chars"].dataType))
    return left
