"""N-gram Jaccard self-join by T-occurrence search.

Two documents match when the Jaccard similarity of their sets of word n-grams is at least a
threshold t.  The search is exact (up to collisions of 55-bit hashes) and every document is a query:

1. Each document becomes a set of n-gram hashes; documents with equal sets are one *set* from here on.
2. Postings are shuffled by n-gram class, so that a task holds complete inverted lists.  An n-gram
   of a single set can't be in any overlap and is dropped.  As J(x, y) >= t needs an overlap of at
   least T = ceil(t |x|), a set with fewer than T shared n-grams is done: it has no partner.
3. Of the s shared n-grams of each remaining set only the s - T + 1 rarest are merged across the
   cluster (the rest, the longest lists, can hold at most T - 1 of the occurrences).  Every list
   names the least of its sets as leader, and each set joins the groups of its lists' leaders, so
   that any two matching sets meet in a group.
4. Groups are bounded in memory: one of more than ``GROUP_BYTES`` of n-grams is dealt into blocks of sets, and every
   pair of blocks is a group of its own that looks for the matches between the two.
5. Within a group DivideSkip runs on a local inverted index: the L longest lists are set
   aside, the short ones merged and counted, and documents that reach T - L are looked up in the
   long lists by binary search; those whose whole overlap is enough are kept.

6. Groups of many sets that are much alike have long lists, whose merging takes steps with the square of the sets times
   their n-grams.  Where it costs less, the lists that more than one set in ``WIDE`` is in are a bit matrix there,
   and its product with itself adds their part to every overlap; the other lists are counted.

Step 5 merges by sorting where the paper uses a heap: the lists are sorted runs, and numpy's stable sort
finds and merges such runs, in M log k steps for M entries of k lists as a heap does.  Where the entries are more than
the sets of the group, it counts them by set, in M steps.  Neither takes more steps than a heap would.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import checkpointed, chunks, fresh, joined, pack48, parts, runs, u64, unpack48
from .words import Words, gram_sets, mix, within

NGRAM, THRESHOLD = 3, 0.5
#: Weight of a binary probe against a merged entry in choosing the number of long lists.
MU = 0.01
#: N-grams of a group that are searched by one task.
GROUP_BYTES = 32 << 20
#: A list is wide if more than one in so many sets of its group are in it.
WIDE = 8
#: Fewest sets for which the matrix product is thought of, and the overlaps it holds at once.
PRODUCT_SETS, PRODUCT_CELLS = 64, 2 << 20
#: Nanoseconds of an entry merged, a pair compared, a pair in a wide list and an entry counted, as measured roughly.
_MERGED, _PAIR, _WIDE_PAIR, _COUNTED = 15, 20, 0.05, 10

_POSTINGS = "cls int, blk int, keys binary, counts binary, grams binary, df binary, ids binary"
_SETS = "set_key long, doc_ids array<long>, size int, grams binary, prefix int"


def _schema(*names: tuple[str, pa.DataType]) -> pa.Schema:
    return pa.schema([pa.field(n, t) for n, t in names])


_POST_ARROW = _schema(("cls", pa.int32()), ("blk", pa.int32()), *((n, pa.binary()) for n in ("keys", "counts", "grams", "df", "ids")))


def _needed(t: float, size: np.ndarray | float) -> np.ndarray:
    return np.ceil(t * np.asarray(size) - 1e-9)


def _rows(rows: list[tuple]) -> pa.Table:
    cols = list(zip(*rows, strict=True)) if rows else [[] for _ in _POST_ARROW]
    return pa.table([pa.array(c, type=f.type) for c, f in zip(cols, _POST_ARROW, strict=True)], schema=_POST_ARROW)


def _split(cls: np.ndarray, n: int) -> Iterator[tuple[int, slice]]:
    """Slices of equal values of a sorted small-integer array."""
    bounds = np.searchsorted(cls, np.arange(n + 1))
    for c in np.flatnonzero(bounds[1:] > bounds[:-1]):
        yield int(c), slice(int(bounds[c]), int(bounds[c + 1]))


def _by_owner(keys: np.ndarray) -> tuple[bytes, bytes]:
    """Runs of equal owners as (owner, count) arrays."""
    start, length = runs(keys)
    return keys[start].tobytes(), length.astype("<u4").tobytes()


def _explode_docs(n: int, classes: int, every: bool = False):
    """documents -> packed postings by n-gram class, and rows of (set, document, size) by set.

    With ``every``, a document without words is a set of its own; else it is left out.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches):
            w = Words(batch.column(1))
            g, first = gram_sets(w, n)
            size = np.diff(first)
            # A set is known by the sum of its scattered hashes, mixed with its size.
            total = np.zeros(len(g) + 1, dtype=np.uint64)
            np.cumsum(mix(g ^ np.uint64(0xA5A5A5A5A5A5A5A5)), out=total[1:])
            key = mix(total[first[1:]] - total[first[:-1]] + size.astype(np.uint64))
            owner = np.repeat(key, size)
            cls = (g >> np.uint64(48)).astype(np.int64) * classes >> 16
            order = np.argsort(cls, kind="stable")
            cls, owner, g = cls[order], owner[order], g[order]
            rows = []
            for c, at in _split(cls, classes):
                rows.append((c, None, *_by_owner(owner[at]), pack48(g[at]), None, None))
            ids = u64(batch.column(0))
            if every:
                key = np.where(size > 0, key, mix(ids ^ np.uint64(0x5A5A5A5A5A5A5A5A)))
            some = (size > 0) | every
            ids = ids[some]
            blk = (key[some] >> np.uint64(40)).astype(np.int64) % classes
            order = np.argsort(blk, kind="stable")
            k, s, ids, blk = key[some][order], size[some][order], ids[order], blk[order]
            for c, at in _split(blk, classes):
                rows.append((-1 - c, c, k[at].tobytes(), s[at].astype("<u4").tobytes(), None, None, ids[at].tobytes()))
            yield from _rows(rows).to_batches()

    return run


def _shared(classes: int):
    """Complete inverted lists of a class -> postings of those with two sets or more, by set block."""

    def run(table: pa.Table) -> pa.Table:
        if table.column("cls")[0].as_py() < 0:
            return table
        owner = np.repeat(joined(table.column("keys"), "<u8"), joined(table.column("counts"), "<u4"))
        g = unpack48(joined(table.column("grams"), "u1"))
        order = np.lexsort((owner, g))
        g, owner = g[order], owner[order]
        keep = np.ones(len(g), dtype=bool)  # equal documents give equal postings
        keep[1:] = (g[1:] != g[:-1]) | (owner[1:] != owner[:-1])
        g, owner = g[keep], owner[keep]
        _, length = runs(g)
        df = np.repeat(length, length)
        keep = df > 1
        g, owner, df = g[keep], owner[keep], df[keep]
        blk = (owner >> np.uint64(40)).astype(np.int64) % classes
        order = np.lexsort((owner, blk))
        g, owner, df, blk = g[order], owner[order], df[order], blk[order]
        rank = np.minimum(np.floor(np.log2(np.maximum(df, 1)) * 4), 255).astype(np.uint8)
        # The class stands for the hash bits that 48 bits leave out.
        c = table.column("cls")[0].as_py()
        return _rows([(c, b, *_by_owner(owner[at]), pack48(g[at]), rank[at].tobytes(), None) for b, at in _split(blk, classes)])

    return run


def _sets(t: float, every: bool = False):
    """Postings and members of a block of sets -> its sets that have copies or enough shared n-grams, or every set."""

    def run(table: pa.Table) -> pa.Table:
        cls = np.asarray(table.column("cls"))
        meta, post = table.filter(pa.array(cls < 0)), table.filter(pa.array(cls >= 0))
        key, size, ids = joined(meta.column("keys"), "<u8"), joined(meta.column("counts"), "<u4"), joined(meta.column("ids"), "<i8")
        order = np.lexsort((ids, key))
        key, size, ids = key[order], size[order], ids[order]
        keep = np.ones(len(key), dtype=bool)  # repeated rows are one document
        keep[1:] = (key[1:] != key[:-1]) | (ids[1:] != ids[:-1])
        key, size, ids = key[keep], size[keep], ids[keep]
        start, copies = runs(key)
        key, size = key[start], size[start].astype(np.int64)
        counts = joined(post.column("counts"), "<u4")
        owner = np.repeat(np.searchsorted(key, joined(post.column("keys"), "<u8")), counts)
        rank = joined(post.column("df"), "u1")
        g = unpack48(joined(post.column("grams"), "u1"))
        # The class completes the hash: its number goes into the top bits.
        per_row = np.array([len(x) // 6 for x in post.column("grams").to_pylist()], dtype=np.int64)
        g |= np.repeat(np.asarray(post.column("cls")).astype(np.uint64), per_row) << np.uint64(48)
        shared = np.bincount(owner, minlength=len(key))
        need = _needed(t, size).astype(np.int64)
        alive = shared >= np.maximum(need, 1)
        at = alive[owner]
        owner, rank, g = owner[at], rank[at], g[at]
        order = np.lexsort((g, rank, owner))
        g = g[order]
        first = np.searchsorted(owner[order], np.arange(len(key) + 1))
        out = np.flatnonzero(alive | (copies > 1) | every)
        return pa.table(
            {
                "set_key": pa.array(key[out].view(np.int64)),
                "doc_ids": pa.array([ids[start[i] : start[i] + copies[i]] for i in out], type=pa.list_(pa.int64())),
                "size": pa.array(size[out].astype(np.int32)),
                "grams": pa.array([g[first[i] : first[i + 1]].tobytes() if alive[i] else None for i in out], type=pa.binary()),
                "prefix": pa.array(np.where(alive, shared - need + 1, 0)[out].astype(np.int32)),
            }
        )

    return run


def _prefixes(classes: int):
    """Sets -> packed postings of their rarest shared n-grams, by class."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            grams = [np.frombuffer(x, "<u8")[:p] for x, p in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)]
            owner = np.repeat(u64(batch.column(0)), [len(x) for x in grams])
            g = np.concatenate(grams) if grams else np.zeros(0, np.uint64)
            cls = (mix(g) % np.uint64(classes)).astype(np.int64)
            order = np.lexsort((owner, cls))
            cls, owner, g = cls[order], owner[order], g[order]
            rows = [(c, None, *_by_owner(owner[at]), g[at].tobytes(), None, None) for c, at in _split(cls, classes)]
            yield from _rows(rows).to_batches()

    return run


def _leaders(table: pa.Table) -> pa.Table:
    """Lists of a class -> distinct (set, leader) for lists of two sets or more."""
    owner = np.repeat(joined(table.column("keys"), "<u8"), joined(table.column("counts"), "<u4"))
    g = joined(table.column("grams"), "<u8")
    order = np.lexsort((owner, g))
    g, owner = g[order], owner[order]
    start, length = runs(g)
    keep = np.repeat(length, length) > 1
    pair = np.stack([owner[keep], np.repeat(owner[start], length)[keep]], axis=1) if len(g) else np.zeros((0, 2), np.uint64)
    pair = np.unique(pair, axis=0)
    return pa.table({"set_key": pa.array(pair[:, 0].view(np.int64)), "leader": pa.array(pair[:, 1].view(np.int64))})


def _merged(lists: np.ndarray, m: int, x: int) -> tuple[np.ndarray, np.ndarray]:
    """The sets after x in the lists, and in how many of them each is."""
    if len(lists) > m:
        seen = np.bincount(lists, minlength=m)
        seen[: x + 1] = 0
        found = np.flatnonzero(seen)
        return found, seen[found]
    merged = np.sort(lists, kind="stable")
    start, length = runs(merged[np.searchsorted(merged, x, side="right") :])
    return merged[np.searchsorted(merged, x, side="right") + start], length


def matches(grams: list[np.ndarray], sizes: np.ndarray, t: float, mu: float = MU, side: np.ndarray | None = None) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For each set x its matches, each pair of sets once, and their overlaps: see :func:`divide_skip`.

    Without ``side`` the matches of x come after it; with it, only those of different sides are looked for.
    """
    m = len(grams)
    lengths = np.array([len(x) for x in grams], dtype=np.int64)
    owner = np.repeat(np.arange(m), lengths)
    g = np.concatenate(grams) if m else np.zeros(0, np.uint64)
    order = np.lexsort((owner, g))
    start, count = runs(g[order])
    gram_of = np.empty(len(g), dtype=np.int64)
    gram_of[order] = np.repeat(np.arange(len(start)), count)
    entries = owner[order]
    if m >= PRODUCT_SETS:
        one = m if side is None else int((side == side[0]).sum())
        compared = m * (m - 1) / 2 if side is None else one * (m - one)
        squares, wide = np.square(count[count > 1], dtype=np.float64) / 2, count[count > 1] * WIDE > m
        if compared * (_PAIR + _WIDE_PAIR * wide.sum()) + _COUNTED * squares[~wide].sum() < _MERGED * squares.sum():
            yield from _by_product(start, count, entries, gram_of, first=np.append(0, np.cumsum(lengths)), sizes=sizes, t=t, side=side)
            return
    probes = np.repeat(np.arange(len(start)), count) * m + entries  # sorted: list, then set
    first = np.cumsum(lengths) - lengths
    need = _needed(t, sizes).astype(np.int64)
    for x in range(m):
        lists = gram_of[first[x] : first[x] + lengths[x]]
        lists = lists[count[lists] > 1]
        need_x = max(int(need[x]), 1)
        if len(lists) < need_x:
            continue
        lists = lists[np.argsort(count[lists], kind="stable")]
        longest = int(count[lists[-1]])
        n_long = min(need_x - 1, int(need_x / (mu * math.log2(longest + 1) + 1)))
        short, long = lists[: len(lists) - n_long], lists[len(lists) - n_long :]
        found, total = _merged(entries[np.repeat(start[short], count[short]) + within(count[short])], m, x)
        keep = (total >= max(need_x - n_long, 1)) & (sizes[found] >= t * sizes[x] - 1e-9) & (sizes[x] >= t * sizes[found] - 1e-9)
        if side is not None:
            keep &= side[found] != side[x]
        found, total = found[keep], total[keep]
        if not len(found):
            continue
        if n_long:
            wanted = (long[:, None] * m + found[None, :]).ravel()
            at = np.searchsorted(probes, wanted)
            at[at == len(probes)] = 0
            total = total + (probes[at] == wanted).reshape(len(long), len(found)).sum(axis=0)
        good = total * (1 + t) >= t * (sizes[found] + sizes[x]) - 1e-9
        if good.any():
            yield x, found[good], total[good]


def _by_product(start: np.ndarray, count: np.ndarray, entries: np.ndarray, gram_of: np.ndarray, first: np.ndarray, sizes: np.ndarray, t: float, side: np.ndarray | None) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """The same for sets much alike: wide lists by a product of matrices, the others counted entry by entry."""
    m = len(sizes)
    wide = count * WIDE > m
    column = np.cumsum(wide) - 1
    bits = np.zeros((m, int(wide.sum())), dtype=np.uint8)
    gram = np.repeat(np.arange(len(start)), count)
    at = wide[gram]
    bits[entries[at], column[gram[at]]] = 1
    rows, cols = (np.arange(m), np.arange(m)) if side is None else (np.flatnonzero(side == side[0]), np.flatnonzero(side != side[0]))
    tile = max(1, PRODUCT_CELLS // max(1, bits.shape[1]))
    step, begin = max(1, min(256, tile, PRODUCT_CELLS // max(1, len(cols)))), 0
    while begin < len(rows):
        block = rows[begin : begin + step]
        others = cols[begin:] if side is None else cols
        overlap = np.empty((len(block), len(others)), dtype=np.float32)  # whole numbers: exact
        own = bits[block].astype(np.float32)
        for c in range(0, len(others), tile):
            overlap[:, c : c + tile] = own @ bits[others[c : c + tile]].astype(np.float32).T
        for k, x in enumerate(block.tolist()):
            lists = gram_of[first[x] : first[x + 1]]
            lists = lists[(count[lists] > 1) & ~wide[lists]]
            if len(lists):
                overlap[k] += np.bincount(entries[np.repeat(start[lists], count[lists]) + within(count[lists])], minlength=m)[others]
        # Rounded comparison first, with room for its error; what passes is compared exactly.
        rough = overlap * np.float32(1 + t) >= np.float32(t * (1 - 1e-5)) * (sizes[block].astype(np.float32)[:, None] + sizes[others].astype(np.float32))
        for k, x in enumerate(block.tolist()):
            near = np.flatnonzero(rough[k])
            found, total = others[near], overlap[k, near].astype(np.int64)
            good = (total > 0) & (total * (1 + t) >= t * (sizes[found] + sizes[x]) - 1e-9)
            if side is None:
                good &= found > x
            if good.any():
                yield x, found[good], total[good]
        begin += step


def divide_skip(grams: list[np.ndarray], sizes: np.ndarray, t: float, mu: float = MU) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All pairs i < j of sets whose Jaccard similarity is at least t, and their overlaps.

    ``grams`` holds each set's n-grams, of which those in no other set may be missing; ``sizes``
    the full sizes.  T-occurrence search with DivideSkip, one query a set.
    """
    found = [(np.full(len(b), x), b, o) for x, b, o in matches(grams, sizes, t, mu)]
    if not found:
        return (np.zeros(0, np.int64),) * 3
    return tuple(np.concatenate(c) for c in zip(*found, strict=True))


class _Joined:
    """The sets of a group, and which of them matches connect so far."""

    def __init__(self, m: int) -> None:
        self.label, self.members, self.apart = np.arange(m), [[i] for i in range(m)], m

    def join(self, x: int, other: np.ndarray) -> np.ndarray:
        """Places of those matches of x that join what was apart: as few as connect the same sets."""
        new = np.flatnonzero(self.label[other] != self.label[x])
        if not len(new):
            return new
        labels, at = np.unique(self.label[other[new]], return_index=True)
        all_ = [*labels.tolist(), int(self.label[x])]
        most = max(all_, key=lambda i: len(self.members[i]))
        for i in all_:
            if i != most:
                self.label[self.members[i]] = most
                self.members[most] += self.members[i]
                self.members[i] = []
        self.apart -= len(labels)
        return new[at]


def _joining(found: Iterator[tuple[int, np.ndarray, np.ndarray]], m: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Of the matches of a group those that join what was apart; once all are connected, no more are looked for."""
    joined_ = _Joined(m)
    for x, other, overlap in found:
        new = joined_.join(x, other)
        if len(new):
            yield x, other[new], overlap[new]
        if joined_.apart == 1:
            return


def _group(table: pa.Table, t: float) -> tuple[pa.Table, Iterator[tuple[int, np.ndarray, np.ndarray]]]:
    """The sets of a group in order, and their matches."""
    table = table.sort_by("set_key")
    sizes = np.asarray(table.column("size")).astype(np.int64)
    low, high = table.column("low")[0].as_py(), table.column("high")[0].as_py()
    side = np.asarray(table.column("block")) if low != high else None
    return table, matches([np.frombuffer(x, "<u8") for x in table.column("grams").to_pylist()], sizes, t, side=side)


def _search(t: float, links: bool):
    def run(table: pa.Table) -> pa.Table:
        table, found = _group(table, t)
        keys, sizes = np.asarray(table.column("set_key")), np.asarray(table.column("size")).astype(np.int64)
        if links:
            found = _joining(found, len(keys))
        parts_ = [(np.full(len(b), x), b, o) for x, b, o in found]
        a, b, o = (np.concatenate(c) for c in zip(*parts_, strict=True)) if parts_ else (np.zeros(0, np.int64),) * 3
        return pa.table({"set_a": keys[np.minimum(a, b)], "set_b": keys[np.maximum(a, b)], "jaccard": o / (sizes[a] + sizes[b] - o)})

    return run


def _count(t: float):
    """Sets of a group -> its links that connect them, as (set_a, set_b), and how many documents each set is linked to, as (set_a, null, links).

    Two sets may meet in several groups; their link counts in the one of the least leader they have in common.
    """

    def run(table: pa.Table) -> pa.Table:
        table, found = _group(table, t)
        m, own = table.num_rows, table.column("leader")[0].as_py()
        keys, copies = np.asarray(table.column("set_key")), np.asarray(table.column("copies")).astype(np.int64)
        lead = table.column("leaders")
        owner, leader = np.repeat(np.arange(m), np.asarray(pc.list_value_length(lead))), np.asarray(pc.list_flatten(lead))
        owner, leader = owner[leader < own], leader[leader < own]
        order = np.lexsort((owner, leader))
        start, length = runs(leader[order])
        list_of = np.empty(len(leader), dtype=np.int64)
        list_of[order] = np.repeat(np.arange(len(start)), length)
        bound, entries = np.searchsorted(owner, np.arange(m + 1)), owner[order]
        linked, joined_, a, b = np.zeros(m, dtype=np.int64), _Joined(m), [], []
        for x, other, _ in found:
            lists = list_of[bound[x] : bound[x + 1]]
            lists = lists[length[lists] > 1]
            if len(lists):
                before = np.zeros(m, dtype=bool)
                before[entries[np.repeat(start[lists], length[lists]) + within(length[lists])]] = True
                other = other[~before[other]]
            linked[x] += copies[other].sum()
            linked[other] += copies[x]
            if joined_.apart > 1 and len(new := joined_.join(x, other)):
                a.append(np.full(len(new), x))
                b.append(other[new])
        a, b = (np.concatenate(c) if c else np.zeros(0, np.int64) for c in (a, b))
        some = np.flatnonzero(linked)
        return pa.table(
            {
                "set_a": np.concatenate([keys[a], keys[some]]),
                "set_b": pa.array(np.concatenate([keys[b], keys[some]]), mask=np.arange(len(a) + len(some)) >= len(a)),
                "links": pa.array(np.concatenate([np.zeros(len(a), np.int64), linked[some]])),
            }
        )

    return run


def _groups(docs: DataFrame, n: int, threshold: float, group_bytes: int, every: bool = False) -> tuple[DataFrame, DataFrame]:
    """Sets of equal documents, and the sets of each group and pair of blocks in which matches are looked for."""
    spark: SparkSession = docs.sparkSession
    classes = parts(spark)
    source = docs.where(F.col("doc_id").isNotNull() & (F.col("text").isNotNull() | F.lit(every))).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    posted = source.mapInArrow(_explode_docs(n, classes, every), _POSTINGS)
    shared = posted.groupBy("cls").applyInArrow(_shared(classes), _POSTINGS)
    sets = checkpointed(shared.groupBy("blk").applyInArrow(_sets(threshold, every), _SETS))
    alive = sets.where(F.col("grams").isNotNull())
    prefix = alive.select("set_key", "grams", "prefix").mapInArrow(_prefixes(classes), _POSTINGS)
    member = prefix.groupBy("cls").applyInArrow(_leaders, "set_key long, leader long").distinct()
    member = checkpointed(member)
    weighed = member.join(alive.select("set_key", F.octet_length("grams").alias("weight")), "set_key")
    blocks = weighed.groupBy(F.col("leader").alias("of")).agg(F.ceil(F.sum("weight") / group_bytes).cast("int").alias("blocks"))
    # The block of each set in its groups, and the pairs of blocks that it takes part in.
    dealt = member.join(blocks, F.col("leader") == F.col("of")).withColumn("block", F.pmod(F.xxhash64("set_key"), F.col("blocks")).cast("int"))
    dealt = dealt.select("set_key", "leader", "block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
    dealt = dealt.select("set_key", "leader", "block", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"))
    kept = alive.select("set_key", "size", "grams", F.size("doc_ids").alias("copies"))
    if every:
        kept = kept.join(member.groupBy("set_key").agg(F.collect_list("leader").alias("leaders")), "set_key")
    return sets, dealt.join(kept if every else kept.drop("copies"), "set_key")


def similar_sets(docs: DataFrame, n: int = NGRAM, threshold: float = THRESHOLD, links: bool = False, group_bytes: int = GROUP_BYTES) -> tuple[DataFrame, DataFrame]:
    """Sets of equal documents, and pairs of sets whose similarity is at least the threshold.

    The first result has a row (set_key, doc_ids) for each set that has two documents or might have
    a partner; the second a row (set_a, set_b, jaccard) for each pair of different sets that match, or, with ``links``,
    for as many of them as connect the same sets: their number is in proportion to the sets, where that of pairs is not.
    """
    sets, dealt = _groups(docs, n, threshold, group_bytes)
    pairs = dealt.groupBy("leader", "low", "high").applyInArrow(_search(threshold, links), "set_a long, set_b long, jaccard double")
    return sets.select("set_key", "doc_ids"), pairs.distinct()


def ngram_jaccard_join(docs: DataFrame, n: int = NGRAM, threshold: float = THRESHOLD) -> DataFrame:
    """All pairs of documents whose word n-gram Jaccard similarity is at least ``threshold``.

    Columns: doc_a < doc_b (bigint) and jaccard (double).  Words are as in :mod:`.words`; a document
    of fewer than n words has one gram, all its words.  Documents with a null doc_id, a null text or
    no words match nothing.  Rows repeated with one doc_id and text are one document; several texts
    under one doc_id each take part, and no document is paired with itself.  An empty table gives an
    empty result.  Other columns are ignored.
    """
    sets, pairs = similar_sets(docs, n, threshold)
    sets, pairs = checkpointed(sets), checkpointed(pairs)
    copies = sets.where(F.size("doc_ids") > 1).select(F.posexplode("doc_ids").alias("i", "doc_a"), "doc_ids")
    equal = copies.select("doc_a", F.explode(F.expr("slice(doc_ids, i + 2, size(doc_ids))")).alias("doc_b"), F.lit(1.0).alias("jaccard"))
    a = sets.select(F.col("set_key").alias("set_a"), F.col("doc_ids").alias("ids_a"))
    b = sets.select(F.col("set_key").alias("set_b"), F.col("doc_ids").alias("ids_b"))
    near = pairs.join(a, "set_a").join(b, "set_b").select(F.explode("ids_a").alias("x"), "ids_b", "jaccard").select("x", F.explode("ids_b").alias("y"), "jaccard")
    near = near.where("x <> y").select(F.least("x", "y").alias("doc_a"), F.greatest("x", "y").alias("doc_b"), "jaccard")
    return equal.union(near)


def linked_documents(docs: DataFrame, n: int = NGRAM, threshold: float = THRESHOLD, group_bytes: int = GROUP_BYTES) -> DataFrame:
    """A row for each document: the class it is in, and how many documents it matches.

    Columns: doc_id, class_id and links (bigint).  Matches are those of :func:`ngram_jaccard_join`, all counted, copies among them;
    classes are what they connect, known by the least doc_id in them.  A document that matches nothing, such as one without words
    or with a null text, has 0 links and is its own class.  Rows with a null doc_id are left out.  Rows repeated
    with one doc_id and the same n-grams are one document; several texts under one doc_id are documents of their own, with a row each.
    An empty table gives an empty result.  Rows are as many as documents, and pairs are in no table.
    """
    sets, dealt = _groups(docs, n, threshold, group_bytes, every=True)
    found = checkpointed(dealt.groupBy("leader", "low", "high").applyInArrow(_count(threshold), "set_a long, set_b long, links long"))
    group = components(found.where("set_b is not null").select("set_a", "set_b"))
    links = found.where("set_b is null").groupBy(F.col("set_a").alias("set_key")).agg(F.sum("links").alias("links"))
    own = sets.select("set_key", "doc_ids").join(links, "set_key", "left").join(group, "set_key", "left")
    own = own.select(F.coalesce("component", "set_key").alias("component"), "doc_ids", (F.coalesce("links", F.lit(0)) + F.size("doc_ids") - 1).alias("links"))
    least = own.groupBy("component").agg(F.min(F.array_min("doc_ids")).alias("class_id"))
    return own.join(least, "component").select(F.explode("doc_ids").alias("doc_id"), "class_id", "links")


def keep_one_of_each_group(docs: DataFrame, n: int = NGRAM, threshold: float = THRESHOLD) -> DataFrame:
    """The documents without near duplicates: of each group of matching documents one stays.

    Groups are the connected components of the matches of :func:`ngram_jaccard_join`; the document of the least
    doc_id stays, once if its row is repeated (of repeated rows that differ in other columns any one).  Different texts under one doc_id are documents of their
    own.  Rows with a null id or text and documents without words stay as they are, repeated or not.
    All columns are kept, whatever their names.  An empty table gives an empty result.
    """
    # A row is known by its id and text, as one doc_id may stand for several texts.
    key = F.when(F.col("doc_id").isNotNull() & F.col("text").isNotNull(), F.xxhash64(F.col("doc_id").cast("long"), F.col("text").cast("string")))
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), key.alias("key"))
    sets, links = similar_sets(own.select(F.col("key").alias("doc_id"), "text"), n, threshold, links=True)
    group = components(links.select("set_a", "set_b"))
    member = sets.join(group, "set_key", "left").select(F.coalesce("component", "set_key").alias("component"), F.explode("doc_ids").alias("key"))
    member = member.join(own.where("key is not null").select("key", "doc_id"), "key")
    least = member.groupBy("component").agg(F.min(F.struct("doc_id", "key")).alias("least"))
    gone = member.join(least, "component").where("key <> least.key").select("key")
    # One join marks what goes; rows of one id and text lie together then, and the first of them stays.
    mark, gone_, place = fresh(docs, "mark"), fresh(docs, "gone"), fresh(docs, "place")
    marked = docs.withColumn(mark, F.xxhash64(F.col("doc_id").cast("long"), F.col("text").cast("string"))).join(gone.select(F.col("key").alias(mark), F.lit(True).alias(gone_)), mark, "left")
    placed = marked.where(F.col(gone_).isNull()).withColumn(place, F.row_number().over(Window.partitionBy(mark).orderBy(mark)))
    return placed.where((F.col(place) == 1) | F.col("doc_id").isNull() | F.col("text").isNull()).select(docs.columns)


def components(pairs: DataFrame) -> DataFrame:
    """(set_key, component) of all sets in the pairs (set_a, set_b): component is the least set of those connected.

    Alternating large-star and small-star steps (Kiveris et al., 2014), each two shuffles of the
    edges, until nothing changes: a logarithmic number of rounds.
    """
    edges = checkpointed(pairs.select(F.greatest("set_a", "set_b").alias("u"), F.least("set_a", "set_b").alias("v")).where("u <> v").distinct())
    while True:
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("e"))
        after = checkpointed(small.select("e.u", "e.v").where("u <> v").distinct())
        if edges.count() == after.count() and edges.exceptAll(after).isEmpty():
            return after.select(F.col("u").alias("set_key"), F.col("v").alias("component")).union(after.select(F.col("v").alias("set_key"), F.col("v").alias("component"))).distinct()
        edges = after
