"""Packing documents into training sequences by bin completion.

Documents are measured in words (or any length column) and packed into sequences of ``CAPACITY``.
A document longer than that is cut: its full pieces fill sequences of their own and the remainder
is packed like any other document, so that every word has its place.

Documents are dealt by hash into groups of about ``GROUP`` and each group is packed by
branch and bound over bins (Korf, 2003; Fukunaga and Korf, 2007): the largest document left
must go somewhere, so the search branches on how the rest of its bin is filled.  Only undominated
fillings are branched on; a filling is pruned when the waste so far exceeds what a solution with
one bin less than the incumbent may waste.  The first incumbent is best-fit decreasing, and the search
ends when it meets the lower bound, which it mostly does at once, when all fillings have been tried, or after ``NODES``
nodes, each a filling placed or a further batch of steps in finding fillings: then the
incumbent stands, which is complete and valid though perhaps not optimal.

A group's last sequence is the only one left largely empty, which costs less than one in
GROUP * mean length / CAPACITY sequences.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right, insort
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CAPACITY, GROUP, NODES = 2048, 4096, 2000
#: Fillings are found and ordered in batches: of so many without waste, or so many steps; first those that waste a
#: ``LITTLE``-th of the room at most.  None of the three leaves out a filling.
WIDTH, STEPS, LITTLE = 6, 300, 32

_OUT = "bin_id long, doc_id long, start_word long, n_words long, bin_offset long"


def lower_bound(lengths: np.ndarray, capacity: int) -> int:
    """The larger of the bins that the total needs and the items that can't share a bin."""
    return max(-(-int(lengths.sum()) // capacity), int((lengths * 2 > capacity).sum()))


def best_fit_decreasing(lengths: np.ndarray, capacity: int) -> list[list[int]]:
    """Bins of item indices: each item, longest first, goes where it leaves the least room."""
    rooms: list[tuple[int, int]] = []
    bins: list[list[int]] = []
    for i in np.argsort(-lengths, kind="stable").tolist():
        need = int(lengths[i])
        at = bisect_left(rooms, (need, -1))
        if at == len(rooms):
            bins.append([i])
            room, b = capacity, len(bins) - 1
        else:
            room, b = rooms.pop(at)
            bins[b].append(i)
        if room > need:
            insort(rooms, (room - need, b))
    return bins


def _batches(sizes: list[int], left: list[int], room: int, most_waste: int) -> Iterator[list[tuple[int, list[int]]]]:
    """All fillings as :func:`fillings` has them, by and by: those of little waste first, then the others.

    A batch has those found in the next ``STEPS`` steps and may have none.  Fillings of few documents come first, as
    they leave the small ones, which fit anywhere, for later; then those of less waste.
    """
    little, done = min(most_waste, room // LITTLE), -1
    rest = [*accumulate((s * c for s, c in zip(reversed(sizes), reversed(left), strict=True)), initial=0)][::-1]
    for limit in sorted({little, most_waste}) if most_waste >= 0 else ():
        for batch in _of_waste(sizes, left, room, limit, rest):
            # Those of less waste have been had.
            yield sorted((x for x in batch if x[0] > done), key=lambda x: (len(x[1]), x[0]))
        done = limit


def _of_waste(sizes: list[int], left: list[int], room: int, most_waste: int, rest: list[int]) -> Iterator[list[tuple[int, list[int]]]]:
    n = len(sizes)
    rising = sizes[::-1]
    least = next((s for s, c in zip(rising, reversed(left), strict=True) if c), room + 1)
    found: list[tuple[int, list[int]]] = []
    chosen: list[int] = []
    used = [0] * n
    at, steps, full = 0, 0, 0

    def above(s: int) -> int:
        """The least size above s of which something is left."""
        k = bisect_right(rising, s)
        while k < n and left[n - 1 - k] <= used[n - 1 - k]:
            k += 1
        return rising[k] if k < n else most_waste + room + s + 1

    def undominated(waste: int) -> bool:
        if waste == 0:
            return True
        if above(0) <= waste:
            return False  # something more goes in
        own = sorted(set(chosen))
        sums = {sizes[j] for j in own} | {sizes[a] + sizes[b] for k, a in enumerate(own) for b in own[k if used[a] > 1 else k + 1 :]}
        return all(above(s) > s + waste for s in sums)  # no larger item in place of one or two that are no larger together

    while True:
        if steps >= STEPS or full >= WIDTH:
            yield found
            found, steps, full = [], 0, 0
        steps += 1
        while at < n and (sizes[at] > room or left[at] <= used[at]):
            at += 1
        if at < n and most_waste < room - sizes[at] < least:
            # Too small to be the last and too large for another beside it: on to the first that isn't.
            at = max(at, n - bisect_right(rising, room - least))
            while at < n and left[at] <= used[at]:
                at += 1
        if at < n and room - rest[at] <= most_waste:
            chosen.append(at)
            used[at] += 1
            room -= sizes[at]
            continue
        if at == n and room <= most_waste and undominated(room):
            found.append((room, list(chosen)))
            full += room == 0
        if not chosen:
            yield found
            return
        at = chosen.pop()
        used[at] -= 1
        room += sizes[at]
        at += 1


def fillings(sizes: list[int], left: list[int], room: int, most_waste: int) -> list[tuple[int, list[int]]]:
    """All undominated ways to fill the room with the sizes (longest first) of which so many are left.

    Each is (waste, places in sizes), by waste, none above most_waste.
    """
    return sorted((x for batch in _batches(sizes, left, room, most_waste) for x in batch), key=lambda x: x[0])


def pack(lengths: np.ndarray, capacity: int, nodes: int = NODES) -> list[list[int]]:
    """Bins of item indices for items of 1 to ``capacity``, by bin completion."""
    best = best_fit_decreasing(lengths, capacity)
    bound, total = lower_bound(lengths, capacity), int(lengths.sum())
    if len(best) <= bound:
        return best
    sizes = sorted({int(x) for x in lengths}, reverse=True)
    items: dict[int, list[int]] = {s: [] for s in sizes}
    for i, x in enumerate(lengths.tolist()):
        items[x].append(i)
    left = [len(items[s]) for s in sizes]

    def allowed(wasted: int) -> int:
        return (len(best) - 1) * capacity - total - wasted

    def branches(wasted: int) -> Iterator[list[tuple[int, list[int]]]]:
        top = next((j for j, c in enumerate(left) if c), None)
        if top is None or allowed(wasted) < 0:
            return
        own = list(left)
        own[top] -= 1
        for batch in _batches(sizes, own, capacity - sizes[top], allowed(wasted)):
            yield [(w, [top, *chosen]) for w, chosen in batch]

    # Depth first, with an explicit stack of (fillings not yet tried, those not yet found, filling in place).
    rest = branches(0)
    stack: list[tuple[list[tuple[int, list[int]]], Iterator[list[tuple[int, list[int]]]], tuple[int, list[int]] | None]] = [(next(rest, [])[::-1], rest, None)]
    wasted, used = 0, 0
    while stack and used < nodes and len(best) > bound:
        todo, rest, placed = stack.pop()
        if placed is not None:
            wasted -= placed[0]
            for j in placed[1]:
                left[j] += 1
        if not todo:
            more = next(rest, None)
            if more is not None:
                used += 1
                stack.append((more[::-1], rest, None))
            continue
        waste, chosen = todo.pop()
        if waste > allowed(wasted):  # the incumbent has become better since
            stack.append((todo, rest, None))
            continue
        stack.append((todo, rest, (waste, chosen)))
        wasted += waste
        for j in chosen:
            left[j] -= 1
        used += 1
        if not any(left):
            if len(stack) < len(best):
                fresh = {s: list(x) for s, x in items.items()}
                best = [[fresh[sizes[j]].pop() for j in own[1]] for _, _, own in stack if own is not None]
            continue
        rest = branches(wasted)
        stack.append((next(rest, [])[::-1], rest, None))
    return best


def _pack_group(capacity: int, nodes: int):
    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by([("n_words", "descending"), ("doc_id", "ascending")])
        group = int(table.column("grp")[0].as_py())
        ids, total = table.column("doc_id").combine_chunks(), np.asarray(table.column("n_words")).astype(np.int64)
        full, rest = total // capacity, total % capacity
        some = np.flatnonzero(rest)
        bins = pack(rest[some], capacity, nodes)
        row = [np.repeat(np.arange(len(total)), full), *[some[b] for b in bins]]
        piece = np.arange(int(full.sum())) - np.repeat(np.cumsum(full) - full, full)
        row_of = np.concatenate(row).astype(np.int64) if row else np.zeros(0, np.int64)
        packed = np.concatenate([rest[some[b]] for b in bins]) if bins else np.zeros(0, np.int64)
        counts = np.array([len(b) for b in bins], dtype=np.int64)
        before = np.cumsum(packed) - packed
        first = np.cumsum(counts) - counts
        offset = before - np.repeat(before[first] if len(bins) else [], counts).astype(np.int64)
        n_full = len(piece)
        return pa.table(
            {
                "bin_id": pa.array((group << 32) + np.concatenate([np.arange(n_full), n_full + np.repeat(np.arange(len(bins)), counts)]).astype(np.int64)),
                "doc_id": ids.take(pa.array(row_of)),
                "start_word": pa.array(np.concatenate([piece * capacity, (full * capacity)[row_of[n_full:]]]).astype(np.int64)),
                "n_words": pa.array(np.concatenate([np.full(n_full, capacity), packed]).astype(np.int64)),
                "bin_offset": pa.array(np.concatenate([np.zeros(n_full, np.int64), offset]).astype(np.int64)),
            }
        )

    return run


def pack_documents(docs: DataFrame, capacity: int = CAPACITY, group: int = GROUP, nodes: int = NODES, length: Column | None = None) -> DataFrame:
    """Places of all documents in sequences of ``capacity`` words.

    A row (bin_id, doc_id, start_word, n_words, bin_offset), all bigint, puts the n_words words of
    doc_id from its word start_word (counted from 0) at bin_offset of the sequence bin_id.  Words are runs of
    characters other than white space, or what the integer column ``length`` counts.  Documents
    with a null text or length, or without words, take no place and have no row.  Rows with a null id are packed
    under it, and repeated rows are packed each, in one group of documents; of equal lengths the least doc_id is packed first.  A text of
    any length is cut as the module says.  An empty table gives an empty result.  Other columns are ignored.
    """
    n_words = F.regexp_count(F.col("text"), F.lit(r"\S+")) if length is None else length
    # Rows without an id are dealt by their texts, as they would else all lie in a few groups.
    tie = F.when(F.col("doc_id").isNull(), F.xxhash64("text")).alias("tie")
    measured = docs.select(F.col("doc_id").cast("long").alias("doc_id"), n_words.cast("long").alias("n_words"), tie).where("n_words > 0")
    groups = max(1, -(-docs.count() // group))
    dealt = measured.withColumn("grp", F.pmod(F.xxhash64("doc_id", "n_words", "tie", F.lit(5)), F.lit(groups)))
    return dealt.groupBy("grp").applyInArrow(_pack_group(capacity, nodes), _OUT)
