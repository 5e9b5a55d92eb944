"""Token ids in patched frame-of-reference blocks.

Each document's ids are cut into blocks of ``BLOCK``.  A block subtracts its least id and packs the
differences at the width that ``PERCENTILE`` percent of them fit in; what an outlier has beyond
this width goes into the block's exception list.  All integers are little-endian:

    stream:  number of ids (u32), number of blocks (u32), byte at which each block starts (u32 each), blocks
    block:   least id (u32), number of ids (u8, 0 for 256), width in bits (u8), number of exceptions (u8),
             the packed bits: for each bit, from the lowest, a plane of one bit for each id, the first
             in the lowest bit of the first byte, in whole bytes,
             the place of each exception (u8 each), and its bits above the width (u32 each)

The starts make any block readable by itself.
"""

from __future__ import annotations

import base64
import re
import struct
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import chunks

#: How the vocabulary's texts are cut before merging, as published with it.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
BLOCK, PERCENTILE = 128, 90
#: White space as the pattern has it, in runs that its look-ahead would need too deep a stack for.
_LONG_SPACE = re.compile(r"[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]{10000,}")
_HEAD = np.dtype([("least", "<u4"), ("n", "u1"), ("width", "u1"), ("patched", "u1")])


def _bits(x: np.ndarray) -> np.ndarray:
    """Bit length of non-negative integers below 2 ** 53."""
    return np.frexp(x.astype(np.float64))[1]


def encode(ids: np.ndarray, counts: np.ndarray, block: int = BLOCK, percentile: int = PERCENTILE) -> list[bytes]:
    """Streams of consecutive documents of so many ids each."""
    blocks = -(-counts // block)
    n_blocks = int(blocks.sum())
    size = np.full(n_blocks, block, dtype=np.int64)
    last = np.cumsum(blocks)[blocks > 0] - 1
    size[last] = (counts - (blocks - 1) * block)[blocks > 0]
    grid = np.zeros((n_blocks, block), dtype=np.int64)
    filled = np.arange(block) < size[:, None]
    grid[filled] = ids
    least = np.where(filled, grid, np.iinfo(np.int64).max).min(axis=1) if n_blocks else np.zeros(0, np.int64)
    grid -= least[:, None]
    grid[~filled] = 0
    ranked = np.sort(np.where(filled, grid, np.iinfo(np.int64).max), axis=1)
    at = -(-size * percentile // 100) - 1
    width = _bits(ranked[np.arange(n_blocks), at]).astype(np.int64)
    patched = grid >> width[:, None] > 0
    head = np.zeros(n_blocks, dtype=_HEAD)
    head["least"], head["n"], head["width"], head["patched"] = least, size % 256, width, patched.sum(axis=1)
    heads = head.tobytes()
    planes: list[bytes] = [b""] * n_blocks
    for w in np.unique(width[width > 0]):
        own = np.flatnonzero(width == w)
        low = grid[own].astype(np.uint32)
        packed = np.empty((len(own), int(w), -(-block // 8)), dtype=np.uint8)
        for b in range(int(w)):
            packed[:, b] = np.packbits((low >> np.uint32(b) & np.uint32(1)).astype(np.uint8), axis=1, bitorder="little")
        for i, j in enumerate(own):
            planes[j] = packed[i, :, : -(-int(size[j]) // 8)].tobytes()
    row, place = np.nonzero(patched)
    high = (grid[row, place] >> width[row]).astype("<u4")
    place = place.astype(np.uint8)
    bounds = np.searchsorted(row, np.arange(n_blocks + 1))
    step = _HEAD.itemsize
    bodies = [heads[i * step : (i + 1) * step] + planes[i] + place[bounds[i] : bounds[i + 1]].tobytes() + high[bounds[i] : bounds[i + 1]].tobytes() for i in range(n_blocks)]
    out, at = [], 0
    for n, b in zip(counts.tolist(), blocks.tolist(), strict=True):
        own = bodies[at : at + b]
        lengths = np.array([len(x) for x in own], dtype=np.int64)
        starts = 8 + 4 * b + np.cumsum(lengths) - lengths
        out.append(b"".join([struct.pack("<II", n, b), starts.astype("<u4").tobytes(), *own]))
        at += b
    return out


def decode_block(stream: bytes, number: int) -> np.ndarray:
    """The ids of one block."""
    at = struct.unpack_from("<I", stream, 8 + 4 * number)[0]
    least, n, width, patched = (int(x) for x in np.frombuffer(stream, _HEAD, 1, at)[0])
    n = n or 256
    at += _HEAD.itemsize
    per_plane = -(-n // 8)
    value = np.zeros(n, dtype=np.int64)
    for b in range(width):
        value |= np.unpackbits(np.frombuffer(stream, np.uint8, per_plane, at), bitorder="little")[:n].astype(np.int64) << b
        at += per_plane
    place = np.frombuffer(stream, np.uint8, patched, at)
    value[place] |= np.frombuffer(stream, "<u4", patched, at + patched).astype(np.int64) << width
    return value + least


def decode(stream: bytes) -> np.ndarray:
    n, blocks = struct.unpack_from("<II", stream)
    ids = [decode_block(stream, i) for i in range(blocks)]
    out = np.concatenate(ids) if ids else np.zeros(0, np.int64)
    if len(out) != n:
        raise ValueError("the stream is damaged")
    return out


@lru_cache(maxsize=2)
def tokenizer(path: str, pattern: str = PATTERN):
    """The byte-level BPE whose ranks are in the file; loaded once in each worker."""
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
    return tiktoken.Encoding("local", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def encode_text(encoder, text: str) -> list[int]:
    """The ids of a text of any length.

    A long run of white space is one piece of the pattern but for its last character where something follows, which goes with
    that; so it is encoded as such a piece, and the text before and after it by itself, which gives the same ids.
    """
    ids, at = [], 0
    for run in _LONG_SPACE.finditer(text):
        end = run.end() if run.end() == len(text) else run.end() - 1
        ids += encoder.encode_ordinary(text[at : run.start()])
        ids += encoder._encode_single_piece(text[run.start() : end])
        at = end
    return ids + encoder.encode_ordinary(text[at:] if at else text)


def token_ids(texts: list[str | None], path: str) -> tuple[np.ndarray, np.ndarray]:
    """All ids, one text after the other, and how many each text has."""
    encoder = tokenizer(path)
    ids = [np.asarray(encode_text(encoder, t), dtype=np.int64) if t else np.zeros(0, np.int64) for t in texts]
    return (np.concatenate(ids) if ids else np.zeros(0, np.int64)), np.array([len(x) for x in ids], dtype=np.int64)


def tokenized(docs: DataFrame, path: str, block: int = BLOCK, percentile: int = PERCENTILE) -> DataFrame:
    """A row (doc_id bigint, n_tokens bigint, n_blocks bigint, data binary) for every row of the documents.

    ``data`` is the stream of the text's token ids (see the module).  A null text has null data and
    no tokens, an empty one a stream without blocks; null ids and repeated rows are encoded like any
    other, and a text of any length is encoded whole.  An empty table gives an empty result.  Other columns are ignored.  ``path`` must be readable on every executor.
    """
    if not 0 < block <= 256:
        raise ValueError("a block holds 1 to 256 ids")
    if not 0 < percentile <= 100:
        raise ValueError("a percentile is 1 to 100")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, limit=1 << 20):
            texts = batch.column(1).to_pylist()
            ids, counts = token_ids(texts, path)
            data = [None if t is None else x for t, x in zip(texts, encode(ids, counts, block, percentile), strict=True)]
            yield pa.record_batch([batch.column(0), pa.array(counts), pa.array(-(-counts // block)), pa.array(data, type=pa.binary())], names=["doc_id", "n_tokens", "n_blocks", "data"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, n_tokens long, n_blocks long, data binary")
