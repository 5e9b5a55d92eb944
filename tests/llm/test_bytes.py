import io
import random

import numpy as np
import pytest
import zstandard

from steppe.llm import tokens, warc
from steppe.llm.queries import TOKENIZER

from .conftest import EXTRA


def pages(spark):
    rng = random.Random(1)
    rows = [(i, f"http://h{i % 5}.example.com/{i}", f"<html>{'é' * rng.randrange(2000)}{i}</html>") for i in range(300)]
    rows += [(None, None, None), (301, "http://a\r\nX: y", "z"), (302, None, "x" * 900_000), (303, "u", ""), (303, "u", "")]
    return rows, spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "'clash' as text", "1 as data").repartition(2)


def test_bundles_give_back_every_record(spark):
    rows, df = pages(spark)
    out = warc.bundle_pages(df, frame_bytes=20_000, bundle_bytes=200_000).collect()
    assert len(out) > 3 and len({r.bundle_id for r in out}) == len(out)
    got = []
    for r in out:
        whole = zstandard.ZstdDecompressor().stream_reader(io.BytesIO(r.data), read_across_frames=True).read()
        table = warc.read_seek_table(r.data)
        assert len(table) == r.n_frames > 0 and sum(x[2] for x in table) == r.raw_bytes == len(whole)
        assert r.n_records == len(r["index"])
        joined = b""
        for e in r["index"]:
            one = warc.read_record(r.data, e.frame, e.offset, e.length)
            joined += one
            head, body = one.split(b"\r\n\r\n", 1)
            assert head.startswith(b"WARC/1.1\r\n") and e.record_id.encode() in head
            assert f"Content-Length: {len(body) - 4}".encode() in head
            got.append((e.page_id, body[:-4].decode()))
        assert joined == whole
    assert sorted(map(str, got)) == sorted(str((i, h or "")) for i, _, h in rows)


def test_bundle_files_and_records_by_identifier(spark, tmp_path):
    rows, df = pages(spark)
    bundles = warc.bundle_pages(df, frame_bytes=20_000, bundle_bytes=200_000).cache()
    table = warc.write_bundles(bundles, str(tmp_path / "out")).collect()
    assert len(table) == len(rows) and {r.file for r in table} == {p.name for p in (tmp_path / "out").iterdir()}
    for r in table[::17]:
        assert r.record_id.encode() in warc.read_file_record(str(tmp_path / "out" / r.file), r.asDict())
    ids = [(warc.record_id(7, rows[7][1]),), (warc.record_id(303, "u"),), ("<urn:uuid:none>",), (None,)]
    got = warc.find_records(bundles, spark.createDataFrame(ids, "record_id string")).collect()
    assert sorted(r.page_id for r in got) == [7, 303, 303] and all(r.record_id.encode() in bytes(r.record) for r in got)
    assert warc.write_bundles(bundles.limit(0), str(tmp_path / "none")).count() == 0


def test_no_pages(spark):
    _, df = pages(spark)
    assert warc.bundle_pages(df.limit(0)).count() == 0


def test_headers_cannot_be_split():
    assert warc.record(1, "http://a\r\nX: y", "z", "d").count(b"\r\nX: y") == 0


def test_blocks_round_trip():
    rng = np.random.default_rng(0)
    for block in (1, 7, 8, 128, 256):
        docs = [rng.integers(0, 50000, n) for n in (0, 1, 5, 127, 128, 129, 1000)]
        docs += [np.zeros(300, np.int64), np.full(256, 2**32 - 1), np.array([0, 2**32 - 1] * 90), rng.zipf(1.2, 500) % 2**31, np.zeros(0, np.int64)]
        out = tokens.encode(np.concatenate(docs), np.array([len(d) for d in docs]), block)
        for d, s in zip(docs, out, strict=True):
            assert tokens.decode(s).tolist() == d.tolist()
            for b in range(-(-len(d) // block)):
                assert tokens.decode_block(s, b).tolist() == d[b * block : (b + 1) * block].tolist()
    skewed = np.where(np.arange(1280) % 20 == 0, 2**30, np.arange(1280) % 16)
    assert len(tokens.encode(skewed, np.array([1280]))[0]) < 1280 * 4 * 0.35


def test_tokens_of_documents(docs, rows, empty):
    out = tokens.tokenized(docs, TOKENIZER).collect()
    assert len(out) == len(rows) and EXTRA
    encoder = tokens.tokenizer(TOKENIZER)
    want = sorted((str(i), [-1] if t is None else encoder.encode_ordinary(t)) for i, t, *_ in rows)
    got = sorted((str(r.doc_id), [-1] if r.data is None else tokens.decode(bytes(r.data)).tolist()) for r in out)
    assert [g for g in got if g[0] != "None"] == [w for w in want if w[0] != "None"]
    assert all(encoder.decode(tokens.decode(bytes(r.data)).tolist()) == t for r in out for i, t, *_ in rows if r.doc_id == i and t and r.data)
    assert all(r.n_tokens == 0 and r.n_blocks == 0 for r in out if not r.data or len(r.data) == 8)
    assert tokens.tokenized(empty, TOKENIZER).count() == 0


def decoded(stream):
    """The ids of a stream by the book: a bit at a time, from the layout that the module names."""
    number = lambda at, n: int.from_bytes(stream[at : at + n], "little")
    n, blocks = number(0, 4), number(4, 4)
    out = []
    for b in range(blocks):
        at = number(8 + 4 * b, 4)
        least, size, width, patched = number(at, 4), stream[at + 4] or 256, stream[at + 5], stream[at + 6]
        at += 7
        plane = -(-size // 8)
        ids = [least + sum((stream[at + w * plane + i // 8] >> i % 8 & 1) << w for w in range(width)) for i in range(size)]
        at += width * plane
        for k in range(patched):
            ids[stream[at + k]] += number(at + patched + 4 * k, 4) << width
        out += ids
    assert len(out) == n
    return out


def test_streams_are_laid_out_as_the_module_says():
    rng = np.random.default_rng(3)
    for percentile in (1, 50, 90, 100):
        x = rng.zipf(1.3, 700) % 2**31
        assert decoded(tokens.encode(x, np.array([700]), 128, percentile)[0]) == x.tolist()


def test_percentiles_are_checked(docs):
    for p in (0, 101):
        with pytest.raises(ValueError):
            tokens.tokenized(docs, TOKENIZER, percentile=p)


def test_long_runs_of_white_space():
    encoder = tokens.tokenizer(TOKENIZER)
    for space in (" ", "\n", "\u3000 \t"):
        for n in (9_999, 30_000):
            run = (space * n)[:n]
            for text in (run, f"a{run}", f"{run}b", f"one{run}two {run}, three\n", f"x {run}\x1c{run}"):
                assert tokens.encode_text(encoder, text) == encoder.encode_ordinary(text)
    for n in (1_000_000, 4_000_000):
        ids = tokens.encode_text(encoder, "start" + " " * n + "end")
        assert encoder.decode(ids) == "start" + " " * n + "end"
