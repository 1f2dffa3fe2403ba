import gzip
import hashlib
import io
import os
import random
import uuid

import pytest

from stagelens.llm import warc as w
from stagelens.session import scratch_dir
from tests.llm.cases import rows_of

PAGES = "page_id long, url string, html string, key long, digest string"


def pages(spark):
    big, long = "é" * 700, "<p>" + "word " * 40000
    rows = [(1, "http://a/1", big), (2, "http://a/2", big), (2, "http://a/2", big), (3, None, None), (4, "", ""), (5, "u\nv", "short"),
            (6, "u", "short"), (7, "u", long), (9, "u", "x" * 999), (10, "u", "x" * 999), (11, "u", "y" * 1000), (12, "u", "y" * 1000),
            (None, "u", "y" * 1000), (None, None, "lone" * 300)]
    return spark.createDataFrame([(*r, 5, "d") for r in rows], PAGES)


def plain(rows):
    data = [(r.page_id, (r.html or "").encode()) for r in rows]
    out = []
    for key, payload in data:
        same = [k for k, p in data if p == payload and k is not None]
        refers = max(same) if len(payload) >= 1000 and same and key != max(same) else None
        out.append((key, len(payload), hashlib.sha1(payload).hexdigest(), "response" if refers is None else "revisit", refers))
    return sorted(out, key=repr)


COLUMNS = ("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def test_awkward_pages(spark):
    table = pages(spark)
    assert rows_of(w.archived_pages(table), *COLUMNS) == plain(table.collect())


def test_empty_table(spark):
    assert w.archived_pages(spark.createDataFrame([], PAGES)).count() == 0


@pytest.mark.parametrize("split", [50, 1000, 1 << 20])
def test_payloads_come_back_at_any_split(spark, split):
    table = pages(spark)
    path = f"file://{scratch_dir(spark)}/warc-{uuid.uuid4().hex}"
    w.archive_pages(table, path)
    got = w.read_archives(spark, path, split, payloads=True).collect()
    stored = sorted(bytes(r.payload) for r in got if r.record_type == "response")
    rows = table.collect()
    kept = [key for key, *_, kind, _ in plain(rows) if kind == "response"]
    assert len(got) == len(rows) and len(stored) == len(kept)
    assert set(stored) == {(r.html or "").encode() for r in rows}
    assert len({(r.file, r.position) for r in got}) == len(got)
    for name in {r.file for r in got}:  # any gzip reader can read them
        assert gzip.decompress(open(name.removeprefix("file:"), "rb").read()).startswith(b"WARC/1.1\r\n")


def test_ranges_own_what_starts_inside():
    rng = random.Random(3)
    blob, places, payloads = b"", [], []
    for i in range(120):
        n = rng.choice([0, 5, 900, 5000])
        payload = w.MAGIC + b"\0abc" + os.urandom(n) if i % 3 == 0 else b"hello " * n
        places.append(len(blob))
        payloads.append(payload)
        blob += w.page_record(f"urn:page:{i}", "http://x/", payload, "d", len(payload), None)
    for split in (97, 1000, 65536, 10**9):
        got = []
        for start in range(0, len(blob), split):
            stop = min(len(blob), start + split)
            got += [(at, w.parse(r)[1]) for at, r in w.read_range(io.BytesIO(blob), len(blob), start, stop)]
        assert got == list(zip(places, payloads))


def test_magic_alone_is_no_record():
    assert not w.starts_record(w.MAGIC + b"\0" * 100)
    assert not w.starts_record(gzip.compress(b"no archive here\r\n\r\n"))
    assert w.starts_record(w.page_record("urn:page:1", None, b"x", "d", 1, None))


@pytest.mark.parametrize("split", [1000, 70_000, 1 << 20])
def test_long_urls(spark, split):
    rng = random.Random(4)
    mixed = "".join(rng.choice("abcdefghijklmnopqrstuvwxyz0123456789%/-_") for _ in range(200_000))
    urls = {1: "u", 2: "http://a/" + mixed, 3: "u", 4: "http://a/" + "z" * 200_000, 5: "u"}
    table = spark.createDataFrame([(k, u, "y" * 1500 if k < 3 else f"page {k}", 5, "d") for k, u in urls.items()], PAGES)
    path = f"file://{scratch_dir(spark)}/warc-{uuid.uuid4().hex}"
    w.archive_pages(table.coalesce(1), path)
    got = w.read_archives(spark, path, split).collect()
    assert {r.record_id: r.uri for r in got} == {f"urn:page:{k}": u for k, u in urls.items()} and len(got) == 5
    assert {r.refers_to for r in got} == {None, "urn:page:2"}


def test_header_without_end():
    cut = w.page_record("urn:page:1", "u" * 300_000, b"x", "d", 1, None)
    assert w.starts_record(cut) and not w.starts_record(cut[:-200])
    assert not w.starts_record(gzip.compress(w.VERSION + b"1 no blank line" * 20_000))
    assert not w.starts_record(b"") and not w.starts_record(gzip.compress(b"WARC"))
