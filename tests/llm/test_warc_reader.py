"""The WARC reader on records of any form: long HTTP heads, cut and malformed records, and what is read of refused ones."""

import base64
import gzip
import hashlib

import pyarrow as pa
import pytest

from sparkloom.llm import warc

ALL = frozenset(warc.HEADERS) | {"http_length", "payload", "payload_length", "payload_sha1"}


def plain(kind="response", payload=b"body", head_bytes=0, page="7", blank=True):
    http = b"HTTP/1.1 200 OK\r\n" + b"X-Pad: " + b"p" * head_bytes + b"\r\nContent-Length: %d\r\n" % len(payload) + (b"\r\n" if blank else b"")
    block = http + payload
    return f"WARC/1.1\r\nWARC-Type: {kind}\r\nX-Page-Id: {page}\r\nContent-Length: {len(block)}\r\n\r\n".encode() + block + b"\r\n\r\n"


def read(data, names=ALL, filters=(), strict=True):
    return list(warc.records(pa.BufferReader(data), frozenset(names), list(filters), strict))


FORMS = {"plain": lambda r: r, "gzip": gzip.compress, "sl": warc.member}


@pytest.mark.parametrize("form", FORMS)
def test_http_length_does_not_depend_on_the_columns(form):
    data = b"".join(FORMS[form](plain(payload=b"x" * n, head_bytes=pad)) for n, pad in ((5, 0), (0, 5000), (300_000, 3000), (9, 1 << 21)))
    rows = read(data)
    assert [r["http_length"] for r in rows] == [5, 0, 300_000, 9] == [r["payload_length"] for r in rows]
    assert [r["http_length"] for r in read(data, {"http_length"})] == [5, 0, 300_000, 9]
    assert [r["payload_sha1"] for r in rows] == [base64.b32encode(hashlib.sha1(b"x" * n).digest()).decode() for n in (5, 0, 300_000, 9)]


@pytest.mark.parametrize("form", FORMS)
def test_cut_and_malformed_records(form):
    pack = FORMS[form]
    good = pack(plain())
    long = pack(plain(payload=bytes(range(256)) * 40))
    for cut in (9, len(long) // 2, len(long) - 40):
        with pytest.raises(warc.Malformed):
            read(good + long[:-cut])
        assert len(read(good + long[:-cut], strict=False)) == 1
    no_length = pack(b"WARC/1.1\r\nWARC-Type: response\r\n\r\nx\r\n\r\n")
    no_head = pack(b"WARC/1.1\r\nWARC-Type: response")
    for bad in (no_length, no_head):
        with pytest.raises(warc.Malformed):
            read(good + bad)
        assert len(read(good + bad, strict=False)) == 1
    # A member of known length is skipped; one of an unknown length ends its file.
    assert len(read(good + no_length + good, strict=False)) == (2 if form == "sl" else 1)
    assert [r["page_id"] for r in read(pack(plain(page="seven")) + pack(plain(page="12")))] == [None, 12]
    assert read(b"") == []


def test_refused_records_are_not_inflated():
    bulk = b"".join(b"%d," % (i * i * 7919) for i in range(400_000))
    data = warc.member(plain("revisit", payload=bulk, blank=False)) + warc.member(plain())
    buffer = pa.BufferReader(data)
    taken = []

    class Counting:
        size, seek = buffer.size, buffer.seek

        @staticmethod
        def read(n):
            got = buffer.read(n)
            taken.append(len(got))
            return got

    rows = list(warc.records(Counting, ALL, [("record_type", "eq", "response")]))
    assert [r["payload"] for r in rows] == [b"body"] and sum(taken) < 8192 < len(data)


def test_modes_in_spark(spark, tmp_path):
    (tmp_path / "a.warc.gz").write_bytes(warc.member(plain()) + warc.member(b"WARC/1.1\r\n\r\n") + warc.member(plain(page="8")))
    path = str(tmp_path)
    assert sorted(r.page_id for r in warc.read_archives(spark, path, "page_id long", mode="DROPMALFORMED").collect()) == [7, 8]
    with pytest.raises(Exception, match="no length"):
        warc.read_archives(spark, path, "page_id long").collect()


def test_equal_payloads(spark):
    rows = [(i, "u", "copy" if i % 3 else f"own {i}") for i in range(60)]
    got = {r.page_id: r for r in warc.warc_digest(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)).collect()}
    assert {i for i, r in got.items() if r.record_type == "revisit"} == {i for i in range(59) if i % 3} and {r.refers_to for r in got.values()} == {None, 59}
    assert all((r.payload_bytes, r.payload_digest) == (4, base64.b32encode(hashlib.sha1(b"copy").digest()).decode()) for i, r in got.items() if i % 3)
