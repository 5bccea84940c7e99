import hashlib
import struct

import pytest
import zstandard

from tessitura.llm.warc import DICTIONARY_MAGIC, SEPARATOR, archives, frames, page_record, parsed, read_archives, round_trip, write_archives

DATE = "2020-01-01T00:00:00Z"


def records(n):
    out = []
    for k in range(n):
        body = f"<html>{'page text ' * (k % 7)}{k}</html>".encode()
        out.append(page_record(k, f"http://x/{k}", body, hashlib.sha256(body).hexdigest(), None, DATE))
    return out


@pytest.mark.parametrize("n", [1, 3, 50, 400])
def test_archives_begin_with_their_dictionary(n):
    want = records(n)
    rows = [r for part in archives(iter(want), rows=40) for r in part]
    got = []
    for k in range(0, len(rows), 40):
        data = b"".join(r + SEPARATOR for r in rows[k : k + 40])
        assert struct.unpack_from("<I", data)[0] == DICTIONARY_MAGIC
        own = list(frames(data))
        assert own[0].startswith(b"WARC/1.1\r\nWARC-Type: warcinfo")
        got += own[1:]
    assert got == want
    assert all(parsed(r)["problem"] is None for r in got)


def test_compressed_dictionary_and_plain_archive():
    want = records(300)
    made = zstandard.train_dictionary(4096, want)
    pack = zstandard.ZstdCompressor(dict_data=made).compress
    raw = zstandard.compress(made.as_bytes())
    data = struct.pack("<II", DICTIONARY_MAGIC, len(raw)) + raw + b"".join(map(pack, want))
    assert list(frames(data)) == want
    assert list(frames(b"".join(map(zstandard.compress, want)))) == want
    assert list(frames(b"")) == []


def test_broken_archives():
    data = b"".join(r + SEPARATOR for part in archives(iter(records(5))) for r in part)
    for cut in (3, 100, len(data) - 20):
        with pytest.raises(ValueError):
            list(frames(data[:cut]))
    broken = bytearray(data)
    broken[-30] ^= 255
    told = list(frames(bytes(broken)))
    assert [type(x) for x in told[:-1]] == [bytes] * (len(told) - 1) and told[-1].startswith("frame: ")


def test_record_checks():
    body = b"<p>x</p>"
    good = page_record(1, None, body, hashlib.sha256(body).hexdigest(), None, DATE)
    assert parsed(good)["problem"] is None and parsed(good)["payload"] == body
    for old, new, what in ((b"WARC/1.1", b"WARC/9", "no WARC header"), (b"<p>x", b"<p>y", "payload digest does not fit"), (b"<p>x", b"<p>", "content-length does not fit"), (b"WARC-Date: ", b"X-Date: ", "no warc-date"), (b"WARC-Date: ", b"WARC Date ", "malformed header"), (b"Content-Length: 8\r", b"Content-Length: 9\r", "payload length does not fit"), (b"\r\n\r\n", b"", "no WARC header")):
        assert parsed(good.replace(old, new))["problem"] == what, old
    assert parsed(page_record(2, "u", body, "d", 1, DATE))["refers_to"] == "<urn:page:1>"


def test_round_trip(spark, tmp_path):
    long, short = "long payload é " * 20, "short"
    rows = [(1, "http://a\r\nb", long), (2, None, long), (3, "u", short), (4, "u", short), (5, "u", None), (6, "u", ""), (None, "u", long), (7, "u", "x" * 99), (8, "u", "x" * 99), (9, "u", "x" * 100), (10, "u", "x" * 100), (10, "u", "x" * 100), (11, "u", "y" * 3_000_000)]
    pages = spark.createDataFrame([(*r, "extra") for r in rows], "page_id long, url string, html string, digest string").repartition(3)
    got = round_trip(pages, str(tmp_path / "a"), rows=5).collect()
    first = {long: 1, "x" * 100: 9}
    want = []
    for i, _, html in rows:
        raw = (html or "").encode()
        f = first.get(html)
        revisit = f is not None and i != f
        want.append(str((i, len(raw), hashlib.sha256(raw).hexdigest(), "revisit" if revisit else "response", f if revisit else None, None)))
    assert sorted(str(tuple(x)) for x in got) == sorted(want)


def test_files_and_empty_table(spark, tmp_path):
    pages = spark.createDataFrame([(k, "u", f"page {k}") for k in range(30)], "page_id long, url string, html string").coalesce(1)
    write_archives(pages, str(tmp_path / "b"), rows=10)
    files = sorted((tmp_path / "b").glob("part-*"))
    assert len(files) == 4 and all(struct.unpack_from("<I", f.read_bytes())[0] == DICTIONARY_MAGIC for f in files)
    files[0].write_bytes(files[0].read_bytes()[:-30])
    for crc in (tmp_path / "b").glob(".*.crc"):
        crc.unlink()
    got = read_archives(spark, str(tmp_path / "b")).collect()
    assert sum(x.problem is not None for x in got) == 1 and 25 <= len(got) <= 31
    assert round_trip(pages.limit(0), str(tmp_path / "c")).count() == 0
