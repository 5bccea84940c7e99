"""WARC archives in Zstandard: one frame per record, and the dictionary in a leading skippable frame.

An archive begins with a skippable frame that holds its dictionary, then a `warcinfo` record and the records, each a frame
of its own. Spark's text writer puts the frames into files on whatever store the path names; its separator is an empty
skippable frame, which readers pass over. Archives are bounded in records and bytes.

The reader loads the dictionary from the leading frame, finds each frame's end from its block headers, decodes one frame
at a time, and checks record headers, lengths and digests; what is wrong with a record stands in its `problem`.

Defined results: null html is an empty payload, null urls have no target header, line ends in urls become spaces; of equal
payloads of at least `least` bytes those rows with the smallest id are responses (also repeated rows, and all rows if no
id is there), the others revisit it; further columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
import struct
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessitura.llm.shared import columns, new_path, written

#: Rows (frames) and compressed bytes of an archive, at most; the last record may pass the bytes.
ARCHIVE_ROWS, ARCHIVE_BYTES = 2000, 16 << 20
#: The dictionary's size, and the records and bytes it is made from.
DICTIONARY_BYTES, DICTIONARY_RECORDS, DICTIONARY_SOURCE = 16 << 10, 200, 2 << 20
#: A record that claims more is not decoded.
RECORD_BYTES = 1 << 30
DICTIONARY_MAGIC, FRAME_MAGIC, SKIPPABLE = 0x184D2A5D, 0xFD2FB528, 0x184D2A50
#: An empty skippable frame; all its bytes are ASCII.
SEPARATOR = struct.pack("<II", SKIPPABLE, 0)
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_ID = "<urn:page:{}>"
_HEADER = re.compile(rb"([!#-'*+.^_`|~0-9A-Za-z-]+):[ \t]*([^\r\n]*)")
RECORD = "record_type string, record_id string, target_uri string, refers_to string, payload_bytes long, payload_digest string, payload binary, problem string"


def record(kind: str, headers: list[tuple[str, str]], block: bytes) -> bytes:
    head = [("WARC-Type", kind), *headers, ("Content-Length", str(len(block)))]
    return b"WARC/1.1\r\n" + b"".join(f"{k}: {v}\r\n".encode() for k, v in head) + b"\r\n" + block + b"\r\n\r\n"


def page_record(page_id, url: str | None, payload: bytes, digest: str, refers_to, date: str) -> bytes:
    """A response, or a revisit of another page's if `refers_to` is not None; the latter has the HTTP head alone."""
    headers = [("WARC-Record-ID", _ID.format("" if page_id is None else page_id)), ("WARC-Date", date), ("WARC-Payload-Digest", f"sha256:{digest}")]
    if url is not None:
        headers.append(("WARC-Target-URI", re.sub(r"[\r\n]", " ", url)))
    block = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    headers.append(("Content-Type", "application/http; msgtype=response"))
    if refers_to is None:
        return record("response", headers, block + payload)
    return record("revisit", [*headers, ("WARC-Profile", PROFILE), ("WARC-Refers-To", _ID.format(refers_to))], block)


def dictionary(samples: list[bytes]) -> zstandard.ZstdCompressionDict:
    """Trained on an archive's first records, or the last bytes of those where they are too few to train on."""
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, samples)
    except zstandard.ZstdError:
        return zstandard.ZstdCompressionDict(b"".join(samples)[-DICTIONARY_BYTES:] or b"WARC/1.1", dict_type=zstandard.DICT_TYPE_RAWCONTENT)


def archives(records: Iterator[bytes], level: int = 3, rows: int = ARCHIVE_ROWS, size: int = ARCHIVE_BYTES, date: str = "") -> Iterator[list[bytes]]:
    """Rows for the text writer: each archive takes `rows` of them, empty ones filling up all but the last archive."""
    waiting: list[bytes] = []
    records = iter(records)
    while True:
        held = sum(map(len, waiting))
        while len(waiting) < min(DICTIONARY_RECORDS, rows - 2) and held < DICTIONARY_SOURCE and (r := next(records, None)) is not None:
            waiting.append(r)
            held += len(r)
        if not waiting:
            return
        made = dictionary(waiting)
        raw = made.as_bytes()
        with_checks = zstandard.ZstdCompressionParameters.from_level(level, write_checksum=True, write_content_size=True)
        pack = zstandard.ZstdCompressor(dict_data=made, compression_params=with_checks).compress
        info = record("warcinfo", [("WARC-Record-ID", "<urn:archive>"), ("WARC-Date", date), ("Content-Type", "application/warc-fields")], b"software: tessitura\r\nformat: WARC/1.1\r\n")
        out = [struct.pack("<II", DICTIONARY_MAGIC, len(raw)) + raw, pack(info)]
        n, used = 2, sum(map(len, out))
        while n < rows and used < size:
            r = waiting.pop(0) if waiting else next(records, None)
            if r is None:
                break
            out.append(pack(r))
            n, used = n + 1, used + len(out[-1])
            if len(out) >= 100:
                yield out
                out = []
        if waiting or (r := next(records, None)) is not None:
            if not waiting:
                waiting = [r]
            out += [b""] * (rows - n)
            yield out
        else:
            yield out
            return


def write_archives(pages: DataFrame, path: str, least: int = 100, date: str = "1970-01-01T00:00:00Z", level: int = 3, rows: int = ARCHIVE_ROWS, size: int = ARCHIVE_BYTES) -> None:
    """Pages (page_id, url, html) as archives in the folder `path`.

    What is a revisit is decided on ids and digests alone. Payloads meet those decisions by page_id, so equal payloads don't
    gather in one task, and where the decisions are few Spark broadcasts them and no payload moves."""
    payload = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    source = columns(pages, "page_id", "url", "html").select("page_id", "url", payload.alias("payload"), F.sha2(payload, 256).alias("digest"))
    told = written(columns(pages, "page_id", "html").select("page_id", F.unhex(F.sha2(payload, 256)).alias("d"), F.octet_length(payload).alias("bytes")).where(F.col("bytes") >= least).select("page_id", "d"), "digests")
    first = told.groupBy("d").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).where("n > 1").select("d", "first")
    again = told.join(first, "d").where(~F.col("page_id").eqNullSafe(F.col("first")) & F.col("first").isNotNull()).distinct()
    again = written(again.select(F.col("page_id").alias("_p"), F.lower(F.hex("d")).alias("_d"), F.col("first").alias("refers_to")), "revisits")
    source = source.join(again, F.col("page_id").eqNullSafe(F.col("_p")) & (F.col("digest") == F.col("_d")), "left")
    source = source.select("page_id", "url", "payload", "digest", "refers_to")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def records() -> Iterator[bytes]:
            for batch in batches:
                for page_id, url, raw, digest, refers_to in zip(*batch.columns, strict=True):
                    yield page_record(page_id.as_py(), url.as_py(), raw.as_py(), digest.as_py(), refers_to.as_py(), date)

        for out in archives(records(), level, rows, size, date):
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], ["value"])

    frames = source.mapInArrow(work, "value binary").select(F.col("value").cast("string").alias("value"))
    frames.write.option("lineSep", SEPARATOR.decode()).option("maxRecordsPerFile", rows).option("compression", "none").text(path)


def frame_end(data: memoryview, at: int) -> int:
    """Where the frame that begins at `at` ends. ValueError if it is cut off or no frame begins there."""
    if len(data) - at < 8:
        raise ValueError("frame header is cut off")
    magic, skipped = struct.unpack_from("<II", data, at)
    if magic & 0xFFFFFFF0 == SKIPPABLE:
        end = at + 8 + skipped
    elif magic == FRAME_MAGIC:
        head = data[at : at + 18]
        try:
            end, checked = at + zstandard.frame_header_size(head), zstandard.get_frame_parameters(head).has_checksum
        except zstandard.ZstdError as e:
            raise ValueError(f"frame header: {e}") from e
        last = False
        while not last:
            if end + 3 > len(data):
                raise ValueError("block header is cut off")
            word = int.from_bytes(data[end : end + 3], "little")
            last, kind = bool(word & 1), word >> 1 & 3
            if kind == 3:
                raise ValueError("reserved block type")
            end += 3 + (1 if kind == 1 else word >> 3)
        end += 4 * checked
    else:
        raise ValueError(f"no frame at byte {at}")
    if end > len(data):
        raise ValueError("frame is cut off")
    return end


def frames(data: bytes) -> Iterator[bytes | str]:
    """The decoded frames of an archive, with the dictionary of its leading skippable frame if it has one; a problem as text
    for a frame that can't be decoded, after which the next follows. ValueError ends it where no frame's end is found."""
    view, at, unpack = memoryview(data), 0, zstandard.ZstdDecompressor()
    while at < len(view):
        end = frame_end(view, at)
        magic = struct.unpack_from("<I", view, at)[0]
        if magic == DICTIONARY_MAGIC and at == 0:
            raw = bytes(view[8:end])
            if raw[:4] == struct.pack("<I", FRAME_MAGIC):
                raw = zstandard.ZstdDecompressor().decompress(raw, max_output_size=RECORD_BYTES)
            unpack = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(raw))
        elif magic == FRAME_MAGIC:
            size = zstandard.get_frame_parameters(view[at : at + 18]).content_size
            if size > RECORD_BYTES:
                yield f"record of unknown size or more than {RECORD_BYTES} bytes"
            else:
                try:
                    yield unpack.decompress(view[at:end], max_output_size=size) if size else b""
                except zstandard.ZstdError as e:
                    yield f"frame: {e}"
        at = end


def parsed(raw: bytes) -> dict:
    """A record's fields (see RECORD), checked; `problem` is null where all is right."""
    out = dict.fromkeys(("record_type", "record_id", "target_uri", "refers_to", "payload_bytes", "payload_digest", "payload", "problem"))
    head, gap, rest = raw.partition(b"\r\n\r\n")
    first, *fields = head.split(b"\r\n")
    headers: dict[str, str] = {}
    for f in fields:
        if not (m := _HEADER.fullmatch(f)):
            return out | {"problem": "malformed header"}
        headers.setdefault(m[1].decode().lower(), m[2].decode("utf-8", "replace").strip())
    out |= {"record_type": headers.get("warc-type"), "record_id": headers.get("warc-record-id"), "target_uri": headers.get("warc-target-uri"), "refers_to": headers.get("warc-refers-to")}
    if not gap or not re.fullmatch(rb"WARC/1\.[01]", first):
        return out | {"problem": "no WARC header"}
    if missing := [h for h in ("warc-type", "warc-record-id", "warc-date", "content-length") if h not in headers]:
        return out | {"problem": f"no {missing[0]}"}
    size = int(headers["content-length"]) if headers["content-length"].isdigit() else -1
    block = rest[:size] if size >= 0 else b""
    if len(block) != size or rest[size:] != b"\r\n\r\n":
        return out | {"problem": "content-length does not fit"}
    if out["record_type"] not in ("response", "revisit"):
        return out
    http, gap, payload = block.partition(b"\r\n\r\n")
    length = re.search(rb"(?im)^content-length:[ \t]*(\d+)[ \t]*\r?$", http)
    if not gap or not length:
        return out | {"problem": "no HTTP head"}
    digest = headers.get("warc-payload-digest", "").removeprefix("sha256:")
    out |= {"payload_bytes": int(length[1]), "payload_digest": digest}
    if out["record_type"] == "revisit":
        return out | {"problem": None if out["refers_to"] and not payload else "revisit without reference or with payload"}
    if len(payload) != out["payload_bytes"]:
        return out | {"problem": "payload length does not fit"}
    return out | {"payload": payload, "problem": None if hashlib.sha256(payload).hexdigest() == digest else "payload digest does not fit"}


def read_archives(spark, path: str, with_payload: bool = True) -> DataFrame:
    """The records of all archives in a folder, but for warcinfo ones; a frame that can't be decoded, or a rest in which no
    frame is found, is one row with its problem. Without payloads, they are still checked."""
    files = spark.read.format("binaryFile").load(path).select("content")
    schema = pa.schema([("record_type", pa.string()), ("record_id", pa.string()), ("target_uri", pa.string()), ("refers_to", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("payload", pa.binary()), ("problem", pa.string())])

    def rows(data: bytes) -> Iterator[dict]:
        try:
            for raw in frames(data):
                row = dict.fromkeys(schema.names) | {"problem": raw} if isinstance(raw, str) else parsed(raw)
                if row["record_type"] != "warcinfo" or row["problem"]:
                    yield row if with_payload else row | {"payload": None}
        except ValueError as e:
            yield dict.fromkeys(schema.names) | {"problem": str(e)}

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for data in batch.column(0):
                held: list[dict] = []
                size = 0
                for row in rows(data.as_buffer().to_pybytes()):
                    held.append(row)
                    size += len(row["payload"] or b"")
                    if len(held) >= 500 or size > 8 << 20:
                        yield pa.RecordBatch.from_pylist(held, schema)
                        held, size = [], 0
                if held:
                    yield pa.RecordBatch.from_pylist(held, schema)

    return files.mapInArrow(work, RECORD)


def round_trip(pages: DataFrame, path: str, least: int = 100, **options) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to, problem: pages as read back from their archives."""
    write_archives(pages, path, least, **options)
    kind = dict(pages.dtypes)["page_id"]
    page = lambda c: F.nullif(F.regexp_extract(c, r"(?s)\A<urn:page:(.*)>\z", 1), F.lit("")).cast(kind)
    return read_archives(pages.sparkSession, path, with_payload=False).select(page("record_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", page("refers_to").alias("refers_to"), "problem")


def op2_warc_zstandard(spark, sf_dir: str) -> DataFrame:
    return round_trip(spark.read.parquet(f"{sf_dir}/pages.parquet"), new_path(spark, "archives"))


OP2_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS t FROM pages),
f AS (SELECT *, octet_length(encode(t)) AS n, sha256(t) AS d, min(page_id) OVER (PARTITION BY t) AS first FROM p)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, d AS payload_digest,
       CASE WHEN n >= 100 AND page_id <> first THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN n >= 100 AND page_id <> first THEN first END AS refers_to, CAST(NULL AS VARCHAR) AS problem
FROM f
"""
