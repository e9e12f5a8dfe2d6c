"""WARC archives, Zstandard-compressed with a dictionary: writing pages, and reading them back.

An archive begins with a skippable frame that holds the dictionary; then each record is a frame of
its own. Pages with equal payloads are stored once: the smallest page_id is a response, the others
are revisits that name it and carry its digest and the HTTP head, whose Content-Length is that of the
payload. Only digests are shuffled to find them.

Archives are files of bounded size in the run folder. A task writes each under a name of its own and
moves it into place, names follow from the partition, and a reader takes those that the manifest of
finished tasks has; so a task that runs again does no harm. The reader walks the frames of a file,
decodes one at a time, and checks the version line, the headers, the lengths and the digest.

Null html is an empty payload; a null url is left out; line ends in a url are percent-encoded. A null
page_id is larger than any other and written without a number. Repeated rows are all responses.
An empty table gives no archive and an empty result.
"""

from __future__ import annotations

import base64
import hashlib
import os
import struct
from collections.abc import Iterator

import pandas as pd
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from emberwatch.llm.common import run_folder, small_or_shuffled, staged

MIN_BYTES = 0
ARCHIVE_BYTES = 8_000_000
#: The dictionary is trained on so many pages, of each so many leading characters, to so many bytes.
SAMPLE_PAGES, SAMPLE_CHARS, DICTIONARY_BYTES = 500, 16_000, 32_768
LEVEL = 3
#: Fixed values of the formats.
VERSION = "WARC/1.1"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
SKIPPABLE = 0x184D2A5D
ZSTD_MAGIC = b"\x28\xb5\x2f\xfd"
DATE = "1970-01-01T00:00:00Z"
ID = "urn:page:"


def payload_digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(page_id: str | None, url: str | None, payload: bytes, refers_to: str | None) -> bytes:
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n"
    block = head.encode() + (payload if refers_to is None else b"")
    lines = [VERSION, f"WARC-Type: {'response' if refers_to is None else 'revisit'}"]
    lines += [f"WARC-Record-ID: <{ID}{page_id or ''}>", f"WARC-Date: {DATE}"]
    if url is not None:
        lines.append("WARC-Target-URI: " + url.replace("\r", "%0D").replace("\n", "%0A"))
    lines.append(f"WARC-Payload-Digest: sha1:{payload_digest(payload)}")
    if refers_to is not None:
        lines += [f"WARC-Refers-To: <{ID}{refers_to}>", f"WARC-Profile: {PROFILE}"]
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def headers(data: bytes, what: str) -> dict[str, str]:
    found = {}
    for line in data.decode().split("\r\n"):
        name, colon, value = line.partition(":")
        if not colon or not name or name != name.strip():
            raise ValueError(f"{what}: not a header: {line[:80]!r}")
        found[name.lower()] = value.strip()
    return found


def parse(data: bytes) -> dict:
    """A record's type, ids, digest and payload (of a revisit: none, but its length)."""
    top, blank, rest = data.partition(b"\r\n\r\n")
    version, _, lines = top.partition(b"\r\n")
    if not blank or version.decode("latin-1") != VERSION:
        raise ValueError(f"not a {VERSION} record: {data[:20]!r}")
    named = headers(lines, "WARC head")
    for name in ("warc-type", "warc-record-id", "warc-date", "content-length"):
        if name not in named:
            raise ValueError(f"WARC head without {name}")
    length = int(named["content-length"])
    if len(rest) != length + 4 or rest[length:] != b"\r\n\r\n":
        raise ValueError(f"a block of {len(rest) - 4} bytes where {length} are declared")
    if named["warc-type"] not in ("response", "revisit"):
        return {"type": named["warc-type"], "headers": named}
    http, blank, payload = rest[:length].partition(b"\r\n\r\n")
    status, _, lines = http.partition(b"\r\n")
    if not blank or not status.startswith(b"HTTP/"):
        raise ValueError(f"not an HTTP head: {status[:40]!r}")
    size = int(headers(lines, "HTTP head")["content-length"])
    digest = named["warc-payload-digest"].removeprefix("sha1:")
    if named["warc-type"] == "response" and (len(payload) != size or payload_digest(payload) != digest):
        raise ValueError(f"payload of {named['warc-record-id']} differs from its head")
    return {
        "type": named["warc-type"], "headers": named, "payload": payload, "size": size, "digest": digest,
        "id": _number(named["warc-record-id"]), "refers_to": _number(named.get("warc-refers-to")),
    }


def _number(urn: str | None) -> str | None:
    return urn[1:-1].removeprefix(ID) or None if urn else None


def dictionary_frame(dictionary: bytes) -> bytes:
    return struct.pack("<II", SKIPPABLE, len(dictionary)) + dictionary


def frame_end(data: bytes, at: int) -> int:
    """Where the Zstandard frame that begins at `at` ends: its head, blocks and checksum."""
    if data[at : at + 4] != ZSTD_MAGIC:
        raise ValueError(f"no frame at byte {at}")
    piece = data[at : at + 18]
    checksum = zstandard.get_frame_parameters(piece).has_checksum
    at += zstandard.frame_header_size(piece)
    last = False
    while not last:
        if at + 3 > len(data):
            raise ValueError("archive ends inside a frame")
        head = int.from_bytes(data[at : at + 3], "little")
        last, kind, size = head & 1, head >> 1 & 3, head >> 3
        at += 3 + (1 if kind == 1 else size)
    at += 4 * checksum
    if at > len(data):
        raise ValueError("archive ends inside a frame")
    return at


def read_archive(data: bytes) -> Iterator[dict]:
    magic, size = struct.unpack_from("<II", data)
    if magic != SKIPPABLE or 8 + size > len(data):
        raise ValueError("archive without a leading dictionary frame")
    dictionary = data[8 : 8 + size]
    if dictionary.startswith(ZSTD_MAGIC):  # the dictionary may be compressed itself
        dictionary = zstandard.ZstdDecompressor().decompressobj().decompress(dictionary)
    loaded = {"dict_data": zstandard.ZstdCompressionDict(dictionary)} if dictionary else {}
    reader, at = zstandard.ZstdDecompressor(**loaded), 8 + size
    while at < len(data):
        end = frame_end(data, at)
        yield parse(reader.decompressobj().decompress(data[at:end]))
        at = end


def train_dictionary(pages: DataFrame, folder: str) -> bytes:
    """From a bounded sample: the distinct pages of smallest hash, of each the leading characters. The
    hashes are found first and written, so only the sample's pages come to the driver, however
    many tasks read the table."""
    heads = pages.where("length(html) > 0").select(
        F.xxhash64("html").alias("at"), F.substring("html", 1, SAMPLE_CHARS).alias("head")
    )
    least = staged(heads.select("at").distinct().orderBy("at").limit(SAMPLE_PAGES), folder, "sample")
    heads = heads.join(F.broadcast(least), "at").groupBy("at").agg(F.min("head").alias("head"))
    texts = [r["head"].encode() for r in sorted(heads.collect())]
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, texts).as_bytes()
    except (zstandard.ZstdError, ValueError):  # too few or too short pages to train on
        return b""


class Archive:
    """One file that grows record by record and is moved into place when it is closed."""

    def __init__(self, folder: str, name: str, dictionary: bytes):
        from pyarrow.fs import FileSystem

        self.system, root = FileSystem.from_uri(folder)
        self.system.create_dir(root, recursive=True)
        self.name, self.records, self.size = name, 0, 0
        self.end = f"{root}/{name}"
        self.draft = f"{root}/_draft-{name}-{os.getpid()}-{os.urandom(4).hex()}"
        self.stream = self.system.open_output_stream(self.draft)
        loaded = {"dict_data": zstandard.ZstdCompressionDict(dictionary)} if dictionary else {}
        self.packer = zstandard.ZstdCompressor(level=LEVEL, write_checksum=True, **loaded)
        self.add(dictionary_frame(dictionary), packed=True)

    def add(self, data: bytes, packed: bool = False) -> None:
        frame = data if packed else self.packer.compress(data)
        self.stream.write(frame)
        self.size += len(frame)
        self.records += not packed

    def close(self) -> tuple[str, int]:
        self.stream.close()
        self.system.move(self.draft, self.end)
        return self.name, self.records


def _write(folder: str, shared):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        part, count, archive, done = TaskContext.get().partitionId(), 0, None, []
        for frame in frames:
            for page, url, html, first in zip(*(frame[c] for c in ("page", "url", "html", "first")), strict=True):
                if archive is None:
                    archive = Archive(folder, f"pages-{part:07d}-{count:05d}.warc.zst", shared.value)
                    count += 1
                archive.add(record(page, url, (html or "").encode(), first))
                if archive.size >= ARCHIVE_BYTES:
                    done.append(archive.close())
                    archive = None
        if archive is not None:
            done.append(archive.close())
        yield pd.DataFrame(done, columns=["name", "records"])

    return run


def _digests(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for frame in frames:
        payloads = [(x or "").encode() for x in frame["html"]]
        yield pd.DataFrame(
            {"page": frame["page"], "size": [len(p) for p in payloads], "digest": [hashlib.sha1(p).digest() for p in payloads]}
        )


def write_archives(pages: DataFrame, folder: str, min_bytes: int = MIN_BYTES) -> DataFrame:
    """Writes page_id, url and html as archives; gives the manifest: name and records."""
    spark = pages.sparkSession
    mine = pages.select(F.col("page_id").cast("string").alias("page"), "url", "html")
    digests = mine.select("page", "html").mapInPandas(_digests, "page string, size long, digest binary")
    digests = staged(digests.where(F.col("size") >= min_bytes), folder, "digests")
    number = F.col("page").cast("long")
    firsts = digests.groupBy("digest").agg(F.min(number).alias("first"), F.count("*").alias("n"))
    revisits = digests.join(firsts.where("n > 1 AND first IS NOT NULL"), "digest")
    revisits = revisits.where(number.isNull() | (number > F.col("first")))
    # A null id may have several payloads: its rows are told apart by their digest as well.
    revisits = revisits.select("page", F.hex("digest").alias("key"), F.col("first").cast("string").alias("first")).distinct()
    revisits = small_or_shuffled(staged(revisits, folder, "revisits"))
    key = F.upper(F.sha1(F.coalesce("html", F.lit("")).cast("binary")))
    joined = mine.join(revisits, mine["page"].eqNullSafe(revisits["page"]) & (key == revisits["key"]), "left")
    joined = joined.select(mine["page"], "url", "html", "first")
    shared = spark.sparkContext.broadcast(train_dictionary(pages, folder))
    return staged(joined.mapInPandas(_write(f"{folder}/archives", shared), "name string, records long"), folder, "manifest")


def _read(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    columns = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    for frame in frames:
        for content in frame["content"]:
            found = [
                (r["id"], r["size"], r["digest"], r["type"], r["refers_to"]) for r in read_archive(content) if "id" in r
            ]
            yield pd.DataFrame(found, columns=columns)


def read_archives(manifest: DataFrame, folder: str) -> DataFrame:
    """One row per record of the manifest's archives."""
    spark = manifest.sparkSession
    kinds = "page_id string, payload_bytes long, payload_digest string, record_type string, refers_to string"
    if manifest.limit(1).count() == 0:
        return spark.createDataFrame([], kinds)
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.warc.zst").load(f"{folder}/archives")
    files = files.withColumn("name", F.element_at(F.split("path", "/"), -1)).select("name", "content")
    return files.join(small_or_shuffled(manifest.select("name")), "name", "left_semi").mapInPandas(_read, kinds)


def round_trip(pages: DataFrame, min_bytes: int = MIN_BYTES) -> DataFrame:
    """Pages written to archives and read back: page_id, payload_bytes, payload_digest, record_type,
    refers_to."""
    folder = run_folder(pages.sparkSession)
    found = read_archives(write_archives(pages, folder, min_bytes), folder)
    return found.withColumns({c: F.col(c).cast("long") for c in ("page_id", "refers_to")})
