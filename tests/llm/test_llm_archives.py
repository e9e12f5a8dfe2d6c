import base64
import hashlib
import struct

import pytest
import zstandard

pytest.importorskip("emberwatch.llm")

from emberwatch.llm import warc  # noqa: E402

SCHEMA = "page_id long, url string, html string, record_type string"


def expected(rows):
    first = {}
    for page, _, html, _ in rows:
        if page is not None:
            payload = (html or "").encode()
            first[payload] = min(page, first.get(payload, page))
    found = []
    for page, _, html, _ in rows:
        payload = (html or "").encode()
        digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
        lead = first.get(payload)
        revisit = lead is not None and (page is None or page != lead)
        found.append((page, len(payload), digest, "revisit" if revisit else "response", lead if revisit else None))
    return sorted(found, key=str)


@pytest.mark.parametrize("limit", [8_000_000, 500])
def test_round_trip(spark, monkeypatch, limit):
    monkeypatch.setattr(warc, "ARCHIVE_BYTES", limit)
    rows = [
        (5, "http://a/é?x\r\ny", "<p>one</p>", "c"), (3, None, "<p>one</p>", "c"), (8, "http://b", "<p>one</p>", "c"),
        (9, "u", None, "c"), (10, "u", "", "c"), (11, "u", "Ünï\r\n\r\ncode " * 9000, "c"), (12, "u", "WARC/1.1\r\n\r\n", "c"),
        (3, None, "<p>one</p>", "c"), (None, "u", "<p>one</p>", "c"), (None, "u", "only here", "c"), (2, "u", "two", "c"),
    ]
    rows += [(100 + k, f"http://c/{k}", f"page {k} " * (k + 1), "c") for k in range(60)]
    got = warc.round_trip(spark.createDataFrame(rows, SCHEMA).repartition(3)).collect()
    names = ("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
    assert sorted((tuple(r[n] for n in names) for r in got), key=str) == expected(rows)


def test_smaller_payloads_are_all_responses(spark):
    rows = [(k, "u", t, "c") for k, t in enumerate(["", "", "long enough", "long enough"])]
    got = warc.round_trip(spark.createDataFrame(rows, SCHEMA), min_bytes=5).collect()
    assert sorted((r["page_id"], r["record_type"], r["refers_to"]) for r in got) == [
        (0, "response", None), (1, "response", None), (2, "response", None), (3, "revisit", 2),
    ]


def test_empty_table(spark):
    assert warc.round_trip(spark.createDataFrame([], SCHEMA)).count() == 0


def archive(*records: bytes, dictionary: bytes = b"", compressed: bool = False) -> bytes:
    loaded = {"dict_data": zstandard.ZstdCompressionDict(dictionary)} if dictionary else {}
    packer = zstandard.ZstdCompressor(write_checksum=True, **loaded)
    head = zstandard.ZstdCompressor().compress(dictionary) if compressed else dictionary
    return warc.dictionary_frame(head) + b"".join(map(packer.compress, records))


def test_reader_takes_plain_and_compressed_dictionaries():
    words = (b"a common phrase of pages " * 40)[:900]
    payload = b"a common phrase of pages and more"
    for compressed in (False, True):
        data = archive(warc.record("1", "u", payload, None), warc.record("2", "u", payload, "1"), dictionary=words, compressed=compressed)
        one, two = warc.read_archive(data)
        assert one["payload"] == payload and two["refers_to"] == "1" and two["size"] == len(payload) and not two["payload"]
        assert one["headers"]["warc-target-uri"] == "u"


def test_reader_refuses_broken_archives():
    good = warc.record("1", "u", b"payload", None)
    for data in (
        b"", struct.pack("<II", 1, 0), struct.pack("<II", warc.SKIPPABLE, 99), archive(good)[:-3], archive(good) + b"rest of junk",
        archive(good.replace(b"WARC/1.1", b"WARC/9.9")), archive(good + b"x"), archive(good.replace(b"payload\r", b"pAyload\r")),
        archive(good.replace(b"WARC-Date", b"No Date")), archive(good.replace(b"HTTP/1.1 200", b"FTP")),
    ):
        with pytest.raises((ValueError, struct.error)):
            list(warc.read_archive(data))


def test_dictionary_sample_is_bounded_and_copies_count_once(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(warc, "SAMPLE_PAGES", 5)
    seen = []
    monkeypatch.setattr(warc.zstandard, "train_dictionary", lambda size, texts: seen.append(texts) or warc.zstandard.ZstdCompressionDict(b""))
    pages = [(f"<p>{k % 9}</p>" if k % 3 else "<p>hot</p>",) for k in range(300)] + [(None,), ("",)]
    for parts in (1, 40):
        warc.train_dictionary(spark.createDataFrame(pages, "html string").repartition(parts), str(tmp_path / str(parts)))
    assert seen[0] == seen[1] and len(seen[0]) == len(set(seen[0])) == 5
