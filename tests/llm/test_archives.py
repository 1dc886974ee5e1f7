import base64
import hashlib
import struct

import pytest
import zstandard

from floorledger.llm.archives import (
    DICTIONARY_FRAME, ArchiveError, frames, parse_record, payload_digest, read_archives, record, write_archives,
)

PAGES = "page_id long, url string, html string, sha string, bytes int, payload string"


def pages(spark, rows):
    return spark.createDataFrame([(*row, "s", 1, "p") for row in rows], PAGES).repartition(3)


def test_round_trip_beyond_a_broadcast(spark, tmp_path):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        test_round_trip(spark, tmp_path)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_round_trip(spark, tmp_path):
    rows = [(n, f"http://a.test/{n}", f"<p>{n % 50} é😀</p>" * (n % 7 + 1)) for n in range(400)]
    rows += [(900, None, None), (901, "a\r\nb é", ""), (None, "u", "only"), (None, "u", "<p>0 é😀</p>"), (3, "twice", rows[3][2])]
    rows += [(902, "long", "x" * 3_000_000)]
    manifest = write_archives(pages(spark, rows), f"file://{tmp_path}/a", archive_bytes=4_000)
    assert manifest.count() > 3
    found = read_archives(manifest).collect()
    smallest = {}
    for page_id, _, html in rows:
        if page_id is not None:
            smallest[html or ""] = min(page_id, smallest.get(html or "", page_id))
    wanted = []
    for page_id, _, html in rows:
        payload, first = (html or "").encode(), smallest.get(html or "")
        refers_to = first if first is not None and first != page_id and sum((h or "") == (html or "") for _, _, h in rows) > 1 else None
        digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
        wanted.append((page_id, "response" if refers_to is None else "revisit", refers_to, digest, len(payload), payload if refers_to is None else None))
    got = [(r.page_id, r.record_type, r.refers_to, r.payload_digest, r.payload_bytes, r.payload and bytes(r.payload)) for r in found]
    got = [(*row[:5], b"" if row[1] == "response" and row[5] is None else row[5]) for row in got]
    assert sorted(got, key=str) == sorted([(*row[:5], row[5]) for row in wanted], key=str)
    assert all(r.problem is None for r in found)


def test_empty_table(spark, tmp_path):
    manifest = write_archives(pages(spark, []), f"file://{tmp_path}/a")
    assert read_archives(manifest).collect() == []


def test_dictionary_leads_and_other_skippable_frames_are_passed(tmp_path):
    import io

    samples = [b"some text that repeats %d times " % n * 3 for n in range(400)]
    dictionary = zstandard.train_dictionary(2000, samples)
    packer = zstandard.ZstdCompressor(dict_data=dictionary)
    lead = struct.pack("<II", DICTIONARY_FRAME, len(dictionary.as_bytes())) + dictionary.as_bytes()
    data = lead + packer.compress(b"one") + struct.pack("<II", 0x184D2A50, 3) + b"xyz" + packer.compress(b"two")
    assert list(frames(io.BytesIO(data))) == [b"one", b"two"]
    assert list(frames(io.BytesIO(b""))) == []
    with pytest.raises(ArchiveError):
        list(frames(io.BytesIO(data[:-2])))


@pytest.mark.parametrize("break_it", [
    lambda data: data.replace(b"WARC/1.1", b"WARC/9.9"),
    lambda data: data.replace(b"WARC-Date: 1970-01-01T00:00:00Z\r\n", b""),
    lambda data: data[:-1],
    lambda data: data + b"x",
    lambda data: data.replace(b"hello", b"jello"),
    lambda data: data.replace(b"Content-Length: 5", b"Content-Length: 6"),
    lambda data: data.replace(b"urn:page:1", b"urn:pagina:1"),
    lambda data: data.replace(b"WARC-Type: response", b"WARC-Type: magic"),
])
def test_damage_is_found(break_it):
    good = record(1, "http://a.test/", b"hello", None, payload_digest(b"hello"))
    assert parse_record(good)["payload"] == b"hello"
    with pytest.raises(ArchiveError):
        parse_record(break_it(good))
