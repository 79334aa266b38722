import hashlib
import struct

import zstandard

from keelson.llm import warc

SCHEMA = "page_id long, url string, html string, digest string, size int, first long, archive string"


def frame(spark, rows):
    return spark.createDataFrame([(*r, "d", 1, 2, "a") for r in rows], SCHEMA)


LONG = "<p>" + "päge " * 40 + "</p>"
ROWS = [
    (1, "http://a/", LONG), (2, None, LONG), (3, "http://b/ c\r\nX-Evil: 1", "short"), (4, "http://d/", "short"), (5, "http://e/", None), (6, "", ""),
    (7, "http://f/", "x" * 100), (8, "http://g/", "x" * 100), (9, "http://h/", "x" * 99), (10, "http://h/", "x" * 99), (None, "http://n/", LONG),
    (11, "http://big/", "\r\n\r\n<b>漢</b>" * 90_000), (12, "http://i/", "unique " * 30), (12, "http://i/", "unique " * 30),
]


def brute(rows):
    out = []
    for i, _, h in rows:
        b = (h or "").encode()
        same = [j for j, _, x in rows if j is not None and (x or "") == (h or "")]
        first = min(same) if len(b) >= 100 and same and sum((x or "") == (h or "") for _, _, x in rows) > 1 else None
        to = first if first is not None and i != first else None
        out.append((i, len(b), hashlib.sha256(b).hexdigest(), "revisit" if to is not None else "response", to))
    return sorted(out, key=repr)


def test_round_trip(spark):
    archives = warc.archive(frame(spark, ROWS))
    got = warc.read(archives).collect()
    assert sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got), key=repr) == brute(ROWS)
    text = {(i, h or "") for i, _, h in ROWS}
    assert all((r.page_id, r.html) in text for r in got if r.record_type == "response")
    assert {r.url for r in got if r.page_id == 3} == {"http://b/%20c%0D%0AX-Evil:%201"}


def test_format(spark):
    """The first frame is skippable and holds the dictionary; each record is a frame of its own."""
    records = [warc._record(i, f"http://x/{i}", f"<html><body>{'words and more words ' * 20}{i}</body></html>".encode(), "0" * 64, 1, None) for i in range(300)]
    content = warc.write_archive(records)
    magic, size = struct.unpack_from("<II", content)
    assert magic == warc.SKIPPABLE and size > 0
    plain = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(content[8 : 8 + size]))
    at, seen = 8 + size, 0
    while at < len(content):
        frame_ = plain.decompressobj()
        assert frame_.decompress(content[at:]) == records[seen]
        at = len(content) - len(frame_.unused_data)
        seen += 1
    assert seen == len(records)
    assert len(content) < sum(len(zstandard.compress(r)) for r in records)


def test_tiny_archives_have_no_dictionary():
    content = warc.write_archive([warc._record(1, "u", b"", "0" * 64, 0, None)])
    assert len(list(warc.read_archive(content))) == 1


def test_export_and_empty(spark, tmp_path):
    archives = warc.archive(frame(spark, ROWS))
    warc.export(archives, str(tmp_path / "out"))
    files = sorted((tmp_path / "out").iterdir())
    assert files and all(f.name.endswith(".warc.zst") for f in files)
    assert sum(len(list(warc.read_archive(f.read_bytes()))) for f in files) == len(ROWS)
    assert warc.read(warc.archive(frame(spark, []))).collect() == []
