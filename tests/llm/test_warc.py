import hashlib
import os
import random

from fxspark.llm import warc
from fxspark.session import work_dir

SCHEMA = "page_id long, url string, html string, kind string, member string, first string"
LONG = "<p>" + "words of a page " * 20


def page_rows():
    return [(1, "http://a/1", LONG, "z", "z", "z"), (2, "http://a/2", LONG, "z", "z", "z"), (3, None, None, "z", "z", "z"), (4, "http://a/ü b", "", "z", "z", "z"),
            (5, "u", "short", "z", "z", "z"), (6, "u", "short", "z", "z", "z"), (7, "x", "WARC/1.1\r\nnot a record\r\n\r\n" * 9, "z", "z", "z"), (1, "http://a/1", LONG, "z", "z", "z"),
            (None, "n", LONG, "z", "z", "z"), (8, "é", "雪" * 4000, "z", "z", "z")]


def expected():
    for page_id, _, html, *_ in page_rows():
        body = (html or "").encode()
        first = 1 if html == LONG and page_id != 1 else None
        yield page_id or -1, len(body), hashlib.sha256(body).hexdigest(), "revisit" if first else "response", first or -1


def as_rows(frame):
    return sorted((r.page_id or -1, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to or -1) for r in frame.collect())


def test_round_trip(spark):
    pages = spark.createDataFrame(page_rows(), SCHEMA).repartition(3)
    assert as_rows(warc.round_trip(pages)) == sorted(expected())
    folder = work_dir(spark, "warc-test")
    manifest = warc.write(pages, folder, file_bytes=300)
    for size in (64, 500, 1 << 20):
        got = warc.read(manifest, range_bytes=size)
        assert as_rows(got) == sorted(expected())
        assert all(hashlib.sha256(r.payload).hexdigest() == r.payload_digest for r in got.filter("record_type = 'response'").collect())
    assert warc.round_trip(spark.createDataFrame([], SCHEMA)).count() == 0


def archive(n, zipped):
    parts = []
    for i in range(n):
        body = (f"page {i} " * (20 + i)).encode()
        record = warc.encode(i, f"http://x/{i}", hashlib.sha256(body).hexdigest(), len(body), body)
        parts.append(warc.member(record) if zipped else record)
    return parts


def test_salvage_goes_on_after_damage():
    r = random.Random(3)
    for zipped in (True, False):
        parts = archive(12, zipped)
        for _ in range(40):
            hurt, data, starts = {r.randrange(12), r.randrange(12)}, b"", []
            for i, p in enumerate(parts):
                starts.append(len(data))
                if i in hurt:
                    way = r.randrange(4)
                    at = r.randrange(len(p) // 3, len(p) - 8)
                    p = [p[:at] + bytes([p[at] ^ 0x55]) + p[at + 1 :], p[:at], b"", p[:at] + b"\x1f\x8b\x08WARC/1.1\r\n" + p[at:]][way]
                data += p
            found = warc.bytes_of(data)
            good = {x[3]["page_id"] for x in found if x[0] == "record"}
            assert good >= set(range(12)) - hurt
            # records and gaps cover the archive once
            at = 0
            for _, a, b, _ in found:
                assert a == at and b > a
                at = b
            assert at == len(data)
            # byte ranges find the same
            for size in (97, 1000):
                ranged = [x for a in range(0, len(data), size) for x in warc.records(warc.io.BytesIO(data), len(data), a, a + size)]
                assert sorted((x[1], x[2]) for x in ranged if x[0] == "record") == sorted((x[1], x[2]) for x in found if x[0] == "record")
                assert sum(x[2] - x[1] for x in ranged if x[0] == "gap") >= sum(x[2] - x[1] for x in found if x[0] == "gap")


def test_gaps_reach_the_log(spark, tmp_path):
    parts = archive(5, True)
    data = parts[0] + b"\x00" * 50 + parts[1] + parts[2][:-9] + parts[3] + parts[4] + b"tail"
    path = os.path.join(tmp_path, "a.warc.gz")
    with open(path, "wb") as f:
        f.write(data)
    got = warc.read(spark.createDataFrame([(path, len(data))], "path string, bytes long")).collect()
    assert sorted(r.page_id for r in got if r.kind == "record") == [0, 1, 3, 4]
    assert sorted(r.ends - r.place for r in got if r.kind == "gap") == sorted([50, len(parts[2]) - 9, 4])
    assert all(r.reason for r in got if r.kind == "gap")


def test_each_gap_is_logged_once_over_ranges():
    """Damage that spans several ranges belongs to the range of the record in front of it."""
    members = archive(40, True)
    broken = [m if i < 5 or i >= 30 else m[:12] + b"\x00" * (len(m) - 12) for i, m in enumerate(members)]
    data = b"".join(broken)
    whole = list(warc.records(warc.io.BytesIO(data), len(data)))
    gaps = [x[1:3] for x in whole if x[0] == "gap"]
    assert len(gaps) == 1 and gaps[0] == (sum(map(len, broken[:5])), sum(map(len, broken[:30])))
    for size in (50, 333, 1000, 5000, len(data)):
        ranged = [x for a in range(0, len(data), size) for x in warc.records(warc.io.BytesIO(data), len(data), a, a + size)]
        assert [x[1:3] for x in ranged if x[0] == "gap"] == gaps
        assert [x[1] for x in ranged if x[0] == "record"] == [x[1] for x in whole if x[0] == "record"]
    lead = b"".join(broken[6:20])  # nothing opens at all
    for size in (100, 1500):
        ranged = [x for a in range(0, len(lead), size) for x in warc.records(warc.io.BytesIO(lead), len(lead), a, a + size)]
        assert [x[:3] for x in ranged] == [("gap", 0, len(lead))]
