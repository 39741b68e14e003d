"""Archives: exact round trips, segments, odd payloads, repeated rows and damage."""

import gzip
import hashlib
from pathlib import Path

import pytest

from veilframe.llm import warc

SCHEMA = "page_id long, url string, html string, kind string, digest string"
LONG = "é€" * 900 + "x" * 5_000
HTML = [
    "", None, "short", "short", "a" * 99, "a" * 99, "b" * 100, "b" * 100, "b" * 100, LONG, LONG + "y", LONG,
    "\r\n\r\nWARC/1.0\r\n\r\n" * 20, "x\r\n\r\nWARC/1.1\r\nContent-Length: 3\r\n\r\nabc", "\r\n" * 60, "0\r\n\r\n", "tail\r\n\r\n", "\x00" * 120,
]


def pages(spark, html=HTML):
    rows = [(len(html) - i, f"http://e.org/{i}" if i % 3 else None, h, "k", "d") for i, h in enumerate(html)]
    rows += [(None, "http://e.org/\r\nX: y", "b" * 100, None, None), (None, None, "z" * 200, None, None), rows[6]]
    return spark.createDataFrame(rows, SCHEMA), rows


def wanted(rows, least=100):
    first = {}
    for i, _, h, *_ in rows:
        if i is not None and len((h or "").encode()) >= least:
            first[h] = min(first.get(h, i), i)
    out = set()
    for i, _, h, *_ in rows:
        data, of = (h or "").encode(), first.get(h or "")
        again = of is not None and (i is None or i > of)
        out.add((i, len(data), hashlib.sha256(data).hexdigest(), "revisit" if again else "response", of if again else None, None))
    return sorted(out, key=str)


@pytest.mark.parametrize(("chunk", "segment", "compression"), [(2_048, 8_192, "gzip"), (7, 50, "none"), (64, 400, "gzip")])
def test_round_trip(spark, tmp_path, chunk, segment, compression):
    df, rows = pages(spark)
    path = str(tmp_path / "a")
    warc.write_archives(df, path, chunk=chunk, segment=segment, compression=compression)
    assert sorted(map(tuple, warc.captures(spark, path).collect()), key=str) == wanted(rows)
    back = warc.read_payloads(spark, path).where("kind = 'response'").select("page_id", "payload", "uri").collect()
    assert {(r["page_id"], bytes(r["payload"])) for r in back} == {
        (i, (h or "").encode()) for i, _, h, *_ in rows if (i, "response") in {(w[0], w[3]) for w in wanted(rows)} and not (i is None and h[0] == "b")
    }
    assert warc.read_records(spark, path).where("kind = 'continuation'").count() >= 2


def test_segments_in_several_archives(spark, tmp_path):
    """Continuation records are found by the record they continue, wherever they lie."""
    df, rows = pages(spark)
    path, other = str(tmp_path / "a"), str(tmp_path / "b")
    warc.write_archives(df.coalesce(1), path, segment=300, compression="none")
    text = b"".join(p.read_bytes() for p in sorted(Path(path).glob("part-*")))
    records = [b"WARC/1." + r for r in text.split(b"\r\n\r\nWARC/1.")]
    records[0] = records[0].removeprefix(b"WARC/1.")
    Path(other).mkdir()
    for n in range(4):  # backwards, dealt out, each record a member of its own
        Path(other, f"{n}.warc.gz").write_bytes(b"".join(gzip.compress(r + b"\r\n\r\n") for r in records[::-1][n::4]))
    assert sorted(map(tuple, warc.captures(spark, other).collect()), key=str) == wanted(rows)


def test_damage_is_reported(spark, tmp_path):
    path = tmp_path / "a"
    df = spark.createDataFrame([(1, "u", LONG, "", ""), (2, "v", "fine" * 50, "", ""), (3, "w", "fine" * 50, "", "")], SCHEMA)
    warc.write_archives(df.coalesce(1), str(path), segment=2_000, compression="none")
    (file,) = path.glob("part-*")
    records = (b"\r\n\r\n" + file.read_bytes()).split(b"\r\n\r\nWARC/1.1")[1:]

    def state(some):
        for old in path.glob("*"):
            old.unlink()
        for old in path.glob(".*"):
            old.unlink()
        file.write_bytes(b"".join(b"WARC/1.1" + r + b"\r\n\r\n" for r in some))
        return {r["page_id"]: r["problem"] for r in warc.captures(spark, str(path)).collect()}

    order = [i for i, r in enumerate(records) if b"continuation" in r]
    assert state(records) == {1: None, 2: None, 3: None}
    assert state([r for i, r in enumerate(records) if i != order[0]])[1] == "missing segment"
    assert state([r for i, r in enumerate(records) if i != order[-1]])[1] == "missing segment"
    assert state([r.replace(b"Total-Length: ", b"Total-Length: 1") for r in records])[1] == "other length"
    assert state([r.replace(b"finefine", b"finefind") for r in records])[2] == "other digest"
    assert state([r for r in records if b"\r\nPage-ID: 2" not in r]) == {1: None, 3: "no such response"}
    assert state([r[:-40] if i == order[0] else r for i, r in enumerate(records)])[1] == "cut off"


def test_bodies():
    assert warc.unchunked(b"3\r\nabc\r\n2;x=y\r\nde\r\n0\r\n\r\n") == (b"abcde", None)
    assert warc.unchunked(b"0\r\n\r\n") == (b"", None)
    for bad in (b"", b"3\r\nab", b"zz\r\n", b"3\r\nabcd\r\n0\r\n\r\n", b"-1\r\n\r\n", b"3\r\nabc\r\n"):
        assert warc.unchunked(bad) == (None, "bad chunk")
    assert warc.payload_of(b"HTTP/1.1 200 OK\r\nA: b\r\n\r\nplain") == (b"plain", None)
    assert warc.payload_of(b"none") == (None, "no HTTP head")


def test_empty(spark, tmp_path):
    warc.write_archives(spark.createDataFrame([], SCHEMA), str(tmp_path / "a"))
    assert warc.captures(spark, str(tmp_path / "a")).count() == 0
