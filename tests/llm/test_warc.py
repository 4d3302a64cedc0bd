import gzip
import io

from twigspark.llm import warc as W

SCHEMA = "page_id long, url string, html string, payload string"


def pages():
    return [(1, "http://a/1", "<p>é</p>", "x"), (2, None, None, "x"), (3, "http://a/\n3", "", "x"), (5, "http://a/5", "<p>é</p>", "x"), (4, "http://a/4", "<p>é</p>", "x"), (4, "http://a/4", "<p>é</p>", "x"), (7, "u", "long " * 100_000, "x"), (1, "http://a/1", "<p>é</p>", "x")]


def expected(rows, min_bytes):
    first = {}
    for p, _, h, _ in rows:
        b = (h or "").encode()
        first[b] = min(first.get(b, p), p)
    for p, _, h, _ in rows:
        b = (h or "").encode()
        again = len(b) >= min_bytes and first[b] != p
        yield p, len(b), W.base32_sha1(b), "revisit" if again else "response", first[b] if again else None


def test_round_trip(spark):
    df = spark.createDataFrame(pages(), SCHEMA)
    for least in (0, 5):
        assert sorted(map(str, map(tuple, W.report(df, least).collect()))) == sorted(map(str, expected(pages(), least)))
    assert W.report(df.limit(0)).collect() == []


def test_round_trip_with_a_bloom_filter(spark, monkeypatch):
    monkeypatch.setattr(W, "BROADCAST_BYTES", 0)
    df = spark.createDataFrame([*pages(), (None, "n", "<p>é</p>", "x")], SCHEMA)
    got = sorted(map(str, map(tuple, W.report(df, 0).where("page_id is not null").collect())))
    assert got == sorted(map(str, expected(pages(), 0)))


def test_payload_headers_and_filters(spark, tmp_path):
    df = spark.createDataFrame(pages(), SCHEMA)
    W.write(W.records(df), str(tmp_path))
    got = W.read(spark, str(tmp_path)).where("record_type = 'response' and target_uri is not null").collect()
    assert {r.record_id: r.payload.decode() for r in got} == {"urn:page:1": "<p>é</p>", "urn:page:7": "long " * 100_000} | {r.record_id: "" for r in got if r.record_id in ("urn:page:3",)}
    assert got[0].headers["warc-type"] == "response"
    q = W.read(spark, str(tmp_path)).where("target_uri like 'http://a/%' and record_type in ('revisit')")
    assert {r.record_id for r in q.collect()} == {"urn:page:3", "urn:page:4", "urn:page:5"}
    for f in tmp_path.glob("*.gz"):  # any gzip reader can read them
        gzip.decompress(f.read_bytes())


def test_skipped_payload_is_not_decoded():
    row = {"record_type": "response", "record_id": "urn:page:1", "payload": bytes(range(256)) * 40_000}
    data = b"".join(W.member(W.record(row, "2020-01-01T00:00:00Z"), 1) for _ in range(3))
    walk = W.Records(io.BytesIO(data), 0, len(data), True)
    heads = [h for h, _ in walk]
    assert len(heads) == 3 and walk.inflated < 3 * 5000
    assert [b() for _, b in W.Records(io.BytesIO(data), 0, len(data), True)] == [W.HTTP + row["payload"]] * 3


def test_foreign_archives(spark, tmp_path):
    row = {"record_type": "response", "record_id": "urn:page:1", "payload": b"x" * 100_000}
    one = W.record(row, "2020-01-01T00:00:00Z")
    (tmp_path / "a.warc").write_bytes(one * 2)
    (tmp_path / "b.warc.gz").write_bytes(gzip.compress(one) * 2)
    assert W.read(spark, str(tmp_path)).selectExpr("length(payload)").collect() == [(100_000,)] * 4
    assert W.read(spark, str(tmp_path), "record_id string").count() == 4


def test_several_records_in_a_member_and_payloads_thrown_away(spark, tmp_path):
    rows = [{"record_type": "response", "record_id": f"urn:page:{k}", "payload": bytes([65 + k]) * 3_000_000} for k in range(3)]
    parts = [W.record(r, "2020-01-01T00:00:00Z") for r in rows]
    (tmp_path / "whole.warc.gz").write_bytes(gzip.compress(b"".join(parts)))
    (tmp_path / "two.warc.gz").write_bytes(gzip.compress(parts[0] + parts[1]) + gzip.compress(parts[2]))
    got = W.read(spark, str(tmp_path)).collect()
    assert sorted((r.record_id, bytes(r.payload)) for r in got) == sorted((r["record_id"], r["payload"]) for r in rows * 2)
    q = W.read(spark, str(tmp_path)).where("record_id = 'urn:page:2'")
    assert [len(r.payload) for r in q.collect()] == [3_000_000] * 2
    data = (tmp_path / "whole.warc.gz").read_bytes()
    walk = W.Records(io.BytesIO(data), 0, len(data), True)
    kept = [(h["record_id"], len(b()) if h["record_id"] == "urn:page:1" else None) for h, b in walk]
    assert kept == [("urn:page:0", None), ("urn:page:1", 3_000_000 + len(W.HTTP)), ("urn:page:2", None)]


def test_malformed_archives(spark, tmp_path):
    import pytest

    good = W.record({"record_type": "response", "record_id": "urn:page:1", "payload": b"x" * 1000}, "2020-01-01T00:00:00Z")
    bad = good.replace(b"Content-Length", b"Content-Size")
    cases = {"no_length.warc": good + bad, "cut.warc": good + good[:-300], "cut.warc.gz": gzip.compress(good) + gzip.compress(good)[:-40], "cut_head.warc": good + good[:60], "noise.warc.gz": gzip.compress(good) + b"noise, no gzip"}
    for name, data in cases.items():
        folder = tmp_path / name
        folder.mkdir()
        (folder / name).write_bytes(data)
        for schema in (None, "record_id string"):
            with pytest.raises(Exception, match=name.replace(".", r"\.")):
                W.read(spark, str(folder), schema).collect()
            assert [r.record_id for r in W.read(spark, str(folder), schema, malformed="skip").collect()] in ([["urn:page:1"]] if schema is None else [["urn:page:1"], ["urn:page:1"] * 2])
    (tmp_path / "none").mkdir()
    (tmp_path / "none" / "e.warc.gz").write_bytes(b"")
    assert W.read(spark, str(tmp_path / "none")).collect() == []


def test_overwrite_and_append(spark, tmp_path):
    W.register(spark)
    df = W.records(spark.createDataFrame(pages()[:2], SCHEMA))
    for mode, want in (("append", 2), ("append", 4), ("overwrite", 2), ("append", 4)):
        df.write.format("warc").mode(mode).save(str(tmp_path))
        assert W.read(spark, str(tmp_path)).count() == want
