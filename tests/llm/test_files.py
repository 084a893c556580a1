import hashlib

import pytest
from pyspark.sql import functions as F

from invoicelake.llm import compaction, warc
from invoicelake.llm.common import fresh_path


def pages(spark):
    body = "<p>" + "same " * 40 + "</p>"
    rows = [(1, "http://a/1", body), (2, "http://a/2 with space", body), (3, "http://a/3", "<p>small</p>"), (4, "http://a/4", "<p>small</p>"), (5, None, None), (6, "u", "é" * 60 + "\r\n\r\nWARC/1.1\r\n\n"), (7, "u", "é" * 60 + "\r\n\r\nWARC/1.1\r\n\n"), (None, "n", body), (8, "long", "x" * 300_000)]
    return spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "1 as digest", "'c' as content")


def test_arc_to_warc(spark):
    df = pages(spark)
    path = fresh_path(spark, "w")
    warc.convert(warc.arc_files(df.repartition(3)), path)
    got = {r["page_id"]: r for r in warc.read_warcs(spark, path).collect()}
    for r in df.collect():
        data = (r["html"] or "").encode()
        assert (got[r["page_id"]]["payload_bytes"], got[r["page_id"]]["payload_digest"]) == (len(data), hashlib.sha256(data).hexdigest())
    kinds = {k: (r["record_type"], r["refers_to"]) for k, r in got.items()}
    assert kinds == {1: ("response", None), 2: ("revisit", 1), 3: ("response", None), 4: ("response", None), 5: ("response", None), 6: ("response", None), 7: ("revisit", 6), None: ("revisit", 1), 8: ("response", None)}
    assert got[2]["url"] == "http://a/2%20with%20space"


def test_no_pages(spark):
    path = fresh_path(spark, "w")
    warc.convert(warc.arc_files(pages(spark).limit(0)), path)
    assert warc.read_warcs(spark, path).count() == 0


@pytest.mark.parametrize("version", [1, 2])
def test_arc_lines(version):
    data = warc.arc_begin(version, "f.arc", "19970101") + warc.arc_record(version, "http://x/a b", 5, b"one\n\ntwo", "19970102030405", 0, "f.arc") + warc.arc_record(version, "http://y", None, b"", "1997", 1, "f.arc")
    a, b = warc.parse_arc(data)
    assert a["url"] == "http://x/a%20b" and a["block"].endswith(b"\r\n\r\none\n\ntwo") and b["date"] == "1997" and warc.iso_date("1997") == "1997-01-01T00:00:00Z"
    assert warc.iso_date(a["date"]) == "1997-01-02T03:04:05Z"
    with pytest.raises(ValueError):
        list(warc.parse_arc(data[: data.rindex(b"HTTP")] + b"H"))
    with pytest.raises(ValueError):
        list(warc.parse_arc(data.replace(b"URL IP", b"URI IP")))


def test_record_ids_are_stable():
    assert warc.record_id("u", "d", 1, "x") == warc.record_id("u", "d", 1, "x") != warc.record_id("u", "d", 2, "x")


def test_repeated_pages_and_common_payloads(spark, monkeypatch):
    """The same page_id with equal payloads: both are responses. A third of all pages is one payload; firsts joined by a shuffle."""
    monkeypatch.setattr(warc, "BROADCAST_BYTES", -1)
    body = "y" * 200
    rows = [(k, "u", body if k % 3 == 0 else f"{k} " * 60 if k % 3 == 1 else "") for k in range(900)] + [(2000, "v", "z" * 150)] * 2
    path = fresh_path(spark, "w")
    warc.convert(warc.arc_files(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)), path)
    got = warc.read_warcs(spark, path).collect()
    assert len(got) == 902 and all(r["record_type"] == "response" and r["refers_to"] is None for r in got if r["page_id"] == 2000)
    assert all((r["record_type"], r["refers_to"]) == (("revisit", 0) if r["page_id"] % 3 == 0 and r["page_id"] else ("response", None)) for r in got if r["page_id"] < 900)


def test_compaction_keeps_every_row(spark, docs):
    store = compaction.ShardStore(spark, fresh_path(spark, "s"), target_bytes=1 << 20, fan_in=3)
    clashing = docs.withColumn("arrival", F.lit("own"))
    store.append_each(clashing, F.coalesce("doc_id", F.lit(0)) % 5)
    assert sorted(map(str, store.read().collect())) == sorted(map(str, clashing.collect())) and store.read().columns == clashing.columns
    merged = store.manifest()
    assert merged["version"] > 5 and len(merged["shards"]) < 15 and not store.due()
    store.append(clashing.limit(5))
    assert store.read().count() == docs.count() + 5 and store.manifest()["version"] == merged["version"] + 1
    assert store.read(merged["version"]).count() == docs.count()
    with pytest.raises(ValueError):
        store.append(docs)


def test_compaction_of_nothing(spark, nothing):
    store = compaction.ShardStore(spark, fresh_path(spark, "s"))
    with pytest.raises(ValueError):
        store.read()
    store.append_each(nothing, F.col("doc_id"))
    assert store.read().count() == 0 and store.read().schema == nothing.schema and compaction.content_digest(store.read()).count() == 0


def test_old_versions_can_be_read_until_they_are_dropped(spark, docs):
    store = compaction.ShardStore(spark, fresh_path(spark, "s"), fan_in=2, retain=3)
    store.append(docs.limit(3).coalesce(1))
    store.append(docs.limit(4).coalesce(1))
    before = store.read(2)  # a reader that has begun
    assert store.compact() == 1 and before.count() == 7 and store.read().count() == 7
    store.append(docs.limit(1).coalesce(1)), store.append(docs.limit(1).coalesce(1))
    assert store.vacuum() == 2 and store._versions() == [5, 4, 3] and store.read(3).count() == 7


def test_a_writer_that_dies_before_its_rename(spark, docs, monkeypatch):
    root = fresh_path(spark, "s")
    store = compaction.ShardStore(spark, root)
    store.append(docs.limit(3))
    with monkeypatch.context() as m:
        m.setattr(store, "_publish", lambda version, body: (_ for _ in ()).throw(KeyboardInterrupt()))
        with pytest.raises(KeyboardInterrupt):
            store.append(docs.limit(2))
    fs, torn = compaction._fs(spark, f"{root}/manifests/.torn")
    fs.create(torn, False).close()
    assert store.read().count() == 3 and store.append(docs.limit(1))["version"] == 2 and store.read().count() == 4
    assert not store._publish(2, "{}") and store.read().count() == 4


def test_only_one_writer_gets_a_version(spark, docs):
    root = fresh_path(spark, "s")
    one, two = compaction.ShardStore(spark, root), compaction.ShardStore(spark, root)
    one.append(docs.limit(3))
    stale = one.manifest()
    two.append(docs.limit(2))
    real = two.manifest
    two.manifest = lambda version=None, first=[stale]: first.pop() if first else real(version)
    two.append(docs.limit(1))  # begins from the stale version, loses it, and goes on from the newest
    assert sum(1 for _ in one.manifest()["shards"]) == len({s["path"] for s in one.manifest()["shards"]}) and one.read().count() == 6
    gone = {one.manifest()["shards"][0]["path"]}
    one._commit([], gone)
    with pytest.raises(RuntimeError):
        one._commit([], gone)
