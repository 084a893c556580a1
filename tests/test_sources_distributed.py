"""Files as a data source, workbooks written by tasks, extraction through the cache."""

import json
import os
import random
import re
import time
import zipfile
import zlib
from xml.etree import ElementTree

import pytest
from pyspark.sql import functions as F

from invoicelake.sources import cached, files, page_source, records, sheet_writer, xlsx


# Stub renderer: a PDF is text with a page on each line
def count(content):
    if content.startswith(b"broken"):
        raise ValueError("no pages")
    return content.count(b"\n")


def render(content, first, last, dpi):
    pages = content.split(b"\n")[first - 1 : last]
    if b"bad" in pages[0]:
        raise ValueError("can't render")
    return [b"%d:" % dpi + p for p in pages]


def shrink(image, side, quality):
    return b"small " + image


@pytest.fixture
def plugins(tmp_path, monkeypatch):
    """The renderer as a module that executors import."""
    monkeypatch.syspath_prepend(os.path.dirname(__file__))
    return {"count": "test_sources_distributed:count", "render": "test_sources_distributed:render", "normalise": "test_sources_distributed:shrink"}


@pytest.fixture
def folder(spark, tmp_path):
    spark.sparkContext.addPyFile(__file__)
    base = tmp_path / "scans"
    (base / "deep").mkdir(parents=True)
    (base / "long.pdf").write_bytes(b"".join(b"page %d\n" % k for k in range(1, 201)))
    (base / "deep" / "two.PDF").write_bytes(b"a\nbad\n")
    (base / "broken.pdf").write_bytes(b"broken")
    (base / "one.jpg").write_bytes(b"image")
    (base / "notes.txt").write_bytes(b"no invoice")
    (base / "_hidden.pdf").write_bytes(b"a\n")
    (base / "empty.pdf").write_bytes(b"")
    return base


def test_a_long_pdf_is_read_by_many_tasks(spark, folder, plugins):
    df = page_source.pages(spark, f"file://{folder}", pageBytes=8, taskPages=10, **plugins)
    rows = df.withColumn("task", F.spark_partition_id()).collect()
    long = [r for r in rows if r["origen"] == "long.pdf"]
    assert sorted(r["pagina"] for r in long) == list(range(1, 201)) and {r["paginas"] for r in long} == {200}
    assert len({r["task"] for r in long}) > 15 and max(sum(r["task"] == t for r in long) for t in {r["task"] for r in long}) <= 12
    assert {r["imagen"] for r in long if r["pagina"] in (1, 200)} == {b"150:page 1", b"150:page 200"}
    rest = sorted((r["origen"], r["pagina"], r["imagen"] and bytes(r["imagen"]), r["error"]) for r in rows if r["origen"] != "long.pdf")
    assert rest == [("broken.pdf", 1, None, "no pages"), ("one.jpg", 1, b"small image", None), ("two.PDF", 1, b"150:a", None), ("two.PDF", 2, None, "can't render")]
    assert [x["doc_seq"] for x in df.select("path", "doc_seq").distinct().orderBy("path").collect()] == [0, 1, 3, 4]  # an empty PDF has no pages


def test_filters_reach_the_listing_and_unasked_columns_cost_nothing(spark, folder, plugins):
    before = spark.conf.get("spark.sql.python.filterPushdown.enabled")
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    try:
        df = page_source.pages(spark, f"file://{folder}", columns=["doc_seq", "origen", "extension", "pagina"], count="test_sources_distributed:count", render="no.such:module")
        kept = df.filter("extension = 'pdf' and origen like 'long%' and pagina <= 3")
        assert sorted(r["pagina"] for r in kept.collect()) == [1, 2, 3] and {r["doc_seq"] for r in kept.collect()} == {3}
        plan = spark._jvm.PythonSQLUtils.explainString(kept._jdf.queryExecution(), "formatted")
        assert "PushedFilters" in plan and "EqualTo(extension,pdf)" in plan and "StringStartsWith(origen,long)" in plan
        assert df.filter("origen in ('one.jpg', 'two.PDF')").count() == 3 and df.filter("extension like '%pg'").count() == 1
        # files that are ruled out are never opened
        os.chmod(folder / "broken.pdf", 0)
        assert page_source.pages(spark, f"file://{folder}", **plugins).filter("origen <> 'x' and extension = 'jpg'").count() == 1
    finally:
        spark.conf.set("spark.sql.python.filterPushdown.enabled", before)
    assert page_source.pages(spark, f"file://{folder}", **plugins).filter("extension = 'jpg'").count() == 1
    with pytest.raises(Exception, match="colour|pages have no"):
        spark.read.format("escaneos").schema("colour string").option("path", str(folder)).load().count()


def test_an_empty_folder_has_no_pages(spark, tmp_path, plugins):
    assert page_source.pages(spark, f"file://{tmp_path}/none", **plugins).count() == 0


# Workbooks ---------------------------------------------------------------------------------------------------------------
def read_back(path):
    """Every cell (row, letters, value, format) of a workbook, and whether the archive is whole."""
    with zipfile.ZipFile(path) as z:
        assert z.testzip() is None
        sheet = ElementTree.fromstring(z.read("xl/worksheets/sheet1.xml"))
        assert set(z.namelist()) == set(xlsx.parts(""))
    space = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
    out = []
    for row in sheet.iter(f"{space}row"):
        for c in row:
            text, number = c.find(f"{space}is/{space}t"), c.find(f"{space}v")
            assert c.get("r").endswith(row.get("r"))
            out.append((int(row.get("r")), re.sub(r"\d", "", c.get("r")), number.text if text is None else text.text or "", "n" if text is None else "@" if c.get("s") else None))
    return out


def some_cells(n):
    r = random.Random(2)
    signs = ["a", "<", "&", '"', "é", "日", " ", "]]>", "\U0001f600"]
    return [(k + 1, j + 1, "ABC"[j], "".join(r.choice(signs) for _ in range(r.randint(0, 12))), "@" if j == 1 else None) for k in range(n) for j in range(3) if r.random() < 0.8]


@pytest.mark.parametrize("n, tasks", [(0, 1), (1, 1), (7, 3), (3000, 40)])
def test_a_workbook_reads_back_cell_by_cell(spark, tmp_path, n, tasks):
    cells = some_cells(n)
    df = spark.createDataFrame(cells, "fila long, columna int, letra string, valor string, formato string").repartition(max(tasks, 1))
    spark.dataSource.register(sheet_writer.SheetSource)
    dealt = df.repartitionByRange(tasks, "fila").sortWithinPartitions("fila", "columna")
    dealt.write.format("hoja").mode("overwrite").option("path", f"file://{tmp_path}/deep/s.xlsx").save()
    assert read_back(tmp_path / "deep/s.xlsx") == [(r, c, v, f) for r, _, c, v, f in cells]
    sheet_writer.write(df, f"{tmp_path}/t.xlsx")
    assert read_back(tmp_path / "t.xlsx") == [(r, c, v, f) for r, _, c, v, f in cells]
    assert os.listdir(tmp_path / "deep") == ["s.xlsx"] and sorted(os.listdir(tmp_path)) == ["deep", "t.xlsx"]


def test_numbers_and_nulls(spark, tmp_path):
    cells = [(1, 1, "A", "1.5", None), (2, 1, "A", "1.5", None), (3, 1, "A", "-2.25", "@"), (4, 1, "A", "7", None), (5, 1, "A", None, None), (None, 1, "A", "x", None)]
    sheet_writer.write(spark.createDataFrame(cells, "fila long, columna int, letra string, valor string, formato string"), f"{tmp_path}/n.xlsx", "numero")
    assert read_back(tmp_path / "n.xlsx") == [(1, "A", "1.5", None), (2, "A", "1.5", "n"), (3, "A", "-2.25", "n"), (4, "A", "7", None)]


def test_a_failed_write_leaves_the_old_file_and_nothing_else(spark, tmp_path):
    schema = "fila long, columna int, letra string, valor string, formato string"
    sheet_writer.write(spark.createDataFrame([(1, 1, "A", "old", None)], schema), f"{tmp_path}/w.xlsx")
    broken = spark.range(1, 2000).select(F.col("id").alias("fila"), F.lit(1).alias("columna"), F.lit("A").alias("letra"), F.when(F.col("id") == 1500, F.raise_error("lost")).otherwise(F.col("id").cast("string")).alias("valor"), F.lit(None).cast("string").alias("formato"))
    with pytest.raises(Exception, match="lost"):
        sheet_writer.write(broken, f"{tmp_path}/w.xlsx")
    assert os.listdir(tmp_path) == ["w.xlsx"] and read_back(tmp_path / "w.xlsx") == [(1, "A", "old", None)]
    spark.dataSource.register(sheet_writer.SheetSource)
    unsorted = spark.createDataFrame([(2, 1, "A", "b", None), (1, 1, "A", "a", None)], schema).coalesce(1)
    with pytest.raises(Exception, match="sorted"):
        unsorted.write.format("hoja").mode("overwrite").option("path", f"{tmp_path}/w.xlsx").save()
    assert os.listdir(tmp_path) == ["w.xlsx"]
    with pytest.raises(Exception, match="more rows"):
        sheet_writer.write(spark.createDataFrame([(xlsx.MAX_ROWS + 1, 1, "A", "b", None)], schema), f"{tmp_path}/x.xlsx")


def test_an_attempt_that_dies_leaves_no_trace_in_the_file(tmp_path):
    """Two attempts of one task write; the commit knows one of them."""
    import pyarrow as pa

    batch = lambda rows: pa.RecordBatch.from_pylist([{"fila": r, "letra": "A", "valor": v, "formato": None} for r, v in rows])
    w = sheet_writer.SheetWriter(str(tmp_path / "a.xlsx"), False)
    first, lost = w.write(iter([batch([(1, "x"), (2, "y")])])), w.write(iter([batch([(3, "half")])]))
    again = w.write(iter([batch([(3, "z")])]))
    assert lost.path != again.path
    w.commit([again, None, first])
    assert [c[2] for c in read_back(tmp_path / "a.xlsx")] == ["x", "y", "z"] and os.listdir(tmp_path) == ["a.xlsx"]
    w = sheet_writer.SheetWriter(str(tmp_path / "b.xlsx"), False)
    w.write(iter([batch([(1, "x")])]))
    w.abort([])
    assert os.listdir(tmp_path) == ["a.xlsx"]


def test_joined_crcs():
    r = random.Random(3)
    for _ in range(50):
        a, b = r.randbytes(r.randint(0, 3000)), r.randbytes(r.randint(0, 3000))
        assert sheet_writer.crc_joined(zlib.crc32(a), zlib.crc32(b), len(b)) == zlib.crc32(a + b)


# Extraction through the cache --------------------------------------------------------------------------------------------
def scans(spark, n, parts=1):
    rows = [(k, f"f{k}.pdf", 1, b"%d" % k) for k in range(n)]
    return spark.createDataFrame(rows, "doc_seq long, origen string, pagina int, imagen binary").repartitionByRange(parts, "doc_seq").sortWithinPartitions("doc_seq")


def asking(log, fail_at=None, error="credit is depleted"):
    def client(model, image):
        with open(log, "a") as f:
            f.write(image.decode() + "\n")
        if fail_at is not None and image == b"%d" % fail_at:
            raise RuntimeError(error)
        return json.dumps({"num_factura": f"n{image.decode()}"})

    return client


def asked(log):
    return [int(x) for x in open(log).read().split()] if os.path.exists(log) else []


def test_a_client_that_fails_at_a_page_leaves_those_before(spark, tmp_path):
    cache, log = f"file://{tmp_path}/cache", str(tmp_path / "log")
    with pytest.raises(Exception, match="depleted"):
        cached.extract(scans(spark, 20), asking(log, 13), ("m",), cache, slice_pages=4)
    held = records.read_cache(spark, cache)
    assert sorted(r["clave"] for r in held.collect()) == sorted(f"f{k}.pdf#1" for k in range(13)) and 13 in asked(log)
    os.remove(log)
    got = cached.extract(scans(spark, 20), asking(log), ("m",), cache, slice_pages=4)
    assert sorted(asked(log)) == list(range(13, 20))
    assert sorted((r["doc_seq"], json.loads(r["texto"])["num_factura"], r["_error"]) for r in got.collect()) == [(k, f"n{k}", None) for k in range(20)]
    os.remove(log)
    assert cached.extract(scans(spark, 20, 5), asking(log), ("m",), cache).count() == 20 and asked(log) == []


def test_a_task_that_runs_again_reads_its_own_slices(tmp_path):
    first = cached.Slices(f"{tmp_path}/run", 3, 2)
    for k in range(5):
        first.add(f"k{k}", f"t{k}")
    assert len(os.listdir(tmp_path / "run")) == 2  # a fifth answer is held until its slice is full, or the task ends
    first.flush()
    again = cached.Slices(f"{tmp_path}/run", 3, 2)
    assert again.answers == {f"k{k}": f"t{k}" for k in range(5)} and cached.Slices(f"{tmp_path}/run", 4, 2).answers == {}
    again.add("k5", "t5")
    again.flush()
    assert len(cached.Slices(f"{tmp_path}/run", 3, 2).answers) == 6


def test_unreadable_pages_are_placeholders_and_are_asked_again(spark, tmp_path):
    cache, log = f"{tmp_path}/cache", str(tmp_path / "log")
    pages = scans(spark, 4, 2).unionByName(spark.createDataFrame([(9, None, 1, b"9"), (10, "x.pdf", 2, None)], "doc_seq long, origen string, pagina int, imagen binary"))
    for _ in range(2):
        got = {r["doc_seq"]: r for r in cached.extract(pages, asking(log, 2, "illegible"), ("m",), cache).collect()}
        assert got[2]["_error"] == "illegible" and files.UNREADABLE in got[2]["texto"] and got[10]["_error"] == "no image" and got[9]["_error"] is None
        assert len(got) == 6
    assert sorted(asked(log)) == [0, 1, 2, 2, 3, 9, 9]


def test_tasks_wait_out_of_one_budget(spark, tmp_path):
    cache, log = f"{tmp_path}/cache", str(tmp_path / "log")

    def busy(model, image):
        with open(log, "a") as f:
            f.write(image.decode() + "\n")
        raise RuntimeError("503 unavailable")

    began = time.time()
    got = cached.extract(scans(spark, 12, 1), busy, ("m",), cache, tries=3, wait=0.2, budget=1.0).collect()
    assert all("503" in r["_error"] for r in got) and time.time() - began < 30
    assert len(asked(log)) < 12 * 3  # without a budget each page would be asked three times
    notes = [f for f in os.listdir(next((tmp_path / "cache").glob("run-*/_waits"))) if f[0] != "."]
    assert 0 < sum(int(f.split("-")[0]) for f in notes) <= 1000
