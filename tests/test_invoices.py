import json
import zipfile

import pytest
from pyspark.sql import functions as F

from invoicelake.functions import json_text
from invoicelake.functions.dates import period
from invoicelake.operators import build, client, duplicates, edits, fill, grid, gross, memory, periods, replaced, rules, summary, validate
from invoicelake.plans import batch, catalog
from invoicelake.stages import stage
from invoicelake.schema import CLIENT_MEMORY, PROVIDER_MEMORY
from invoicelake.sources import files, layout, records, xlsx
from invoicelake.streaming import learning

ME = "12345678Z"


def record(num="F-1", date="04/06/2026", base="100", pct="21", vat="21", total=None, nif="B86561412", name="MAKRO DISTRIBUCION SA", lines=None, **more):
    return {"emisor_nombre": name, "emisor_nif": nif, "receptor_nombre": "CLIENTE UNO DOS", "receptor_nif": ME, "num_factura": num, "fecha": date, "lineas_iva": lines if lines is not None else [{"base": base, "tipo_iva": pct, "cuota_iva": vat}], "total": total, "cuenta_gasto": "600", **more}


def raw(spark, *recs):
    return records.literal(spark, list(recs), "f.pdf")


def built(spark, *recs):
    who = spark.createDataFrame([("CLIENTE UNO DOS", ME)], "nombre string, nif string")
    return stage(build.build(raw(spark, *recs), who))


def rows(df):
    return [r.asDict(recursive=True) for r in df.orderBy("doc_seq", "line_no").collect()]


def state(spark, rec, p=20262):
    return rows(validate.validate(built(spark, rec), F.lit(p).cast("long")))[0]


def test_credit_note(spark):
    line = {"base": "12,29-", "tipo_iva": 21.0, "cuota_iva": "2,58-", "pct_requiv": 5.20, "cuota_requiv": "0,64-"}
    note = record(num="4533583066", lines=[line], total="15,51-")
    r = state(spark, note)
    assert (r["base_iva"], r["cuota_iva"], r["cuota_requiv"], r["total_impreso"], r["estado"]) == (-12.29, -2.58, -0.64, -15.51, "ok")
    assert rows(gross.collapse(built(spark, note)))[0]["base_iva"] == -15.51
    lost = record(lines=[{k: str(v).replace("-", "") for k, v in line.items()}], total="15,51-")
    r = state(spark, lost)
    assert r["estado"] == "error" and any("signo no cuadra" in i["message"] for i in r["issues"])


def test_surcharge_of_the_header(spark):
    rec = record(num="4532677314", date="07/05/2026", base=114.98, vat=24.15, total=145.11, base_requiv=114.98, pct_requiv=5.2, cuota_requiv=5.98)
    r = state(spark, rec)
    assert (r["base_requiv"], r["pct_requiv"], r["cuota_requiv"], r["estado"]) == (114.98, 5.2, 5.98, "ok")
    g = rows(gross.collapse(built(spark, rec)))[0]
    assert g["base_iva"] == 145.11 and [g[c] for c in ("pct_iva", "cuota_iva", "base_requiv", "pct_requiv", "cuota_requiv")] == [None] * 5


TWO = [{"base": 19.96, "tipo_iva": 10, "cuota_iva": 2.00, "pct_requiv": 1.4, "cuota_requiv": 0.28}, {"base": 8.44, "tipo_iva": 4, "cuota_iva": 0.34, "pct_requiv": 0.5, "cuota_requiv": 0.04}]


def test_two_rates(spark):
    good = rows(built(spark, record(lines=TWO, total=31.06)))
    assert [r["lineas_factura"] for r in good] == [2, 2] and [r["base_requiv"] for r in good] == [19.96, 8.44] and good[0]["aviso"] == ""
    assert "no cuadra" in rows(built(spark, record(lines=TWO, total=99.99)))[0]["aviso"]
    assert [r["base_iva"] for r in rows(gross.collapse(built(spark, record(lines=TWO, total=31.06))))] == [31.06]


def test_withholding_blocks_the_gross_view(spark):
    rec = record(total=106, base_irpf=100, pct_irpf=15, cuota_irpf=15, cuenta_gasto="623")
    g = rows(gross.collapse(built(spark, rec)))[0]
    assert g["base_iva"] == 100 and "retención" in g["aviso"] and state(spark, rec)["estado"] == "ok"
    sale = built(spark, rec).withColumn("tipo", F.lit("venta"))
    assert rows(gross.collapse(sale)) == rows(sale)


def test_no_lines_and_handwriting(spark):
    a, b = rows(built(spark, record(lines=[]), record(hay_anotaciones_manuscritas=True)))
    assert a["line_no"] == 0 and a["base_iva"] is None and a["lineas_factura"] == 1 and "escrito a mano" in b["aviso"]


def test_roles(spark):
    base = record()
    flip = {**base, "emisor_nif": ME, "emisor_nombre": "CLIENTE UNO DOS", "receptor_nif": "B86561412", "receptor_nombre": "OTRO"}
    unknown = {**flip, "emisor_nif": None, "receptor_nif": None}
    neither = {**base, "receptor_nif": None, "receptor_nombre": "NADIE"}
    got = [(r["tipo"], r["nombre"], r["cuenta"], r["aviso"][:10]) for r in rows(built(spark, base, flip, unknown, neither))]
    assert got == [("gasto", "MAKRO DISTRIBUCION SA", "600", ""), ("venta", "OTRO", "700", ""), ("venta", "OTRO", "700", "El cliente"), ("gasto", "MAKRO DISTRIBUCION SA", "600", "Rol emisor")]


@pytest.mark.parametrize("text,account,sub", [("Factura de MÓVIL", "628", "G17"), ("Gasóleo A", "628", "G18"), ("Tasa de basuras", "631", None), ("soporte", "624", None), ("cosas", "600", None), ("automovil", "628", "G17"), ("luz", "600", "G14")])
def test_accounts(spark, text, account, sub):
    r = spark.createDataFrame([(1, text)], "id int, t string")
    got = r.select(rules.expense_account(F.col("t")), rules.supplies_subcode(F.col("t")), rules.by_case(F.col("t"), rules.EXPENSE_RULES, "600", whole_words=True)).first()
    assert got[:2] == (account, sub) and (text != "automovil" or got[2] == "600")
    assert rules.by_join(r, "id", F.col("t"), rules.rule_table(spark, rules.EXPENSE_RULES), "600").first()["codigo"] == account


def test_client(spark):
    other = {**record(), "emisor_nif": "A28017895"}
    assert tuple(client.detect(raw(spark, record(), other, record(nif="A28017895"))).first()) == ("CLIENTE UNO DOS", ME)
    assert tuple(client.detect(raw(spark, {"total": 1})).first()) == ("", "")


def test_sibling_fill(spark):
    fixed = rows(fill.from_siblings(built(spark, record(), record(nif=None), record(nif="B8656141Z"), record(nif=None, lines=TWO), record(nif=None, name="OTRA EMPRESA"))))
    assert [r["nif"] for r in fixed] == ["B86561412"] * 5 + [None] and "«B8656141Z»" in fixed[2]["aviso"] and fixed[0]["aviso"] == ""
    several = rows(fill.from_siblings(built(spark, record(), record(nif="A28017895"), record(nif=None))))
    assert several[2]["nif"] is None and "2 NIF distintos" in several[2]["aviso"] and "A28017895, B86561412" in several[2]["aviso"]


def providers(spark, *r):
    return spark.createDataFrame(list(r), PROVIDER_MEMORY)


def test_memory(spark):
    held = providers(spark, ("ANTONIO CANIZARES", "B30048276", "ANTONIO Y CAÑIZARES SL", True))
    got = rows(fill.from_memory(built(spark, *(record(nif=n, name="Antonio y Cañizares, S.L.") for n in (None, "B3OO48276", "B73549388"))), held))
    assert [r["nif"] for r in got] == ["B30048276", "B30048276", "B73549388"] and got[2]["aviso"].startswith("OJO")
    news = memory.learnable(built(spark, record(nif="B73549388", name="Antonio y Cañizares"), record(), record(num="F-2", nif="A28017895"), record(nif="bad", name="X Y Z"), record(name=None)))
    after = {r["clave"]: (r["nif"], r["manual"]) for r in memory.upsert_providers(held, news).collect()}
    assert after == {"ANTONIO CANIZARES": ("B30048276", True), "DISTRIBUCION MAKRO": ("A28017895", False)}
    by_hand = memory.upsert_providers(held, news, manual=True).filter("clave = 'ANTONIO CANIZARES'").first()
    assert (by_hand["nif"], by_hand["manual"]) == ("B73549388", True)
    clients = memory.upsert_clients(spark.createDataFrame([("B1", True, "UNO")], CLIENT_MEMORY), spark.createDataFrame([("b-1", False, ""), ("C2", True, "DOS")], CLIENT_MEMORY))
    assert sorted(map(tuple, clients.collect())) == [("B1", False, "UNO"), ("C2", True, "DOS")]
    spread = rows(memory.spread_manual_id(built(spark, record(nif=None), record(nif="zz"), record(nif="A28017895")), 0, "B86561412"))
    assert [r["nif"] for r in spread] == ["B86561412", "B86561412", "A28017895"]


def test_replaced(spark):
    old, new = record(num="4532023141"), record(num="5907798669", sustituye_a="4532.023.141")
    got = rows(replaced.mark(built(spark, old, new, record(num="1", sustituye_a="9999999999"), record(num="77", sustituye_a="77"))))
    assert [r["sustituida_por"] for r in got] == ["5907798669", None, None, None] and "SUSTITUIDA" in got[0]["aviso"] and got[1]["aviso"] == ""


def test_periods_and_summary(spark):
    df = built(spark, record(date="04/06/2026"), record(date="12/05/2026"), record(date="15/03/2026"))
    assert periods.detect(df).first()[0] == 20262 and periods.detect(df.limit(0)).first()[0] is None
    assert [i["rule"] for i in rows(validate.validate(df, F.lit(20262).cast("long")))[2]["issues"]] == [3] and rows(validate.validate(df))[2]["estado"] == "ok"
    sums = summary.totals(built(spark, record(base=53.02, vat=11.13), record(base=200, vat=42), record(base_irpf=100, pct_irpf=15, cuota_irpf=15))).first()
    assert (sums["base"], sums["iva"], sums["irpf"], sums["total"]) == (353.02, 74.13, 15.0, 412.15)
    one = summary.totals(built(spark, record(base=53.02, vat=11.13))).select(summary.described(), summary.described(True)).first()
    assert one[0] == "base 53,02 €  ·  IVA 11,13 €  ·  total factura 64,15 €" and one[1] == "total factura 64,15 €"


def test_duplicates_and_states(spark):
    df = duplicates.mark(validate.validate(built(spark, record(), record(), record(num="F-2"), record(num="F-2", pct=10, vat=10), record(num=None, nif=None, lines=[]), record(num=None, nif=None, lines=[]))))
    got = rows(validate.final_state(df))
    assert [r["dup_doc"] for r in got] == [None, 0, None, None, None, None] and [r["estado"] for r in got[:4]] == ["ok", "error", "ok", "ok"]
    numbered = summary.numbered(validate.final_state(df)).select("fila", "estado")
    assert summary.in_state(numbered, "error").count() == 3 and summary.in_state(numbered).count() == 6
    assert summary.next_incident(numbered, 1).first()["fila"] == 4 and summary.next_incident(numbered, 5).first()["fila"] == 1


def test_order_and_partitions_do_not_matter(spark):
    recs = [record(num=f"F-{k % 7}", nif=None if k % 3 else "B86561412", base=100 + k % 2) for k in range(20)]
    df = raw(spark, *recs)
    none = providers(spark)
    one, two = (batch.run(d, none) for d in (df, df.repartition(5).orderBy(F.rand(3))))
    assert rows(one.lines) == rows(two.lines)
    again = fill.from_siblings(one.lines)
    assert [r["nif"] for r in rows(again)] == [r["nif"] for r in rows(one.lines)]
    assert batch.run(df.limit(0), none).lines.count() == 0


def test_edits(spark):
    df = built(spark, record(), record(num="F-2"))
    twice = spark.createDataFrame([(0, 0, "nif", "B2", 2), (0, 0, "nif", "A9", 3), (0, 0, "nif", "Z1", 1)], "doc_seq long, line_no int, campo string, valor string, orden int")
    assert rows(edits.apply(df, twice))[0]["nif"] == "A9"
    typed = spark.createDataFrame([(0, 0, "base_iva", "1.234,50 €"), (1, 0, "tipo", "venta"), (1, 0, "nombre", "")], "doc_seq long, line_no int, campo string, valor string")
    got = rows(edits.apply(df, typed))
    assert (got[0]["base_iva"], got[1]["tipo"], got[1]["nombre"], got[1]["cuenta"]) == (1234.5, "venta", "", "600")
    gone = edits.without_rows(df, df.filter("doc_seq = 0"))
    assert gone.count() == 1 and [r["num_factura"] for r in rows(edits.restored(gone, df.filter("doc_seq = 0")))] == ["F-2", "F-1"]


XML = '<?xml version="1.0" encoding="ISO-8859-1"?><GestionFiscal><COMBOBOXCOMPRASVENTAS>COMPRAS/GASTOS</COMBOBOXCOMPRASVENTAS><CHECKBOXFICHEROINCLUYECABECERA>S</CHECKBOXFICHEROINCLUYECABECERA><PRIMERAFILADATOSCSV>2</PRIMERAFILADATOSCSV><EDITFRAPROVE>q</EDITFRAPROVE><EDITFRARECIB></EDITFRARECIB><EDITFECHA>B</EDITFECHA><EDITBASEIVA>D</EDITBASEIVA><EDITIVA>E</EDITIVA><EDITNIF>O</EDITNIF></GestionFiscal>'


def test_sheet(spark, tmp_path):
    (tmp_path / "gastos.xml").write_text(XML, "latin-1")
    where = layout.read(spark, f"file://{tmp_path}/gastos.xml")
    assert {(r["campo"], r["letra"]) for r in where.collect()} == {("num_factura", "Q"), ("fecha", "B"), ("base_iva", "D"), ("pct_iva", "E"), ("nif", "O")}
    assert [r["letra"] for r in grid.by_letter(where).collect()] == ["B", "D", "E", "O", "Q"]
    assert where.first()["primera_fila"] == 2 and where.first()["incluye_cabecera"] and layout.is_expenses(where).first()[0]
    cells = grid.sheet(built(spark, record(base="1.234,5"), record(num=None)), where)
    got = {(r["fila"], r["letra"]): (r["valor"], r["formato"]) for r in cells.collect()}
    assert got[1, "Q"][0] == "Nº Factura" and got[2, "D"] == ("1234,50", "@") and got[2, "E"] == ("21", "@") and (3, "Q") not in got and got[3, "O"] == ("B86561412", None)
    assert xlsx.write_by_type({"gasto": cells, "venta": cells.limit(0)}, str(tmp_path)) == [f"{tmp_path}/gastos.xlsx"]
    sheet = zipfile.ZipFile(tmp_path / "gastos.xlsx").read("xl/worksheets/sheet1.xml").decode()
    assert '<c r="D2" t="inlineStr" s="1"><is><t xml:space="preserve">1234,50</t></is></c>' in sheet
    xlsx.write(grid.sheet(built(spark, record(base="1.234,5")), where, "numero"), str(tmp_path / "n.xlsx"), "numero")
    assert "<v>1234.5</v>" in zipfile.ZipFile(tmp_path / "n.xlsx").read("xl/worksheets/sheet1.xml").decode()
    assert grid.grid_view(built(spark, record())).first()["base_iva"] == "100,00" and len(grid.exported(built(spark, record())).columns) == 26


def test_files_and_extraction(spark, tmp_path):
    for name in ("a.PDF", "b.jpg", "c.txt", "d.png"):
        (tmp_path / name).write_bytes(name.encode())
    docs = files.documents(spark, f"file://{tmp_path}")
    pages = files.pages(docs, lambda content, dpi: [content + b"1", content + b"2"])
    assert sorted((r["origen"], r["pagina"]) for r in pages.collect()) == [("a.PDF", 1), ("a.PDF", 2), ("b.jpg", 1), ("d.png", 1)]

    def ask(model, image):
        if image.startswith(b"d"):
            raise ValueError("unreadable")
        if model == "first":
            raise RuntimeError("503 unavailable")
        return json.dumps({"num_factura": image.decode()})

    assert {r["imagen"] for r in files.pages(docs, lambda content, dpi: [], normalise=lambda image, side, quality: b"%d %d " % (side, quality) + image).collect()} == {b"2000 80 b.jpg", b"2000 80 d.png"}
    assert [r["origen"] for r in docs.orderBy("doc_seq").collect()] == ["a.PDF", "b.jpg", "d.png"]
    got = records.parse(files.extract(pages, ask, ("first", "second"), wait=0.0).drop("_error")).collect()
    assert sorted(str(r["num_factura"]) for r in got) == ["None", "a.PDF1", "a.PDF2", "b.jpg"] and any(r["emisor_nombre"] == "(NO SE PUDO LEER)" for r in got)
    assert files.import_arguments(["x", "--import", "a", "b"]) == ["a", "b"] and files.local_paths(["file:///x/a.PDF", "http://x/a.pdf", "/y/b.doc"]) == ["/x/a.PDF"]


@pytest.mark.parametrize("text,good", [('{"a": 1}', True), ("```json\n{\"a\": [1,],}\n```", True), ("{broken}", False), ("", False), (None, False), ("Here: {\"a\": 1, }", True), ("null", False)])
def test_readable(spark, text, good):
    assert json_text.readable(text) == good == (spark.createDataFrame([(text,)], "t string").select(json_text.repaired(F.col("t")).contains("{")).first()[0] or False)


def test_asking_again(spark):
    asked = []

    def ask(model, image):
        asked.append(model)
        raise {"a": RuntimeError("429 quota exceeded"), "b": RuntimeError("prepaid balance depleted")}[model]

    with pytest.raises(files.NoCredit):
        files._ask(ask, ("a", "b"), b"", 3, 0.0)
    assert asked == ["a", "a", "a", "b"]
    page = spark.createDataFrame([(0, "f", 1, b"x")], "doc_seq long, origen string, pagina int, imagen binary")
    got = files.extract(page, lambda model, image: "{broken}", ("a",), wait=0.0).first()
    assert "(NO SE PUDO LEER)" in got["texto"] and "{broken}" in got["_error"]


def test_stores(spark, tmp_path):
    root = f"file://{tmp_path}"
    assert records.read_memory(spark, f"{root}/none", PROVIDER_MEMORY).count() == 0 and records.read_cache(spark, f"{root}/none").count() == 0
    (tmp_path / "p.json").write_text(json.dumps({"K": {"nif": "B86561412", "nombre": "N", "manual": True}}))
    held = records.read_provider_json(spark, f"{root}/p.json")
    records.write_memory(held, f"{root}/m")
    records.write_memory(memory.upsert_providers(records.read_memory(spark, f"{root}/m", PROVIDER_MEMORY), memory.learnable(built(spark, record()))), f"{root}/m")
    assert {r["clave"] for r in records.read_memory(spark, f"{root}/m", PROVIDER_MEMORY).collect()} == {"K", "DISTRIBUCION MAKRO"}
    (tmp_path / "c.json").write_text(json.dumps({"f.pdf#1": {"total": 1}}))
    cache = records.read_cache(spark, f"{root}/c.json")
    pages = spark.createDataFrame([("f.pdf", 1), ("f.pdf", 2)], "origen string, pagina int")
    assert [r["pagina"] for r in records.uncached(pages, cache).collect()] == [2]
    for page in (1, 2):
        records.append_cache(pages.filter(f"pagina = {page}").select(F.concat_ws("#", "origen", "pagina").alias("clave"), F.lit('{"total": "7"}').alias("texto")), f"{root}/cache")
    back = records.read_cache(spark, f"{root}/cache")
    assert {tuple(r) for r in back.collect()} == {("f.pdf#1", '{"total": "7"}'), ("f.pdf#2", '{"total": "7"}')} and records.uncached(pages, back).count() == 0
    (tmp_path / "k.json").write_text(json.dumps({"B1": {"recargo_equivalencia": True}, "B2": {"nombre": "DOS"}}))
    assert sorted(map(tuple, records.read_client_json(spark, f"{root}/k.json").collect())) == [("B1", True, ""), ("B2", False, "DOS")]
    (tmp_path / "bad.json").write_text("{")
    assert records.read_client_json(spark, f"{root}/bad.json").count() == records.read_provider_json(spark, f"{root}/bad.json").count() == 0


def test_memory_versions(spark, tmp_path):
    root = f"file://{tmp_path}/m"
    for k in range(4):
        records.write_memory(providers(spark, (f"K{k}", "B86561412", "N", False)), root)
    assert sorted(p.name for p in (tmp_path / "m").iterdir()) == ["v=000000003", "v=000000004"]
    (tmp_path / "m" / "v=000000005").mkdir()  # a writer that failed
    assert records.read_memory(spark, root, PROVIDER_MEMORY).first()["clave"] == "K3"
    records.write_memory(providers(spark, ("K5", "B86561412", "N", False)), root)
    assert records.read_memory(spark, root, PROVIDER_MEMORY).first()["clave"] == "K5"
    for part in (tmp_path / "m" / "v=000000006").glob("part-*"):
        part.write_bytes(b"no parquet at all")
    for crc in (tmp_path / "m" / "v=000000006").glob(".*.crc"):
        crc.unlink()
    with pytest.warns(UserWarning):
        assert records.read_memory(spark, root, PROVIDER_MEMORY).first()["clave"] == "K3"


def test_stream_learns_once(spark, tmp_path):
    src = spark.createDataFrame([(0, "f", 1, json.dumps(record()))], "doc_seq long, origen string, pagina int, texto string")
    src.write.json(f"file://{tmp_path}/in")
    who = spark.createDataFrame([("CLIENTE UNO DOS", ME)], "nombre string, nif string")
    stream = build.build(records.parse(learning.read_texts(spark, f"file://{tmp_path}/in")), who)
    for _ in range(2):
        learning.learn(stream, f"file://{tmp_path}/mem", f"file://{tmp_path}/cp").awaitTermination(60)
    assert [r["nif"] for r in records.read_memory(spark, f"file://{tmp_path}/mem", PROVIDER_MEMORY).collect()] == ["B86561412"]


def test_catalog_has_a_check_for_each_query():
    assert set(catalog.QUERIES) == set(catalog.ORACLE_SQL) and len(catalog.QUERIES) > 40


def test_period_filter(spark):
    df = built(spark, record(), record(date="15/03/2026"), record(date="?"))
    assert periods.within(df, 20262).count() == 1 and summary.outside(df, 20262).first()[0] == 2 and df.select(period(F.col("fecha"))).count() == 3


@pytest.mark.parametrize("adaptive", [True, False])
def test_numbers_of_many_rows(spark, adaptive):
    n = 300_000
    spark.conf.set("spark.sql.adaptive.enabled", adaptive)
    spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", "200k")
    try:
        df = spark.range(n, numPartitions=7).select((F.col("id") * 7919 % n).alias("doc_seq"), (F.col("id") % 3).cast("int").alias("line_no"), F.repeat(F.lit("x"), 20).alias("nombre"))
        got = stage(summary.numbered(df))
        assert got.count() == n and got.filter("fila = doc_seq").count() == n
        assert summary.numbered(df).select("fila").distinct().count() == n
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled"), spark.conf.unset("spark.sql.adaptive.advisoryPartitionSizeInBytes")


def test_common_keys(spark):
    """A third of the rows without a key, a third of one number that a third replace."""
    n = 300
    recs = [record(num="" if k % 3 == 0 else "F-1" if k % 3 == 1 else f"N-{k}", sustituye_a="f1" if k % 3 == 2 else "", nif=None if k % 3 == 0 else "B86561412", lines=[] if k % 3 == 0 else None) for k in range(n)]
    df = built(spark, *recs)
    marked = rows(duplicates.mark(df))
    assert len(marked) == n and sum(r["dup_doc"] is not None for r in marked) == n // 3 - 1
    got = rows(replaced.mark(df))
    assert len(got) == n and all((r["sustituida_por"] == f"N-{n - 1}") == (r["doc_seq"] % 3 == 1) for r in got) and got[1]["aviso"].count("SUSTITUIDA") == n // 3
    assert replaced.counted(df).first()[0] == (n // 3) ** 2


def test_counts_and_closing(spark, tmp_path):
    held = providers(spark, ("ANTONIO CANIZARES", "B30048276", "N", True))
    recs = [record(), record(num="F-2", nif=None), record(num="F-3", nif=None, name="Antonio Cañizares"), record(num="F-4", sustituye_a="F-1")]
    done = batch.run(raw(spark, *recs), held)
    assert done.counts.first().asDict() == {"copiadas": 1, "dudosas": 0, "de_memoria": 1, "distintas": 0, "aprendidas": 3, "marcadas": 1}
    assert done.lines.count() == 4 and summary.report(done.lines).first()["texto"].endswith("400.00")
    done.close()
    with pytest.raises(Exception, match="(?i)path|exist"):
        done.lines.count()
    names = spark.createDataFrame([("/a/b.pdf",), ("/a/a.pdf",), ("/c.pdf",), ("/d.pdf",)], "path string")
    assert summary.batch_label(names).first()[0] == "4 archivos: a.pdf, b.pdf, c.pdf…" and summary.batch_label(names.limit(1)).first()[0].startswith("1 archivo: ")
