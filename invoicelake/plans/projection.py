"""Invoices out of a trading schema: orders become invoices, their lines VAT lines, parts' names providers.

One text serves two SQL dialects, so a query over the result and its check in the other engine start from the same rows. Amounts are
rounded to cents as text before they are summed as decimals, so sums depend neither on the order of rows nor on the engine.
Every kind of damage comes from a remainder of the order's key.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

CLIENT_ID, CLIENT_NAME = "12345678Z", "CLIENTE DE PRUEBA INDUSTRIAL SL"



def _near(x: str) -> str:
    """Whether an amount's cents are far from a half and no negative zero: then arithmetic gives them as text would."""
    return f"abs({x}) >= 0.01D AND abs({x}) < 1e9D AND abs({x} * 100D - floor({x} * 100D) - 0.5D) > 1e-4D"


_SPARK = {
    # a lambda takes its projection out of the fused code of a stage: fused, these long projections are one method that Java doesn't compile
    "APART": lambda x, form: form.format(*[f"element_at(transform(array({x}), x -> x), 1)"] * 2),
    "CENTS": lambda x: f"(CASE WHEN {_near(x)} THEN floor({x} * 100D + 0.5D) ELSE CAST(CAST(replace(format_number({x}, '0.00'), ',', '') AS DECIMAL(18,2)) * 100 AS BIGINT) END)",
    "EUROS": lambda cents: f"({cents} / 100D)",
    "R2": lambda x: f"(CASE WHEN {_near(x)} THEN floor({x} * 100D + 0.5D) / 100D ELSE CAST(replace(format_number({x}, '0.00'), ',', '') AS DOUBLE) END)",
    "F2": lambda x: f"replace(format_number({x}, '0.00'), ',', '')", "DATE": lambda d, f: f"date_format({d}, '{f}')", "NUM": lambda n: f"{n}D",
    "JOINED": lambda t, by: f"array_join(transform(array_sort(collect_list(struct({by} AS o, {t} AS t))), x -> x.t), ',')",
}
_FORMS = {"dd/MM/yyyy": "%d/%m/%Y", "d-M-yyyy": "%-d-%-m-%Y", "dd.MM.yyyy": "%d.%m.%Y", "yyyy-MM-dd": "%Y-%m-%d", "dd/MM/yy": "%d/%m/%y"}
_DUCK = {
    "APART": lambda x, form: x if form == "{}" else "", "CENTS": lambda x: f"CAST(printf('%.2f', {x}) AS DECIMAL(18,2))", "EUROS": lambda cents: cents, "R2": lambda x: f"CAST(printf('%.2f', {x}) AS DOUBLE)",
    "F2": lambda x: f"printf('%.2f', {x})", "DATE": lambda d, f: f"strftime({d}, '{_FORMS[f]}')", "NUM": lambda n: f"CAST({n} AS DOUBLE)",
    "JOINED": lambda t, by: f"string_agg({t}, ',' ORDER BY {by})",
}


def _lines(m: dict) -> str:
    date, num, cents, euros, r2 = m["DATE"], m["NUM"], m["CENTS"], m["EUROS"], m["R2"]
    summed = f"sum({cents('base_iva')} + {cents('cuota_iva')} + {cents('coalesce(cuota_requiv, ' + num('0.0') + ')')} - {cents('coalesce(cuota_irpf, ' + num('0.0') + ')')}{m['APART']('k', ' + ({} - {})')}) OVER (PARTITION BY k)"
    return f"""
    SELECT *, CAST(total_cents AS DOUBLE) * (CASE WHEN k % 29 = 0 THEN {num("-1.0")} ELSE {num("1.0")} END) + (CASE WHEN k % 13 = 0 THEN {num("1.0")} ELSE {num("0.0")} END) AS total_impreso
    FROM (
      SELECT *, {euros(summed)} AS total_cents
      FROM (
        SELECT k, line_no, lineas_factura, concat('F-', {m["APART"]("k", "{}")}) AS num_factura,
          CASE k % 6 WHEN 0 THEN {date("o_orderdate", "dd/MM/yyyy")} WHEN 1 THEN {date("o_orderdate", "d-M-yyyy")} WHEN 2 THEN {date("o_orderdate", "dd.MM.yyyy")}
                     WHEN 3 THEN {date("o_orderdate", "yyyy-MM-dd")} WHEN 4 THEN {date("o_orderdate", "dd/MM/yy")} ELSE CASE WHEN k % 5 = 0 THEN '31/02/2001' ELSE {date("o_orderdate", "dd/MM/yyyy")} END END AS fecha,
          CASE WHEN k % 4 = 0 THEN '700' WHEN k % 37 = 0 THEN NULL ELSE '600' END AS concepto, CASE WHEN k % 4 = 0 THEN 'venta' ELSE 'gasto' END AS tipo,
          base_iva, pct_iva, {r2("base_iva * pct_iva / 100")} + (CASE WHEN k % 19 = 0 THEN {num("0.05")} ELSE {num("0.0")} END) AS cuota_iva,
          CASE WHEN line_no = 0 AND k % 10 = 0 THEN base_iva END AS base_irpf, CASE WHEN line_no = 0 AND k % 10 = 0 THEN {num("15.0")} END AS pct_irpf,
          CASE WHEN line_no = 0 AND k % 10 = 0 THEN {r2("base_iva * " + num("15.0") + " / 100")} END AS cuota_irpf,
          CASE WHEN re > 0 THEN base_iva END AS base_requiv, CASE WHEN re > 0 THEN re END AS pct_requiv, CASE WHEN re > 0 THEN {r2("base_iva * re / 100")} END AS cuota_requiv,
          CASE WHEN k % 7 = 0 THEN NULL WHEN k % 11 = 0 THEN concat(nif, 'O') ELSE nif END AS nif, p_name AS nombre,
          CASE WHEN k % 17 = 0 THEN concat('f. ', k - 1) ELSE '' END AS sustituye_a
        FROM (
          SELECT *, concat(lpad(CAST(idk AS STRING), 8, '0'), substr('TRWAGMYFPDXBNJZSQVHLCKE', CAST(idk % 23 AS INT) + 1, 1)) AS nif,
            CASE WHEN k % 9 <> 0 THEN {num("0.0")} WHEN pct_iva = 21 THEN {num("5.2")} WHEN pct_iva = 10 THEN {num("1.4")} WHEN pct_iva = 4 THEN {num("0.5")} ELSE {num("0.0")} END AS re
          FROM (
            SELECT n.k, n.line_no, n.lineas_factura, n.base_iva, n.pct_iva, o.o_orderdate, p.p_name, f.fk + CASE WHEN f.fk % 5 = 0 THEN n.k % 2 ELSE 0 END AS idk
            FROM (
              SELECT k, base_iva, CAST(pct AS DOUBLE) AS pct_iva, CAST(row_number() OVER (PARTITION BY k ORDER BY pct) - 1 AS INT) AS line_no,
                     CAST(count(*) OVER (PARTITION BY k) AS INT) AS lineas_factura, min(pk) OVER (PARTITION BY k) AS mk
              FROM (
                SELECT l_orderkey AS k, CASE WHEN l_tax < 0.005 THEN 0 WHEN l_tax < 0.035 THEN 4 WHEN l_tax < 0.055 THEN 10 ELSE 21 END AS pct,
                       CAST({euros("sum(" + cents("l_extendedprice * (1 - l_discount)") + ")")} AS DOUBLE) AS base_iva, min(l_partkey) AS pk
                FROM lineitem GROUP BY 1, 2
              ) g
            ) n JOIN orders o ON n.k = o.o_orderkey JOIN part p ON n.mk = p.p_partkey
            JOIN (SELECT p_name, min(p_partkey) AS fk FROM part GROUP BY p_name) f ON f.p_name = p.p_name
          ) a
        ) b
      ) c
    ) d"""


_COLUMNS = (
    "line_no, num_factura, fecha, concepto, base_iva, pct_iva, cuota_iva, base_irpf, pct_irpf, cuota_irpf, base_requiv, pct_requiv, cuota_requiv, nif, nombre, "
    "total_impreso, lineas_factura, tipo, sustituye_a, '' AS aviso, CAST(NULL AS STRING) AS sustituida_por"
)


def _scanned(m: dict) -> str:
    """Every 23rd invoice was scanned twice."""
    return f"SELECT k AS doc_seq, {_COLUMNS} FROM {{p}} UNION ALL SELECT k + 1000000000 AS doc_seq, {_COLUMNS} FROM {{p}} WHERE k % 23 = 0"


def _texts(m: dict) -> str:
    f2, joined = m["F2"], m["JOINED"]
    amount = lambda c: f"replace({f2(c)}, '.', ',')"
    quoted = lambda c: f"coalesce('\"' || {c} || '\"', 'null')"
    line = "concat('{\"base\": \"', " + amount("base_iva") + ", '\", \"tipo_iva\": ', CAST(CAST(pct_iva AS INT) AS STRING), ', \"cuota_iva\": \"', " + amount("cuota_iva") + ", ' €\"', CASE WHEN pct_requiv IS NULL THEN '' ELSE concat(', \"pct_requiv\": \"', " + amount("pct_requiv") + ", '\", \"cuota_requiv\": \"', " + amount("cuota_requiv") + ", '\"') END, '}')"
    party = lambda side, name, nif: f"concat('\"{side}_nombre\": ', {quoted(name)}, ', \"{side}_nif\": ', {quoted(nif)})"
    client_nif = f"CASE WHEN doc_seq % 31 = 0 THEN NULL ELSE '{CLIENT_ID}' END"
    body = (
        "concat('{', CASE WHEN tipo = 'venta' THEN concat(" + party("emisor", f"'{CLIENT_NAME}'", client_nif) + ", ', ', " + party("receptor", "nombre", "nif") + ") ELSE concat("
        + party("emisor", "nombre", "nif") + ", ', ', " + party("receptor", f"'{CLIENT_NAME}'", client_nif) + ") END, ', \"num_factura\": \"', num_factura, '\", \"fecha\": \"', fecha, '\", \"total\": \"', "
        + "CASE WHEN total_impreso < 0 THEN concat(" + amount("-total_impreso") + ", '-') ELSE " + amount("total_impreso") + " END, '\"', "
        + "CASE WHEN i_base IS NULL THEN '' ELSE concat(', \"base_irpf\": \"', " + amount("i_base") + ", '\", \"pct_irpf\": 15, \"cuota_irpf\": \"', " + amount("i_cuota") + ", '\"') END, "
        + "CASE WHEN doc_seq % 27 = 0 THEN ', \"hay_anotaciones_manuscritas\": true' ELSE '' END, "
        + "', \"sustituye_a\": \"', sustituye_a, '\", \"concepto_texto\": \"', concepto_texto, '\", \"lineas_iva\": [', lineas, ']')"
    )
    topic = lambda k: f"CASE {k} % 9 WHEN 0 THEN 'Recibo de móvil' WHEN 1 THEN 'Gasóleo A' WHEN 2 THEN 'Tasa de basuras' WHEN 3 THEN 'Soporte técnico' WHEN 4 THEN 'Reparación de taller' WHEN 5 THEN 'Gas natural' WHEN 6 THEN 'Factura de agua' WHEN 7 THEN 'Luz y electricidad' ELSE 'Género vario' END"
    topics = f"concat({topic('doc_seq')}, CASE WHEN doc_seq % 5 = 0 THEN concat(' y ', {topic('(doc_seq + 4)')}) ELSE '' END)"
    return f"""
    SELECT doc_seq, concat('scan-', doc_seq % 100, '.pdf') AS origen, CAST(1 AS INT) AS pagina,
      CASE doc_seq % 3 WHEN 0 THEN concat('```json', chr(10), body, ', }}', chr(10), '```') WHEN 1 THEN concat(body, '}}') ELSE concat('Here it is: ', body, ' ,}}') END AS texto
    FROM (
      SELECT doc_seq, {body} AS body FROM (
        SELECT doc_seq, min(tipo) AS tipo, min(nombre) AS nombre, min(nif) AS nif, min(num_factura) AS num_factura, min(fecha) AS fecha, min(total_impreso) AS total_impreso, min(sustituye_a) AS sustituye_a,
               min(base_irpf) AS i_base, min(cuota_irpf) AS i_cuota, {topics} AS concepto_texto, {joined(line, "line_no")} AS lineas
        FROM {{lines}} GROUP BY doc_seq
      ) x
    ) y"""


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Invoice lines as the operators take them."""
    tables = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("lineitem", "orders", "part")}
    text = _lines(_SPARK)
    for t in tables:
        text = text.replace(f"FROM {t} ", f"FROM {{{t}}} ").replace(f"JOIN {t} ", f"JOIN {{{t}}} ")
    p = spark.sql(text, **tables)
    # the same as ``_scanned``, with the tables read once
    return spark.sql(f"SELECT explode(CASE WHEN k % 23 = 0 THEN array(k, k + 1000000000) ELSE array(k) END) AS doc_seq, {_COLUMNS} FROM {{p}}", p=p)


def texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_seq, origen, pagina, texto): the same invoices as JSON that a language model may have written."""
    body = _texts(_SPARK)
    body = body.replace("{", "{{").replace("}", "}}").replace("{{lines}}", "{lines}")
    return spark.sql(body, lines=lines(spark, sf_dir))


#: Common table expressions for the other engine: p, lines, texts. Each is computed once, however often it is named.
DUCK = f"WITH p AS MATERIALIZED ({_lines(_DUCK)}), lines AS MATERIALIZED ({_scanned(_DUCK).replace('{p}', 'p')}), texts AS MATERIALIZED ({_texts(_DUCK).replace('{lines}', 'lines')})"
