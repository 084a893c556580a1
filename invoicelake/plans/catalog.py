"""Registered queries over the invoice projection, each with the same question in DuckDB SQL."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import messages as M
from ..functions import cells, dates, json_text, names, nfd, numbers, taxid
from ..operators import build, client, duplicates, edit_log, edits, fill, grid, gross, incidents, memory, name_join, periods, replaced, revalidate, rule_index, rules, summary, validate
from ..sources import records
from ..stages import stage
from . import batch
from .projection import CLIENT_ID, CLIENT_NAME, DUCK, lines, texts

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}
#: The quarter that the period queries ask for.
QUARTER = 19982


def _query(sql: str | None, source: bool = True) -> Callable[[Query], Query]:
    """Registers a query with its check; ``source`` puts the projection's common tables in front."""

    def put(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = f"{DUCK}{sql}" if source and sql.lstrip().startswith(",") else f"{DUCK} {sql}" if source else sql
        return f

    return put


# Fixed values for the checks: the same rules as SQL.
_NORM = "coalesce(regexp_replace(upper(trim({0})), '[. -]', '', 'g'), '')"
_ALNUM = "coalesce(upper(regexp_replace({0}, '[^\\p{{L}}\\p{{N}}]', '', 'g')), '')"


def _valid_sql(c: str) -> str:
    t0 = f"regexp_replace(upper(trim({c})), '[ -]', '', 'g')"
    t = f"(translate(substr({t0}, 1, 1), 'XYZ', '012') || substr({t0}, 2))"
    digit = lambda i: f"TRY_CAST(substr({t}, {i}, 1) AS INT)"
    twice = lambda i: f"(CASE WHEN {digit(i)} < 5 THEN {digit(i)} * 2 ELSE {digit(i)} * 2 - 9 END)"
    control = f"((10 - ({digit(3)} + {digit(5)} + {digit(7)} + {twice(2)} + {twice(4)} + {twice(6)} + {twice(8)}) % 10) % 10)"
    person = f"substr('{taxid.PERSON_LETTERS}', TRY_CAST(substr({t}, 1, 8) AS INT) % 23 + 1, 1) = substr({t}, 9, 1)"
    last = f"substr({t}, 9, 1)"
    company = f"CASE WHEN regexp_full_match({last}, '[0-9]') THEN TRY_CAST({last} AS INT) = {control} ELSE {last} = substr('{taxid.COMPANY_LETTERS}', {control} + 1, 1) END"
    return f"coalesce(CASE WHEN regexp_full_match({t}, '[0-9]{{8}}\\p{{L}}') THEN {person} WHEN regexp_full_match({t}, '[{taxid.COMPANY_KINDS}][0-9]{{7}}.') THEN {company} END, FALSE)"


def _tokens_sql(c: str) -> str:
    t = f"upper(strip_accents({c}))"
    for piece in names._DROPPED:
        t = f"replace({t}, '{piece}', ' ')"
    return f"coalesce(list_sort(list_distinct(list_filter(regexp_split_to_array({t}, '\\s+'), lambda w: length(w) >= 3))), [])"


def _key_sql(c: str) -> str:
    return f"array_to_string({_tokens_sql(c)}, ' ')"


def _period_sql(c: str) -> str:
    d = f"coalesce(try_strptime({c}, '%d/%m/%Y'), try_strptime({c}, '%d-%m-%Y'), try_strptime({c}, '%d.%m.%Y'), try_strptime({c}, '%Y-%m-%d'), try_strptime({c}, '%d/%m/%y'))"
    d = f"(CASE WHEN regexp_full_match({c}, '[0-9]{{1,2}}/[0-9]{{1,2}}/[0-9]{{2}}') THEN try_strptime({c}, '%d/%m/%y') ELSE {d} END)"
    return f"CAST(year({d}) * 10 + quarter({d}) AS BIGINT)"


def _r2(x: str) -> str:
    return f"CAST(printf('%.2f', {x}) AS DOUBLE)"


def _msg(template: str, **values: str) -> str:
    """A message's template in SQL, with values as texts; a null reads None."""
    parts = re.split(r"\{(\w+)\}", template)
    return "concat(" + ", ".join(f"coalesce(CAST({values[p]} AS VARCHAR), 'None')" if k % 2 else "'" + p.replace("'", "''") + "'" for k, p in enumerate(parts)) + ")"


def _rules_sql(text: str, table: rules.Rules, default: str) -> str:
    """The first rule with a keyword in the text, without accents and in lower case."""
    hit = lambda keywords: " OR ".join(f"contains(strip_accents(lower({text})), '{k}')" for k in keywords)
    return "CASE " + " ".join(f"WHEN {hit(keywords)} THEN '{code}'" for code, keywords in table) + f" ELSE {default} END"


_LINE = "doc_seq, line_no"


# Numbers --------------------------------------------------------------------------------------------------------------
_PRINTED = """SELECT l_orderkey AS k, l_linenumber AS n, CASE (l_orderkey + l_partkey) % 10
  WHEN 0 THEN {f2} WHEN 1 THEN replace({f2}, '.', ',') WHEN 2 THEN concat(replace({f2}, '.', ','), '-') WHEN 3 THEN concat(replace({f2}, '.', ','), ' €')
  WHEN 4 THEN concat(substr({f2}, 1, 1), '.', substr({f2}, 2, 3), ',5') WHEN 5 THEN concat(substr({f2}, 1, 1), '.', substr({f2}, 2, 3)) WHEN 6 THEN '' WHEN 7 THEN '12d'
  WHEN 8 THEN concat('1.', substr({f2}, 1, 3), '.', substr({f2}, 1, 3)) ELSE NULL END AS t FROM {tab}"""
_DUCK_PRINTED = _PRINTED.format(f2="printf('%.2f', l_extendedprice)", tab="lineitem")
_NUMERIC = "[+-]?([0-9]+[.]?[0-9]*|[.][0-9]+)([eE][+-]?[0-9]+)?"


def _printed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(_PRINTED.format(f2="replace(format_number(l_extendedprice, '0.00'), ',', '')", tab="{li}"), li=spark.read.parquet(f"{sf_dir}/lineitem.parquet"))


@_query(f"""WITH s AS ({_DUCK_PRINTED}), a AS (SELECT *, replace(replace(trim(t), '€', ''), ' ', '') AS b FROM s),
  c AS (SELECT *, CASE WHEN b LIKE '%-' THEN left(b, -1) ELSE b END AS m FROM a),
  d AS (SELECT *, CASE WHEN m LIKE '%,%' AND m LIKE '%.%' THEN replace(replace(m, '.', ''), ',', '.') ELSE replace(m, ',', '.') END AS u FROM c)
  SELECT k, n, t, CASE WHEN regexp_full_match(u, '{_NUMERIC}') THEN CAST(u AS DOUBLE) * CASE WHEN b LIKE '%-' THEN -1 ELSE 1 END END AS valor FROM d""", source=False)  # fmt: skip
def q_num_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _printed(spark, sf_dir).withColumn("valor", numbers.parse_number(F.col("t")))


@_query(f"""WITH s AS ({_DUCK_PRINTED}), a AS (SELECT *, replace(replace(trim(t), '€', ''), ' ', '') AS b FROM s),
  d AS (SELECT *, CASE WHEN b LIKE '%,%' THEN replace(replace(b, '.', ''), ',', '.') WHEN b LIKE '%.%.%' OR regexp_full_match(b, '[^.]*[.][^.]{{3}}') THEN replace(b, '.', '') ELSE b END AS u FROM a)
  SELECT k, n, t, CASE WHEN regexp_full_match(u, '{_NUMERIC}') THEN CAST(u AS DOUBLE) END AS valor FROM d""", source=False)  # fmt: skip
def q_num_parse_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _printed(spark, sf_dir).withColumn("valor", numbers.parse_typed_number(F.col("t")))


@_query(f"SELECT {_LINE}, replace(printf('%.2f', base_iva), '.', ',') AS importe, replace(printf('%.2f', total_impreso), '.', ',') AS total FROM lines")
def q_fmt_amount(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines(spark, sf_dir).select("doc_seq", "line_no", numbers.amount_text(F.col("base_iva")).alias("importe"), numbers.amount_text(F.col("total_impreso")).alias("total"))


@_query(f"SELECT {_LINE}, CASE WHEN pct_requiv = floor(pct_requiv) THEN CAST(CAST(pct_requiv AS BIGINT) AS VARCHAR) ELSE replace(printf('%g', pct_requiv), '.', ',') END AS recargo, CAST(CAST(pct_iva AS BIGINT) AS VARCHAR) AS iva FROM lines")
def q_fmt_pct(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines(spark, sf_dir).select("doc_seq", "line_no", numbers.percent_text(F.col("pct_requiv")).alias("recargo"), numbers.percent_text(F.col("pct_iva")).alias("iva"))


@_query(f"""SELECT {_LINE}, (CASE WHEN total_impreso < 0 THEN '-' ELSE '' END) || replace(replace(replace(format('{{:,.2f}}', abs(total_impreso)), ',', '_'), '.', ','), '_', '.') || ' €' AS texto FROM lines""")
def q_fmt_eur(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines(spark, sf_dir).select("doc_seq", "line_no", numbers.euros(F.col("total_impreso")).alias("texto"))


# Tax ids and names ----------------------------------------------------------------------------------------------------
@_query(f"SELECT {_LINE}, nif, {_valid_sql('nif')} AS valido, {_valid_sql(chr(39) + 'A' + chr(39) + ' || lpad(CAST(doc_seq % 10000000 AS VARCHAR), 7, ' + chr(39) + '0' + chr(39) + ') || CAST(doc_seq % 10 AS VARCHAR)')} AS cif_valido FROM lines")
def q_taxid_valid(spark: SparkSession, sf_dir: str) -> DataFrame:
    company = F.concat(F.lit("A"), F.lpad((F.col("doc_seq") % 10_000_000).cast("string"), 7, "0"), (F.col("doc_seq") % 10).cast("string"))
    return lines(spark, sf_dir).select("doc_seq", "line_no", "nif", taxid.is_valid(F.col("nif")).alias("valido"), taxid.is_valid(company).alias("cif_valido"))


@_query(f"SELECT {_LINE}, {_NORM.format(chr(39) + ' b-' + chr(39) + ' || nif || ' + chr(39) + '.1 ' + chr(39))} AS norma, {_ALNUM.format('sustituye_a')} AS doc FROM lines")
def q_taxid_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines(spark, sf_dir).select("doc_seq", "line_no", taxid.normalize(F.concat(F.lit(" b-"), F.col("nif"), F.lit(".1 "))).alias("norma"), taxid.alnum_key(F.col("sustituye_a")).alias("doc"))


_FIRM = "(p_name || CASE p_partkey % 4 WHEN 0 THEN ', S.L.' WHEN 1 THEN ' Gestión SA' WHEN 2 THEN ' (Ibérica) y Compañía de Suministros Generales' ELSE ' El Norte' END)"


def _firms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(f"SELECT p_partkey, {_FIRM} AS nombre, p_name FROM {{part}}", part=spark.read.parquet(f"{sf_dir}/part.parquet"))


@_query(f"SELECT p_partkey, array_to_string({_tokens_sql('nombre')}, '|') AS palabras FROM (SELECT p_partkey, {_FIRM} AS nombre FROM part) t", source=False)
def q_name_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _firms(spark, sf_dir).select("p_partkey", F.array_join(names.tokens(F.col("nombre")), "|").alias("palabras"))


@_query(f"""SELECT p_partkey, len(list_intersect(a, b)) >= 2 AND len(list_intersect(a, b)) / greatest(least(len(a), len(b)), 1) >= 0.6 AS igual
  FROM (SELECT p_partkey, {_tokens_sql('nombre')} AS a, {_tokens_sql(chr(39) + 'Iberica y Compania ' + chr(39) + ' || p_name')} AS b FROM (SELECT *, {_FIRM} AS nombre FROM part) t) u""", source=False)  # fmt: skip
def q_name_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _firms(spark, sf_dir).select("p_partkey", names.same_name(F.col("nombre"), F.concat(F.lit("Iberica y Compania "), F.col("p_name"))).alias("igual"))


@_query(f"SELECT p_partkey, {_key_sql('nombre')} AS clave FROM (SELECT p_partkey, {_FIRM} AS nombre FROM part) t", source=False)
def q_provider_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _firms(spark, sf_dir).select("p_partkey", names.provider_key(F.col("nombre")).alias("clave"))


def _trim_sql(c: str) -> str:
    s = f"trim(regexp_replace({c}, '\\s+', ' ', 'g'))"
    return f"""CASE WHEN length({s}) <= 40 THEN {s} ELSE regexp_replace(regexp_replace(regexp_replace(
    CASE WHEN substr({s}, 41, 1) <> ' ' AND strpos(left({s}, 40), ' ') > 0 AND 40 - strpos(reverse(left({s}, 40)), ' ') >= 34 THEN left({s}, 40 - strpos(reverse(left({s}, 40)), ' ')) ELSE left({s}, 40) END,
    '[ ,.-]+$', ''), '(?i) (DE|DEL|LA|EL|LOS|LAS|Y|E)$', ''), '[ ,.-]+$', '') END"""


@_query(f"SELECT p_partkey, {_trim_sql(_FIRM)} AS nombre FROM part", source=False)
def q_name_trim(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _firms(spark, sf_dir).select("p_partkey", names.trimmed(F.col("nombre")).alias("nombre"))


# Dates ----------------------------------------------------------------------------------------------------------------
@_query(f"SELECT {_LINE}, fecha, {_period_sql('fecha')} AS periodo FROM lines")
def q_period_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines(spark, sf_dir).select("doc_seq", "line_no", "fecha", dates.period(F.col("fecha")).alias("periodo"))


@_query(f"SELECT p AS periodo FROM (SELECT {_period_sql('fecha')} AS p, count(*) AS n FROM lines GROUP BY 1) t WHERE p IS NOT NULL ORDER BY n DESC, p DESC LIMIT 1")
def q_period_mode(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periods.detect(lines(spark, sf_dir))


# Records --------------------------------------------------------------------------------------------------------------
@_query("SELECT doc_seq, num_factura, fecha, n AS lineas, CAST(1 AS BOOLEAN) AS legible FROM (SELECT doc_seq, min(num_factura) AS num_factura, min(fecha) AS fecha, count(*) AS n FROM lines GROUP BY 1) t")
def q_json_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return records.parse(texts(spark, sf_dir)).select("doc_seq", "num_factura", "fecha", F.size("lineas_iva").cast("long").alias("lineas"), "legible")


@_query(f"SELECT {_LINE}, replace(printf('%.2f', base_iva), '.', ',') AS base, CAST(CAST(pct_iva AS INT) AS VARCHAR) AS tipo_iva, replace(printf('%.2f', cuota_iva), '.', ',') || ' €' AS cuota_iva FROM lines")
def q_json_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = records.parse(texts(spark, sf_dir))
    return r.select("doc_seq", F.posexplode_outer("lineas_iva").alias("line_no", "l")).select("doc_seq", "line_no", "l.base", "l.tipo_iva", "l.cuota_iva")


_SIDES = f""", sides AS (SELECT doc_seq, lado, {_NORM.format('nif')} AS nif, nombre FROM (
    SELECT doc_seq, CASE WHEN tipo = 'venta' THEN 0 ELSE 1 END AS lado, CASE WHEN doc_seq % 31 <> 0 THEN '{CLIENT_ID}' END AS nif, '{CLIENT_NAME}' AS nombre FROM lines WHERE line_no = 0
    UNION ALL SELECT doc_seq, CASE WHEN tipo = 'venta' THEN 1 ELSE 0 END, nif, nombre FROM lines WHERE line_no = 0) u),
  named AS (SELECT nif, nombre, count(*) AS n, min(doc_seq * 2 + lado) AS f FROM sides WHERE nif <> '' GROUP BY 1, 2)"""


@_query(f"""{_SIDES}, top AS (SELECT nif FROM named GROUP BY 1 ORDER BY sum(n) DESC, min(f) LIMIT 1)
  SELECT nombre, nif FROM named WHERE nif = (SELECT nif FROM top) ORDER BY n DESC, f LIMIT 1""")
def q_client_detect(spark: SparkSession, sf_dir: str) -> DataFrame:
    return client.detect(records.parse(texts(spark, sf_dir)))


def _built(spark: SparkSession, sf_dir: str) -> DataFrame:
    who = spark.createDataFrame([(CLIENT_NAME, CLIENT_ID)], "nombre string, nif string")
    return build.build(records.parse(texts(spark, sf_dir)), who)


@_query("SELECT DISTINCT doc_seq, tipo, nombre, n2 AS nif FROM (SELECT *, min(nif) OVER (PARTITION BY doc_seq) AS n2 FROM lines) t")
def q_role(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _built(spark, sf_dir).filter("line_no = 0").select("doc_seq", "tipo", "nombre", "nif")


_CONCEPT = "json_extract_string('{' || regexp_extract(texto, '\"concepto_texto\": \"[^\"]*\"') || '}', '$.concepto_texto')"
_BOOKED = f""", booked AS (SELECT t.doc_seq, l.tipo, {_CONCEPT} AS concepto, {_CONCEPT} || ' ' || CASE WHEN l.tipo = 'venta' THEN '{CLIENT_NAME}' ELSE coalesce(l.nombre, '') END AS t FROM texts t JOIN lines l ON l.doc_seq = t.doc_seq AND l.line_no = 0),
  accounts AS (SELECT *, CASE WHEN tipo = 'venta' THEN '700' ELSE {_rules_sql('t', rules.EXPENSE_RULES, "'600'")} END AS cuenta FROM booked)"""


@_query(f"{_BOOKED} SELECT doc_seq, cuenta FROM accounts")
def q_account_rule(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _built(spark, sf_dir).filter("line_no = 0").select("doc_seq", "cuenta")


@_query(f"{_BOOKED} SELECT doc_seq, {_rules_sql('concepto', rules.EXPENSE_RULES, chr(39) + '600' + chr(39))} AS codigo FROM booked")
def q_account_rule_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = records.parse(texts(spark, sf_dir))
    return rules.by_join(r, "doc_seq", F.col("concepto_texto"), rules.rule_table(spark, rules.EXPENSE_RULES), rules.DEFAULT_EXPENSE)


@_query(f"{_BOOKED} SELECT doc_seq, CASE WHEN tipo <> 'venta' AND cuenta = '628' THEN {_rules_sql('t', rules.SUBCODE_RULES, 'NULL')} END AS gxx FROM accounts")
def q_subaccount(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _built(spark, sf_dir).filter("line_no = 0").select("doc_seq", "gxx")


@_query(f"SELECT {_LINE}, num_factura, base_iva, pct_iva, {_r2('cuota_iva')} AS cuota_iva, {_r2('total_impreso')} AS total_impreso, lineas_factura FROM lines")
def q_explode_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _built(spark, sf_dir).select("doc_seq", "line_no", "num_factura", "base_iva", "pct_iva", "cuota_iva", "total_impreso", "lineas_factura")


@_query(f"SELECT {_LINE}, base_requiv, pct_requiv, cuota_requiv FROM lines")
def q_surcharge(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _built(spark, sf_dir).select("doc_seq", "line_no", "base_requiv", "pct_requiv", "cuota_requiv")


@_query(f"SELECT {_LINE}, base_irpf, pct_irpf, cuota_irpf FROM lines")
def q_withholding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _built(spark, sf_dir).select("doc_seq", "line_no", "base_irpf", "pct_irpf", "cuota_irpf")


_CENTS = "CAST(printf('%.2f', {0}) AS DECIMAL(18,2))"
_SUMMED = " + ".join(_CENTS.format(c) for c in ("base_iva", "cuota_iva", "coalesce(cuota_requiv, 0)")) + " - " + _CENTS.format("coalesce(cuota_irpf, 0)")


@_query(f"""SELECT doc_seq, trim(concat_ws(' ', CASE WHEN n >= 2 AND abs(suma - total) > 0.02 THEN {_msg(M.WARN_SUM, total="printf('%.2f', total)", n="n", sum="printf('%.2f', suma)")} END, CASE WHEN doc_seq % 27 = 0 THEN '{M.WARN_HANDWRITTEN}' END)) AS aviso
  FROM (SELECT doc_seq, count(*) AS n, CAST(sum({_SUMMED}) AS DOUBLE) AS suma, {_r2('min(total_impreso)')} AS total FROM lines GROUP BY 1) t WHERE doc_seq % 31 <> 0""")
def q_reconcile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _built(spark, sf_dir).filter("line_no = 0 and doc_seq % 31 <> 0").select("doc_seq", "aviso")  # others have a warning on the role too


# Repairs --------------------------------------------------------------------------------------------------------------
_HEAD = f", h AS MATERIALIZED (SELECT doc_seq, nombre, nif, {_key_sql('nombre')} AS clave, {_NORM.format('nif')} AS norm, {_valid_sql(_NORM.format('nif'))} AS valido FROM lines WHERE line_no = 0)"
_READ = "trim(coalesce(h.nif, ''))"
_SIBLINGS = f"""{_HEAD}, v AS MATERIALIZED (SELECT clave, count(*) AS n, min(norm) AS bueno, arg_min(donante, norm) AS de, string_agg(norm, ', ' ORDER BY norm) AS ids
  FROM (SELECT clave, norm, arg_min(nombre, doc_seq) AS donante FROM h WHERE valido AND clave <> '' GROUP BY 1, 2) d GROUP BY 1)"""
_COPIED = f"""CASE WHEN h.valido OR v.n IS NULL THEN '' WHEN v.n = 1 THEN {_msg(M.WARN_COPIED, name="v.de", stored="v.bueno", why=f"CASE WHEN {_READ} <> '' THEN {_msg(M.WHY_COPIED_BAD, read=_READ)} ELSE '{M.WHY_COPIED_NONE}' END")}
  ELSE {_msg(M.WARN_SEVERAL, n="v.n", ids="v.ids")} END"""


@_query(f"""{_SIBLINGS} SELECT l.doc_seq, l.line_no, CASE WHEN NOT h.valido AND v.n = 1 THEN v.bueno ELSE l.nif END AS nif, {_COPIED} AS aviso FROM lines l JOIN h USING (doc_seq) LEFT JOIN v ON v.clave = h.clave""")
def q_fill_sibling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fill.from_siblings(stage(lines(spark, sf_dir))).select("doc_seq", "line_no", "nif", "aviso")


def _memory(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = spark.sql("SELECT p_name, min(p_partkey) AS fk FROM {part} GROUP BY p_name", part=spark.read.parquet(f"{sf_dir}/part.parquet")).filter("fk % 3 <> 0")
    key = (F.col("fk") * 2).cast("string")
    letter = F.expr(f"substr('{taxid.PERSON_LETTERS}', cast(fk * 2 % 23 as int) + 1, 1)")
    return s.select(names.provider_key(F.col("p_name")).alias("clave"), F.concat(F.lpad(key, 8, "0"), letter).alias("nif"), F.col("p_name").alias("nombre"), (F.col("fk") % 2 == 0).alias("manual"))


_MEM = f", m AS MATERIALIZED (SELECT {_key_sql('p_name')} AS clave, lpad(CAST(fk * 2 AS VARCHAR), 8, '0') || substr('{taxid.PERSON_LETTERS}', CAST(fk * 2 % 23 AS INT) + 1, 1) AS nif, p_name AS nombre, fk % 2 = 0 AS manual FROM (SELECT p_name, min(p_partkey) AS fk FROM part GROUP BY 1) s WHERE fk % 3 <> 0)"


def _remembered(head: str) -> str:
    """The warning of an invoice whose provider the memory knows."""
    read = _READ.replace("h.", f"{head}.")
    why = f"CASE WHEN {read} <> '' THEN {_msg(M.WHY_MEMORY_BAD, read=read)} ELSE '{M.WHY_MEMORY_NONE}' END"
    return f"""CASE WHEN m.nif IS NULL OR {head}.valido AND {head}.norm = m.nif THEN '' WHEN {head}.valido THEN {_msg(M.WARN_MEMORY_DIFFERS, name=f"{head}.nombre", stored="m.nif", read=f"{head}.norm")}
      ELSE {_msg(M.WARN_FROM_MEMORY, stored="m.nif", name=f"{head}.nombre", why=why)} END"""


@_query(f"""{_HEAD}{_MEM} SELECT l.doc_seq, l.line_no, CASE WHEN NOT h.valido AND m.nif IS NOT NULL THEN m.nif ELSE l.nif END AS nif, {_remembered("h")} AS aviso
  FROM lines l JOIN h USING (doc_seq) LEFT JOIN m ON m.clave = h.clave""")
def q_fill_memory(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fill.from_memory(stage(lines(spark, sf_dir)), _memory(spark, sf_dir)).select("doc_seq", "line_no", "nif", "aviso")


@_query(f"""{_HEAD}{_MEM}, w AS (SELECT clave, arg_max(norm, doc_seq) AS nif, arg_max(nombre, doc_seq) AS nombre FROM h WHERE valido AND clave <> '' GROUP BY 1)
  SELECT coalesce(m.clave, w.clave) AS clave, CASE WHEN coalesce(m.manual, FALSE) OR w.clave IS NULL THEN m.nif ELSE w.nif END AS nif,
  CASE WHEN coalesce(m.manual, FALSE) OR w.clave IS NULL THEN m.nombre ELSE w.nombre END AS nombre, coalesce(m.manual, FALSE) AS manual FROM m FULL JOIN w ON m.clave = w.clave""")
def q_memory_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    return memory.upsert_providers(_memory(spark, sf_dir), memory.learnable(lines(spark, sf_dir)))


_PAIRS = f""", d AS MATERIALIZED (SELECT doc_seq, num_factura, {_ALNUM.format('num_factura')} AS k, {_ALNUM.format('sustituye_a')} AS t FROM lines WHERE line_no = 0),
  r AS MATERIALIZED (SELECT o.doc_seq AS old, n.doc_seq AS new, n.num_factura AS num FROM (SELECT * FROM d WHERE k <> '') o JOIN (SELECT * FROM d WHERE t <> '') n ON o.k = n.t WHERE o.doc_seq <> n.doc_seq),
  rp AS MATERIALIZED (SELECT old, arg_max(num, new) AS por, string_agg({_msg(M.WARN_REPLACED, new='num')}, ' ' ORDER BY new) AS msg FROM r GROUP BY 1)"""


@_query(f"{_PAIRS} SELECT l.doc_seq, l.line_no, rp.por AS sustituida_por, coalesce(rp.msg, '') AS aviso FROM lines l LEFT JOIN rp ON rp.old = l.doc_seq")
def q_replaced(spark: SparkSession, sf_dir: str) -> DataFrame:
    return replaced.mark(stage(lines(spark, sf_dir))).select("doc_seq", "line_no", "sustituida_por", "aviso")


@_query(f"""SELECT l.doc_seq, l.line_no, CASE WHEN tipo = 'gasto' AND NOT g.held THEN g.gross ELSE base_iva END AS base_iva, CASE WHEN tipo <> 'gasto' OR g.held THEN pct_iva END AS pct_iva,
  CASE WHEN tipo <> 'gasto' OR g.held THEN cuota_requiv END AS cuota_requiv, tipo = 'gasto' AND g.held AS retenida
  FROM lines l JOIN (SELECT doc_seq, CAST(sum(CAST(printf('%.2f', base_iva) AS DECIMAL(18,2)) + CAST(printf('%.2f', cuota_iva) AS DECIMAL(18,2)) + CAST(printf('%.2f', coalesce(cuota_requiv, 0)) AS DECIMAL(18,2))) AS DOUBLE) AS gross, max(coalesce(cuota_irpf, 0) <> 0) AS held FROM lines GROUP BY 1) g USING (doc_seq)
  WHERE tipo <> 'gasto' OR g.held OR line_no = 0""")
def q_gross(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gross.collapse(lines(spark, sf_dir)).select("doc_seq", "line_no", "base_iva", "pct_iva", "cuota_requiv", F.col("aviso").contains("retención").alias("retenida"))


# Checks ---------------------------------------------------------------------------------------------------------------
_DUP = f""", u AS (SELECT *, first_value(doc_seq) OVER w AS d0, first_value(line_no) OVER w AS l0 FROM lines
  WINDOW w AS (PARTITION BY upper(trim(coalesce(num_factura, ''))), upper(trim(coalesce(nif, ''))), {_r2('base_iva')}, {_r2('pct_iva')} ORDER BY doc_seq, line_no)),
  x AS (SELECT *, CASE WHEN d0 <> doc_seq OR l0 <> line_no THEN d0 END AS dup_doc, CASE WHEN d0 <> doc_seq OR l0 <> line_no THEN l0 END AS dup_line FROM u)"""


@_query(f"{_DUP} SELECT doc_seq, line_no, dup_doc, dup_line FROM x")
def q_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return duplicates.mark(stage(lines(spark, sf_dir))).select("doc_seq", "line_no", "dup_doc", "dup_line")


_PER = _period_sql("fecha")
_DUE = _r2("base_iva + cuota_iva + coalesce(cuota_requiv, 0) - coalesce(cuota_irpf, 0)")
_WHOLE = "total_impreso IS NOT NULL AND base_iva IS NOT NULL AND lineas_factura = 1"
_RULES = (
    (1, 2, "coalesce(fecha, '') = ''"), (2, 1, f"coalesce(fecha, '') <> '' AND {_PER} IS NULL"), (3, 1, f"coalesce({_PER}, {QUARTER}) <> {QUARTER}"), (4, 2, "coalesce(num_factura, '') = ''"),
    (5, 2, "coalesce(nombre, '') = ''"), (6, 2, "coalesce(concepto, '') = ''"), (7, 1, "coalesce(nif, '') = ''"), (8, 1, f"coalesce(nif, '') <> '' AND NOT {_valid_sql('nif')}"),
    (9, 1, "base_iva IS NOT NULL AND pct_iva IS NOT NULL AND cuota_iva IS NULL"), (10, 2, f"abs(cuota_iva - {_r2('base_iva * pct_iva / 100.0::DOUBLE')}) > 0.02::DOUBLE"),
    (11, 2, f"coalesce(abs(cuota_irpf - {_r2('base_irpf * pct_irpf / 100.0::DOUBLE')}) > 0.02::DOUBLE, FALSE)"), (12, 2, f"{_WHOLE} AND (total_impreso < 0) <> (base_iva < 0)"),
    (13, 1, f"{_WHOLE} AND abs({_DUE} - total_impreso) > 0.02::DOUBLE"),
)
_RULE_IDS = "concat_ws(',', " + ", ".join(f"CASE WHEN {c} THEN '{k}' END" for k, _, c in _RULES) + ")"
_SEVERITY = "greatest(" + ", ".join(f"CASE WHEN {c} THEN {s} ELSE 0 END" for _, s, c in _RULES) + ")"
_STATE = f"CASE {_SEVERITY} WHEN 2 THEN 'error' WHEN 1 THEN 'revisar' ELSE 'ok' END"


def _py(x: str) -> str:
    """A number with at least one decimal, as messages show it."""
    return f"CASE WHEN {x} = floor({x}) AND abs({x}) < 1e15 THEN CAST(CAST({x} AS BIGINT) AS VARCHAR) || '.0' ELSE CAST({x} AS VARCHAR) END"


_PERIOD_TEXT = f"(({_PER} % 10) || 'T ' || ({_PER} // 10))"
_VAT, _HELD = _r2("base_iva * pct_iva / 100.0::DOUBLE"), _r2("base_irpf * pct_irpf / 100.0::DOUBLE")
_MESSAGES = {
    1: _msg(M.NO_DATE), 2: _msg(M.ODD_DATE, fecha="fecha"), 3: _msg(M.OTHER_PERIOD, period=f"'{QUARTER % 10}T {QUARTER // 10}'", own=_PERIOD_TEXT, fecha="fecha"), 4: _msg(M.NO_NUMBER), 5: _msg(M.NO_NAME),
    6: _msg(M.NO_CONCEPT), 7: _msg(M.NO_ID), 8: _msg(M.ODD_ID, nif="nif"), 9: _msg(M.NO_VAT), 10: _msg(M.ODD_VAT, cuota=_py("cuota_iva"), due=_py(_VAT)), 11: _msg(M.ODD_WITHHOLDING, cuota=_py("cuota_irpf"), due=_py(_HELD)),
    12: _msg(M.ODD_SIGN, total=_py("total_impreso"), base=_py("base_iva")), 13: _msg(M.ODD_TOTAL, total=_py("total_impreso"), due=_py(_DUE)),
}


@_query(f"SELECT {_LINE}, concat_ws(' | ', " + ", ".join(f"CASE WHEN {c} THEN {_MESSAGES[k]} END" for k, _, c in _RULES) + ") AS mensajes FROM lines")
def q_validate_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _checked(spark, sf_dir).select("doc_seq", "line_no", F.array_join(F.transform("issues", lambda i: i["message"]), " | ").alias("mensajes"))


def _checked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return validate.validate(lines(spark, sf_dir), F.lit(QUARTER).cast("long"))


def _marked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines with their states and duplicates. What nothing here asks for, such as messages, isn't stored."""
    asked = ("doc_seq", "line_no", "num_factura", "nif", "base_iva", "pct_iva", "fecha", "tipo", "aviso", "estado")
    return duplicates.mark(stage(_checked(spark, sf_dir).select(*asked)))


@_query(f"SELECT {_LINE}, {_RULE_IDS} AS reglas FROM lines")
def q_validate_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _checked(spark, sf_dir).select("doc_seq", "line_no", F.array_join(F.transform("issues", lambda i: i["rule"].cast("string")), ",").alias("reglas"))


_FINAL = f"CASE WHEN dup_doc IS NOT NULL THEN 'error' ELSE {_STATE} END"


@_query(f"{_DUP} SELECT {_LINE}, {_FINAL} AS estado FROM x")
def q_validate_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    return validate.final_state(_marked(spark, sf_dir)).select("doc_seq", "line_no", "estado")


@_query(f"{_DUP}, e AS (SELECT {_FINAL} AS estado, tipo FROM x) SELECT count(*) AS total, count(*) FILTER (estado = 'ok') AS ok, count(*) FILTER (estado = 'revisar') AS revisar, count(*) FILTER (estado = 'error') AS error, count(*) FILTER (tipo = 'gasto') AS gastos, count(*) FILTER (tipo = 'venta') AS ventas FROM e")
def q_state_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return summary.state_counts(validate.final_state(_marked(spark, sf_dir)))


_SUM = "CAST(sum(CAST(printf('%.2f', coalesce({0}, 0)) AS DECIMAL(18,2))) AS DOUBLE)"


@_query(f"""SELECT periodo, tipo, lineas, base, iva, irpf, requiv, {_r2('base + iva + requiv - irpf')} AS total, abs(irpf) > 0.005 AS tiene_irpf, abs(requiv) > 0.005 AS tiene_requiv FROM (
  SELECT {_PER} AS periodo, tipo, count(*) AS lineas, {_SUM.format('base_iva')} AS base, {_SUM.format('cuota_iva')} AS iva, {_SUM.format('cuota_irpf')} AS irpf, {_SUM.format('cuota_requiv')} AS requiv FROM lines GROUP BY 1, 2) t""")
def q_quarter_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return summary.totals(lines(spark, sf_dir).withColumn("periodo", dates.period(F.col("fecha"))), "periodo", "tipo")


@_query(f"SELECT tipo, {_SUM.format('base_iva')} AS base FROM lines GROUP BY 1")
def q_base_by_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    return summary.totals(lines(spark, sf_dir), "tipo").select("tipo", "base")


@_query(f"SELECT count(*) FILTER ({_PER} IS DISTINCT FROM {QUARTER}) AS fuera FROM lines")
def q_out_of_quarter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return summary.outside(lines(spark, sf_dir), QUARTER)


@_query(f"{_DUP} SELECT count(dup_doc) AS duplicadas, count(*) FILTER ({_SEVERITY} = 2) AS errores, count(*) FILTER ({_PER} IS DISTINCT FROM {QUARTER}) AS fuera FROM x")
def q_export_problems(spark: SparkSession, sf_dir: str) -> DataFrame:
    return summary.export_problems(_marked(spark, sf_dir), QUARTER)


# A whole batch ----------------------------------------------------------------------------------------------------------
_BATCH = f"""{_SIBLINGS}{_MEM}{_PAIRS}, a0 AS MATERIALIZED (
    SELECT doc_seq, trim(concat_ws(' ', CASE WHEN doc_seq % 31 = 0 AND tipo = 'venta' THEN '{M.WARN_NO_ID}' END, CASE WHEN n >= 2 AND abs(suma - total) > 0.02 THEN {_msg(M.WARN_SUM, total="printf('%.2f', total)", n="n", sum="printf('%.2f', suma)")} END,
      CASE WHEN doc_seq % 27 = 0 THEN '{M.WARN_HANDWRITTEN}' END)) AS aviso
    FROM (SELECT doc_seq, min(tipo) AS tipo, count(*) AS n, CAST(sum({_SUMMED}) AS DOUBLE) AS suma, {_r2('min(total_impreso)')} AS total FROM lines GROUP BY 1) g),
  s AS MATERIALIZED (SELECT l.* EXCLUDE (nif, aviso, cuota_iva, total_impreso, concepto, sustituida_por), {_r2('l.cuota_iva')} AS cuota_iva, {_r2('l.total_impreso')} AS total_impreso,
      CASE WHEN NOT h.valido AND v.n = 1 THEN v.bueno ELSE l.nif END AS nif, trim(concat_ws(' ', a0.aviso, {_COPIED})) AS aviso
    FROM lines l JOIN h USING (doc_seq) JOIN a0 USING (doc_seq) LEFT JOIN v ON v.clave = h.clave),
  h2 AS MATERIALIZED (SELECT doc_seq, nombre, nif, {_key_sql('nombre')} AS clave, {_NORM.format('nif')} AS norm, {_valid_sql(_NORM.format('nif'))} AS valido FROM s WHERE line_no = 0),
  t AS MATERIALIZED (SELECT s.* EXCLUDE (nif, aviso), CASE WHEN NOT h2.valido AND m.nif IS NOT NULL THEN m.nif ELSE s.nif END AS nif, trim(concat_ws(' ', s.aviso, {_remembered("h2")})) AS aviso
    FROM s JOIN h2 USING (doc_seq) LEFT JOIN m ON m.clave = h2.clave),
  y AS MATERIALIZED (SELECT t.* EXCLUDE (aviso), '600' AS concepto, rp.por AS sustituida_por, trim(concat_ws(' ', t.aviso, coalesce(rp.msg, ''))) AS aviso FROM t LEFT JOIN rp ON rp.old = t.doc_seq),
  modal AS (SELECT {_PER} AS p FROM y WHERE {_PER} IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, 1 DESC LIMIT 1){_DUP.replace("FROM lines", "FROM y")}"""


def _batch(spark: SparkSession, sf_dir: str) -> batch.Batch:
    return batch.run(records.parse(texts(spark, sf_dir)), _memory(spark, sf_dir))


@_query(f"""{_BATCH} SELECT doc_seq, line_no, nif, aviso, sustituida_por, dup_doc, dup_line,
  CASE WHEN dup_doc IS NOT NULL OR sev = 2 THEN 'error' WHEN sev = 1 OR aviso <> '' THEN 'revisar' ELSE 'ok' END AS estado FROM (SELECT *, {_SEVERITY.replace(str(QUARTER), "(SELECT p FROM modal)")} AS sev FROM x) z""")
def q_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _batch(spark, sf_dir).lines.select("doc_seq", "line_no", "nif", "aviso", "sustituida_por", "dup_doc", "dup_line", "estado")


_LEARNED = f"""{_BATCH}, h3 AS (SELECT doc_seq, nombre, {_key_sql('nombre')} AS clave, {_NORM.format('nif')} AS norm FROM t WHERE line_no = 0 AND {_valid_sql(_NORM.format('nif'))}),
  w AS (SELECT clave, arg_max(norm, doc_seq) AS nif, arg_max(nombre, doc_seq) AS nombre FROM h3 WHERE clave <> '' GROUP BY 1)"""


@_query(f"""{_LEARNED} SELECT coalesce(m.clave, w.clave) AS clave, CASE WHEN coalesce(m.manual, FALSE) OR w.clave IS NULL THEN m.nif ELSE w.nif END AS nif,
  CASE WHEN coalesce(m.manual, FALSE) OR w.clave IS NULL THEN m.nombre ELSE w.nombre END AS nombre, coalesce(m.manual, FALSE) AS manual FROM m FULL JOIN w ON m.clave = w.clave""")
def q_batch_memory(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _batch(spark, sf_dir).memory


@_query(f"""{_LEARNED} SELECT (SELECT count(*) FROM h JOIN v USING (clave) WHERE NOT h.valido AND v.n = 1) AS copiadas, (SELECT count(*) FROM h JOIN v USING (clave) WHERE NOT h.valido AND v.n > 1) AS dudosas,
  (SELECT count(*) FROM h2 JOIN m USING (clave) WHERE NOT h2.valido) AS de_memoria, (SELECT count(*) FROM h2 JOIN m USING (clave) WHERE h2.valido AND h2.norm <> m.nif) AS distintas,
  (SELECT count(*) FROM h3 WHERE clave <> '' AND clave NOT IN (SELECT clave FROM m WHERE manual)) AS aprendidas, (SELECT count(*) FROM r) AS marcadas""")
def q_batch_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _batch(spark, sf_dir).counts


@_query(f"{_DUP} SELECT {_LINE}, estado FROM (SELECT {_LINE}, {_FINAL} AS estado FROM x) e WHERE estado = 'revisar'")
def q_filter_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    return summary.in_state(validate.final_state(_marked(spark, sf_dir)), "revisar").select("doc_seq", "line_no", "estado")


def _eur_sql(x: str) -> str:
    return f"(CASE WHEN {x} < 0 THEN '-' ELSE '' END) || replace(replace(replace(format('{{:,.2f}}', abs({x})), ',', '_'), '.', ','), '_', '.') || ' €'"


@_query(f"""SELECT (periodo % 10) || 'T ' || (periodo // 10) AS trimestre, tipo, concat_ws('  ·  ', 'base ' || {_eur_sql('base')}, 'IVA ' || {_eur_sql('iva')}, CASE WHEN abs(requiv) > 0.005 THEN 'recargo ' || {_eur_sql('requiv')} END,
    CASE WHEN abs(irpf) > 0.005 THEN 'IRPF −' || {_eur_sql('irpf')} END, 'total factura ' || {_eur_sql('total')}) AS texto
  FROM (SELECT *, {_r2('base + iva + requiv - irpf')} AS total FROM (
    SELECT {_PER} AS periodo, tipo, {_SUM.format('base_iva')} AS base, {_SUM.format('cuota_iva')} AS iva, {_SUM.format('cuota_irpf')} AS irpf, {_SUM.format('cuota_requiv')} AS requiv FROM lines WHERE {_PER} IS NOT NULL GROUP BY 1, 2) g) t""")
def q_described(spark: SparkSession, sf_dir: str) -> DataFrame:
    dated = lines(spark, sf_dir).withColumn("periodo", dates.period(F.col("fecha"))).filter("periodo is not null")
    return summary.totals(dated, "periodo", "tipo").select(dates.period_text(F.col("periodo")).alias("trimestre"), "tipo", summary.described().alias("texto"))


#: The invoice whose id a person types, and the id.
TYPED = (7, "B86561412")


@_query(f"""{_HEAD} SELECT l.doc_seq, l.line_no, CASE WHEN l.doc_seq = {TYPED[0]} OR same.clave IS NOT NULL AND NOT h.valido THEN '{TYPED[1]}' ELSE l.nif END AS nif
  FROM lines l JOIN h ON h.doc_seq = l.doc_seq LEFT JOIN h AS same ON same.doc_seq = {TYPED[0]} AND same.clave <> '' AND same.clave = h.clave""")
def q_typed_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return memory.spread_manual_id(lines(spark, sf_dir), *TYPED).select("doc_seq", "line_no", "nif")


@_query("SELECT CASE WHEN doc_seq % 47 = 0 THEN doc_seq + 1 + (SELECT max(doc_seq) FROM lines WHERE doc_seq % 47 <> 0) ELSE doc_seq END AS doc_seq, line_no, num_factura FROM lines")
def q_restored(spark: SparkSession, sf_dir: str) -> DataFrame:
    every = lines(spark, sf_dir)
    gone = every.filter("doc_seq % 47 = 0")
    return edits.restored(edits.without_rows(every, gone), gone).select("doc_seq", "line_no", "num_factura")


_NUMBERED = f"{_DUP}, z AS (SELECT *, row_number() OVER (ORDER BY doc_seq, line_no) - 1 AS fila, {_FINAL} AS estado FROM x)"
CURRENT = 100


@_query(f"{_NUMBERED} SELECT fila, estado FROM z WHERE estado <> 'ok' ORDER BY ((fila - {CURRENT + 1}) % (SELECT count(*) FROM z) + (SELECT count(*) FROM z)) % (SELECT count(*) FROM z) LIMIT 1")
def q_next_incident(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = summary.numbered(validate.final_state(_marked(spark, sf_dir)).select("doc_seq", "line_no", "estado")).select("fila", "estado")
    return summary.next_incident(rows, CURRENT)


@_query(f"""{_NUMBERED}{_PAIRS}, dd AS (SELECT a.fila, 0 AS clase, b.fila AS primera, a.num_factura, a.nombre FROM z a JOIN z b ON b.doc_seq = a.dup_doc AND b.line_no = a.dup_line
    UNION ALL SELECT fila, 1, NULL, num_factura, nombre FROM z WHERE doc_seq IN (SELECT old FROM rp))
  SELECT clase, fila, 'Línea ' || (fila + 1) || ': factura ' || num_factura || ' de ' || nombre || CASE clase WHEN 0 THEN ' — repetida de la línea ' || (primera + 1) || '.' ELSE ' — sustituida por otra del lote.' END AS texto, (SELECT count(*) FROM dd) AS avisos
  FROM dd ORDER BY clase, fila LIMIT 6""")
def q_top_alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    every = lines(spark, sf_dir).select("doc_seq", "line_no", "num_factura", "nombre", "nif", "base_iva", "pct_iva", "sustituye_a", "sustituida_por", "aviso")
    rows = summary.numbered(duplicates.mark(stage(replaced.mark(stage(every)))).select("doc_seq", "line_no", "num_factura", "nombre", "aviso", "dup_doc", "dup_line"))
    first = rows.select(F.col("doc_seq").alias("dup_doc"), F.col("line_no").alias("dup_line"), F.col("fila").alias("dup_fila"))
    rows = rows.join(first, ["dup_doc", "dup_line"], "left").withColumn("sustituida", F.col("aviso").contains("SUSTITUIDA"))
    return summary.alerts(rows)


# The sheet ------------------------------------------------------------------------------------------------------------
# The shipped layout of expenses.
LAYOUT = (("fecha", "B"), ("concepto", "C"), ("base_iva", "D"), ("pct_iva", "E"), ("cuota_iva", "F"), ("base_irpf", "G"), ("pct_irpf", "H"), ("cuota_irpf", "I"), ("base_requiv", "J"), ("fecha_operacion", "K"), ("pct_requiv", "M"), ("cuota_requiv", "N"), ("nif", "O"), ("nombre", "P"), ("num_factura", "Q"))


def layout(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([("COMPRAS/GASTOS", True, 2, c, x) for c, x in LAYOUT], "tipo string, incluye_cabecera boolean, primera_fila int, campo string, letra string")


def _cell_sql() -> str:
    def value(c: str) -> str:
        if c == "nif":
            return f"nullif({_NORM.format('nif')}, '')"
        if c == "nombre":
            return _trim_sql("nombre")
        if c in cells.PERCENTAGES:
            return f"CASE WHEN {c} = floor({c}) THEN CAST(CAST({c} AS BIGINT) AS VARCHAR) ELSE replace(printf('%g', {c}), '.', ',') END"
        return f"replace(printf('%.2f', {c}), '.', ',')" if c in cells.AMOUNTS else c

    have = [(c, x) for c, x in LAYOUT if c != "fecha_operacion"]
    from ..messages import HEADERS

    body = " UNION ALL ".join(f"SELECT fila + 2 AS fila, CAST({ord(x) - 64} AS INT) AS columna, '{x}' AS letra, {value(c)} AS valor, CAST({chr(39) + '@' + chr(39) if c in cells.AMOUNTS or c in cells.PERCENTAGES else 'NULL'} AS VARCHAR) AS formato FROM nn" for c, x in have)
    head = " UNION ALL ".join(f"SELECT 1, {ord(x) - 64}, '{x}', '{HEADERS[c]}', NULL" for c, x in LAYOUT)
    return f", nn AS (SELECT *, row_number() OVER (ORDER BY doc_seq, line_no) - 1 AS fila FROM lines WHERE tipo = 'gasto'), cc AS ({body} UNION ALL {head}) SELECT * FROM cc WHERE valor IS NOT NULL"


def _all_fields(df: DataFrame) -> DataFrame:
    text = ("fecha_operacion", "fecha_deduccion", "descripcion_sii", "tipo_factura", "clave_reg_esp", "isp", "recc")
    return df.withColumns({c: F.lit(None).cast("string") for c in text} | {c: F.lit(None).cast("double") for c in ("base_sujeta_cero", "suplidos", "no_sujeta")})


@_query(_cell_sql())
def q_layout_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grid.sheet(_all_fields(lines(spark, sf_dir).filter("tipo = 'gasto'")), layout(spark))


@_query(f"SELECT {_LINE}, tipo, coalesce(concepto, '') AS concepto, '' AS gxx, coalesce(fecha, '') AS fecha, num_factura, nombre, coalesce(nif, '') AS nif, replace(printf('%.2f', base_iva), '.', ',') AS base_iva, replace(printf('%.2f', pct_iva), '.', ',') AS pct_iva, replace(printf('%.2f', cuota_iva), '.', ',') AS cuota_iva, replace(printf('%.2f', total_impreso), '.', ',') AS total_impreso FROM lines")
def q_grid_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grid.grid_view(lines(spark, sf_dir).withColumn("gxx", F.lit("")))


@_query(f"SELECT {_LINE}, CASE WHEN doc_seq % 41 = 0 THEN 'venta' ELSE tipo END AS tipo, CASE WHEN doc_seq % 43 = 0 AND line_no = 0 THEN 1234.5::DOUBLE ELSE {_r2('base_iva')} END AS base_iva FROM lines WHERE doc_seq % 47 <> 0")
def q_edits(spark: SparkSession, sf_dir: str) -> DataFrame:
    all_lines = edits.as_shown(lines(spark, sf_dir))
    typed = all_lines.filter("doc_seq % 41 = 0").select("doc_seq", "line_no", F.lit("tipo").alias("campo"), F.lit("venta").alias("valor"))
    priced = all_lines.filter("doc_seq % 43 = 0 and line_no = 0").select("doc_seq", "line_no", F.lit("base_iva").alias("campo"), F.lit("1.234,50 €").alias("valor"))
    kept = edits.without_rows(all_lines, all_lines.filter("doc_seq % 47 = 0"))
    return edits.apply(kept, typed.unionByName(priced)).select("doc_seq", "line_no", "tipo", "base_iva")


@_query("SELECT c_custkey, CAST(c_custkey % 4 = 0 AS BOOLEAN) AS recargo_equivalencia FROM customer", source=False)
def q_client_regime(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = spark.read.parquet(f"{sf_dir}/customer.parquet").select("c_custkey", F.concat(F.lit("es-"), F.col("c_custkey")).alias("nif"))
    news = c.filter("c_custkey % 2 = 0").select("nif", (F.col("c_custkey") % 4 == 0).alias("recargo_equivalencia"), F.lit("").alias("nombre"))
    held = memory.upsert_clients(spark.createDataFrame([], "nif string, recargo_equivalencia boolean, nombre string"), news)
    return memory.in_surcharge_regime(c, held, "nif").select("c_custkey", "recargo_equivalencia")


# Tables of rules and names at scale --------------------------------------------------------------------------------------
_WORD = "translate(substr(md5(concat(CAST({0} AS STRING), '-', CAST({1} AS STRING))), 1, {2}), '0123456789', 'etaoinshrl')"
_KEYWORDS = f"""SELECT (p_partkey * 7919 + j * 104729) % 10007 AS prio, {_WORD.format("p_partkey", "j", "CAST(3 + (p_partkey + j) % 5 AS INT)")} AS clave
  FROM (SELECT p_partkey, {{five}} AS j FROM {{part}}) x"""


@_query(f"""WITH k AS MATERIALIZED (SELECT clave, min(prio) AS prio FROM ({_KEYWORDS.format(part="part", five="unnest([1, 2, 3, 4, 5])")}) a GROUP BY 1), d AS MATERIALIZED (SELECT doc_id, strip_accents(lower(coalesce(text, ''))) AS t FROM documents),
  h AS (SELECT doc_id, min(prio) AS prio FROM d JOIN k ON contains(d.t, k.clave) GROUP BY 1)
  SELECT d.doc_id, coalesce(CAST(600 + h.prio % 30 AS VARCHAR), '600') AS codigo FROM d LEFT JOIN h ON h.doc_id = d.doc_id""", source=False)  # fmt: skip
def q_indexed_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five keywords for each part, against whole documents."""
    keywords = spark.sql(_KEYWORDS.replace("{five}", "explode(array(1, 2, 3, 4, 5))"), part=spark.read.parquet(f"{sf_dir}/part.parquet"))
    table = keywords.select(F.col("prio").cast("int").alias("prio"), (600 + F.col("prio") % 30).cast("string").alias("codigo"), "clave")
    return rule_index.by_index(spark.read.parquet(f"{sf_dir}/documents.parquet"), "doc_id", F.col("text"), table, "600")


_PARTY = f"concat(CASE WHEN p_partkey % 3 = 0 THEN 'Suministros ' ELSE '' END, p_name, ' ', {_WORD.format('p_partkey % 331', 7, 6)}, CASE p_partkey % 4 WHEN 0 THEN ', S.L.' WHEN 1 THEN concat(' ', {_WORD.format('p_partkey % 113', 8, 5)}, ' SA') ELSE '' END)"


@_query(f"""WITH n AS (SELECT p_partkey, {_tokens_sql(_PARTY)} AS w FROM part), c AS MATERIALIZED (SELECT w, count(*) AS n, min(p_partkey) AS least FROM n GROUP BY 1),
  g AS (SELECT a.w, sum(b.n) AS n, min(CASE WHEN a.w <> b.w THEN b.least END) AS least FROM c a JOIN c b ON len(list_intersect(a.w, b.w)) >= 2 AND len(list_intersect(a.w, b.w)) / least(len(a.w), len(b.w)) >= 0.6 GROUP BY 1),
  o AS (SELECT *, min(p_partkey) OVER (PARTITION BY w) AS first, min(p_partkey) OVER (PARTITION BY w ORDER BY p_partkey ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS later FROM n)
  SELECT p_partkey, CAST(coalesce(g.n - 1, 0) AS BIGINT) AS partners, CASE WHEN g.w IS NOT NULL THEN least(g.least, CASE WHEN p_partkey > first THEN first ELSE later END) END AS least_partner FROM o LEFT JOIN g ON g.w = o.w""", source=False)  # fmt: skip
def q_same_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each party how many others are the same firm, and the first of them; a third of all share one word."""
    parties = spark.sql(f"SELECT p_partkey, {_PARTY} AS nombre FROM {{part}}", part=spark.read.parquet(f"{sf_dir}/part.parquet"))
    return name_join.within(parties, id_col="p_partkey")


_CLIENTS = f"SELECT c_custkey, {_WORD.format('c_custkey % 331', 7, 6)} || ' ' || {_WORD.format('c_custkey % 113', 8, 5)} || CASE WHEN c_custkey % 3 = 0 THEN ' Suministros' ELSE '' END AS nombre FROM {{customer}}"


@_query(f"""WITH l AS (SELECT c_custkey, {_tokens_sql("nombre")} AS w FROM ({_CLIENTS.format(customer="customer")}) a), r AS (SELECT {_tokens_sql(_PARTY)} AS w, count(*) AS n, min(p_partkey) AS least FROM part GROUP BY 1),
  c AS (SELECT DISTINCT w FROM l),
  g AS (SELECT c.w, sum(r.n) AS n, min(r.least) AS least FROM c JOIN r ON len(list_intersect(c.w, r.w)) >= 2 AND len(list_intersect(c.w, r.w)) / least(len(c.w), len(r.w)) >= 0.6 GROUP BY 1)
  SELECT c_custkey, CAST(coalesce(g.n, 0) AS BIGINT) AS partners, g.least AS least_partner FROM l LEFT JOIN g ON g.w = l.w""", source=False)  # fmt: skip
def q_clients_by_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Many clients at once: for each the parties that bear its name."""
    clients = spark.sql(_CLIENTS, customer=spark.read.parquet(f"{sf_dir}/customer.parquet")).select(F.col("c_custkey").alias("id"), "nombre")
    parties = spark.sql(f"SELECT p_partkey AS id, {_PARTY} AS nombre FROM {{part}}", part=spark.read.parquet(f"{sf_dir}/part.parquet"))
    return name_join.across(clients, parties).withColumnRenamed("id", "c_custkey")


@_query(f"""{_NUMBERED} SELECT fila, coalesce(min(CASE WHEN estado <> 'ok' THEN fila END) OVER (ORDER BY fila ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), (SELECT min(fila) FROM z WHERE estado <> 'ok')) AS siguiente FROM z""")
def q_next_incidents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For every line the next one to look at, going round."""
    rows = stage(summary.numbered(validate.final_state(_marked(spark, sf_dir)).select("doc_seq", "line_no", "estado")).select("fila", "estado"))
    return incidents.next_incidents(rows)


# What a person did, and what follows from it ------------------------------------------------------------------------------
#: Entries: 1 to 3 edits of a name, the last one undone for every second document, the undo undone for every sixth; deletions, some undone.
_LOGGED = """SELECT doc_seq * 10 + 1 AS seq, 'edita' AS accion, doc_seq, 0 AS line_no, 'nombre' AS campo, concat('primera ', doc_seq) AS valor, CAST(NULL AS BIGINT) AS deshace FROM {h} WHERE doc_seq % 4 = 0
  UNION ALL SELECT doc_seq * 10 + 2, 'edita', doc_seq, 0, 'nombre', concat('segunda ', doc_seq), CAST(NULL AS BIGINT) FROM {h} WHERE doc_seq % 8 = 0
  UNION ALL SELECT doc_seq * 10 + 3, 'deshace', CAST(NULL AS BIGINT), CAST(NULL AS INT), CAST(NULL AS STRING), CAST(NULL AS STRING), doc_seq * 10 + 2 FROM {h} WHERE doc_seq % 16 = 0
  UNION ALL SELECT doc_seq * 10 + 4, 'deshace', CAST(NULL AS BIGINT), CAST(NULL AS INT), CAST(NULL AS STRING), CAST(NULL AS STRING), doc_seq * 10 + 3 FROM {h} WHERE doc_seq % 48 = 0
  UNION ALL SELECT doc_seq * 10 + 5, 'borra', doc_seq, 0, CAST(NULL AS STRING), CAST(NULL AS STRING), CAST(NULL AS BIGINT) FROM {h} WHERE doc_seq % 7 = 0
  UNION ALL SELECT doc_seq * 10 + 6, 'deshace', CAST(NULL AS BIGINT), CAST(NULL AS INT), CAST(NULL AS STRING), CAST(NULL AS STRING), doc_seq * 10 + 5 FROM {h} WHERE doc_seq % 21 = 0"""


@_query(f"""SELECT {_LINE}, CASE WHEN line_no > 0 THEN nombre WHEN doc_seq % 8 = 0 AND (doc_seq % 16 <> 0 OR doc_seq % 48 = 0) THEN 'segunda ' || doc_seq WHEN doc_seq % 4 = 0 THEN 'primera ' || doc_seq ELSE nombre END AS nombre
  FROM lines WHERE NOT (line_no = 0 AND doc_seq % 7 = 0 AND doc_seq % 21 <> 0)""")
def q_edit_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lines as a log of edits, deletions and undos leaves them."""
    every = stage(lines(spark, sf_dir))
    log = spark.sql(_LOGGED, h=every.filter("line_no = 0"))
    return edit_log.at_version(every, log).select("doc_seq", "line_no", "nombre")


_EDITED = _DUP.replace("FROM lines", "FROM edited").replace(", u AS", ", edited AS (SELECT * REPLACE (CASE WHEN doc_seq % 101 = 0 AND line_no = 0 THEN 'F-1' ELSE num_factura END AS num_factura) FROM lines WHERE NOT (doc_seq % 211 = 0 AND line_no = 0)), u AS", 1)


@_query(f"{_EDITED} SELECT {_LINE}, dup_doc, {_FINAL} AS estado FROM x")
def q_revalidated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Results after edits and deletions, of which only what they touch is computed anew."""
    every = stage(lines(spark, sf_dir))
    results = revalidate.Results(every, QUARTER)
    typed = every.filter("doc_seq % 101 = 0 and line_no = 0").select("doc_seq", "line_no", F.lit("num_factura").alias("campo"), F.lit("F-1").alias("valor"))
    results.apply(typed, every.filter("doc_seq % 211 = 0 and line_no = 0"))
    return results.lines().select("doc_seq", "line_no", "dup_doc", "estado")


@_query("SELECT doc_id, md5(strip_accents(coalesce(text, ''))) AS md5 FROM documents", source=False)
def q_without_marks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole texts in canonical decomposition, without marks."""
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", F.md5(nfd.without_marks(F.coalesce("text", F.lit("")))).alias("md5"))
