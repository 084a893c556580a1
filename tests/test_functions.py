import random
import unicodedata
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from invoicelake.functions import cells, dates, json_text, names, numbers, taxid


def column(spark, f, values, kind="string"):
    df = spark.createDataFrame([(k, v) for k, v in enumerate(values)], f"k int, v {kind}")
    return [r[0] for r in df.orderBy("k").select(f(F.col("v")).alias("o")).collect()]


def test_numbers_as_printed(spark):
    cases = {"15,51-": -15.51, "12,29-": -12.29, "1.234,56-": -1234.56, "15,51": 15.51, "1.234,56": 1234.56, "-15.51": -15.51, "1.234": 1.234, "-5-": 5.0, " 3 € ": 3.0, "12d": None, "nan": None, "": None, None: None, "no es un numero": None}
    assert column(spark, numbers.parse_number, list(cases)) == list(cases.values())


def test_numbers_as_typed(spark):
    cases = {"1.234,56 €": 1234.56, "1.234": 1234.0, "1234.56": 1234.56, "21": 21.0, "1.234.567": 1234567.0, "1.2345": 1.2345, "5,5-": None, "x": None, None: None}
    assert column(spark, numbers.parse_typed_number, list(cases)) == list(cases.values())


def test_rounding_is_that_of_the_binary_value(spark):
    r = random.Random(1)
    xs = [r.randint(-10**7, 10**7) / 1000 for _ in range(2000)] + [2.675, 0.005, 1.005, -0.125, 0.125]
    assert column(spark, numbers.round2, xs, "double") == [float(f"{x:.2f}") for x in xs]
    assert column(spark, numbers.amount_text, xs, "double") == [f"{x:.2f}".replace(".", ",") for x in xs]


def test_percent_and_euros(spark):
    assert column(spark, numbers.percent_text, [21.0, 5.2, 0.5, 21.5, 1.4, None], "double") == ["21", "5,2", "0,5", "21,5", "1,4", None]
    assert column(spark, numbers.euros, [64.15, -1234567.891, 0.0], "double") == ["64,15 €", "-1.234.567,89 €", "0,00 €"]


def valid(s):
    t = (s or "").strip().upper().replace("-", "").replace(" ", "")
    if t[:1] and t[0] in "XYZ":
        t = str("XYZ".index(t[0])) + t[1:]
    if len(t) != 9:
        return False
    if t[:8].isdigit() and t[8].isalpha():
        return "TRWAGMYFPDXBNJZSQVHLCKE"[int(t[:8]) % 23] == t[8]
    if t[0] in "ABCDEFGHJNPQRSUVW" and t[1:8].isdigit():
        luhn = sum(int(c) if k % 2 else sum(map(int, str(2 * int(c)))) for k, c in enumerate(t[1:8]))
        c = -luhn % 10
        return t[8] in (str(c), "JABCDEFGHI"[c])
    return False


def test_tax_ids(spark):
    good = ["12345678Z", "B86561412", "A28017895", "B30048276", "B73549388", " b-86561412 ", "X1234567L"]
    bad = ["B3OO48276", "B8656141Z", "XXXX", "", None, "B.86561412"]
    r = random.Random(2)
    more = ["".join([r.choice("ABXYZ0123456789K"), *(r.choice("0123456789") for _ in range(7)), r.choice("0123456789ABCDEFGHIJTRW")]) for _ in range(3000)]
    assert column(spark, taxid.is_valid, good) == [True] * len(good) and column(spark, taxid.is_valid, bad) == [False] * len(bad)
    assert column(spark, taxid.is_valid, more) == [valid(x) for x in more]
    assert column(spark, taxid.normalize, ["b.86-561 412", None, ""]) == ["B86561412", "", ""]
    assert column(spark, taxid.alnum_key, ["f. 45/ñ-1", None]) == ["F45Ñ1", ""]


def test_names(spark):
    def words(s):
        t = "".join(c for c in unicodedata.normalize("NFD", s) if unicodedata.category(c) != "Mn").upper()
        for piece in (",", ".", "(", ")", " SL", " S L", " SLU", " SA", " SAU", " CB"):
            t = t.replace(piece, " ")
        return sorted({w for w in t.split() if len(w) >= 3})

    r = random.Random(3)
    firms = ["ANTONIO Y CAÑIZARES SL", "Pedro Sánchez", "Salón Sur, S.A.", "a b", ""] + ["".join(r.choice("aÉñ sSlLAa,.()üç") for _ in range(20)) for _ in range(1500)]
    assert column(spark, names.tokens, firms) == [words(f) for f in firms] and column(spark, names.tokens, [None]) == [[]]
    assert column(spark, names.provider_key, ["Antonio y Cañizares, S.L.", None]) == ["ANTONIO CANIZARES", ""]
    df = spark.createDataFrame([("JOSE ANTONIO MARIN PRIETO", "JOSE ANTONIO MAYOR MARCO"), ("MARIN PRIETO JOSE", "José Marín Prieto SL"), (None, "A")], "a string, b string")
    assert [r[0] for r in df.select(names.same_name(F.col("a"), F.col("b"))).collect()] == [False, True, False]


def test_cut_names(spark):
    cases = {"COCA-COLA EUROPACIFIC PARTNERS IBERIA, S.L.U.": "COCA-COLA EUROPACIFIC PARTNERS IBERIA", "MAKRO SA": "MAKRO SA", "a  b\tc": "a b c", "X" * 50: "X" * 40, "COMUNIDAD DE PROPIETARIOS EDIFICIO DE LA CALLE": "COMUNIDAD DE PROPIETARIOS EDIFICIO DE"}
    assert column(spark, names.trimmed, list(cases)) == list(cases.values())


def test_periods(spark):
    def own(s):
        for f in ("%d/%m/%Y", "%d-%m-%Y", "%d.%m.%Y", "%Y-%m-%d", "%d/%m/%y"):
            try:
                d = datetime.strptime((s or "").strip(), f)
                return d.year * 10 + (d.month + 2) // 3
            except ValueError:
                pass
        return None

    r = random.Random(4)
    texts = ["04/06/2026", "31/03/2026", "01/10/2026", "2026-06-04", "no es fecha", None, "31/02/2026", "4/6/85", " 1.1.2020 "]
    texts += [f"{r.randint(1, 32)}{s}{r.randint(1, 13)}{s}{r.choice([r.randint(1950, 2050), f'{r.randint(0, 99):02d}'])}" for s in "/-." for _ in range(300)]
    assert column(spark, dates.period, texts) == [own(t) for t in texts]
    assert column(spark, dates.period_text, [20262, None], "long") == ["2T 2026", "—"]


@pytest.mark.parametrize("text,want", [('{"a": 1}', '{"a": 1}'), ('```json\n{"a": 1,}\n```', '{"a": 1}'), ('so: {"a": [1, 2, ], } ok', '{"a": [1, 2]}'), ("nothing", None), (None, None)])
def test_json_repair(spark, text, want):
    assert column(spark, json_text.repaired, [text]) == [want]


def test_cells(spark):
    assert column(spark, cells.column_index, ["A", "Q", "Z", "AA", "az"]) == [1, 17, 26, 27, 52]
    assert column(spark, lambda c: cells.cell_value("nif", c), ["b-8.6", "", None]) == ["B86", None, None]
    assert column(spark, lambda c: cells.cell_value("base_iva", c), [1234.5, None], "double") == ["1234,50", None]
    assert column(spark, lambda c: cells.cell_value("base_iva", c, "numero"), [1234.567], "double") == ["1234.57"]


def test_numbers_in_messages(spark):
    values = [0.0, 1.0, -2.5, 12500000.0, 123456789.12, 1e15, 1e16, 0.05, 0.0001, 1e-5, -9999999.99, 10000000.01, None]
    df = spark.createDataFrame([(x,) for x in values], "x double").select("x", numbers.plain_text(F.col("x")).alias("t"))
    assert [r["t"] for r in df.collect()] == [None if x is None else {1e16: "1.0E16", 1e-5: "1.0E-5"}.get(x, repr(x)) for x in values]


def test_numbers_and_dates_are_generated_code(spark):
    """Lambdas are interpreted, value by value; amounts and dates are in every line."""
    from invoicelake.functions import dates, numbers

    odd = {"-5-": 5.0, "5--": None, "0,-.": None, "5-\n€": None, "57\n-": -57.0, " 1.234,50- €": -1234.5, "12d": None, "0,00-": 0.0}
    df = spark.createDataFrame([(t,) for t in odd], "t string").select("t", numbers.parse_number(F.col("t")).alias("n"), dates.period(F.col("t")).alias("p"))
    assert {r["t"]: r["n"] for r in df.collect()} == odd
    assert "lambda" not in df._jdf.queryExecution().toString()
