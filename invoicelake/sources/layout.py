"""Column layouts from XML."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# The XML's tags and the fields they place; of two tags of one field the later wins.
TAGS = {
    "EDITFRAPROVE": "num_factura", "EDITFRARECIB": "num_factura", "EDITFECHA": "fecha", "EDITFECHADEDUCCION": "fecha_deduccion", "EDITFECHAOPER": "fecha_operacion",
    "EDITCONCEPTO": "concepto", "EDITBASEIVA": "base_iva", "EDITIVA": "pct_iva", "EDITCUOTAIVA": "cuota_iva", "EDITBASEIRPF": "base_irpf", "EDITIRPF": "pct_irpf",
    "EDITCUOTAIRPF": "cuota_irpf", "EDITBASEREQUIV": "base_requiv", "EDITREQUIV": "pct_requiv", "EDITCUOTAREQUIV": "cuota_requiv", "EDITNIF": "nif", "EDITNOMBRE": "nombre",
    "EDITDESCRIPSII": "descripcion_sii", "EDITTIPOFACT": "tipo_factura", "EDITCLAVEREGESP": "clave_reg_esp", "EDITISP": "isp", "EDITSUJETACERO": "base_sujeta_cero",
    "EDITRECC": "recc", "EDITSUPLIDOS": "suplidos", "EDITNOSUJETA": "no_sujeta",
}
ROOT, KIND, HEADER, FIRST_ROW, DEFAULT_KIND = "GestionFiscal", "COMBOBOXCOMPRASVENTAS", "CHECKBOXFICHEROINCLUYECABECERA", "PRIMERAFILADATOSCSV", "COMPRAS/GASTOS"


def read(spark: SparkSession, path: str, encoding: str = "ISO-8859-1") -> DataFrame:
    """(tipo, incluye_cabecera, primera_fila, campo, letra), a row for each field that has a column."""
    schema = ", ".join(f"{t} string" for t in (KIND, HEADER, FIRST_ROW, *TAGS))
    root = spark.read.schema(schema).option("rowTag", ROOT).option("encoding", encoding).format("xml").load(path)
    text = lambda c: F.trim(F.coalesce(F.col(c), F.lit("")))
    items = F.array(*(F.struct(F.lit(k).alias("k"), F.lit(f).alias("campo"), F.upper(text(t)).alias("letra")) for k, (t, f) in enumerate(TAGS.items())))
    first = F.coalesce(text(FIRST_ROW).try_cast("int"), F.lit(2))
    rows = root.select(F.coalesce(F.nullif(text(KIND), F.lit("")), F.lit(DEFAULT_KIND)).alias("tipo"), (F.upper(text(HEADER)) == "S").alias("incluye_cabecera"), first.alias("primera_fila"), F.explode(items).alias("i"))
    placed = rows.filter("i.letra <> ''").groupBy("tipo", "incluye_cabecera", "primera_fila", F.col("i.campo").alias("campo"))
    return placed.agg(F.max_by("i.letra", "i.k").alias("letra"))


def is_expenses(layout: DataFrame) -> DataFrame:
    return layout.select(F.upper("tipo").startswith("COMPRAS").alias("es_gastos")).distinct()
