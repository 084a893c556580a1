"""Texts that users read. They must equal those of the application whose results these are."""

WARN_NO_ID = "El cliente figura como emisor sin NIF: confirma si es venta o gasto."
WARN_ROLE = "Rol emisor/destinatario dudoso: revisa si es gasto o venta."
WARN_HANDWRITTEN = "Tiene algo escrito a mano: se han usado los importes IMPRESOS (lo manuscrito no cuenta). Compruébala."
WARN_SUM = "El total no cuadra: la factura pone {total} y sus {n} líneas de IVA suman {sum}."
WARN_REPLACED = "SUSTITUIDA por la factura {new} del mismo lote: NO la importes o duplicarás el gasto."
WARN_WITHHOLDING = "Lleva retención de IRPF: NO se ha pasado a total factura (la retención hay que declararla). Revísala."
WARN_MEMORY_DIFFERS = "OJO: {name} tiene guardado el NIF {stored} y esta factura trae {read}. Comprueba cuál es el bueno."
WARN_FROM_MEMORY = "NIF puesto de memoria ({stored}): es el que consta guardado para {name} y {why}. Compruébalo."
WHY_MEMORY_BAD = "aquí se leyó «{read}», que no es válido"
WHY_MEMORY_NONE = "aquí no se leyó ninguno"
WARN_SEVERAL = "Hay {n} NIF distintos para este mismo nombre en el lote ({ids}): no se copia ninguno, escríbelo a mano."
WARN_COPIED = "NIF copiado de otra factura de {name} ({stored}): aquí {why}. Compruébalo."
WHY_COPIED_BAD = "se leyó «{read}», que no es un NIF válido"
WHY_COPIED_NONE = "no se leyó ningún NIF"

NO_DATE = "Falta la fecha (obligatorio)"
ODD_DATE = "No se entiende la fecha «{fecha}»: no se puede comprobar el trimestre"
OTHER_PERIOD = "FUERA DEL {period}: esta factura es del {own} ({fecha})"
NO_NUMBER = "Falta el nº de factura (obligatorio)"
NO_NAME = "Falta el nombre (obligatorio)"
NO_CONCEPT = "Falta el concepto (obligatorio)"
NO_ID = "Falta el NIF"
ODD_ID = "NIF/CIF dudoso (no pasa el digito de control): {nif}"
NO_VAT = "Falta la cuota de IVA"
ODD_VAT = "Cuota IVA descuadra: {cuota} pero base×% = {due}"
ODD_WITHHOLDING = "Cuota IRPF descuadra: {cuota} pero base×% = {due}"
ODD_SIGN = "El signo no cuadra: el total es {total} y la base {base}. ¿Es un abono/devolución? En un abono TODOS los importes van en negativo."
ODD_TOTAL = "El total no cuadra: factura pone {total}, base+cuota = {due} (¿suplidos/retención/financiación?)"
ALERT_DUPLICATE = "Línea {row}: factura {num} de {name} — repetida de la línea {first}."
ALERT_REPLACED = "Línea {row}: factura {num} de {name} — sustituida por otra del lote."
UNREADABLE = "(NO SE PUDO LEER)"

HEADERS = {
    "num_factura": "Nº Factura", "fecha": "Fecha", "fecha_deduccion": "Fecha Deduc.", "fecha_operacion": "Fecha Oper.", "concepto": "Concepto",
    "base_iva": "Base IVA", "pct_iva": "% IVA", "cuota_iva": "Cuota IVA", "base_irpf": "Base IRPF", "pct_irpf": "% IRPF", "cuota_irpf": "Cuota IRPF",
    "base_requiv": "Base R.Equiv", "pct_requiv": "% R.Equiv", "cuota_requiv": "Cuota R.Equiv", "nif": "NIF", "nombre": "Nombre",
    "descripcion_sii": "Descripcion SII", "tipo_factura": "Tipo Factura", "clave_reg_esp": "Clave Reg. Esp.", "isp": "ISP",
    "base_sujeta_cero": "Base sujeta 0%", "recc": "RECC", "suplidos": "Suplidos", "no_sujeta": "No sujeta",
}
