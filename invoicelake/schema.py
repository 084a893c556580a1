"""The invoice model: raw records, lines, memories, layouts."""

from __future__ import annotations

RAW_LINE = "struct<base:string,tipo_iva:string,cuota_iva:string,pct_requiv:string,cuota_requiv:string>"
RAW = (
    "emisor_nombre string, emisor_nif string, receptor_nombre string, receptor_nif string, num_factura string, fecha string, fecha_operacion string, "
    f"lineas_iva array<{RAW_LINE}>, base_irpf string, pct_irpf string, cuota_irpf string, base_requiv string, pct_requiv string, cuota_requiv string, "
    "total string, sustituye_a string, hay_anotaciones_manuscritas boolean, cuenta_gasto string, subclave_gxx string, concepto_texto string, confianza string"
)

# The exported fields of an invoice line, in order.
FIELDS = (
    "num_factura", "fecha", "fecha_operacion", "fecha_deduccion", "concepto", "base_iva", "pct_iva", "cuota_iva", "base_irpf", "pct_irpf", "cuota_irpf",
    "base_requiv", "pct_requiv", "cuota_requiv", "nif", "nombre", "descripcion_sii", "tipo_factura", "clave_reg_esp", "isp", "base_sujeta_cero", "recc",
    "suplidos", "no_sujeta",
)
PROVIDER_MEMORY = "clave string, nif string, nombre string, manual boolean"
CLIENT_MEMORY = "nif string, recargo_equivalencia boolean, nombre string"
LAYOUT = "tipo string, incluye_cabecera boolean, primera_fila int, campo string, letra string"
