"""Code lists, field vocabulary and lookups. All values here are fixed by the e-invoice standard or the document model."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# fixed values: code lists of the e-invoice standard
AGENCIES = ("TTN", "Tunisie TradeNet")
PARTNER_ID_TYPES = ("I-01", "I-02", "I-03", "I-04")
DATE_FUNCTIONS = tuple(f"I-3{n}" for n in range(1, 9))
PARTNER_FUNCTIONS = tuple(f"I-6{n}" for n in range(1, 10))
SELLER_ROLES = ("I-62", "I-63", "I-66")
BUYER_ROLES = ("I-61", "I-64", "I-65")
CONTACT_MEANS = ("I-101", "I-102", "I-103", "I-104")
TAX_TYPES = (*(f"I-16{n}" for n in range(10)), "I-1601", "I-1602", "I-1603", "I-1604")
AMOUNT_TYPES = (*(f"I-17{n}" for n in range(1, 10)), *(f"I-18{n}" for n in range(10)))
DOCUMENT_LABELS = {"I-11": "Facture", "I-12": "Facture d'avoir"}
FORMAT_VERSION, COUNTRY, CURRENCY = "1.8.8", "TN", "TND"

# fixed values: the flat field vocabulary, in order, and each field's path in the nested record
FIELDS = (
    "invoice_number", "issue_date", "seller_name", "seller_tax_id", "seller_address", "seller_rc_number", "seller_capital", "buyer_name", "buyer_tax_id",
    "buyer_address", "currency", "total_ht", "tva_amount", "stamp_duty", "total_ttc", "delivery_note_number", "other_references",
)
LINE_FIELDS = ("code", "description", "unit_price_ht", "quantity", "vat_rate_percent", "line_total_ht")
PAYMENT_FIELDS = ("bank_name", "rib", "iban", "swift_bic", "payment_terms")
MANDATORY = ("invoice_number", "issue_date", "seller_tax_id", "buyer_tax_id", "total_ttc")
EXPECTED = ("invoice_number", "issue_date", "seller_name", "seller_tax_id", "buyer_name", "buyer_tax_id", "total_ht", "tva_amount", "stamp_duty", "total_ttc")
TOTALS = ("total_ht", "tva_amount", "stamp_duty", "total_ttc")
PATHS = {
    "invoice_number": "invoice_number", "issue_date": "issue_date", "seller_name": "seller.name", "seller_tax_id": "seller.tax_id",
    "seller_address": "seller.address.raw_text", "seller_rc_number": "seller.rc_number", "seller_capital": "capital_social", "buyer_name": "buyer.name",
    "buyer_tax_id": "buyer.tax_id", "buyer_address": "buyer.address.raw_text", "total_ht": "total_ht", "tva_amount": "tva_amount",
    "stamp_duty": "stamp_duty", "total_ttc": "total_ttc",
}
# fixed values: display colours, by field position
COLOURS = (
    "#e6194B", "#3cb44b", "#4363d8", "#f58231", "#911eb4", "#42d4f4", "#f032e6", "#9A6324",
    "#469990", "#800000", "#808000", "#000075", "#e6beff", "#fabed4", "#aaffc3", "#ffd8b1",
)

LISTS = {"agency": AGENCIES, "partner_id": PARTNER_ID_TYPES, "date": DATE_FUNCTIONS, "partner": PARTNER_FUNCTIONS, "contact": CONTACT_MEANS, "tax": TAX_TYPES, "amount": AMOUNT_TYPES}


def code_table(spark: SparkSession) -> DataFrame:
    """``list, code``: all code lists as one small dimension table."""
    return spark.createDataFrame([(name, code) for name, codes in LISTS.items() for code in codes], "list string, code string")


def lookup(pairs: dict[str, str], key: Column) -> Column:
    """The mapped value, or null."""
    return F.try_element_at(F.create_map(*(F.lit(x) for kv in pairs.items() for x in kv)), key)


def nested_name(flat: Column) -> Column:
    """A flat field's path in the nested record; other names pass through."""
    return F.coalesce(lookup(PATHS, flat), flat)


def flat_name(path: Column) -> Column:
    return F.coalesce(lookup({v: k for k, v in PATHS.items()}, path), path)


def colour_of(key: Column) -> Column:
    """A stable colour for a field key; line items start half a palette on."""
    line = F.regexp_extract(key, r"^line_items\[(\d+)\]", 1)
    place = F.array_position(F.array(*(F.lit(f) for f in FIELDS)), key) - 1
    index = F.when(line != "", F.try_add(line.try_cast("bigint"), F.lit(len(COLOURS) // 2))).when(place >= 0, place).otherwise(F.xxhash64(key))
    return F.element_at(F.array(*(F.lit(c) for c in COLOURS)), (F.pmod(index, F.lit(len(COLOURS))) + 1).cast("int"))


def field_spec(spark: SparkSession) -> DataFrame:
    """``pos, key, kind``: every field, so that omitted ones stay visible."""
    rows = [(i, k, "field") for i, k in enumerate(FIELDS)] + [(i, k, "line") for i, k in enumerate(LINE_FIELDS)]
    return spark.createDataFrame(rows, "pos int, key string, kind string")
