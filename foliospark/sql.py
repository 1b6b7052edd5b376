"""The engine's rules as SQL table functions, for users who write nothing but SQL.

``register(spark)`` puts them into the session's catalogue. They are SQL functions over the same column expressions
as the DataFrame operators: a query that calls them with LATERAL is planned as one, without Python workers.

* ``invoice_checks(fields, line_items, source_text, reported)``: ``rule, severity, field, message`` of a flat record's problems
* ``invoice_deficient(fields, line_items, source_text, reported)``: ``field`` of what is worth asking for again, in order
* ``invoice_values(fields, line_items)``: ``key, value`` of every field and line value that is there
* ``einvoice_findings(xml)``: ``rule, severity, path, message``
* ``einvoice_lines(xml)``: ``line, item, description, quantity, rate`` as the XML has them

``fields`` is a map of texts, ``line_items`` an array of the engine's line structs. Null arguments are absent ones: a null map lacks every field,
a null XML is not well-formed.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from foliospark.functions import codes
from foliospark.functions.scalars import fold, let, present
from foliospark.operators import rules, xmlcheck
from foliospark.operators.repair import LINES

_RECORD = f"fields MAP<STRING, STRING>, line_items {LINES}, source_text STRING, reported ARRAY<STRING>"


def text_of(c: Column) -> str:
    """The SQL text of a column expression: as Spark prints it, with operators quoted, since it prints them as functions."""
    parts = re.split(r"('(?:[^'\\]|\\.)*')", repr(c).removeprefix("Column<'").removesuffix("'>"))  # every second part is a literal
    parts[::2] = [re.sub(r"(?<![\w`])(<=>|<=|>=|!=|[=<>!+\-*/%]|and|or|not)\(", r"`\1`(", x) for x in parts[::2]]
    return "".join(parts)


def _get(key: str) -> Column:
    return F.try_element_at(F.col("fields"), F.lit(key))


def _problems() -> Column:
    def with_text(text: Column) -> Column:
        return let(rules.parsed_totals(_get), lambda n: let(rules.line_summary(F.col("line_items")), lambda s: rules.all_problems(rules.Facts(_get, F.col("line_items"), text, F.col("reported"), lambda k: n[k], s))))

    return let(fold(present(F.col("source_text"))), with_text)


def _values() -> Column:
    pair = lambda k, v: F.struct(k.alias("key"), v.alias("value"))
    own = F.array(*(pair(F.lit(k), _get(k)) for k in codes.FIELDS if k != "other_references"))
    at = lambda i, k: F.concat(F.lit("line_items["), i.cast("string"), F.lit(f"].{k}"))
    lines = F.flatten(F.transform(F.coalesce("line_items", F.array().cast(LINES)), lambda x, i: F.array(*(pair(at(i, k), x[k]) for k in codes.LINE_FIELDS))))
    return F.filter(F.concat(own, lines), lambda p: F.trim(F.coalesce(p["value"], F.lit(""))) != "")


def _findings() -> Column:
    return let(F.coalesce("xml", F.lit("<")), lambda x: let(xmlcheck.parse(x, xmlcheck.CHECKED), lambda d: xmlcheck.findings_of(d, xmlcheck.root_name(x, d))))


def _lines() -> Column:
    lines = let(xmlcheck.parse(F.col("xml")), lambda d: d["InvoiceBody"]["LinSection"]["Lin"])
    row = lambda x, i: F.struct(
        (i + 1).alias("line"), x["ItemIdentifier"].alias("item"), x["LinImd"]["ItemDescription"].alias("description"), x["LinQty"]["Quantity"]["_VALUE"].alias("quantity"), x["LinTax"]["TaxDetails"]["TaxRate"].alias("rate"),
    )
    return F.transform(lines, row)


def functions() -> dict[str, tuple[str, str, str]]:
    """Name to parameters, columns of the result, and the select list over the parameters."""
    deficient = let(_problems(), lambda p: rules.deficient(_get, p))
    return {
        "invoice_checks": (_RECORD, "rule STRING, severity STRING, field STRING, message STRING", f"inline({text_of(_problems())})"),
        "invoice_deficient": (_RECORD, "field STRING", f"explode({text_of(deficient)})"),
        "invoice_values": (f"fields MAP<STRING, STRING>, line_items {LINES}", "key STRING, value STRING", f"inline({text_of(_values())})"),
        "einvoice_findings": ("xml STRING", "rule STRING, severity STRING, path STRING, message STRING", f"inline({text_of(_findings())})"),
        "einvoice_lines": ("xml STRING", "line INT, item STRING, description STRING, quantity STRING, rate STRING", f"inline({text_of(_lines())})"),
    }


def register(spark: SparkSession) -> list[str]:
    """Create the functions for this session; their names."""
    made = functions()
    for name, (parameters, columns, body) in made.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({parameters}) RETURNS TABLE ({columns}) RETURN SELECT {body}")
    return list(made)
