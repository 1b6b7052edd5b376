"""The engine from SQL alone: table functions called with LATERAL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from foliospark import sql
from foliospark.operators import assemble, einvoice
from foliospark.plans.rule_queries import PROBLEMS
from foliospark.plans.tables import query, records
from foliospark.plans.xml_queries import XML_FINDINGS


@query("q_sql_checks", PROBLEMS + "SELECT rule, severity, field, count(*) n, count(DISTINCT doc_id) documents FROM p GROUP BY 1, 2, 3")
def sql_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    sql.register(spark)
    return spark.sql("""
        SELECT c.rule, c.severity, c.field, count(*) AS n, count(DISTINCT r.doc_id) AS documents
        FROM {records} AS r, LATERAL invoice_checks(from_json(to_json(r.fields), 'map<string, string>'), r.line_items, r.source_text, r.reported) AS c
        GROUP BY c.rule, c.severity, c.field""", records=records(spark, sf_dir))


@query("q_sql_findings", XML_FINDINGS + "SELECT doc_id, rule, CAST(sum(n) AS BIGINT) n FROM fnd GROUP BY 1, 2")
def sql_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    sql.register(spark)
    made = einvoice.build(assemble.to_invoice(records(spark, sf_dir))).select("doc_id", "xml")
    return spark.sql("SELECT d.doc_id, f.rule, count(*) AS n FROM {documents} AS d, LATERAL einvoice_findings(d.xml) AS f GROUP BY d.doc_id, f.rule", documents=made)
