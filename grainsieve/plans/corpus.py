"""A knowledge base over ``documents``: each text behind a passage with planted issues.

The driver's texts hold almost none of what the detectors look for. The view is plain SQL that Spark and
DuckDB read alike; every document is in it with its whole text.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

_N = "CAST(doc_id % 9 + 2 AS STRING)"
PASSAGES = (
    "'INTERNAL NOTE: keep quiet about case 4471. The billing team handles refund requests within ' || {n} || ' business days of approval. Updated March 2024.'",
    "'TODO: add details about limits here. The finance team handles refund requests within ' || {n} || ' business days of approval. They will call you. See the FAQ page.'",
    "'Write to anna.berg@example.com or to billing@example.com. The Acme platform costs $' || {n} || '/mo for the Pro plan. Version 2.' || {n} || ' is current as of Jan 5, 2025.'",
    "'Escalate to the appropriate team if the SLA is missed. DRAFT v2 pending legal review. Customer Success Manager (CSM) will help. Q3 2023 figures apply.'",
    "'Delete the account after the customer asks. To cancel the subscription contact support. The DPO reviews all deletion requests. 2024-05-17 is the cutoff.'",
    "'Ticket JIRA-4521 was fixed in build core-1.2-rc3 during Sprint 14, see #ops-help and https://wiki.internal.example.com/a/b. The system handles all cases.'",
    "'Call +1 555-201-4477 for questions. Contact: Maria Lopez handles disputes for Europe. Step 1: open the form. Step 3: send it. As mentioned above, the team decides.'",
    "'Our support team seamlessly handles most scenarios. This is the Enterprise tier in North America. Billing manages invoice disputes and chargebacks. v3.1 of the guide.'",
    "'[TRACKED CHANGE: was 5 days] Invoices are due in ' || {n} || ' days. ~~old text~~ Last edited by Tom. VPN required for the portal. Refer to Figure 2 or refer to appendix.'",
    "'The service is available to Starter customers. It works automatically. Agents should not share this. The CRM stores every ticket. Processing takes ' || {n} || ' hours of work.'",
    "'Account number: 12345678 is on file. My bank account 555-333-4444 is listed. Remove permanently all data. Effective since June 2022 for the EU region.'",
    "'<!-- hidden --> The tool is provided as is. 1. Open it 2. Use it. Their policy is strict. Ask them. Reach out to them early. The PII and the MFA rules hold.'",
    "'Billing approves credit limit increases. Finance approves credit limit increases. The legal group reviews contract terms; Legal reviews all contract terms.'",
    "'Coming soon: a section to be defined. Image not available. The above is old. Work orders (WO) and the SSO login with the Key Performance Indicator (KPI) board.'",
    "'Acme costs $' || {n} || '.50 per seat, refunds take ' || {n} || ' weeks of review time here. Those are final. The department can cancel your plan.'",
    "'A plain passage about shipping, returns and warranty terms for every customer. Nothing is planted here but words about delivery and delivery windows.'",
)
HEADINGS = ("Billing refunds", "Refund policy", "Notes", "Escalation paths", "Account deletion", "Misc", "Contact", "Overview", "Invoice terms", "Ticket system", "Data", "Section 4", "Credit limits", "", "Pricing", "Shipping and returns")


def _case(values: list[str]) -> str:
    return "CASE doc_id % 16 " + " ".join(f"WHEN {i} THEN {v}" for i, v in enumerate(values)) + " ELSE '' END"


TABLES = """'<table><tr><th>Region</th><th>Code</th><th>Hours</th></tr><tr><td>Asia</td><td>E' || {n} || '</td><td>-</td></tr><tr><td>Europe</td><td>E7</td><td>9 to ' || {n} || '</td></tr></table>'"""
STEPS = "'<ol><li>Open the <b>form</b></li><li>Wait ' || {n} || ' days</li></ol>'"
FIGURE = "'<p>[Figure 2: Refund workflow]</p><p>As shown, the workflow has 4 stages. It ends there.</p>'"

KB_SQL = f"""
SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 'Acme - Guide' ELSE 'guide to things' END AS title, {_case([f"'{h}'" for h in HEADINGS])} AS heading,
  {_case([p.format(n=_N) for p in PASSAGES])} || ' ' || text AS content,
  CASE WHEN doc_id % 5 = 0 THEN NULL WHEN doc_id % 5 = 1 THEN '2025-0' || {_N.replace('9 + 2', '9 + 1')} || '-11T08:00:00' WHEN doc_id % 5 = 2 THEN '2023-11-02' WHEN doc_id % 5 = 3 THEN 'unknown' ELSE '2024-12-31' END AS last_modified,
  CASE WHEN doc_id % 4 = 0 THEN 'Ann' ELSE 'Bob' END AS author
FROM documents WHERE text IS NOT NULL"""

HTML_SQL = f"""
SELECT doc_id, heading, CASE WHEN heading = '' THEN '' ELSE '<h2>' || heading || '</h2>' END || '<p>' || content || '</p>'
  || CASE doc_id % 3 WHEN 0 THEN '<h3>Regional <b>codes</b></h3>' || {TABLES.format(n=_N)} WHEN 1 THEN '<h2>Error handling</h2>' || {STEPS.format(n=_N)} ELSE {FIGURE} END AS html
FROM kb"""


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The table; where it has fewer splits than there are cores, as a small file does, its rows are dealt out first."""
    docs, cores = spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.sparkContext.defaultParallelism
    return docs if len(docs.inputFiles()) >= cores or docs.rdd.getNumPartitions() > 2 * cores else docs.repartition(2 * cores)


def kb(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, title, heading, content, last_modified, author."""
    documents(spark, sf_dir).createOrReplaceTempView("documents")
    return spark.sql(KB_SQL)


def kb_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, heading, html."""
    kb(spark, sf_dir).createOrReplaceTempView("kb")
    return spark.sql(HTML_SQL)
