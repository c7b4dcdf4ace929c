"""Queries of disclosures, evidence, corpora, learned rules and boards."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyloom.operators import comparison, document_tree, evidence, learning, reports
from tallyloom.operators.disclosures import disclosure_flags
from tallyloom.plans.documents import ITEMS_SQL
from tallyloom.plans.packs import rules_threshold
from tallyloom.plans.registry import ORACLES, query, table
from tallyloom.sources import corpus
from tallyloom.sources.statements import statements
from tallyloom.streaming.jobs import hourly_board

#: Sentences that a customer's report holds if its key is divisible by the number before them.
SENTENCES = [
    (2, "Opinion and basis for opinion are given with an emphasis of matter, key audit matters and other information."),
    (3, "Responsibilities of management and auditor's responsibilities, other matters, other legal and regulatory requirements and internal financial controls follow."),
    (5, "The Companies Auditor's Report Order is not applicable."), (7, "See CARO."), (4, "CIN and DIN of the director, registered office."),
    (6, "A shareholder has more than 5% of all shares."), (9, "Earnings per share is Rs. 12.40."), (8, "EPS is not given."), (10, "![seal](s.png)"), (11, "UDIN 2409."),
    (12, "Significant accounting policies and a cash flow statement."), (13, "The accounting software has an edit log throughout the year; it has not been tampered with and is preserved."),
]


APART = "\n" + "-" * 160 + "\n"
#: Sentences of which a report holds the one whose place is its key modulo their number: each phrase alone, and near misses.
PHRASES = [
    "", "An audit trail was kept.", "There is an edit log.", "The accounting software is in use.", "Recording audit trail is on.", "It operated throughout the year.", "It operated on most days and throughout.",
    "It was used throughout the year.", "The log was tampered with.", "It was not tampered.", "Records retention follows the audit trail.", "The records are preserved.",
    "The audit trail and edit log operated throughout the year, were not tampered with and are preserved.",
    "Foreign exchange of 12 lakh.", "Forex is described elsewhere.", "Related party: 7 items.", "Loan to directors was none.", "Statement as at 31st March 2024.", "Figures of 31.03.2023 are given.", "The prior year is shown.",
    "Amount required to be spent: 5.", "What is required to be spent is nothing.", "Expenditure incurred was 8.", "Shortfall at the end: 3.", f"Shortfall at the end is nil.{APART}A shortfall of 5.", "Previous year shortfall: 9.",
    "Reason for shortfall, see 2.", "Contribution towards 4 schools.", "CSR activities took place.", "A trust got 6.", "Provision is made for 7.", "A liability incurred.", "A dividend is proposed.", "Reconciliation is given.", "The promoter owns shares.",
    "c.l.f basis" + " " * 149 + "1.", "c.l.f basis" + " " * 150 + "1.", "1" + " " * 149 + "c.l.f basis.", "1" + " " * 150 + "c.l.f basis.",
]


def reports_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """filing_id, full_text and what the checks compare: a customer's report, of the sentences that its key picks."""
    c, money = F.col("c_custkey"), F.abs("c_acctbal") * 100
    picked = F.array_compact(F.array(*[F.when(c % n == 0, s) for n, s in SENTENCES]))
    phrase = F.element_at(F.array(*map(F.lit, PHRASES)), (c % len(PHRASES) + 1).cast("int"))
    filed = F.when(c % 7 == 3, F.col("c_acctbal")).when(c % 7 == 4, F.col("c_acctbal") * 1.02 + 2)
    compared = F.struct(F.lit("Turnover").alias("label"), F.col("c_acctbal").alias("stated"), filed.alias("filed"))
    return table(spark, sf_dir, "customer").select(
        c.alias("filing_id"), F.array_join(F.concat(picked, F.array(phrase)), APART).alias("full_text"), (c % 3 > 0).alias("csr_applicable"), F.array(compared).alias("comparatives"),
        F.when(c % 4 == 1, "yes").when(c % 4 == 2, "no").alias("in_format"), money.alias("stated_authorised"), F.when(c % 5 > 0, money + (c % 5) * 600).alias("registry_authorised"),
        F.when(c % 6 > 0, money).alias("stated_paid_up"), (money - (c % 7) * 400).alias("registry_paid_up"), (c % 4).alias("export_sales"), F.when(c % 11 > 0, c % 2).alias("rpt_sale_goods"),
    )


@query(
    "t_disclosures",
    """WITH c AS (SELECT c_custkey AS k, c_custkey % 39 AS p, c_acctbal AS b, abs(c_acctbal) * 100 AS m FROM customer),
    x AS (SELECT k, unnest([
      {'n': 'audit_headings', 'v': CASE WHEN k % 6 = 0 THEN 'Yes' ELSE 'No' END},
      {'n': 'caro', 'v': CASE WHEN k % 5 = 0 THEN 'Not Applicable' WHEN k % 7 = 0 THEN 'Yes' ELSE 'No' END},
      {'n': 'statement_format', 'v': CASE WHEN k % 4 = 1 THEN 'Yes' ELSE 'No' END},
      {'n': 'cin_din_address', 'v': CASE WHEN k % 4 = 0 THEN 'Yes' ELSE 'No' END},
      {'n': 'previous_year_figures', 'v': CASE WHEN k % 7 = 3 THEN 'Yes' WHEN k % 7 = 4 THEN CASE WHEN abs(b - (b * 1.02 + 2)) <= greatest(1.0, 0.01 * abs(b * 1.02 + 2)) THEN 'Yes' ELSE 'No' END
        WHEN p IN (17, 18, 19, 25) THEN 'Yes' ELSE 'No' END},
      {'n': 'five_percent_holders', 'v': CASE WHEN k % 6 = 0 THEN 'Yes' ELSE 'No' END},
      {'n': 'statutory_register', 'v': 'No'}, {'n': 'board_resolution', 'v': 'No'}, {'n': 'directors_abroad', 'v': 'No'},
      {'n': 'authorised_capital', 'v': CASE WHEN k % 5 = 0 THEN 'Missing Data' WHEN k % 5 * 600 <= greatest(1000, 0.01 * (m + k % 5 * 600)) THEN 'Yes' ELSE 'No' END},
      {'n': 'paid_up_capital', 'v': CASE WHEN k % 6 = 0 THEN 'Missing Data' WHEN k % 7 * 400 <= greatest(1000, 0.01 * abs(m - k % 7 * 400)) THEN 'Yes' ELSE 'No' END},
      {'n': 'eps', 'v': CASE WHEN k % 9 = 0 THEN 'Yes' ELSE 'No' END},
      {'n': 'signed_by_both', 'v': CASE WHEN k % 10 = 0 AND (k % 4 = 0 OR p = 16) AND (k % 3 = 0 OR k % 5 = 0) THEN 'Yes' ELSE 'No' END},
      {'n': 'udin', 'v': CASE WHEN k % 11 = 0 THEN 'Yes' ELSE 'No' END},
      {'n': 'auditor_seal', 'v': CASE WHEN k % 10 = 0 THEN 'Yes' ELSE 'No' END},
      {'n': 'related_party_sales', 'v': CASE WHEN k % 11 > 0 AND (k % 4 > 0 OR k % 2 > 0) THEN CASE WHEN k % 4 = k % 2 THEN 'Yes' ELSE 'No' END WHEN p IN (15, 16) THEN 'Yes' ELSE 'No' END},
      {'n': 'forex', 'v': CASE WHEN p IN (13, 15, 35, 37) THEN 'Yes' ELSE 'No' END},
      {'n': 'reconciliation_of_shares', 'v': CASE WHEN p = 33 THEN 'Yes' ELSE 'No' END}, {'n': 'promoter_holding', 'v': CASE WHEN p = 34 THEN 'Yes' ELSE 'No' END},
      {'n': 'accounting_policies', 'v': CASE WHEN k % 12 = 0 THEN 'Yes' ELSE 'No' END},
      {'n': 'cash_flow_statement', 'v': CASE WHEN k % 12 = 0 THEN 'Yes' ELSE 'No' END},
      {'n': 'csr_required_amount', 'v': CASE WHEN k % 3 = 0 THEN 'Not Applicable' WHEN p = 20 THEN 'Yes' ELSE 'No' END},
      {'n': 'csr_expenditure', 'v': CASE WHEN k % 3 = 0 THEN 'Not Applicable' WHEN p = 22 THEN 'Yes' ELSE 'No' END},
      {'n': 'csr_shortfall', 'v': CASE WHEN k % 3 = 0 THEN 'Not Applicable' WHEN p IN (23, 25, 26) THEN 'Yes' ELSE 'No' END},
      {'n': 'csr_previous_shortfall', 'v': CASE WHEN k % 3 = 0 THEN 'Not Applicable' WHEN p = 25 THEN 'Yes' ELSE 'No' END},
      {'n': 'csr_shortfall_reason', 'v': CASE WHEN k % 3 = 0 THEN 'Not Applicable' WHEN p = 26 THEN 'Yes' ELSE 'No' END},
      {'n': 'csr_activities', 'v': CASE WHEN k % 3 = 0 THEN 'Not Applicable' WHEN p = 27 THEN 'Yes' ELSE 'No' END},
      {'n': 'csr_trust', 'v': CASE WHEN k % 3 = 0 THEN 'Not Applicable' WHEN p = 29 THEN 'Yes' ELSE 'No' END},
      {'n': 'csr_obligation', 'v': CASE WHEN k % 3 = 0 THEN 'Not Applicable' WHEN p = 30 THEN 'Yes' ELSE 'No' END},
      {'n': 'audit_trail_software', 'v': CASE WHEN k % 13 = 0 OR p IN (1, 2, 3, 4, 10, 12) THEN 'Yes' ELSE 'No' END},
      {'n': 'audit_trail_edit_log', 'v': CASE WHEN k % 13 = 0 OR p IN (2, 4, 12) THEN 'Yes' ELSE 'No' END},
      {'n': 'audit_trail_throughout_year', 'v': CASE WHEN p IN (5, 6, 12) THEN 'Yes' ELSE 'No' END},
      {'n': 'audit_trail_tampering', 'v': CASE WHEN k % 13 = 0 OR p IN (8, 9, 12) THEN 'Yes' ELSE 'No' END},
      {'n': 'audit_trail_preservation', 'v': CASE WHEN p IN (10, 12) THEN 'Yes' ELSE 'No' END},
      {'n': 'audit_trail_verdict', 'v': CASE WHEN p = 12 THEN 'Yes' ELSE 'No' END},
      {'n': 'Details of dividend?', 'v': CASE WHEN p = 32 THEN 'Yes' ELSE 'No' END}]) AS u FROM c)
    SELECT k AS filing_id, u.n AS "check", u.v AS user_value, CASE WHEN u.v = 'Yes' THEN 'Passed' ELSE 'Failed' END AS status FROM x""",
)
def t_disclosures(spark: SparkSession, sf_dir: str) -> DataFrame:
    return disclosure_flags(reports_text(spark, sf_dir), particulars=("Details of dividend?",)).select("filing_id", "check", "user_value", "status")


def _document_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return document_tree.lines(table(spark, sf_dir, "documents").select("doc_id", "text"))


LINES_SQL = """l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(1, len(string_split(text, chr(10))) + 1))::INTEGER AS line_no FROM documents)"""
WORDS = {"insult": ["worthless", "(^|[^a-z])clown([^a-z]|$)", "idiot"], "opening": ["^the ", "^der ", "^le "], "digits": ["[0-9]{3}"]}


@query(
    "w1_keyword_hits",
    f"""WITH {LINES_SQL}, t(field, priority, p) AS (VALUES ('insult', 0, 'worthless'), ('insult', 1, '(^|[^a-z])clown([^a-z]|$)'), ('insult', 2, 'idiot'),
      ('opening', 0, '^the '), ('opening', 1, '^der '), ('opening', 2, '^le '), ('digits', 0, '[0-9]{{3}}')),
    h AS (SELECT doc_id, field, priority, line_no, row_number() OVER (PARTITION BY doc_id, field ORDER BY priority, line_no) AS nth FROM l JOIN t ON regexp_matches(lower(line), p))
    SELECT doc_id, field, priority::INTEGER AS priority, line_no FROM h WHERE nth = 1""",
)
def w1_keyword_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evidence.keyword_hits(_document_lines(spark, sf_dir), WORDS)


@query(
    "j21_supported_hits",
    f"""WITH {LINES_SQL}, m AS (SELECT *, max(contains(lower(line), 'de ')) OVER (PARTITION BY doc_id ORDER BY line_no ROWS BETWEEN 3 PRECEDING AND 1 FOLLOWING) AS supported FROM l)
    SELECT doc_id, line_no, supported FROM m WHERE contains(lower(line), 'the ')""",
)
def j21_supported_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    has = lambda words: lambda x: F.lower(x).contains(words)
    return evidence.supported(table(spark, sf_dir, "documents"), has("the "), has("de "), 3, 1).select("doc_id", "line_no", "supported")


@query(
    "j22_look_ahead",
    f"""WITH {LINES_SQL}, m AS (SELECT *, CASE WHEN regexp_matches(line, '[0-9]') THEN line END AS ok FROM l)
    SELECT doc_id, line_no, coalesce(lead(ok, 1) OVER w, lead(ok, 2) OVER w) AS ahead FROM m WINDOW w AS (PARTITION BY doc_id ORDER BY line_no)""",
)
def j22_look_ahead(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evidence.look_ahead(table(spark, sf_dir, "documents"), lambda x: x.rlike("[0-9]"), 2)


@query(
    "j23_context",
    f"""WITH {LINES_SQL}, m AS (SELECT *, last_value(CASE WHEN contains(lower(line), 'with') THEN line_no WHEN contains(line, '|') THEN -1 END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY line_no) AS opened FROM l)
    SELECT doc_id, line_no, coalesce(opened > 0 AND line_no - opened < 3, false) AS context FROM m""",
)
def j23_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evidence.in_context(table(spark, sf_dir, "documents"), lambda x: F.lower(x).contains("with"), lambda x: x.contains("|"), 3)


@query(
    "s21_classify",
    """SELECT doc_id, CASE WHEN source IN ('src1', 'src2') THEN 'board_resolution' WHEN source = 'src3' OR lang = 'de' THEN 'consent_letter' WHEN lang = 'fr' THEN 'auditor_certificate' ELSE 'generic' END AS kind FROM documents""",
)
def s21_classify(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")
    name = F.when(F.col("source") == "src1", "CTC_BM-signed.pdf").when(F.col("source") == "src3", "Consent-Letter.pdf").otherwise("scan.pdf")
    text = F.concat_ws(" ", "text", F.when(F.col("source") == "src2", "RESOLVED THAT").otherwise(F.when(F.col("lang") == "de", "We hereby give our consent").when(F.col("lang") == "fr", "To whomsoever it may concern")))
    return docs.select("doc_id", corpus.classify(name, text).alias("kind"))


@query(
    "s3_roles",
    """WITH f AS (SELECT p_partkey // 10 AS filing_id, p_partkey AS listing_no, p_partkey % 7 AS k FROM part),
    s AS (SELECT filing_id, CASE k WHEN 0 THEN 'board_report' WHEN 3 THEN 'shareholders_fdi' WHEN 4 THEN 'odi_details' WHEN 5 THEN 'extra_details' END AS role, max(listing_no) AS n FROM f WHERE k IN (0, 3, 4, 5) GROUP BY ALL),
    m AS (SELECT filing_id, listing_no, k, min(CASE WHEN k = 1 THEN 0 ELSE 1 END) OVER (PARTITION BY filing_id) AS best FROM f WHERE k IN (1, 2)),
    q AS (SELECT filing_id, listing_no, row_number() OVER (PARTITION BY filing_id ORDER BY listing_no) - 1 AS nth FROM m WHERE (best = 0 AND k = 1) OR (best = 1 AND k = 2))
    SELECT filing_id, role, n AS listing_no FROM s UNION ALL SELECT filing_id, 'financials_' || nth, listing_no FROM q""",
)
def s3_roles(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("p_partkey")
    names = F.element_at(F.array(*[F.lit(x) for x in ("Board report.pdf", "Audited notes.md", "Balance sheet.pdf", "Shareholders.xlsx", "ODI financial.xlsx", "Extra.md", "photo.png")]), (key % 7 + 1).cast("int"))
    files = table(spark, sf_dir, "part").select(F.floor(key / 10).alias("filing_id"), key.alias("listing_no"), F.concat(key.cast("string"), F.lit("/"), names).alias("path"))
    return corpus.assign_roles(files).select("filing_id", "role", F.split("path", "/")[0].cast("long").alias("listing_no"))


@query(
    "s20_template_fields",
    """WITH w AS (SELECT p_partkey // 50 AS doc_id, p_size % 5 AS page, p_partkey * 37 % 600 AS x0, p_partkey % 800 AS top, p_name AS text FROM part),
    b AS (SELECT doc_id, page, round_even(top / 8, 0) * 8 AS band, string_agg(text, ' ' ORDER BY x0, text) AS label FROM w WHERE x0 < 0.45 * 612 GROUP BY ALL)
    SELECT doc_id, label, 'field_' || regexp_replace(label, '[^a-z0-9_]', '', 'g')[:50] AS field_id, arg_min(page, (page, band))::INTEGER AS page FROM b WHERE length(label) >= 4 GROUP BY doc_id, label""",
)
def s20_template_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("p_partkey")
    words = table(spark, sf_dir, "part").select(F.floor(key / 50).alias("doc_id"), (F.col("p_size") % 5).alias("page"), F.lit(612.0).alias("page_width"), (key * 37 % 600).alias("x0"), (key % 800).alias("top"), F.col("p_name").alias("text"))
    return corpus.template_fields(words)


@query(
    "p31_predictions",
    """SELECT event_id AS doc_id, CASE WHEN event_id % 2 = 0 THEN event_type ELSE 'k' END AS key, CASE WHEN event_id % 2 = 0 THEN user_id::VARCHAR ELSE json_extract_string(props, '$.k') END AS value FROM events WHERE event_id % 5 <> 3""",
)
def p31_predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("event_id")
    wrapped = F.concat(F.lit('{"data": [{"label": "'), F.col("event_type"), F.lit('", "amount": '), F.col("user_id").cast("string"), F.lit("}]}"))
    raw = F.when(key % 5 == 3, "not json").when(key % 2 == 0, wrapped).otherwise(F.col("props"))
    return corpus.flatten_predictions(table(spark, sf_dir, "events").select(key.alias("doc_id"), raw.alias("raw")))


@query(
    "l1_alias_upsert",
    """WITH r AS (SELECT p_brand AS template, p_type AS field, p_name AS extracted_key, p_partkey AS pos FROM part),
    n AS (SELECT *, row_number() OVER (PARTITION BY template, field ORDER BY pos DESC) AS nth FROM r)
    SELECT template, field, extracted_key, pos AS "at" FROM n WHERE nth = 1 AND pos % 11 <> 0""",
)
def l1_alias_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "part").select(F.col("p_brand").alias("template"), F.col("p_type").alias("field"), F.when(F.col("p_partkey") % 11 != 0, F.col("p_name")).alias("extracted_key"), F.col("p_partkey").alias("at"))
    return learning.upsert_aliases(rows.filter("at % 2 = 0"), rows.filter("at % 2 = 1"))


@query(
    "l4_replay",
    f"""WITH {ITEMS_SQL}, r AS (SELECT doc_id, item, CASE WHEN fy % 7 < 1 THEN '(' || format('{{:,.2f}}', fy) || ')' ELSE format('{{:,.2f}}', fy) END AS this,
      CASE WHEN py IS NULL THEN '-' WHEN py % 7 < 1 THEN '(' || format('{{:,.2f}}', py) || ')' ELSE format('{{:,.2f}}', py) END AS before, y FROM items WHERE item = '2-HIGH')
    SELECT doc_id, 'high' AS rule_id, 'cell' AS node_type, CASE WHEN y % 2 = 0 THEN this ELSE before END AS text FROM r""",
)
def l4_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    step = "struct<type:string,label:string,col_index:int>"
    rules = spark.sql(f"""SELECT 'high' AS rule_id, from_json('[{{"type":"section"}},{{"type":"section"}},{{"type":"section","label":"financial"}},{{"type":"section","label":"balance"}},{{"type":"table"}},{{"type":"row","label":"2-high"}},{{"type":"cell","label":"0.00","col_index":3}}]', 'array<{step}>') AS path""")
    return learning.replay_from(statements(spark, sf_dir), rules, 7).select("doc_id", "rule_id", "node_type", "text")


@query(
    "j16_cascade_match",
    """WITH k AS (SELECT DISTINCT n_name, n_nationkey, c_custkey % 5 AS t, CASE c_custkey % 5 WHEN 0 THEN n_name WHEN 1 THEN lower(n_name) WHEN 2 THEN replace(n_name, '_', ' - ') WHEN 3 THEN 'of ' || c_custkey || ': ' || n_name || '!' ELSE 'x' || c_custkey END AS key
      FROM customer JOIN nation ON c_nationkey = n_nationkey)
    SELECT DISTINCT key, CASE WHEN t = 4 THEN 'Unknown' WHEN t = 3 AND n_nationkey > 9 THEN 'NATION_' || (n_nationkey // 10) ELSE n_name END AS field, (t + 1)::INTEGER AS tier FROM k""",
)
def j16_cascade_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    n, c = F.col("n_name"), F.col("c_custkey")
    nations = table(spark, sf_dir, "nation")
    whose = table(spark, sf_dir, "customer").join(nations, F.col("c_nationkey") == F.col("n_nationkey"))
    forms = F.when(c % 5 == 0, n).when(c % 5 == 1, F.lower(n)).when(c % 5 == 2, F.replace(n, F.lit("_"), F.lit(" - "))).when(c % 5 == 3, F.concat(F.lit("of "), c.cast("string"), F.lit(": "), n, F.lit("!"))).otherwise(F.concat(F.lit("x"), c.cast("string")))
    return comparison.cascade_match(whose.select(forms.alias("key")).distinct(), nations.select(n.alias("field"), F.col("n_nationkey").alias("ord")))


STATUS_SQL = "CASE event_type WHEN 'signup' THEN 'uploaded' WHEN 'view' THEN 'processing' WHEN 'click' THEN 'review_needed' WHEN 'purchase' THEN 'completed' WHEN 'error' THEN 'error' END"


@query(
    "a21_task_board",
    f"""WITH t AS (SELECT user_id AS company, {STATUS_SQL} AS status, ts, lead(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS done FROM events)
    SELECT company, count(*) AS n_tasks, count(*) FILTER (WHERE status = 'completed') AS n_completed, round_even(count(*) FILTER (WHERE status = 'completed') * 100 / count(*), 0)::BIGINT AS success_percent,
      round(avg((epoch_us(done) - epoch_us(ts)) / 1000000) FILTER (WHERE status = 'completed'), 3) AS mean_seconds FROM t GROUP BY 1""",
)
def a21_task_board(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.task_board(reports.tasks(spark, sf_dir))


@query("st2_hourly_board", f"SELECT date_trunc('hour', ts)::TIMESTAMP AS hour, {STATUS_SQL} AS status, count(*) AS n FROM events GROUP BY 1, 2")
def st2_hourly_board(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hourly_board(reports.tasks(spark, sf_dir))


@query("a20_review_progress", f"SELECT rule_id, count(*) AS n_flags, count(*) FILTER (WHERE status <> 'Passed') AS n_failed, round(1 - count(*) FILTER (WHERE status <> 'Passed') / count(*), 6) AS resolved FROM ({ORACLES['rules_threshold']}) GROUP BY 1")
def a20_review_progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.review_progress(rules_threshold(spark, sf_dir))


