"""Queries of names found again under other names, over keys that grow with the parts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyloom.operators import lookup
from tallyloom.plans.registry import query, table

#: What a template asks for.
FIELDS = [
    "Total Paid-up capital", "Total Paid-up capital__PY", "Total Equity & Participating Preference share capital", "Mobile No.", "Net worth", "Net worth__shares", "Name of the contact person", "Total reserves", "Tax",
]
#: Forms of keys by the number of the part modulo their count; {n} is the number.
KEYS = [
    "Total Paid-up capital", "total paidup   capital", "4.{n} Total paidup capital (Rs.)", "total paidup capital of {n}__PY", "Total equity and participating {n}", "Mobile phone {n}", "NET-worth", "net worth of {n} holders__shares",
    "total", "reserves", "contact person", "part {n}", "Tax", "Taxes of {n}", "wo", "***", "Net worth {n}__PY", "name of the contact person in {n}",
]
#: Official fields and their aliases.
ALIASES = [
    ("pan_number", ["pan", "pannumber"]), ("contact_name", ["contactname", "contactperson"]), ("mobile_number", ["mobile"]), ("equity_amount_lakhs_py", ["paidupcapitalpy"]),
]
OFFICIAL = ["pan_number", "profit_before_tax_py", "profit_before_tax_fy", "total_reserves", "net_worth_of_shares_fy", "id_no"]
PAYLOAD = [
    "FIELD_2PANNUMBER", "3.{n} Profit (+)/Loss (-) before tax PY", "3.1 Profit before TAX", "pan_number", "FIELD_NAMEOFTHECONTACTPERSON", "Reserves, total {n}", "Net worth {n}", "mobile of {n}", "Net worth 2024", "id {n} no", "Paid-up capital PY", "part {n}", "total_reserves", "contact {n}", "Pan Number", "profit tax before {n}",
]


def _values(rows: list[str]) -> str:
    return ", ".join("(" + ", ".join([str(i), "'" + r.replace("'", "''") + "'"]) + ")" for i, r in enumerate(rows))


def _keys(spark: SparkSession, sf_dir: str, forms: list[str], each: int) -> DataFrame:
    """filing_id, ord, key and value: one key for each part, some without a value."""
    n = F.col("p_partkey")
    form = F.element_at(F.array(*map(F.lit, forms)), ((n * 7 % len(forms)) + 1).cast("int"))
    key = F.replace(form, F.lit("{n}"), n.cast("string"))
    value = F.when(n % 11 == 0, "Unknown").when(n % 13 == 0, F.lit(None)).otherwise(F.concat(F.lit("v"), n.cast("string")))
    return table(spark, sf_dir, "part").select(F.floor(n / each).alias("filing_id"), n.alias("ord"), key.alias("key"), value.alias("value"))


def _keys_sql(forms: list[str], each: int) -> str:
    return f"""forms(i, form) AS (VALUES {_values(forms)}),
    k AS (SELECT p_partkey // {each} AS filing_id, p_partkey AS ord, replace(form, '{{n}}', p_partkey::VARCHAR) AS key,
      CASE WHEN p_partkey % 11 = 0 THEN 'Unknown' WHEN p_partkey % 13 = 0 THEN NULL ELSE 'v' || p_partkey END AS value FROM part JOIN forms ON i = p_partkey * 7 % {len(forms)})"""


CLEAN_SQL = "trim(regexp_replace(regexp_replace(lower({c}), '[^a-z0-9 ]', '', 'g'), ' +', ' ', 'g'))"


@query(
    "j10_field_lookup",
    f"""WITH {_keys_sql(KEYS, 40)}, f(i, field) AS (VALUES {_values(FIELDS)}),
    m AS (SELECT k.*, field, {CLEAN_SQL.format(c="key")} AS ck, {CLEAN_SQL.format(c="field")} AS cf, contains(key, '__shares') = contains(field, '__shares') AND contains(key, '__PY') = contains(field, '__PY') AS alike FROM k, f),
    t AS (SELECT *, CASE WHEN key = field THEN 1 WHEN ck = cf THEN 2
      WHEN alike AND cf = 'total paidup capital' AND contains(ck, cf) THEN 3
      WHEN alike AND cf = 'total equity participating preference share capital' AND (contains(ck, 'total equity and participating') OR contains(ck, 'total equity participating')) THEN 3
      WHEN alike AND length(cf) >= 5 AND ck NOT IN ('total', 'name', 'value', 'shares', 'class') AND (contains(ck, cf) OR contains(cf, ck) OR (contains(cf, 'mobile') AND contains(ck, 'mobile'))) THEN 4 END AS tier FROM m),
    r AS (SELECT *, row_number() OVER (PARTITION BY filing_id, field ORDER BY tier, ord) AS nth FROM t WHERE tier IS NOT NULL)
    SELECT filing_id, field, value, key, tier::INTEGER AS tier FROM r WHERE nth = 1""",
)
def j10_field_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    fields = spark.createDataFrame([(f,) for f in FIELDS], "field string")
    return lookup.lookup(_keys(spark, sf_dir, KEYS, 40), fields)


@query(
    "j18_official_fields",
    f"""WITH {_keys_sql(PAYLOAD, 25)}, o(i, field) AS (VALUES {_values(OFFICIAL)}),
    a(field, word) AS (VALUES {", ".join(f"('{f}', '{w}')" for f, ws in ALIASES for w in ws)}),
    named AS (SELECT field FROM o UNION SELECT field FROM a),
    s AS (SELECT *, regexp_replace(lower(key), '[^a-z0-9]', '', 'g') AS plain FROM k WHERE coalesce(value, '') NOT IN ('', 'Unknown', 'N/A')),
    own AS (SELECT filing_id, field, arg_max(value, ord) AS value FROM s JOIN named ON key = field GROUP BY ALL),
    p AS (SELECT filing_id, plain, min(ord) AS ord, arg_max(value, ord) AS value FROM s GROUP BY ALL),
    y AS (SELECT field, regexp_extract(field, '_(py|fy)$', 1) AS year, list_filter(string_split(regexp_replace(field, '_(py|fy)$', ''), '_'), lambda t: t NOT IN ('and', 'of', 'the', 'amount', 'lakhs', 'count', 'share', 'shares')) AS parts FROM o),
    met AS (SELECT p.*, a.field, 1 AS nth FROM p, a WHERE contains(plain, word)
      UNION ALL SELECT p.*, field, 2 FROM p, y WHERE len(parts) > 0 AND len(list_filter(parts, lambda t: NOT contains(plain, t))) = 0
        AND CASE year WHEN 'py' THEN regexp_matches(plain, 'py|previous|2024|prior') WHEN 'fy' THEN NOT regexp_matches(plain, 'py|previous|2024|prior') ELSE true END),
    b AS (SELECT *, row_number() OVER (PARTITION BY filing_id, field ORDER BY nth, ord) AS first FROM met)
    SELECT filing_id, field, value, 'own' AS way FROM own
    UNION ALL SELECT filing_id, field, value, CASE nth WHEN 1 THEN 'alias' ELSE 'parts' END FROM b WHERE first = 1 AND NOT EXISTS (SELECT 1 FROM own WHERE own.filing_id = b.filing_id AND own.field = b.field)""",
)
def j18_official_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    aliases = spark.createDataFrame(ALIASES, "field string, words array<string>")
    fields = spark.createDataFrame([(f,) for f in OFFICIAL], "field string")
    return lookup.normalise_payload(_keys(spark, sf_dir, PAYLOAD, 25), aliases, fields)
