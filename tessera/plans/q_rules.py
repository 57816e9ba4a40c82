"""Rule-report queries over orders, line items and customers."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera import fixed_values as FV
from tessera.operators import rules
from tessera.plans.catalog import register
from tessera.plans.sqlbits import lit
from tessera.sources import tables as T

# action per market segment (MACHINERY maps to an action the rule table does not know)
SEGMENT_ACTION = {"AUTOMOBILE": "sign_contract", "BUILDING": "marriage", "FURNITURE": "work",
                  "HOUSEHOLD": "criminal_responsibility", "MACHINERY": "notarize"}
# case type per order priority ('5-LOW' maps to an unknown type)
PRIORITY_CASE = {"1-URGENT": "civil", "2-HIGH": "labor", "3-MEDIUM": "administrative",
                 "4-NOT SPECIFIED": "criminal", "5-LOW": "tax"}
AS_OF_YEAR = 2025


def _map_sql(col, mapping):
    return "CASE " + " ".join(f"WHEN {col} = '{k}' THEN '{v}'" for k, v in mapping.items()) + " END"


def _map_col(col, mapping):
    e = None
    for k, v in mapping.items():
        e = F.when(F.col(col) == k, v) if e is None else e.when(F.col(col) == k, v)
    return e


PEN_SQL = """
WITH c AS (SELECT l.l_orderkey AS order_key, l.l_linenumber AS line_number, o.o_custkey AS party,
                  o.o_totalprice AS contract_value, l.l_discount * 10 AS penalty_rate,
                  (date_diff('day', o.o_orderdate, l.l_shipdate) - 30) AS days_late
           FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey),
p AS (SELECT *, contract_value * (penalty_rate / 100.0) * days_late AS raw, contract_value * 0.12 AS mx FROM c),
r AS (SELECT *, raw > mx AS capped, CASE WHEN raw > mx THEN mx ELSE raw END AS penalty_amount FROM p)
"""


def _penalties(spark, sf):
    cases = T.penalty_cases(T.table(spark, sf, "orders"), T.table(spark, sf, "lineitem"))
    return rules.penalty_report(cases)


@register("penalty_report", sql=PEN_SQL + f"""
SELECT order_key, line_number, party, penalty_amount::DECIMAL(38, 6)::DOUBLE + 0.0 AS penalty_amount, capped,
       CASE WHEN capped THEN '{FV.PENALTY_NOTE_CAPPED}' ELSE '{FV.PENALTY_NOTE_AGREED}' END AS note,
       format('{{:,.0f}}', contract_value) || ' VNĐ' AS contract_value_text
FROM r
""")
def penalty_report(spark, sf):
    """AG23 detail: one contract case per line item."""
    r = _penalties(spark, sf)
    return r.select("order_key", "line_number", "party", (F.col("penalty_amount").cast("decimal(38,6)").cast("double") + 0.0).alias("penalty_amount"),
                    "capped", "note", "contract_value_text")


@register("penalty_totals", sql=PEN_SQL + """
SELECT party, count(*) AS n_cases, count(*) FILTER (WHERE capped) AS n_capped, sum(penalty_amount::DECIMAL(38, 6))::DOUBLE + 0.0 AS total_penalty
FROM r GROUP BY party
""")
def penalty_totals(spark, sf):
    """AG23 totals per party."""
    return rules.penalty_totals(_penalties(spark, sf)).withColumn(
        "total_penalty", F.col("total_penalty").cast("double") + 0.0)


def _persons(spark, sf):
    p = T.persons(T.table(spark, sf, "customer"))
    return p.withColumn("action_type", _map_col("segment", SEGMENT_ACTION))


def _age_sql():
    rows = " UNION ALL ".join(
        f"SELECT '{k}' AS a, {v[0]} AS min_age, {v[1]} AS partial_age, '{v[2]}' AS legal_basis, "
        f"'{v[3]}' AS partial_note, '{v[4]}' AS note" for k, v in FV.AGE_RULES.items())
    d = FV.AGE_RULES[FV.AGE_DEFAULT_ACTION]
    return f"""
WITH rules AS ({rows}),
p AS (SELECT c_custkey AS person_id, (1950 + c_custkey % 70)::INT AS birth_year,
             {_map_sql('c_mktsegment', SEGMENT_ACTION)} AS action_type FROM customer),
j AS (SELECT p.person_id, p.action_type, ({AS_OF_YEAR} - p.birth_year)::INT AS age,
             coalesce(r.min_age, {d[0]}) AS min_age, coalesce(r.partial_age, {d[1]}) AS partial_age,
             coalesce(r.legal_basis, '{d[2]}') AS legal_basis, coalesce(r.partial_note, '{d[3]}') AS partial_note,
             coalesce(r.note, '{d[4]}') AS note
      FROM p LEFT JOIN rules r ON r.a = p.action_type),
e AS (SELECT *, CASE WHEN age >= min_age THEN 'yes' WHEN partial_age > 0 AND age >= partial_age THEN 'partial' ELSE 'no' END AS eligible FROM j)
"""


@register("age_eligibility", sql=_age_sql() + f"""
SELECT person_id, action_type, age, eligible,
       CASE eligible WHEN 'yes' THEN '{FV.AGE_STATUS_YES}' WHEN 'partial' THEN '{FV.AGE_STATUS_PARTIAL_PREFIX}' || partial_note
                     ELSE '{FV.AGE_STATUS_NO}' END AS status, legal_basis, note
FROM e
""")
def age_eligibility(spark, sf):
    """AG24 + JN10 detail (as-of year 2025)."""
    return rules.age_eligibility_report(_persons(spark, sf), AS_OF_YEAR)


@register("age_eligibility_counts", sql=_age_sql() + """
SELECT action_type, eligible, count(*) AS n_persons FROM e GROUP BY 1, 2
""")
def age_eligibility_counts(spark, sf):
    """AG24 counts per action and outcome."""
    r = rules.age_eligibility_report(_persons(spark, sf), AS_OF_YEAR)
    return r.groupBy("action_type", "eligible").agg(F.count(F.lit(1)).alias("n_persons"))


@register("inheritance_shares", sql=f"""
WITH h AS (SELECT l_orderkey AS estate_id, l_linenumber AS heir_idx, 'heir-' || l_partkey AS name,
                  CASE WHEN l_linenumber = 1 THEN 'spouse' WHEN l_linenumber <= 5 THEN 'child' ELSE 'parent' END AS relation,
                  l_linenumber > 4 AS is_minor FROM lineitem),
n AS (SELECT estate_id, count(*) AS num_heirs FROM h GROUP BY 1),
e AS (SELECT o_orderkey AS estate_id, o_totalprice AS total_value, n.num_heirs
      FROM orders LEFT JOIN n ON n.estate_id = o_orderkey)
SELECT e.estate_id, h.heir_idx, h.name, h.relation, e.num_heirs,
       format('{{:,.0f}}', e.total_value) || ' VNĐ' AS total_value_text,
       format('{{:,.0f}}', e.total_value / e.num_heirs) || ' VNĐ' AS share,
       format('{{:,.2f}}', 100.0 / e.num_heirs) || '%' AS percentage,
       CASE WHEN h.is_minor THEN '{FV.INHERITANCE_MINOR_NOTE}' END AS note, NULL AS error
FROM e JOIN h USING (estate_id) WHERE e.num_heirs IS NOT NULL
UNION ALL
SELECT estate_id, NULL, NULL, NULL, 0, format('{{:,.0f}}', total_value) || ' VNĐ', NULL, NULL, NULL, '{FV.INHERITANCE_NO_HEIRS}'
FROM e WHERE num_heirs IS NULL
""")
def inheritance_shares(spark, sf):
    """WN10: orders as estates, their line items as heirs."""
    return rules.inheritance_shares(T.estates(T.table(spark, sf, "orders")), T.heirs(T.table(spark, sf, "lineitem")))


def _names(spark, sf):
    return rules.name_checks(T.business_names(T.table(spark, sf, "customer")))


_SPECIAL_SQL = rules.SPECIAL_CHAR_CLASS.replace("'", "''")


def _name_sql():
    issues = ", ".join(f"CASE WHEN contains(lower(c_name), {lit(w)}) THEN {lit(FV.NAME_ISSUE_TEMPLATE.format(word=w))} END"
                       for w in FV.PROHIBITED_NAME_WORDS)
    warns = (f"CASE WHEN length(c_name) < {FV.NAME_MIN_LENGTH} THEN '{FV.NAME_WARN_SHORT}' END, "
             f"CASE WHEN regexp_matches(c_name, '{_SPECIAL_SQL}') THEN '{FV.NAME_WARN_SPECIAL}' END, "
             f"CASE WHEN regexp_matches(c_name, '^\\p{{Nd}}') THEN '{FV.NAME_WARN_DIGIT}' END")
    return f"""
WITH n AS (SELECT c_custkey AS name_id, c_name,
                  list_filter([{issues}], lambda x: x IS NOT NULL) AS issues,
                  list_filter([{warns}], lambda x: x IS NOT NULL) AS warnings FROM customer)
"""


@register("name_checks", sql=_name_sql() + f"""
SELECT name_id, len(issues) = 0 AS is_valid,
       CASE WHEN len(issues) = 0 THEN '{FV.NAME_STATUS_VALID}' ELSE '{FV.NAME_STATUS_INVALID}' END AS status,
       array_to_string(issues, '|') AS issues, array_to_string(warnings, '|') AS warnings
FROM n
""")
def name_checks(spark, sf):
    """AG22 detail over customer names."""
    n = _names(spark, sf)
    return n.select("name_id", "is_valid", "status", F.array_join("issues", "|").alias("issues"),
                    F.array_join("warnings", "|").alias("warnings"))


@register("name_rule_report", sql=_name_sql() + """
SELECT rule, count(*) AS n_names FROM (
  SELECT unnest(list_concat(list_transform(issues, lambda x: 'issue: ' || x),
                            list_transform(warnings, lambda x: 'warning: ' || x))) AS rule FROM n)
GROUP BY rule
""")
def name_rule_report(spark, sf):
    """AG22 report: names failing each rule."""
    return rules.name_rule_report(_names(spark, sf))


def _statute_sql():
    rows = []
    for k, (g, d, s, ex, det) in FV.STATUTES.items():
        exs = "NULL" if ex is None else lit("|".join(ex))
        dets = "NULL" if det is None else lit("|".join(det))
        rows.append(f"SELECT '{k}' AS t, '{g}' AS general_statute, '{d}' AS description, '{s}' AS start_date, "
                    f"{exs} AS exceptions, {dets} AS details")
    return " UNION ALL ".join(rows)


@register("statute_lookup", sql=f"""
WITH st AS ({_statute_sql()}),
c AS (SELECT o_orderkey AS order_key, {_map_sql('o_orderpriority', PRIORITY_CASE)} AS case_type FROM orders)
SELECT c.order_key, c.case_type, st.general_statute, st.description, st.start_date, st.exceptions, st.details,
       CASE WHEN st.t IS NULL THEN replace({lit(FV.STATUTE_ERROR_TEMPLATE)}, '{{case_type}}', c.case_type) END AS error,
       CASE WHEN st.t IS NULL THEN '{",".join(FV.STATUTES)}' END AS valid_types
FROM c LEFT JOIN st ON st.t = c.case_type
""")
def statute_lookup(spark, sf):
    """JN9: one case per order, case type from the order priority."""
    o = T.table(spark, sf, "orders")
    cases = o.select(F.col("o_orderkey").alias("order_key"), _map_col("o_orderpriority", PRIORITY_CASE).alias("case_type"))
    r = rules.statute_lookup(cases)
    return r.select("order_key", "case_type", "general_statute", "description", "start_date",
                    F.array_join("exceptions", "|").alias("exceptions"), F.array_join("details", "|").alias("details"),
                    "error", "valid_types")
