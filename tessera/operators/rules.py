"""Rule reports over case tables: contract penalties (AG23), legal age
(AG24, JN10), inheritance shares (WN10), business names (AG22) and statutes
of limitation (JN9).

Rule tables are small literal DataFrames built from ``fixed_values`` (their
size is fixed by the parameters, so broadcasting them is safe); the case
tables are arbitrary large DataFrames.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera import fixed_values as FV


def money(c: Column) -> Column:
    """'{:,.0f} VNĐ'."""
    return F.concat(F.format_number(c, 0), F.lit(FV.CURRENCY_SUFFIX))


def penalty_report(cases: DataFrame, cap: float = FV.PENALTY_CAP) -> DataFrame:
    """AG23: value x rate/100 x days, capped at ``cap`` x value."""
    raw = F.col("contract_value") * (F.col("penalty_rate") / 100.0) * F.col("days_late")
    max_p = F.col("contract_value") * cap
    capped = raw > max_p
    return cases.withColumns({
        "penalty_amount": F.when(capped, max_p).otherwise(raw),
        "capped": capped,
        "note": F.when(capped, F.lit(FV.PENALTY_NOTE_CAPPED)).otherwise(F.lit(FV.PENALTY_NOTE_AGREED)),
    }).withColumns({
        "contract_value_text": money(F.col("contract_value")),
        "penalty_amount_text": money(F.col("penalty_amount")),
    })


def penalty_totals(report: DataFrame, party: str = "party") -> DataFrame:
    """AG23 totals per party (partial aggregation; a hot party is pre-aggregated
    map-side).  Amounts are summed as DECIMAL(38,6), so totals do not depend
    on the order in which partitions arrive."""
    return report.groupBy(party).agg(F.count(F.lit(1)).alias("n_cases"),
                                     F.count_if("capped").alias("n_capped"),
                                     F.sum(F.col("penalty_amount").cast("decimal(38,6)")).alias("total_penalty"))


def age_rules(spark: SparkSession, rules: dict | None = None) -> DataFrame:
    rules = FV.AGE_RULES if rules is None else rules
    rows = [(k, v[0], v[1], v[2], v[3], v[4]) for k, v in rules.items()]
    return spark.createDataFrame(rows, "rule_action string, min_age int, partial_age int, legal_basis string, "
                                       "partial_note string, note string")


def age_eligibility_report(persons: DataFrame, as_of_year: int, rules: dict | None = None,
                           default_action: str = FV.AGE_DEFAULT_ACTION) -> DataFrame:
    """AG24 + JN10: persons(person_id, birth_year, action_type) -> eligibility.

    Left join with the (broadcast, parameter-sized) rule table; an unknown
    action falls back to the default action's rule, whose values are literals.
    """
    rules = FV.AGE_RULES if rules is None else rules
    r = F.broadcast(age_rules(persons.sparkSession, rules))
    dflt = dict(zip(["min_age", "partial_age", "legal_basis", "partial_note", "note"], rules[default_action]))
    j = persons.join(r, persons.action_type == r.rule_action, "left")
    pick = {c: F.coalesce(F.col(c), F.lit(v)) for c, v in dflt.items()}
    age = (F.lit(as_of_year) - F.col("birth_year")).cast("int")
    eligible = F.when(age >= pick["min_age"], "yes") \
                .when((pick["partial_age"] > 0) & (age >= pick["partial_age"]), "partial").otherwise("no")
    status = F.when(eligible == "yes", F.lit(FV.AGE_STATUS_YES)) \
              .when(eligible == "partial", F.concat(F.lit(FV.AGE_STATUS_PARTIAL_PREFIX), pick["partial_note"])) \
              .otherwise(F.lit(FV.AGE_STATUS_NO))
    return j.select("person_id", "action_type", age.alias("age"), eligible.alias("eligible"),
                    status.alias("status"), pick["legal_basis"].alias("legal_basis"), pick["note"].alias("note"))


def inheritance_shares(estates: DataFrame, heirs: DataFrame) -> DataFrame:
    """WN10: equal shares among first-rank heirs; estates without heirs give an
    error row.  Heir counts come from a grouped count (partial aggregation)
    joined back, not from a window over a possibly huge estate."""
    n = heirs.groupBy("estate_id").agg(F.count(F.lit(1)).alias("num_heirs"))
    e = estates.join(n, "estate_id", "left")
    share = F.col("total_value") / F.col("num_heirs")
    ok = e.filter(F.col("num_heirs").isNotNull()).join(heirs, "estate_id").select(
        "estate_id", "heir_idx", "name", "relation", "num_heirs",
        money(F.col("total_value")).alias("total_value_text"),
        money(share).alias("share"),
        F.concat(F.format_number(F.lit(100.0) / F.col("num_heirs"), 2), F.lit("%")).alias("percentage"),
        F.when(F.col("is_minor"), F.lit(FV.INHERITANCE_MINOR_NOTE)).alias("note"),
        F.lit(None).cast("string").alias("error"))
    bad = e.filter(F.col("num_heirs").isNull()).select(
        "estate_id", F.lit(None).cast(heirs.schema["heir_idx"].dataType).alias("heir_idx"),
        F.lit(None).cast("string").alias("name"), F.lit(None).cast("string").alias("relation"),
        F.lit(0).cast("bigint").alias("num_heirs"), money(F.col("total_value")).alias("total_value_text"),
        F.lit(None).cast("string").alias("share"), F.lit(None).cast("string").alias("percentage"),
        F.lit(None).cast("string").alias("note"), F.lit(FV.INHERITANCE_NO_HEIRS).alias("error"))
    return ok.unionByName(bad)


SPECIAL_CHAR_CLASS = "[" + "".join("\\" + ch if ch in "[]\\^-" else ch for ch in FV.NAME_SPECIAL_CHARS) + "]"


def name_checks(names: DataFrame, name: str = "business_name", banned: list[str] | None = None) -> DataFrame:
    """AG22 detail: issues (banned substrings) and warnings per name."""
    banned = FV.PROHIBITED_NAME_WORDS if banned is None else banned
    low = F.lower(F.coalesce(F.col(name), F.lit("")))
    issues = F.filter(F.array(*[F.when(low.contains(w), F.lit(FV.NAME_ISSUE_TEMPLATE.format(word=w)))
                                for w in banned]), lambda x: x.isNotNull())
    nm = F.coalesce(F.col(name), F.lit(""))
    warnings = F.filter(F.array(
        F.when(F.length(nm) < FV.NAME_MIN_LENGTH, F.lit(FV.NAME_WARN_SHORT)),
        F.when(nm.rlike(SPECIAL_CHAR_CLASS), F.lit(FV.NAME_WARN_SPECIAL)),
        F.when(nm.rlike(r"^\p{Nd}"), F.lit(FV.NAME_WARN_DIGIT))), lambda x: x.isNotNull())
    out = names.withColumn("issues", issues).withColumn("warnings", warnings)
    valid = F.size("issues") == 0
    return out.withColumn("is_valid", valid).withColumn(
        "status", F.when(valid, F.lit(FV.NAME_STATUS_VALID)).otherwise(F.lit(FV.NAME_STATUS_INVALID))) \
        .withColumn("legal_basis", F.lit(FV.NAME_LEGAL_BASIS))


def name_rule_report(checked: DataFrame) -> DataFrame:
    """AG22 report: number of names failing each rule."""
    rules = F.concat(F.transform("issues", lambda x: F.concat(F.lit("issue: "), x)),
                     F.transform("warnings", lambda x: F.concat(F.lit("warning: "), x)))
    return checked.select(F.explode(rules).alias("rule")).groupBy("rule").agg(F.count(F.lit(1)).alias("n_names"))


def statutes_table(spark: SparkSession, statutes: dict | None = None) -> DataFrame:
    statutes = FV.STATUTES if statutes is None else statutes
    rows = [(k, v[0], v[1], v[2], v[3], v[4]) for k, v in statutes.items()]
    return spark.createDataFrame(rows, "st_type string, general_statute string, description string, "
                                       "start_date string, exceptions array<string>, details array<string>")


def statute_lookup(cases: DataFrame, statutes: dict | None = None) -> DataFrame:
    """JN9: broadcast left join; an unknown type yields an error row with the valid types."""
    statutes = FV.STATUTES if statutes is None else statutes
    st = statutes_table(cases.sparkSession, statutes)
    j = cases.join(F.broadcast(st), cases.case_type == st.st_type, "left")
    missing = F.col("st_type").isNull()
    err = F.when(missing, F.replace(F.lit(FV.STATUTE_ERROR_TEMPLATE), F.lit("{case_type}"), F.col("case_type")))
    return j.select(*cases.columns, "general_statute", "description", "start_date", "exceptions", "details",
                    err.alias("error"), F.when(missing, F.lit(",".join(statutes))).alias("valid_types"))
