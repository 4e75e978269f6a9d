"""Record-level validation: every rule adds an issue and none drops a row."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sievework.functions import fixed

#: Codes that are not warnings.
ERRORS = ["email_invalid_syntax", "email_disposable_domain", "phone_unparseable", "phone_impossible", "url_unparseable", "url_missing_host", "followers_negative", "no_name", "no_contact_channel"]
INFOS = ["profile_numeric_id_only", "name_truncated", "city_unresolved", "city_resolved_to_state_only", "email_domain_website_mismatch", "zero_followers"]


def severity(code):
    return F.when(code.isin(ERRORS), "error").when(code.isin(INFOS), "info").otherwise("warning")


def _has(df: DataFrame, *fields: str):
    """Whether any of the fields that the rows have holds a value."""
    own = [F.col(f"{f}_value") for f in fields if f"{f}_value" in df.columns]
    return F.coalesce(*own).isNotNull() if own else F.lit(False)


def add_rule_codes(rows: DataFrame) -> DataFrame:
    """``rule_codes``: (field, code) of each record-level rule that a normalised row breaks, in the rules' order."""
    domain, host = F.col("email_domain"), F.col("company_domain")
    apart = domain.isNotNull() & host.isNotNull() & ~F.col("email_free") & (domain != host) & ~domain.endswith(F.concat(F.lit("."), host))
    researched = host.isNotNull() | _has(rows, "linkedin", "instagram", "youtube")
    rules = [
        ("name", "no_name", F.col("name_value").isNull()),
        ("contact", "no_contact_channel", ~_has(rows, "email", "phone", "whatsapp")),
        ("email", "email_domain_website_mismatch", apart),
        ("record", "thin_record", ~researched & (F.coalesce("followers_value", F.lit(0)) < fixed.THIN_FOLLOWERS)),
        ("followers", "zero_followers", F.col("followers_value") == 0),
        ("facebook", "unverifiable_identity", F.col("facebook_numeric") & F.col("name_placeholder")),
    ]
    # arrays of one or none, as a filter of all would be interpreted for each row with the conditions in it
    none = F.array().cast("array<struct<field:string,code:string>>")
    each = [F.when(cond, F.array(F.struct(F.lit(field).alias("field"), F.lit(code).alias("code")))).otherwise(none) for field, code, cond in rules]
    return rows.withColumn("rule_codes", F.concat(*each))


def issues(rows: DataFrame) -> DataFrame:
    """row_id, field, code, severity of every issue of rows with field_codes and rule_codes."""
    one = rows.select("row_id", F.explode(F.concat("field_codes", "rule_codes")).alias("i")).select("row_id", "i.field", "i.code")
    return one.withColumn("severity", severity(F.col("code")))
