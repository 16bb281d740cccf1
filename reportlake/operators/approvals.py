"""Approval of official mappings as a dimension with validity.

approvals: domain, classification, valid_from, valid_to (null bounds do not restrict)."""

from pyspark.sql import DataFrame, functions as F

from reportlake.operators.rules import WARNING
from reportlake.settings import SYNTHETIC

CODE = "UNAPPROVED_OFFICIAL_MAPPING"
# Messages of single reports and of population sources.
REPORT_MESSAGE = "Official schema mapping is not approved; extracted values require human review."
SOURCE_MESSAGE = "Nguồn không có nhãn synthetic; cần cán bộ xác nhận trước khi sử dụng."


def unapproved(files: DataFrame, key: str, approvals: DataFrame | None = None, message: str = REPORT_MESSAGE) -> DataFrame:
    """(key, code, severity, field_path, message) of files that are not synthetic and whose domain and
    classification have no approval on the file's `period_start`. Without approvals none is approved;
    a file without date or domain is not approved either."""
    official = files.filter(~F.col("classification").eqNullSafe(F.lit(SYNTHETIC)))
    if approvals is not None:
        known = approvals.select(
            F.col("domain").alias("_domain"), F.col("classification").alias("_classification"), "valid_from", "valid_to")
        day = F.col("period_start").cast("date")
        in_force = (
            (F.col("domain") == F.col("_domain")) & (F.col("classification") == F.col("_classification")) & day.isNotNull()
            & (F.col("valid_from").isNull() | (F.col("valid_from") <= day)) & (F.col("valid_to").isNull() | (F.col("valid_to") >= day)))
        official = official.join(known, in_force, "left_anti")
    return official.select(
        key, F.lit(CODE).alias("code"), F.lit(WARNING).alias("severity"), F.lit(None).cast("string").alias("field_path"),
        F.lit(message).alias("message"))
