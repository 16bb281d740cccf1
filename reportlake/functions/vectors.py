"""Vector columns (array<float> or array<double>); arithmetic in double."""

from pyspark.sql import Column, functions as F


def _double(vector: Column) -> Column:
    return vector.cast("array<double>")


def squared_norm(vector: Column) -> Column:
    return F.aggregate(_double(vector), F.lit(0.0), lambda total, x: total + x * x)


def dot(left: Column, right: Column) -> Column:
    products = F.zip_with(_double(left), _double(right), lambda x, y: x * y)
    return F.aggregate(products, F.lit(0.0), lambda total, x: total + x)


def l2_normalize(vector: Column) -> Column:
    """Unit vector; null for the zero vector, which the caller reports as an issue."""
    values = _double(vector)
    return F.aggregate(
        values,
        F.lit(0.0),
        lambda total, x: total + x * x,
        lambda total: F.when(total > 0, F.transform(values, lambda x: x / F.sqrt(total))),
    )


def vector_issue(vector: Column, dimension: Column | None = None) -> Column:
    """First reason why a vector may not be stored, else null."""
    finite = F.forall(
        _double(vector), lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    )
    issue = (
        F.when(vector.isNull(), F.lit("missing_vector"))
        .when(F.size(vector) == 0, F.lit("empty_vector"))
        .when(~finite, F.lit("non_finite_value"))
    )
    if dimension is not None:
        issue = issue.when(F.size(vector) != dimension, F.lit("dimension_mismatch"))
    return issue.when(squared_norm(vector) == 0, F.lit("zero_vector"))
