"""Where a merged value comes from: lineage rows that follow the winning source of each field.

provenance: bundle_id, source_file_id, field, ord, sheet, row, method, evidence. Rows stay rows: a field
may have any number of origins, and no list of them is built."""

from pyspark.sql import Column, DataFrame, functions as F

from reportlake.operators.bundle import CLOSING, ROLES

ORIGIN = ("source_file_id", "ord", "sheet", "row", "method", "evidence")


def source_place(role: Column, source_file_id: Column) -> Column:
    """Order of the sources of a bundle: by role, then by file; unknown roles come last."""
    order = F.array_position(F.array(*[F.lit(r) for r in ROLES]), role)
    return F.struct(F.when(order > 0, order).otherwise(len(ROLES) + 1).alias("role"), source_file_id.alias("file"))


def winning_sources(values: DataFrame) -> DataFrame:
    """(bundle_id, field, source_file_id): of several sources of one field the last in order."""
    place = source_place(F.col("role"), F.col("source_file_id"))
    return values.groupBy("bundle_id", "field").agg(F.max_by("source_file_id", place).alias("source_file_id"))


def value_provenance(standardized: DataFrame, values: DataFrame, provenance: DataFrame) -> DataFrame:
    """(bundle_id, field, term, term_no, origin columns) of every value of the standardized bundles.

    A merged field has the origins of its winning source; a closing balance those of its terms, in
    the order of the sum. A bundle without values has no lineage, a field without origins no row."""
    targets = [(f, f, 0) for f in dict.fromkeys(f for plus, minus in CLOSING.values() for f in (*plus, *minus))]
    targets += [(term, closing, n) for closing, (plus, minus) in CLOSING.items() for n, term in enumerate((*plus, *minus))]
    of: dict[str, list] = {}
    for term, field, n in targets:
        of.setdefault(term, []).append(F.struct(F.lit(field).alias("field"), F.lit(n).alias("term_no")))
    uses = F.create_map(*[x for term, fields in of.items() for x in (F.lit(term), F.array(*fields))])
    alone = F.array(F.struct(F.col("term").alias("field"), F.lit(0).alias("term_no")))
    usable = standardized.filter("report_id is not null").select("bundle_id")
    won = winning_sources(values).join(usable, "bundle_id", "left_semi")
    origins = won.join(provenance.select("bundle_id", "field", *ORIGIN), ["bundle_id", "field", "source_file_id"])
    used = origins.withColumnRenamed("field", "term").withColumn(
        "use", F.explode(F.coalesce(F.try_element_at(uses, F.col("term")), alone)))
    return used.select("bundle_id", F.col("use.field").alias("field"), "term", F.col("use.term_no").alias("term_no"), *ORIGIN)


def unknown_fields(provenance: DataFrame, values: DataFrame, key: str = "report_id") -> DataFrame:
    """(key, field, issue): provenance that names a field without a value in its report."""
    named = provenance.select(key, "field").distinct()
    return named.join(values.select(key, "field"), [key, "field"], "left_anti").withColumn(
        "issue", F.lit("PROVENANCE_UNKNOWN_FIELD"))


def long_values(standardized: DataFrame, fields: tuple[str, ...], key: str = "bundle_id") -> DataFrame:
    """(key, field, value) of the filled values of wide reports."""
    pairs = F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).cast("bigint").alias("value")) for f in fields])
    return standardized.select(key, F.explode(pairs).alias("p")).select(key, "p.*").filter("value is not null")
