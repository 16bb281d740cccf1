"""Run registered queries in Spark and their SQL in DuckDB and compare whole results."""

import sys
import time

import duckdb
import pandas as pd

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def connect(folder: str):
    con = duckdb.connect()
    con.execute("set timezone='UTC'")
    for table in TABLES:
        con.execute(f"create view {table} as select * from '{folder}/{table}.parquet'")
    return con


def kind(dtype: str) -> str:
    d = dtype.lower()
    for names, k in (
        (("tinyint", "smallint", "int", "bigint", "hugeint"), "int"),
        (("float", "double"), "float"),
        (("varchar", "string"), "string"),
        (("timestamp",), "timestamp"),
    ):
        if any(d.startswith(n) for n in names):
            return k
    return d


def frame(pdf: pd.DataFrame) -> pd.DataFrame:
    pdf = pdf[sorted(pdf.columns)].copy()
    for c in pdf.columns:
        pdf[c] = pdf[c].map(lambda v: None if v is None or v is pd.NaT or v != v else str(v) if not isinstance(v, (int, float, bool)) else v)
        if len(pdf) and pdf[c].map(lambda v: isinstance(v, (int, float)) or v is None).all():
            pdf[c] = pdf[c].map(lambda v: None if v is None else float(v))
        pdf[c] = pdf[c].map(lambda v: v[:10] if isinstance(v, str) and v.endswith(" 00:00:00") else v)
        pdf[c] = pdf[c].astype(object).where(pdf[c].notna(), None)
    rows = sorted(map(repr, pdf.itertuples(index=False, name=None)))
    return rows


def compare(spark_df, con, sql: str) -> tuple[list[str], int]:
    problems = []
    rel = con.sql(sql)
    want_types = {c: kind(str(d)) for c, d in zip(rel.columns, rel.types)}
    got_types = {c: kind(d) for c, d in spark_df.dtypes}
    if want_types != got_types:
        problems.append(f"types differ: spark {got_types} sql {want_types}")
    if set(want_types) != set(got_types):
        return problems, 0
    got = frame(pd.DataFrame([r.asDict() for r in spark_df.collect()], columns=spark_df.columns))
    want = frame(pd.DataFrame(rel.fetchall(), columns=rel.columns))
    if got != want:
        only = sorted(set(got) - set(want))[:3], sorted(set(want) - set(got))[:3]
        problems.append(f"rows differ: {len(got)} / {len(want)}\n  spark {only[0]}\n  sql   {only[1]}")
    return problems, len(got)


def main() -> None:
    sys.path.insert(0, ".")
    from pyspark.sql import SparkSession

    import __spark_entry__ as entry

    folder = f"/root/testdata/{sys.argv[1]}"
    spark = (
        SparkSession.builder.master("local[8]")
        .config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.driver.memory", "12g")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(folder)
    queries, oracles = entry.queries(), entry.oracle_sql()
    for name in sys.argv[2:] or queries:
        start = time.time()
        try:
            df = queries[name](spark, folder)
            if name in oracles:
                result = compare(df, con, oracles[name])
                problems, n = result if isinstance(result, tuple) else (result, "?")
            else:
                problems, n = ["no oracle"], df.count()
        except Exception as error:  # noqa: BLE001
            problems, n = [f"{type(error).__name__}: {str(error)[:1500]}"], "?"
        print(f"{name}: {'ok' if not problems else problems[0]} rows={n} {time.time() - start:.1f}s", flush=True)
        for p in problems[1:]:
            print("   ", p)


if __name__ == "__main__":
    main()
