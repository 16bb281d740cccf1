import zipfile

from pyspark.sql import functions as F

from reportlake.operators import inventory
from reportlake.sources import files, store
from reportlake.streaming import ingest


def _files(folder):
    return {str(p.relative_to(folder)) for p in folder.rglob("*.parquet")}


def test_upsert_and_delete_touch_only_their_buckets(spark, tmp_path):
    folder, schema = tmp_path / "t", "id string, v int"
    path, rows = str(folder), lambda: {r["id"]: r["v"] for r in store.read_keyed(spark, path, schema).collect()}
    assert store.read_keyed(spark, path, schema).count() == 0
    assert store.delete_keys(spark.createDataFrame([("a",)], "id string"), path, schema, "id", 8) == []
    store.upsert(spark.createDataFrame([(f"k{i}", 1) for i in range(40)], schema), path, schema, ["id"], buckets=8)
    before = _files(folder)
    new = spark.createDataFrame([("k1", 2), ("n", 2), ("n", 3)], schema)
    touched = store.upsert(new, path, schema, ["id"], "v", buckets=8)
    want = {f"k{i}": 1 for i in range(40)} | {"k1": 2, "n": 3}
    assert rows() == want and 1 <= len(touched) <= 2
    kept = {f for f in before if int(f.split("/")[0].split("=")[1]) not in touched}
    assert kept and kept <= _files(folder) and not (before - kept) & _files(folder)
    store.upsert(new, path, schema, ["id"], "v", buckets=8)
    assert rows() == want
    gone = spark.createDataFrame([(k,) for k in ("k1", "k2", "unknown")], "id string")
    middle = _files(folder)
    touched = store.delete_keys(gone, path, schema, "id", 8)
    del want["k1"], want["k2"]
    assert rows() == want
    assert {f for f in middle if int(f.split("/")[0].split("=")[1]) not in touched} <= _files(folder)
    everything = store.read_keyed(spark, path, schema).select("id")
    store.delete_keys(everything, path, schema, "id", 8)
    assert rows() == {} and _files(folder) == set()


def test_delete_appends_an_event(spark, tmp_path):
    folder, events, schema = str(tmp_path / "p"), str(tmp_path / "e"), "document_id string, chunk_id string"
    store.upsert(spark.createDataFrame([("a", "1"), ("a", "2"), ("b", "1")], schema), folder, schema, ["document_id", "chunk_id"])
    spark.sql("select 'a' as document_id, timestamp'2026-01-01' as ts, 1L as seq, 'ready' as state, cast(null as string) as stage, 2L as chunk_count").write.parquet(events)
    gone = spark.createDataFrame([("a",), ("a",)], "document_id string")
    for _ in range(2):
        store.delete_with_event(gone, folder, schema, events, F.lit("2026-01-02").cast("timestamp"))
    assert [tuple(r) for r in store.read_keyed(spark, folder, schema).collect()] == [("b", "1")]
    state = store.lifecycle_states(spark.read.parquet(events)).collect()
    assert [(r["document_id"], r["processing_status"], r["chunk_count"]) for r in state] == [("a", "deleted", 2)]


def test_point_metadata(spark):
    chunk = spark.sql("select 'd' as document_id, 'c' as chunk_id, map('source', 'x', 'k', 'v') as metadata")
    payload = F.create_map(F.lit("source"), F.lit("y"), F.lit("none"), F.lit(None).cast("string"))
    row = store.embedded_points(chunk, payload).first()
    assert row["metadata"] == {"source": "y", "k": "v"}
    assert row["point_id"] == store.embedded_points(chunk).first()["point_id"]


def test_vectors(spark):
    df = spark.createDataFrame([(0, [1.0, 0.0]), (1, [1.0]), (2, [0.0, 0.0])], "i int, vector array<double>")
    assert {r["i"]: r["issue"] for r in store.incompatible_vectors(df, 2).collect()} == {
        1: "dimension_mismatch", 2: "zero_vector"}


def test_files(spark, tmp_path):
    root = tmp_path / "in"
    (root / "tasks").mkdir(parents=True)
    (root / "tasks" / "a.pdf").write_bytes(b"%PDF-1.7 x")
    (root / "tasks" / "b.pdf").write_bytes(b"nope")
    (root / "tasks" / "c.docx").write_bytes(b"nope")

    def package(name, *members):
        with zipfile.ZipFile(root / "tasks" / name, "w") as z:
            for m in members:
                z.writestr(m, "x")

    package("d.docx", "[Content_Types].xml", "word/document.xml")
    package("e.xlsx", "[Content_Types].xml", "word/document.xml")
    package("f.xlsx", "[Content_Types].xml", "xl/workbook.xml", "xl/vbaProject.bin")
    (root / "tasks" / "g.pdf").write_bytes(b"%PDF-" + b"x" * 100)
    (root / "tasks" / "note.txt").write_bytes(b"x")
    found = files.read_files(spark, str(root))
    issues = {r["path"][-5:].lstrip("/"): r["issue"] for r in files.file_issues(found, 5000).collect()}
    assert issues["a.pdf"] is None
    names = {r["path"].rsplit("/", 1)[1]: r["issue"] for r in files.file_issues(found, 5000).collect()}
    assert names == {
        "a.pdf": None, "b.pdf": "pdf_signature_mismatch", "c.docx": "invalid_package", "d.docx": None,
        "e.xlsx": "package_content_mismatch", "f.xlsx": "active_content", "g.pdf": None}
    small = {r["path"].rsplit("/", 1)[1]: r["issue"] for r in files.file_issues(found, 50).collect()}
    assert small["g.pdf"] == "file_too_large"
    stock = files.inventory(spark, str(root))
    assert {r["domain"] for r in stock.collect()} == {"tasks"} and stock.count() == 7
    assert files.discover(spark, str(root)).count() == 5
    inspected = {r["original_filename"]: r for r in files.inspect_documents(found).collect()}
    assert inspected["e.xlsx"]["issue"] == "unsupported_extension"
    assert inspected["a.pdf"]["source_id"].startswith("doc-")
    counts = inventory.inventory_counts(stock, "domain", "format").collect()
    assert {(r["dimension"], r["value"]): r["n"] for r in counts}["format", "pdf"] == 3


def test_registry_with_byte_order_mark(spark, tmp_path):
    path = tmp_path / "provinces.csv"
    path.write_bytes("﻿MaTinh,TenTinh\n01,Hà Nội\n".encode())
    rows = files.read_registry(spark, str(path), "code string, name string").collect()
    assert [(r["code"], r["name"]) for r in rows] == [("01", "Hà Nội")]
    results = tmp_path / "r.json"
    results.write_text('{"query_id": "q", "retrieved": ["a"], "expected": ["b"]}\n')
    assert files.read_retrieval_results(spark, str(results)).first()["retrieved"] == ["a"]


def test_longest_prefix(spark):
    mapping = spark.createDataFrame([("a/", "common", "legal"), ("a/b/", "tasks", "template")],
                                    "prefix string, domain string, document_type string")
    paths = spark.createDataFrame([("a/b/x.pdf",), ("a/y.pdf",), ("z.pdf",)], "path string")
    found = {r["path"]: r["domain"] for r in inventory.classify_paths(paths, mapping).collect()}
    assert found == {"a/b/x.pdf": "tasks", "a/y.pdf": "common", "z.pdf": None}


def test_stream_ingest_survives_restarts_and_late_repeats(spark, tmp_path):
    source, table, checkpoint = (str(tmp_path / n) for n in ("in", "table", "cp"))
    schema = "checksum string, domain string, received_at timestamp"
    batches = [
        [("a", "tasks", "2026-01-01 00:00:00"), ("a", "tasks", "2026-01-01 01:00:00")],
        [("b", "tasks", "2026-01-01 02:00:00"), ("a", "common", "2026-01-01 02:00:00")],
        [("a", "tasks", "2026-01-09 00:00:00"), ("c", "tasks", "2026-01-09 00:00:00")],
    ]
    for batch in batches:
        spark.createDataFrame(batch, "checksum string, domain string, t string").select(
            "checksum", "domain", F.col("t").cast("timestamp").alias("received_at")
        ).write.mode("append").json(source)
        stream = spark.readStream.schema(schema).json(source)
        ingest.ingest(stream, table, checkpoint).awaitTermination()
    rows = sorted((r["checksum"], r["domain"]) for r in spark.read.parquet(table).collect())
    assert rows == [("a", "common"), ("a", "tasks"), ("b", "tasks"), ("c", "tasks")]


def test_lifecycle(spark):
    events = spark.sql("""select * from values ('d', 1, 1, 'uploaded', null, null), ('d', 2, 2, 'failed', 'embedding', null),
        ('d', 3, 3, 'deleted', null, null), ('e', 1, 1, 'failed', 'x', null), ('e', 2, 2, 'ready', null, 7)
        as t(document_id, ts, seq, state, stage, chunk_count)""")
    rows = {r["document_id"]: r for r in store.lifecycle_states(events).collect()}
    assert (rows["d"]["processing_status"], rows["d"]["failed_stage"]) == ("deleted", "embedding")
    assert (rows["e"]["processing_status"], rows["e"]["failed_stage"], rows["e"]["chunk_count"]) == ("ready", None, 7)


def _states(spark, source, rows):
    spark.createDataFrame(rows, "document_id string, state string, t string, seq int").select(
        "document_id", "state", F.col("t").cast("timestamp").alias("ts"), "seq").write.mode("append").json(source)
    return spark.readStream.schema("document_id string, state string, ts timestamp, seq int").json(source)


def test_state_log_is_compacted(spark, tmp_path):
    source, folder, checkpoint = (str(tmp_path / n) for n in ("in", "states", "cp"))
    assert ingest.current_states(spark, folder).count() == 0
    for n in range(9):
        stream = _states(spark, source, [("a", f"s{n}", f"2026-01-{n + 1:02d}", 1), (f"d{n}", "x", "2026-01-01", 1)])
        ingest.track_states(stream, folder, checkpoint, every=3).awaitTermination()
        found = {r["document_id"]: r["state"] for r in ingest.current_states(spark, folder).collect()}
        assert found == {"a": f"s{n}"} | {f"d{k}": "x" for k in range(n + 1)}
    assert ingest._numbered(spark, f"{folder}/base/upto") == [5, 8]
    assert ingest._numbered(spark, f"{folder}/log/batch") == [6, 7, 8]
    ingest.compact_states(spark, folder, 8)
    assert ingest.current_states(spark, folder).count() == 10


def test_ingest_starts_from_what_other_runs_stored(spark, tmp_path):
    source, table = str(tmp_path / "in"), str(tmp_path / "table")
    for n, rows in enumerate([["a", "b", "a"], ["b", "c"]]):
        spark.createDataFrame([(x, "tasks", "2026-01-01") for x in rows], "checksum string, domain string, t string").select(
            "checksum", "domain", F.col("t").cast("timestamp").alias("received_at")).write.mode("append").json(source)
        stream = spark.readStream.schema("checksum string, domain string, received_at timestamp").json(source)
        ingest.ingest(stream, table, str(tmp_path / f"cp{n}")).awaitTermination()
        assert sorted(r["checksum"] for r in spark.read.parquet(table).collect()) == (["a", "b"] if n == 0 else ["a", "b", "c"])
    assert spark.conf.get(ingest.PROVIDER) != ingest.ROCKSDB


def test_ingest_looks_up_keys_without_python_workers(spark, tmp_path):
    source, table = str(tmp_path / "in"), str(tmp_path / "table")
    schema = "checksum string, domain string, received_at timestamp"

    def run(checkpoint, *rows):
        spark.createDataFrame([(x, d, "2026-01-01") for x, d in rows], "checksum string, domain string, t string").select(
            "checksum", "domain", F.col("t").cast("timestamp").alias("received_at")).write.mode("append").json(source)
        query = ingest.ingest(spark.readStream.schema(schema).json(source), table, str(tmp_path / checkpoint))
        query.awaitTermination()
        return query.lastProgress.stateOperators[0]

    assert run("cp0", ("a", "01"), ("b", None), ("b", None)).operatorName == "dedupe"
    # A new checkpoint: keys of the other run, with a domain that looks like a number and without one.
    assert run("cp1", ("a", "01"), ("c", "01"), ("c", "01")).numRowsTotal == 3
    # A later batch: what the other run stored is known from the state.
    assert run("cp1", ("a", "01"), ("b", None), ("c", "01"), ("d", "01")).numRowsTotal == 4
    rows = spark.read.schema("checksum string, domain string").parquet(table).collect()
    assert sorted((r["checksum"], r["domain"] or "") for r in rows) == [("a", "01"), ("b", ""), ("c", "01"), ("d", "01")]
