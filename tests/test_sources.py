import json

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from inkproof.operators import quality, requests, responses
from inkproof.sources import bucketed, files, results
from inkproof.sources.shared import shuffles_removed
from inkproof.streaming import scoring
from workload import catalog, frames


def test_scan_files(spark, tmp_path):
    contents = {"a b é.PDF": b"%PDF" * 40, "scan.tar.gz": b"\x00\xff" * 100, "note.txt": "naïve".encode()}
    for name, data in contents.items():
        (tmp_path / name).write_bytes(data)
    scanned = files.scan_files(spark, str(tmp_path))
    info = {r.name: r for r in files.file_info(scanned).collect()}
    assert set(info) == set(contents)
    assert (info["a b é.PDF"].extension, info["a b é.PDF"].is_pdf) == ("pdf", True)
    assert info["scan.tar.gz"].size_bytes == 200
    encoded = files.with_encoding(scanned).select("path", "mime_type", files.encoded_uri().alias("uri"))
    import base64

    for row in encoded.collect():
        name = row.path.rsplit("/", 1)[1]
        want = base64.b64encode(contents[name]).decode()
        assert row.uri == f"data:{row.mime_type};base64,{want}"
    assert files.scan_files(spark, str(tmp_path), glob="*.txt").count() == 1


def test_results_round_trip(spark, small, tmp_path):
    written = catalog._flow(spark, small)
    path = str(tmp_path / "results")
    results.write_results(written, path)
    again = results.scan_results(spark, path)
    assert again.count() == written.count()
    pick = ["doc_id", "mode", "confidence.overall_confidence", "evaluation.overall_score", "ocr_result.full_text"]
    assert again.select(*pick).exceptAll(written.select(*pick)).isEmpty()
    line = spark.read.text(path).where(F.contains("value", F.lit('"document_number":"INV-00000006"')))
    stored = json.loads(line.first()["value"])
    assert "document_date" in stored["extraction"] and stored["extraction"]["supplier"]["tax_id"] is None


def test_indented_result_file(spark, tmp_path):
    one = {"doc_id": 1, "confidence": {"overall_confidence": 0.87}, "extraction": {"document_number": "0324é"}}
    (tmp_path / "one.json").write_text(json.dumps(one, indent=2, ensure_ascii=False), encoding="utf-8")
    row = results.scan_results(spark, str(tmp_path), multi_line=True).first()
    assert row.confidence.overall_confidence == 0.87
    assert row.extraction.document_number == "0324é"


def test_golden_quality(spark):
    rows = [(1, "groundedness", 2.0, None), (1, "relevance", 5.0, None), (1, "coherence", 4.0, None),
            (2, "groundedness", None, "boom"), (2, "relevance", 5.0, None), (2, "coherence", None, None)]
    judge = spark.createDataFrame(rows, "doc_id int, metric string, score double, error string")
    names = requests.JUDGE_METRICS
    score = quality.overall_quality(F.lit(1.0), [F.col(m) for m in names], [F.col(f"{m}_error") for m in names])
    got = {r.doc_id: r.s for r in quality.judge_by_document(judge).select("doc_id", score.alias("s")).collect()}
    assert got[1] == 0.7777777777777777
    assert got[2] == pytest.approx((0.25 + 0.0 + 0.15) / 0.65)
    result = judge.select("metric", quality.judge_result(F.col("score")).alias("r")).where("score is not null")
    assert [r.r for r in result.collect()] == ["fail", "pass", "pass", "pass"]


def test_diagnosis(spark):
    rows = [(1.0, 5.0, 5.0, 5.0, "consistent"), (0.9, 5.0, 5.0, 5.0, "noisy_text"), (0.0, 5.0, 5.0, 5.0, "restated"),
            (1.0, 5.0, 1.0, 5.0, "misplaced"), (1.0, 5.0, 5.0, 2.0, "inconsistent"), (0.0, 2.0, None, None, "unsupported"),
            (0.87, 2.0, 5.0, 4.0, "undecided")]
    frame = spark.createDataFrame(rows, "f double, g double, r double, c double, want string")
    found = quality.diagnosis(*[F.col(c) for c in "fgrc"])
    assert all(r.got == r.want for r in frame.select("want", found.alias("got")).collect())
    own = quality.diagnosis(*[F.col(c) for c in "fgrc"], verdicts=list("abcdefg"))
    assert [r.got for r in frame.select(own.alias("got")).collect()] == list("abcdefg")


GOOD = (
    '{"document_type":"a","document_number":null,"document_date":null,"supplier":null,'
    '"customer":{"name":"x","address":null,"tax_id":null},"total_amount":{"amount":1,"currency":"USD"},"line_items":%s}'
)


def test_conformance_of_items_and_nulls(spark):
    item = '[{"description":"d","quantity":%s,"unit_price":null,"total":1.5}]'
    bodies = [
        (GOOD % "[]", []), (GOOD % item % "2", []), (GOOD % item % '"many"', ["line_items[].quantity"]),
        (GOOD % "[1,2]", ["line_items[]"]), (GOOD % "[null]", ["line_items[]"]), (GOOD % '["x"]', ["line_items[]"]),
        (GOOD % "null", ["line_items"]), (GOOD % '{"a":1}', ["line_items"]),
        ((GOOD % "[]").replace('"a"', "null", 1), ["document_type"]),
        ((GOOD % "[]").replace('"name":"x"', '"name":null'), ["customer.name"]),
        ((GOOD % "[]").replace('"amount":1', '"amount":null'), ["total_amount.amount"]),
    ]
    frame = spark.createDataFrame([(n, b) for n, (b, _) in enumerate(bodies)], "doc_id int, body string")
    checked = {r.doc_id: r for r in responses.check_conformance(frame).collect()}
    parsed = {r.doc_id: r for r in responses.parse_records(frame).collect()}
    for n, (body, wrong) in enumerate(bodies):
        assert checked[n].wrong_types == wrong and checked[n].conforms == (not wrong), body
        if parsed[n].parse_error is not None:
            assert not checked[n].conforms
    with pytest.raises(TypeError):
        responses.check_conformance(frame, T.StructType([T.StructField("d", T.DateType())]))


def test_strict_schema():
    schema = T.StructType(
        [
            T.StructField("a", T.StringType(), False),
            T.StructField("b", T.ArrayType(T.LongType(), containsNull=False)),
            T.StructField("c", T.StructType([T.StructField("d", T.BooleanType(), False)]), False),
        ]
    )
    assert json.loads(requests.strict_schema(schema)) == {
        "type": "object",
        "properties": {
            "a": {"type": "string"},
            "b": {"anyOf": [{"type": "array", "items": {"type": "integer"}}, {"type": "null"}]},
            "c": {
                "type": "object", "properties": {"d": {"type": "boolean"}}, "required": ["d"], "additionalProperties": False,
            },
        },
        "required": ["a", "b", "c"],
        "additionalProperties": False,
    }
    with pytest.raises(TypeError):
        requests.strict_schema(T.StructType([T.StructField("d", T.BinaryType())]))


def test_results_of_judge_services(spark, tmp_path):
    """Members under the metric's name and members under their own are read alike, and written results come back."""
    service = {"groundedness": 2.0, "groundedness_reason": "why", "groundedness_result": "fail", "groundedness_threshold": 3,
               "groundedness_prompt_tokens": 7, "groundedness_model": "m", "other": [1]}
    one = {"doc_id": 1, "evaluation": {"ai_metrics": {"groundedness": service, "relevance": {"error": "late"}}, "overall_score": 0.5,
           "validation_metrics": {"validations": {"total_amount": {"valid": True, "message": "m", "value": 500.0}}}}}
    (tmp_path / "one").mkdir()
    (tmp_path / "one/a.json").write_text(json.dumps(one, indent=1))
    read = results.scan_results(spark, str(tmp_path / "one"), multi_line=True)
    row = read.first().evaluation
    got = row.ai_metrics["groundedness"]
    assert (got.score, got.reason, got.result, got.threshold, got.prompt_tokens, got.model) == (2.0, "why", "fail", 3.0, 7, "m")
    assert row.ai_metrics["relevance"].score is None and row.ai_metrics["relevance"].error == "late"
    assert row.validation_metrics.validations["total_amount"].value == "500.0"
    results.write_results(read, str(tmp_path / "again"))
    assert results.scan_results(spark, str(tmp_path / "again")).first().evaluation == row


def test_flow_without_text_answers_or_judges(spark):
    from inkproof.plans.document_flow import document_results

    files = spark.createDataFrame([(n, f"in/{n}.png", 1) for n in range(1, 6)], "doc_id int, path string, size_bytes long")
    ocr = spark.createDataFrame(
        [(1, '{"pages":[{"markdown":"a x 1.00"}]}'), (2, '{"pages":[{"mark'), (4, '{"pages":[]}'), (5, "{}")], "doc_id int, body string"
    )
    answers = spark.createDataFrame(
        [(n, GOOD % "[]", "m", "r", 1, 1) for n in (1, 2, 3)] + [(4, "{", "m", "r", 1, 1)],
        "doc_id int, body string, model string, response_id string, input_tokens long, output_tokens long",
    )
    judge = spark.createDataFrame([(1, "relevance", 5.0, None)], "doc_id int, metric string, score double, error string")
    got = {r.doc_id: r for r in document_results(files, ocr, answers, judge).collect()}
    assert [got[n].error for n in range(1, 6)] == [
        None, "ocr_unreadable", "ocr_missing", "answer_unreadable", "ocr_unreadable,answer_missing"]
    assert got[1].confidence.overall_confidence > 0 and got[1].evaluation.overall_score > 0
    for n in (2, 3, 4, 5):
        assert got[n].confidence is None and got[n].evaluation is None
    assert got[2].ocr_result is None and got[4].ocr_result.pages_processed == 0
    # a record type of one's own: the default fields it hasn't got are compared as null
    own = T.StructType([T.StructField("document_number", T.StringType()), T.StructField("note", T.StringType())])
    row = {r.doc_id: r for r in document_results(files, ocr, answers, schema=own).collect()}[1]
    assert row.confidence.summary.total_fields == 5
    assert [row.confidence.fields[f].note for f in ("total_amount", "supplier_name")] == ["Field is null"] * 2
    assert row.extraction.note is None and row.evaluation is None


def test_malformed_bodies_never_fail(spark):
    bodies = [(1, "{"), (2, "[]"), (3, '{"document_type": 5, "total_amount": []}'), (4, None), (5, '"text"')]
    frame = spark.createDataFrame(bodies, "doc_id int, body string")
    parsed = {r.doc_id: r for r in responses.parse_records(frame).collect()}
    assert parsed[1].record is None and parsed[1].parse_error == "{"
    assert parsed[4].record is None
    checked = {r.doc_id: r for r in responses.check_conformance(frame).collect()}
    assert not any(checked[i].well_formed or checked[i].conforms for i in (1, 2, 4, 5))
    assert "total_amount" in checked[3].wrong_types and "document_type" in checked[3].wrong_types


def test_streaming_equals_batch(spark, small, tmp_path):
    source, sink, checkpoint = (str(tmp_path / n) for n in ("in", "out", "checkpoint"))
    docs = frames.invoices(spark, small)
    docs.repartition(3).write.parquet(source)
    stream = scoring.read_documents(spark, source, docs.schema, files_per_batch=1)
    scoring.write_available(scoring.score_stream(stream), sink, checkpoint).awaitTermination()
    got = spark.read.parquet(sink)
    want = catalog.field_scores(spark, small)
    assert got.count() == want.count()
    assert got.exceptAll(want.select(*got.columns)).isEmpty()


def _in_waves(spark, small, tmp_path, monkeypatch, query):
    """The folders that the query makes, by name; its rows are those of the flow without waves."""
    made = []

    def folder(spark, name):
        made.append(f"file://{tmp_path}/{name}-{len(made)}")
        return made[-1]

    want = sorted(map(str, catalog.document_results(spark, small).collect()))
    monkeypatch.setattr(catalog, "shared_folder", folder)
    monkeypatch.setattr(catalog, "DOCS_A_WAVE", 800)
    assert sorted(map(str, query(spark, small).collect())) == want
    paths = {p.name.split("-")[0]: p for p in tmp_path.iterdir()}
    # the last wave's only
    assert 0 < spark.read.parquet(str(paths["invoices"])).count() < 1000 < len(want)
    return paths


def test_export_in_waves(spark, small, tmp_path, monkeypatch):
    paths = _in_waves(spark, small, tmp_path, monkeypatch, catalog.result_export)
    assert {p.suffix for p in paths["results"].glob("part-*")} == {".gz"}


def test_bucketed_in_waves(spark, small, tmp_path, monkeypatch):
    paths = _in_waves(spark, small, tmp_path, monkeypatch, catalog.bucketed_results)
    for name in ("files", "texts", "answers", "judge"):
        buckets = [p.name.split("_")[1].split(".")[0] for p in paths[name].glob("part-*")]
        assert len(set(buckets)) == len(buckets) == 16, name


def test_a_key_is_in_one_wave(spark, monkeypatch):
    monkeypatch.setattr(catalog, "DOCS_A_WAVE", 7)
    keys = spark.range(-50, 50).union(spark.sql("select cast(null as bigint)"))
    for bucket, buckets in ((lambda key: bucketed.bucket_of(key, 16), 16), (catalog._slice_of, catalog._SLICES)):
        waves = catalog._waves(100, bucket, buckets)
        assert len(waves) == 15 and catalog._waves(7, bucket, buckets) == catalog._waves(0, bucket, buckets) == [None]
        within = F.array(*[F.coalesce(some(F.col("id")), F.lit(False)).cast("int") for some in waves])
        assert {sum(r[0]) for r in keys.select(within).collect()} == {1}


def test_shuffle_files_are_removed_after_the_write(spark, tmp_path):
    import time

    def shuffles():
        manager = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
        found = manager.getAllFiles()
        return {found.apply(i).getName() for i in range(found.size()) if found.apply(i).getName().startswith("shuffle_")}

    setting = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    held, before = spark.conf.get(setting), shuffles()
    with shuffles_removed(spark):
        spark.range(1000).repartition(4, "id").write.parquet(str(tmp_path / "kept"))
    for _ in range(50):
        if shuffles() <= before:
            break
        time.sleep(0.2)
    assert shuffles() <= before and spark.conf.get(setting) == held
    assert spark.read.parquet(str(tmp_path / "kept")).count() == 1000
