"""Calls are counted by the files that the clients of a test leave."""

import uuid

import pytest
from pyspark.sql import functions as F

from inkproof.operators.resume import ResponseStore, apply_resumable, request_id
from inkproof.sources import shared


def counting_client(folder, refuse=(), die=()):
    def make():
        def call(request):
            with open(f"{folder}/{uuid.uuid4().hex}", "w") as file:
                file.write(request)
            if request in refuse:
                raise ValueError(request)
            if request in die:
                raise SystemExit("lost")
            return request.upper()

        return call

    return make


def calls(folder):
    return sorted(f.read_text() for f in folder.iterdir())


def frame(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, request string")


ROWS = [(1, "a"), (2, "b"), (3, "a"), (4, None), (5, "c"), (6, "")]


def run(spark, rows, store, folder, **options):
    folder.mkdir()
    done = apply_resumable(frame(spark, rows), counting_client(folder, **options), store, waves=2, task_requests=1, attempts=2)
    return {(r.doc_id, r.response, r.error, r.sends) for r in done.collect()}


def test_second_run_sends_only_what_is_missing(spark, tmp_path):
    store = ResponseStore(spark, f"file://{tmp_path}/store")
    first = run(spark, ROWS, store, tmp_path / "1", refuse=("b", "c"))
    assert calls(tmp_path / "1") == ["", "a", "b", "c"]
    assert (2, None, "ValueError: b", 1) in first and (4, None, None, None) in first and (6, "", None, 1) in first
    second = run(spark, [*ROWS, (7, "d")], store, tmp_path / "2", refuse=("c",))
    assert calls(tmp_path / "2") == ["b", "c", "d"]
    assert {(1, "A", None, 1), (3, "A", None, 1), (2, "B", None, 2), (7, "D", None, 1), (5, None, "ValueError: c", 2)} <= second
    # no request is left: c was sent as often as allowed
    assert run(spark, ROWS, ResponseStore(spark, store.path), tmp_path / "3") == {r for r in second if r[0] != 7}
    assert calls(tmp_path / "3") == []


def test_a_lost_run_keeps_its_waves(spark, tmp_path):
    store = ResponseStore(spark, f"file://{tmp_path}/store")
    rows = [(n, f"r{n}") for n in range(40)]
    with pytest.raises(Exception):
        run(spark, rows, store, tmp_path / "1", die=[f"r{n}" for n in range(40) if n % 13 == 12])
    kept = {r.request_id for r in store.answers().where("response is not null").collect()}
    run(spark, rows, store, tmp_path / "2")
    sent = calls(tmp_path / "2")
    ids = {r.request: r.id for r in frame(spark, rows).select("request", request_id(F.col("request")).alias("id")).collect()}
    assert sorted(sent) == sorted(t for t, i in ids.items() if i not in kept)


def test_a_wave_recorded_twice_counts_once(spark, tmp_path):
    store = ResponseStore(spark, f"file://{tmp_path}/store")
    part = spark.createDataFrame([("x", "X", None, 1)], "request_id string, response string, error string, attempt int")
    for _ in range(2):
        store.append(part, "run1", 0)
    assert [tuple(r) for r in store.answers().collect()] == [("x", "X", None, "run1", 1)]


def test_no_task_writes_a_whole_wave(spark, tmp_path):
    store = ResponseStore(spark, f"file://{tmp_path}/store")
    settings = {"spark.sql.adaptive.coalescePartitions.enabled": "false", "spark.sql.shuffle.partitions": "5"}
    before = {name: spark.conf.get(name) for name in settings}
    for name, value in settings.items():
        spark.conf.set(name, value)
    try:
        run(spark, [(n, f"r{n}") for n in range(60)], store, tmp_path / "1")
    finally:
        for name, value in before.items():
            spark.conf.set(name, value)
    for wave in (0, 1):
        assert len(list(tmp_path.glob(f"store/todo/*/wave={wave}/*.parquet"))) > 1


def test_shared_folder(spark):
    one, two = (shared.shared_folder(spark, "x") for _ in range(2))
    assert one != two and one.startswith("file:")

    class Cluster:
        class sparkContext:
            master = "spark://host:7077"
            getCheckpointDir = staticmethod(lambda: None)

        class conf:
            get = staticmethod(lambda name, default: default)

    with pytest.raises(RuntimeError):
        shared.shared_folder(Cluster, "x")
