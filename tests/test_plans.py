"""What the plans must not contain."""

from workload import catalog, frames


def _plan(frame) -> str:
    return frame._jdf.queryExecution().executedPlan().toString()


def _prepared(spark, small, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("run") / "invoices")
    frames.invoices(spark, small).write.parquet(path)
    return spark.read.parquet(path)


def test_grounding_is_row_local(spark, small, tmp_path_factory):
    from inkproof.operators import grounding

    docs = _prepared(spark, small, tmp_path_factory)
    grounded = grounding.ground(docs)
    for frame in (grounding.field_scores(grounded), grounding.doc_confidence(grounded)):
        plan = _plan(frame)
        assert "Exchange" not in plan and "Join" not in plan
        assert plan.count("ArrowEvalPython") == 1
    # only the record columns and the text are read
    assert "ocr_head" not in _plan(grounded)


def test_no_filter_takes_in_the_scoring(spark, small):
    assert len(catalog.confidence_report(spark, small)._jdf.queryExecution().optimizedPlan().toString()) < 500_000


def test_no_cross_joins_and_no_python_rows(spark, small):
    for name, query in catalog.QUERIES.items():
        plan = _plan(query(spark, small))
        assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan, name
        assert "BatchEvalPython" not in plan, name


def test_page_totals_never_collect_text(spark, small):
    plan = _plan(catalog.page_totals(spark, small))
    assert "collect_list" not in plan and "partial_sum" in plan


def test_bucketed_inputs_are_not_shuffled(spark, small):
    setting = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(setting)
    spark.conf.set(setting, "-1")
    try:
        frame = catalog.bucketed_results(spark, small)
        plan = _plan(frame)
        assert "Exchange" not in plan and plan.count("SortMergeJoin") == 3
        spark.conf.set(setting, before)
        assert sorted(map(str, frame.collect())) == sorted(map(str, catalog.document_results(spark, small).collect()))
    finally:
        spark.conf.set(setting, before)


def _optimized(frame) -> str:
    return frame._jdf.queryExecution().optimizedPlan().toString()


def test_spread_search_normalises_the_text_once(spark, small):
    assert _optimized(catalog.find_fuzzy_spread(spark, small)).count("lower(coalesce(text#") == 1


def test_checks_of_a_record_are_made_in_one_place(spark, small):
    from inkproof.functions.checks import INVALID_DATE

    # with an amount and without one
    assert _optimized(catalog.document_results(spark, small)).count(INVALID_DATE) == 2


def test_buckets_do_not_grow_with_the_table():
    from inkproof.sources.bucketed import ROWS_A_BUCKET, bucket_count

    assert bucket_count(0) == bucket_count(16 * ROWS_A_BUCKET) == 16
    assert bucket_count(16 * ROWS_A_BUCKET + 1) == 17


def test_methods_are_small_enough_to_be_compiled(spark, small, tmp_path_factory, capsys):
    import re

    from inkproof.operators import grounding, reporting

    grounded = grounding.ground(_prepared(spark, small, tmp_path_factory))
    scores = reporting.field_quality(grounding.field_scores(grounded))
    before = spark.conf.get("spark.sql.adaptive.enabled")
    # the JVM leaves methods of more than 8000 bytes uncompiled
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        for frame in (grounding.doc_confidence(grounded), scores):
            capsys.readouterr()
            frame.explain("codegen")
            sizes = [int(n) for n in re.findall(r"maxMethodCodeSize:(\d+)", capsys.readouterr().out)]
            assert sizes and max(sizes) < 8000, sizes
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", before)


def test_lines_are_not_shuffled_by_the_customer(spark, small):
    import re

    setting = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(setting)
    spark.conf.set(setting, "-1")
    try:
        plan = _plan(frames.invoices(spark, small))
    finally:
        spark.conf.set(setting, before)
    joins = re.findall(r"SortMergeJoin \[(\w+)#", plan)
    # from the top
    assert len(joins) == 4 and joins.index("o_custkey") == 1
