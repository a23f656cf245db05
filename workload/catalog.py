"""The registered queries: each takes a session and a table folder and gives a frame.

Results are flat rows of scalars, so that they can be compared with SQL.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from inkproof.functions import text
from inkproof.functions.checks import amount_check, date_check
from inkproof.functions.ratio import gestalt_ratio as ratio_of
from inkproof.operators import grounding, json_schema, pages, quality, reporting, requests, responses, resume, spread
from inkproof.plans.document_flow import document_results as flow
from inkproof.sources import bucketed
from inkproof.sources import files as file_source
from inkproof.sources import results as result_store
from inkproof.sources.shared import shared_folder, shuffles_removed
from workload import frames

MODEL = "model-1"
CUSTOM_WEIGHTS = {"document_number": 3.0, "total_amount": 1.0, "supplier_name": 0.0}
QUERIES = {}


def _query(run):
    QUERIES[run.__name__] = run
    return run


def _grounded(spark: SparkSession, sf: str, **options) -> DataFrame:
    return grounding.ground(frames.invoices(spark, sf), **options)


# -- text and files -------------------------------------------------------------


@_query
def normalize_text(spark, sf):
    docs = frames.documents(spark, sf)
    return docs.select("doc_id", text.normalize(F.col("text")).alias("normalized"))


@_query
def normalize_amount(spark, sf):
    lines = frames.table(spark, sf, "lineitem").select(
        F.lit("line").alias("source"),
        F.col("l_orderkey").alias("key"),
        text.normalize_amount(F.col("l_extendedprice") * F.col("l_discount")).alias("normalized"),
    )
    kind = F.pmod("o_orderkey", F.lit(50))
    printed = (
        F.when(kind == 0, "n/a")
        .when(kind == 1, "")
        .otherwise(F.concat(F.lit("USD -"), frames.with_separator(F.col("o_totalprice"))))
    )
    orders = frames.table(spark, sf, "orders").select(
        F.lit("order").alias("source"),
        F.col("o_orderkey").alias("key"),
        text.normalize_amount_text(printed).alias("normalized"),
    )
    return lines.unionByName(orders)


@_query
def text_preview(spark, sf):
    return pages.text_summary(frames.table(spark, sf, "documents"), "text")


@_query
def file_info(spark, sf):
    return file_source.file_info(frames.page_files(spark, sf), "page_id")


@_query
def mime_type(spark, sf):
    found = frames.page_files(spark, sf)
    return found.select("page_id", text.mime_type(text.file_name(F.col("path"))).alias("mime_type"))


def _encoded(spark, sf):
    return file_source.with_encoding(frames.page_files(spark, sf))


@_query
def data_uri(spark, sf):
    return _encoded(spark, sf).select("page_id", file_source.encoded_uri().alias("data_uri"))


@_query
def route_mode(spark, sf):
    modes = F.array(F.lit("hybrid"), F.lit("text_only"), F.lit("vision_only"), F.lit(None))
    mode = F.element_at(modes, F.pmod("page_id", F.lit(4)).cast("int") + 1)
    direct = F.pmod("page_id", F.lit(2)) == 0
    return file_source.file_info(frames.page_files(spark, sf), "page_id").select(
        "page_id", requests.route(mode, F.col("is_pdf"), direct).alias("route")
    )


# -- pages ----------------------------------------------------------------------


@_query
def page_concat(spark, sf):
    turns = frames.table(spark, sf, "conversations")
    return pages.assemble_pages(turns, key="conv_id", page_no="turn", text="text")


@_query
def page_totals(spark, sf):
    return pages.page_totals(frames.table(spark, sf, "conversations"), key="conv_id", text="text")


@_query
def parse_ocr_response(spark, sf):
    lines = F.transform(
        F.split("text", "\n"), lambda line: F.struct(F.when(line != "", line).alias("markdown"))
    )
    body = F.to_json(F.struct(lines.alias("pages")))
    kind = F.pmod("doc_id", F.lit(17))
    recorded = frames.table(spark, sf, "documents").select(
        "doc_id",
        F.when(kind == 0, F.left(body, F.length(body) - 1))
        .when(kind == 1, "{}")
        .when(kind != 2, body)
        .alias("body"),
    )
    return pages.parse_ocr_response(recorded)


# -- requests and responses -------------------------------------------------------


@_query
def ocr_request(spark, sf):
    return requests.ocr_requests(_encoded(spark, sf), model=MODEL, keys=["page_id"])


def _routed_invoices(spark, sf) -> DataFrame:
    mode = F.element_at(
        F.array(F.lit("text"), F.lit("hybrid"), F.lit("direct_pdf")), F.pmod("v", F.lit(3)) + 1
    )
    encoded = text.base64_text(F.encode("ocr_text", "UTF-8"))
    return (
        frames.invoices(spark, sf)
        .withColumn("mode", mode)
        .withColumn(
            "image_uri", F.when(F.col("mode") == "hybrid", text.data_uri(F.lit("image/png"), encoded))
        )
        .withColumn(
            "file_uri",
            F.when(
                F.col("mode") == "direct_pdf",
                text.data_uri(F.lit(requests.PDF_MIME_TYPE), encoded),
            ),
        )
        .withColumn("filename", F.concat("document_number", F.lit(".pdf")))
        .withColumn("instructions", F.when(F.pmod("doc_id", F.lit(5)) == 0, "Totals only."))
    )


@_query
def extract_request(spark, sf):
    sent = requests.extraction_requests(_routed_invoices(spark, sf), model=MODEL)
    return sent.select(
        "doc_id", "mode", "model", "instructions", "schema_name", "strict", "temperature",
        F.to_json("content").alias("content"), "schema_json", "payload",
    )


def _record() -> Column:
    return F.struct(
        "document_type", "document_number", "document_date", "supplier", "customer",
        "total_amount", "line_items",
    )


@_query
def judge_request(spark, sf):
    return requests.judge_requests(_routed_invoices(spark, sf), _record())


def _answered(spark, sf) -> DataFrame:
    return frames.bodies(frames.invoices(spark, sf))


@_query
def response_attach(spark, sf):
    sent = frames.document_keys(spark, sf)
    recorded = sent.where(F.pmod("doc_id", F.lit(11)) != 0).select(
        "doc_id",
        F.concat(F.lit("resp_"), F.col("doc_id").cast("string")).alias("response_id"),
        (F.pmod("doc_id", F.lit(200)) + 50).alias("output_tokens"),
    )
    return requests.attach_responses(sent, recorded)


@_query
def model_apply(spark, sf):
    # defined in here, so that it travels to the workers with the query
    def digest_client():
        import hashlib

        def call(request: str) -> str:
            if request.split("\n")[2] == "":
                raise ValueError("supplier line is blank")
            return hashlib.sha256(request.encode()).hexdigest()

        return call

    sent = frames.invoices(spark, sf).select("doc_id", F.col("ocr_text").alias("request"))
    return requests.apply_model(sent, digest_client)


@_query
def model_resume(spark, sf):
    """Two runs over one store: the second sends what was refused by the first, and nothing else."""

    def client(busy: str):
        # defined in here, so that it travels to the workers with the query
        def make():
            import hashlib

            def call(request: str) -> str:
                digest = hashlib.sha256(request.encode()).hexdigest()
                if request.split("\n")[2] == "":
                    raise ValueError("supplier line is blank")
                if digest[0] in busy:
                    raise TimeoutError("service is busy")
                return f"{'second' if not busy else 'first'} {digest}"

            return call

        return make

    sent = frames.invoices(spark, sf).select("doc_id", F.col("ocr_text").alias("request"))
    store = resume.ResponseStore(spark, shared_folder(spark, "answers"))
    resume.apply_resumable(sent, client("0369cf"), store, waves=2, task_requests=20_000)
    done = resume.apply_resumable(sent, client(""), store, waves=2, task_requests=20_000)
    return done.select("doc_id", "response", "error", "sends")


def _item_number() -> Column:
    return (F.col("position") + 1).alias("item")


@_query
def response_parse(spark, sf):
    """Every field of every record, a row per item (one without items)."""
    recorded = _answered(spark, sf)
    parsed = responses.parse_records(
        recorded, kept=["response_id", "input_tokens", "output_tokens"]
    )
    meta = responses.response_metadata(
        F.lit(MODEL), F.col("response_id"), F.lit("hybrid"),
        F.col("input_tokens"), F.col("output_tokens"),
    )
    record = responses.with_default_currency(F.col("record"))
    listed = parsed.select("doc_id", record.alias("r"), meta.alias("m"), "parse_error").select(
        "*", F.posexplode_outer("r.line_items").alias("position", "i")
    )
    return listed.select(
        "doc_id",
        F.col("r").isNotNull().alias("has_record"),
        F.col("r.document_type").alias("document_type"),
        F.col("r.document_number").alias("document_number"),
        F.col("r.document_date").alias("document_date"),
        F.col("r.supplier.name").alias("supplier_name"),
        F.col("r.customer.name").alias("customer_name"),
        F.col("r.total_amount.amount").alias("amount"),
        F.col("r.total_amount.currency").alias("currency"),
        F.size("r.line_items").cast("bigint").alias("n_items"),
        _item_number(),
        F.col("i.description").alias("description"),
        F.col("i.quantity").alias("quantity"),
        F.col("i.unit_price").alias("unit_price"),
        F.col("i.total").alias("total"),
        F.col("m.model").alias("model"),
        F.col("m.response_id").alias("response_id"),
        F.col("m.mode").alias("mode"),
        F.col("m.usage.input_tokens").alias("input_tokens"),
        F.col("m.usage.output_tokens").alias("output_tokens"),
        "parse_error",
    )


@_query
def schema_conformance(spark, sf):
    checked = responses.check_conformance(_answered(spark, sf))
    listed = [F.array_join(c, ",").alias(c) for c in ("missing_keys", "extra_keys", "wrong_types")]
    return checked.select("doc_id", "well_formed", *listed, "conforms")


_TEXT = {"type": "string"}
_NUMBER = {"type": "number"}


def _object(required: list[str] | None = None, **properties) -> dict:
    required = list(properties) if required is None else required
    return {"type": "object", "properties": properties, "required": required, "additionalProperties": False}


def _or_null(schema: dict) -> dict:
    return {"anyOf": [schema, {"type": "null"}]}


PAYMENT = {
    **_object(
        method={"anyOf": [{"$ref": "#/$defs/Card"}, {"$ref": "#/$defs/Transfer"}, {"enum": ["cash"], "type": "string"}]},
        payer={"$ref": "#/$defs/Side"},
        payee=_or_null({"$ref": "#/$defs/Side"}),
        amounts={"type": "array", "items": {"anyOf": [_NUMBER, {"$ref": "#/$defs/Money"}]}},
    ),
    "$defs": {
        "Card": _object(type={"const": "card"}, number=_TEXT),
        "Transfer": _object(type={"const": "transfer"}, iban=_TEXT),
        "Side": _object(["name"], name=_TEXT, tax_id=_or_null(_TEXT)),
        "Money": _object(amount=_NUMBER, currency=_TEXT),
    },
}
NESTED = {
    **_object(lines=_or_null({"$ref": "#/$defs/Line"}), sum={"$ref": "#/$defs/Sum"}),
    "$defs": {
        "Line": _object(description=_TEXT, quantity=_NUMBER, next=_or_null({"$ref": "#/$defs/Line"})),
        "Sum": {"anyOf": [_NUMBER, {"$ref": "#/$defs/Pair"}]},
        "Pair": _object(left={"$ref": "#/$defs/Sum"}, right={"$ref": "#/$defs/Sum"}),
    },
}


def _checked(bodies: DataFrame, schema: dict) -> DataFrame:
    listed = [F.array_join(kind, ",").alias(kind) for kind in json_schema.KINDS]
    return json_schema.check_schema(bodies, schema).select("doc_id", "well_formed", *listed, "conforms")


@_query
def schema_union(spark, sf):
    """Bodies against a schema with shared parts and unions."""
    return _checked(frames.payments(frames.invoices(spark, sf)), PAYMENT)


@_query
def schema_recursive(spark, sf):
    """Bodies of any depth against a schema that refers to itself."""
    return _checked(frames.nested_lines(frames.invoices(spark, sf)), NESTED)


#: As a model class gives it: nothing is strict yet.
RECEIPT_SCHEMA = {
    "title": "Receipt",
    "type": "object",
    "properties": {
        "store_name": {"$ref": "#/$defs/Text"},
        "store_address": {"$ref": "#/$defs/Text"},
        "date": {"$ref": "#/$defs/Text", "description": "as printed"},
        "items": _or_null({"type": "array", "items": {"$ref": "#/$defs/Text"}}),
        "subtotal": _or_null(_NUMBER),
        "tax": {"type": ["number", "null"], "default": None},
        "total": _or_null(_NUMBER),
        "payment_method": {"$ref": "#/$defs/Text"},
    },
    "required": ["store_name", "total"],
    "$defs": {"Text": _or_null(_TEXT)},
}
RECEIPT = json_schema.record_type(json_schema.strict_form(RECEIPT_SCHEMA))


@_query
def custom_schema(spark, sf):
    """Every field of every receipt, a row per item (one without items)."""
    recorded = frames.receipts(frames.invoices(spark, sf))
    parsed = responses.parse_records(recorded, RECEIPT).select(
        "*", F.posexplode_outer("record.items").alias("position", "name")
    )
    return parsed.select(
        "doc_id",
        F.lit(responses.schema_name("Receipt")).alias("schema_name"),
        *[F.col(f"record.{f}").alias(f) for f in RECEIPT.names if f != "items"],
        F.size("record.items").cast("bigint").alias("n_items"),
        _item_number(),
        "name",
        "parse_error",
    )


# -- grounding --------------------------------------------------------------------


@_query
def text_similarity(spark, sf):
    pairs = frames.text_pairs(frames.invoices(spark, sf))
    return grounding.text_similarity(pairs, "a", "b").select("doc_id", "kind", "place", "similarity")


@_query
def gestalt_ratio(spark, sf):
    pairs = frames.text_pairs(frames.invoices(spark, sf))
    return pairs.select("doc_id", "kind", "place", ratio_of(F.col("a"), F.col("b")).alias("ratio"))


@_query
def find_exact(spark, sf):
    docs = frames.documents(spark, sf)
    last_line = F.element_at(F.split("text", "\n"), -1)
    values = F.array(
        F.struct(F.lit("last line").alias("kind"), last_line.alias("value")),
        F.struct(F.lit("origin").alias("kind"), F.concat_ws(" ", "lang", "source").alias("value")),
    )
    normal = docs.select("doc_id", text.normalize(F.col("text")).alias("t"), values.alias("vs"))
    checked = F.transform(
        "vs",
        lambda v: F.struct(
            v["kind"].alias("kind"),
            grounding.found_exactly(v["value"], text.normalize(v["value"]), F.col("t")).alias("found"),
        ),
    )
    return normal.select("doc_id", F.inline(checked))


def _raw_finds(spark, sf, threshold: float) -> DataFrame:
    names = ["document_number", "document_date", "supplier_name", "customer_name"]
    docs = frames.invoices(spark, sf).withColumn("values", F.array(*names))
    found = grounding.find_values(
        docs, "values", keys=["doc_id"], text="ocr_text", threshold=threshold
    )
    field = F.element_at(F.array(*[F.lit(n) for n in names]), F.col("position") + 1)
    return found.select("doc_id", field.alias("field"), "found", "confidence")


@_query
def find_fuzzy(spark, sf):
    return _raw_finds(spark, sf, grounding.DEFAULT_THRESHOLD)


@_query
def find_fuzzy_t07(spark, sf):
    return _raw_finds(spark, sf, grounding.LENIENT_THRESHOLD)


def _first_lines(spark, sf) -> DataFrame:
    first_line = F.element_at(F.split("text", "\n"), 1)
    return frames.documents(spark, sf).select(
        "doc_id", "text", F.array(F.translate(first_line, "e", "c")).alias("values")
    )


@_query
def find_fuzzy_documents(spark, sf):
    found = grounding.find_values(_first_lines(spark, sf), "values", keys=["doc_id"], text="text")
    return found.select("doc_id", "found", "confidence")


@_query
def find_fuzzy_spread(spark, sf):
    """The same with the words of each text dealt over all tasks."""
    found = spread.find_values_spread(_first_lines(spark, sf), "values", keys=["doc_id"], text="text", text_block=512)
    return found.select("doc_id", "found", "confidence")


@_query
def field_scores(spark, sf):
    return grounding.field_scores(_grounded(spark, sf))


@_query
def line_item_scores(spark, sf):
    return grounding.line_item_scores(_grounded(spark, sf))


@_query
def doc_confidence(spark, sf):
    return grounding.doc_confidence(_grounded(spark, sf))


@_query
def doc_confidence_weighted(spark, sf):
    return grounding.doc_confidence(_grounded(spark, sf), weights=CUSTOM_WEIGHTS)


@_query
def confidence_report(spark, sf):
    """The whole report, a row per field."""
    report = grounding.confidence_report(_grounded(spark, sf))
    # outer, as in field_scores: else a filter on the map's size takes in the whole scoring, several times over
    each = report.select("doc_id", "overall_confidence", "method", "summary", F.explode_outer("fields").alias("name", "f"))
    return each.where(F.col("name").isNotNull()).select("doc_id", "overall_confidence", "method", "name", "f.*", "summary.*")


@_query
def field_scores_text(spark, sf):
    """Amounts given as text, and a plain double above ten million."""
    kind, total = F.pmod("o_orderkey", F.lit(5)), F.col("o_totalprice")
    amount = (
        F.when(kind == 0, frames.with_separator(total))
        .when(kind == 1, F.concat(F.lit("USD -"), frames.money(total)))
        .when(kind == 2, "n/a")
        .when(kind == 3, "")
    )
    size = (F.col("o_orderkey") + 20_000_000).cast("double")
    docs = frames.table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("doc_id"),
        amount.alias("amount"),
        size.alias("size"),
        F.concat(
            F.lit("size "), (F.col("o_orderkey") + 20_000_000).cast("string"), F.lit(".0 total "),
            F.when(kind == 1, F.floor(total).cast("string")).otherwise(frames.money(total)),
        ).alias("ocr_text"),
    )
    fields = [grounding.Field("amount", "amount", is_amount=True), grounding.Field("size", "size")]
    return grounding.field_scores(grounding.ground(docs, fields=fields, items=None))


# -- validation and quality ---------------------------------------------------------


@_query
def validate_date(spark, sf):
    day = F.col("o_orderdate")
    dates = F.array(
        F.date_format(day, "yyyy-MM-dd"), F.date_format(day, "dd/MM/yyyy"),
        F.lit("2024-99-99"), F.lit(""), F.lit(None), F.date_format(day, "yyyy-M-d"),
    )
    given = F.element_at(dates, F.pmod("o_orderkey", F.lit(6)).cast("int") + 1)
    orders = frames.table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("doc_id"), date_check(given).alias("c")
    )
    return orders.select("doc_id", "c.valid", "c.message")


def _signed_total() -> Column:
    key = F.col("o_orderkey")
    return (
        F.when(F.pmod(key, F.lit(97)) == 0, float("nan"))
        .when(F.pmod(key, F.lit(89)) == 0, None)
        .when(F.pmod(key, F.lit(8)) == 7, -F.col("o_totalprice"))
        .otherwise(F.col("o_totalprice") * 100)
    )


@_query
def validate_amount(spark, sf):
    orders = frames.table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("doc_id"), amount_check(_signed_total()).alias("c")
    )
    return orders.select("doc_id", "c.valid", "c.message")


@_query
def validation_score(spark, sf):
    key, total = F.col("o_orderkey"), _signed_total()
    kind, day = F.pmod(key, F.lit(4)), F.col("o_orderdate")
    date = (
        F.when(kind == 0, "n/a")
        .when(kind == 1, F.date_format(day, "yyyy-MM-dd"))
        .when(kind == 2, F.date_format(day, "dd/MM/yyyy"))
    )
    orders = frames.table(spark, sf, "orders").select(
        key.alias("doc_id"),
        date.alias("document_date"),
        F.when(total.isNotNull(), F.struct(total.alias("amount"))).alias("total_amount"),
    )
    return quality.validate(orders)


@_query
def judge_scores(spark, sf):
    return frames.judge_rows(spark, sf).select(
        "doc_id", "metric", "score", "error", "reason", "threshold", "model", "total_tokens",
        quality.judge_result(F.col("score")).alias("result"),
        quality.judge_band(F.col("score"), F.col("error")).alias("band"),
    )


def _judged(spark, sf) -> DataFrame:
    return quality.judge_by_document(frames.judge_rows(spark, sf))


@_query
def overall_quality(spark, sf):
    kind = F.pmod("doc_id", F.lit(3))
    validation = F.when(kind == 0, 1.0).when(kind == 1, 0.5).otherwise(0.0)
    metrics = requests.JUDGE_METRICS
    score = quality.overall_quality(
        validation, [F.col(m) for m in metrics], [F.col(f"{m}_error") for m in metrics]
    )
    return _judged(spark, sf).select("doc_id", *metrics, score.alias("overall_score"))


@_query
def diagnose(spark, sf):
    matches = F.array(*[F.lit(x) for x in (1.0, 0.85, 0.0, 0.97, 0.4)])
    fuzzy = F.element_at(matches, F.pmod(F.floor(F.col("doc_id") / 5), F.lit(5)).cast("int") + 1)
    found = quality.diagnosis(fuzzy, *[F.col(m) for m in requests.JUDGE_METRICS])
    return _judged(spark, sf).select("doc_id", found.alias("diagnosis"))


# -- reports ------------------------------------------------------------------------


@_query
def mode_compare(spark, sf):
    return reporting.compare_modes(frames.mode_runs(spark, sf))


@_query
def token_usage(spark, sf):
    return reporting.token_usage(frames.mode_runs(spark, sf))


@_query
def judge_token_usage(spark, sf):
    return reporting.judge_token_usage(frames.judge_rows(spark, sf))


@_query
def field_quality(spark, sf):
    return reporting.field_quality(grounding.field_scores(_grounded(spark, sf)))


_REPORTED = ["doc_id", "document_type", "document_number", "document_date", "total_amount", "line_items"]


@_query
def report(spark, sf):
    grounded = _grounded(spark, sf, keys=_REPORTED)
    return reporting.result_rows(grounding.doc_confidence(grounded, keys=_REPORTED))


@_query
def line_item_listing(spark, sf):
    return reporting.list_items(frames.invoices(spark, sf))


@_query
def score_bands(spark, sf):
    summary = grounding.confidence_summary(F.col("comparisons"))
    scored = _grounded(spark, sf).withColumn("s", summary)
    fields = scored.select("doc_id", "s.overall_confidence", F.inline_outer("comparisons"))
    return fields.select(
        "doc_id",
        "field",
        quality.field_band(F.col("confidence")).alias("field_band"),
        quality.overall_band(F.col("overall_confidence")).alias("overall_band"),
    )


@_query
def export_json(spark, sf):
    docs = frames.invoices(spark, sf)
    return result_store.result_json(
        docs.select(
            "doc_id", "document_type", "document_number", "document_date", "supplier", "customer",
            "total_amount", "line_items",
        ),
        "doc_id",
    )


# -- everything together --------------------------------------------------------------


#: Documents that are built, and exported or laid out, at a time: what is shuffled for them doesn't grow with the tables.
DOCS_A_WAVE = 4_000_000


def _waves(documents: int, bucket: Callable[[Column], Column], buckets: int) -> list[frames.Some]:
    """Conditions on the key, each for some buckets next to each other; a key fulfils one of them.  One wave needs none."""
    many = max(1, min(buckets, -(-documents // DOCS_A_WAVE)))
    ends = [n * buckets // many for n in range(many + 1)]
    if many == 1:
        return [None]
    return [lambda key, a=a, b=b: bucket(key).between(a, b - 1) for a, b in zip(ends, ends[1:])]


_SLICES = 1 << 16


def _slice_of(key: Column) -> Column:
    """One of ``_SLICES``; by another hash than that of a shuffle, so that a slice is dealt to all its partitions."""
    return F.pmod(F.xxhash64(key.cast("bigint")), F.lit(_SLICES))


def _flow_inputs(spark, sf, answers, path: str | None = None, some: frames.Some = None) -> dict[str, DataFrame]:
    """Files, texts, answers and judge rows of all invoices; some have no text, an unreadable one, no answer, or no judge row.

    Of the orders for whose key ``some`` holds, if it is given.  Invoices are stored below ``path`` in place of what is there.
    """
    path, key = path or shared_folder(spark, "invoices"), F.col("doc_id")
    # texts and answers are both made of them
    built = frames.invoices(spark, sf, some).select(
        "doc_id", "document_number", "document_date", "supplier_name", "customer_name", "amount", "line_items", "ocr_head", "ocr_body"
    )
    with shuffles_removed(spark):
        built.write.mode("overwrite").parquet(path, compression="zstd")
    docs = spark.read.parquet(path).withColumn("ocr_text", F.concat("ocr_head", F.lit("\n"), "ocr_body"))
    orders = frames.orders(spark, sf, some).withColumn("doc_id", F.col("o_orderkey"))
    suffix = F.when(F.pmod(key, F.lit(2)) == 1, ".pdf").otherwise(".png")
    found = orders.select(
        "doc_id",
        F.concat(F.lit("in/INV-"), F.lpad(key.cast("string"), 8, "0"), suffix).alias("path"),
        F.floor(F.col("o_totalprice") * 10).alias("size_bytes"),
    )
    page = [F.struct(F.col(c).alias("markdown")) for c in ("ocr_head", "ocr_body")]
    body = F.to_json(F.struct(F.array(*page).alias("pages")))
    cut = F.when(F.pmod(key, F.lit(17)) == 1, F.left(body, F.length(body) - 1)).otherwise(body)
    ocr = docs.where(F.pmod(key, F.lit(13)) != 0).select("doc_id", cut.alias("body"))
    answered = answers(docs.where(F.pmod(key, F.lit(19)) != 2)).withColumn("model", F.lit(MODEL))
    metrics = F.explode(F.array(*[F.lit(m) for m in requests.JUDGE_METRICS]))
    judged = orders.where(F.pmod(key, F.lit(23)) != 3).select("doc_id", metrics.alias("metric"))
    late = (F.pmod(key, F.lit(7)) == 0) & (F.col("metric") == "relevance")
    judge = judged.select(
        "doc_id",
        "metric",
        F.when(~late, (F.pmod(key, F.lit(5)) + 1).cast("double")).alias("score"),
        F.when(late, "timed out").alias("error"),
        F.concat(F.lit("why "), F.col("metric")).alias("reason"),
    )
    return {"files": found, "texts": ocr, "answers": answered, "judge": judge}


def _flow(spark, sf, answers=frames.bodies, **options) -> DataFrame:
    return flow(*_flow_inputs(spark, sf, answers).values(), use_direct_pdf=True, **options)


def _field_columns(names: list[str]) -> list[Column]:
    fields = F.col("confidence.fields")
    return [
        F.try_element_at(fields, F.lit(n))[part].alias(f"{n}_{part}") for n in names for part in ("confidence", "note")
    ]


@_query
def document_results(spark, sf):
    return _result_columns(_flow(spark, sf))


def _result_columns(results: DataFrame) -> DataFrame:
    fields = [f.name for f in grounding.DEFAULT_FIELDS] + [grounding.ITEMS_FIELD]
    metrics = [
        F.try_element_at(F.col("evaluation.ai_metrics"), F.lit(m))[part].alias(f"{m}_{part}")
        for m in requests.JUDGE_METRICS
        for part in ("score", "error", "result", "reason")
    ]
    return results.select(
        "doc_id",
        "mode",
        F.col("file_info.name").alias("name"),
        F.col("file_info.size_mb").alias("size_mb"),
        F.col("ocr_result.pages_processed").alias("pages_processed"),
        F.col("ocr_result.text_length").alias("text_length"),
        F.col("ocr_result.full_text").alias("full_text"),
        F.col("extraction.document_number").alias("document_number"),
        F.col("extraction._metadata.mode").alias("recorded_mode"),
        F.col("confidence.overall_confidence").alias("overall_confidence"),
        F.col("confidence.summary.total_fields").alias("total_fields"),
        F.col("confidence.summary.high_confidence").alias("high_confidence"),
        *_field_columns(fields),
        *metrics,
        F.try_element_at(F.col("evaluation.validation_metrics.validations"), F.lit("document_date"))["value"].alias("checked_date"),
        F.col("evaluation.validation_metrics.passed_checks").alias("passed_checks"),
        F.col("evaluation.validation_metrics.total_checks").alias("total_checks"),
        F.col("evaluation.overall_score").alias("overall_score"),
        "error",
    )


@_query
def bucketed_results(spark, sf):
    """The same from inputs that are laid out by the document, with no shuffle after that."""
    documents = frames.document_keys(spark, sf).count()
    buckets, store, tables = bucketed.bucket_count(documents), shared_folder(spark, "invoices"), {}
    for some in _waves(documents, lambda key: bucketed.bucket_of(key, buckets), buckets):
        for name, frame in _flow_inputs(spark, sf, frames.bodies, store, some).items():
            path, mode = (tables[name][1], "append") if name in tables else (shared_folder(spark, name), "overwrite")
            table = f"{name}_{path.rsplit('-', 1)[1]}"
            with shuffles_removed(spark):
                laid = bucketed.write_bucketed(frame, table, path, buckets=buckets, mode=mode, compression="zstd")
            tables[name] = laid, path
    return _result_columns(flow(*[laid for laid, _ in tables.values()], use_direct_pdf=True))


@_query
def result_export(spark, sf):
    """The nested results written, scanned again, and compared as they are without the way over the files."""
    path, store = shared_folder(spark, "results"), shared_folder(spark, "invoices")
    for some in _waves(frames.document_keys(spark, sf).count(), _slice_of, _SLICES):
        results = flow(*_flow_inputs(spark, sf, frames.bodies, store, some).values(), use_direct_pdf=True)
        with shuffles_removed(spark):
            result_store.write_results(results, path, mode="append", compression="gzip")
    return _result_columns(result_store.scan_results(spark, path))


RECEIPT_FIELDS = [
    grounding.Field("store_name", "store_name"),
    grounding.Field("date", "date"),
    grounding.Field("total", "total", is_amount=True),
    grounding.Field("cashier", "cashier.name"),
]


def _receipt_answers(docs: DataFrame) -> DataFrame:
    none = F.lit(None)
    return frames.receipts(docs).select(
        "doc_id", "body", none.cast("string").alias("response_id"),
        none.cast("bigint").alias("input_tokens"), none.cast("bigint").alias("output_tokens"),
    )


@_query
def custom_flow(spark, sf):
    """The flow with records of a type and fields of the caller's own."""
    names = [f.name for f in RECEIPT_FIELDS]
    results = _flow(spark, sf, _receipt_answers, schema=RECEIPT, fields=RECEIPT_FIELDS)
    return results.select(
        "doc_id",
        F.col("extraction.store_name").alias("store_name"),
        F.col("extraction.total").alias("total"),
        F.col("confidence.overall_confidence").alias("overall_confidence"),
        *_field_columns(names),
        F.col("evaluation.validation_metrics.total_checks").alias("total_checks"),
        "error",
    )
