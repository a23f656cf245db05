"""Request rows for the OCR, extraction and judge services, and their responses.

The services are remote; what Spark keeps are the rows sent and received.
Instructions and wrappings are parameters, the defaults below are only a start.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator, Mapping, Sequence
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from inkproof.functions.text import data_uri
from inkproof.operators.json_schema import strict_form
from inkproof.operators.record import DEFAULT_RECORD

# --- fixed values ------------------------------------------------------------
MODE_TEXT = "text"
MODE_HYBRID = "hybrid"
MODE_DIRECT_PDF = "direct_pdf"
RECORDED_MODE = {MODE_HYBRID: "hybrid_ocr_vision", MODE_DIRECT_PDF: "direct_pdf"}
JUDGE_METRICS = ["groundedness", "relevance", "coherence"]
CONTEXT_FREE_METRIC = "coherence"
PDF_MIME_TYPE = "application/pdf"
DEFAULT_SCHEMA_NAME = "document_extraction"
# -----------------------------------------------------------------------------


@dataclass(frozen=True)
class Prompts:
    """Instructions per mode, the text put around a document, and the judge query."""

    text: str = "Fill the schema from the document text; leave out what is not stated."
    hybrid: str = "Fill the schema from the image; the text only helps reading it."
    direct_pdf: str = "Fill the schema from the attached file; leave out what is not stated."
    before_text: str = "Text of the document:\n"
    after_text: str = "\nEnd of the text."
    file_task: str = "Fill the schema from the file."
    judge_query: str = "Fill the schema from the document."
    direct_pdf_context: str = "(the file was read by the model itself)"


DEFAULT_PROMPTS = Prompts()


def route(mode: Column, is_pdf: Column, use_direct_pdf: Column) -> Column:
    """direct_pdf only for PDF files that ask for it; else hybrid by name; else text."""
    return (
        F.when(F.coalesce(use_direct_pdf & is_pdf, F.lit(False)), MODE_DIRECT_PDF)
        .when(mode == MODE_HYBRID, MODE_HYBRID)
        .otherwise(MODE_TEXT)
    )


def ocr_requests(
    files: DataFrame,
    *,
    model: str,
    keys: Sequence[str] = ("doc_id",),
    mime: str = "mime_type",
    encoded: str = "base64",
    include_images: bool = False,
) -> DataFrame:
    """PDF types travel as document_url, everything else as image_url."""
    kind = F.when(F.contains(F.col(mime), F.lit("pdf")), "document_url").otherwise("image_url")
    rows = files.select(
        *keys,
        F.lit(model).alias("model"),
        kind.alias("document_type"),
        data_uri(F.col(mime), F.col(encoded)).alias("document_url"),
        F.lit(include_images).alias("include_image_base64"),
    )

    def address(name: str) -> Column:
        return F.when(F.col("document_type") == name, F.col("document_url")).alias(name)

    payload = F.struct(
        "model",
        F.struct(
            F.col("document_type").alias("type"), address("document_url"), address("image_url")
        ).alias("document"),
        "include_image_base64",
    )
    return rows.withColumn("payload", F.to_json(payload))


def extraction_requests(
    docs: DataFrame,
    *,
    model: str,
    keys: Sequence[str] = ("doc_id",),
    mode: str = "mode",
    text: str = "ocr_text",
    image_uri: str = "image_uri",
    file_uri: str = "file_uri",
    filename: str = "filename",
    instructions: str = "instructions",
    schema: T.StructType | Mapping = DEFAULT_RECORD,
    schema_name: str = DEFAULT_SCHEMA_NAME,
    prompts: Prompts = DEFAULT_PROMPTS,
) -> DataFrame:
    """One request per document; the parts and their order depend on its mode.

    text: optional image, then the text; hybrid: image, then the text;
    direct_pdf: the file, then the task.  ``instructions`` may be null per row.  ``schema`` is a record type or a JSON
    schema, which is sent in its strict form.  ``payload`` is the whole request as JSON.
    """

    def part(kind: str, **content: Column) -> Column:
        names = ("image_url", "text", "filename", "file_data")
        return F.struct(
            F.lit(kind).alias("type"),
            *[content.get(n, F.lit(None).cast("string")).alias(n) for n in names],
        )

    wrapped = F.concat(F.lit(prompts.before_text), F.col(text), F.lit(prompts.after_text))
    image = part("input_image", image_url=F.col(image_uri))
    document = part("input_text", text=wrapped)
    file = part("input_file", filename=F.col(filename), file_data=F.col(file_uri))
    task = part("input_text", text=F.lit(prompts.file_task))
    content = (
        F.when(F.col(mode) == MODE_DIRECT_PDF, F.array(file, task))
        .when((F.col(mode) == MODE_HYBRID) | (F.col(image_uri) != ""), F.array(image, document))
        .otherwise(F.array(document))
    )
    default = (
        F.when(F.col(mode) == MODE_HYBRID, prompts.hybrid)
        .when(F.col(mode) == MODE_DIRECT_PDF, prompts.direct_pdf)
        .otherwise(prompts.text)
    )
    strict = strict_form(schema) if isinstance(schema, Mapping) else None
    schema_json = json.dumps(strict, separators=(",", ":"), ensure_ascii=False) if strict else strict_schema(schema)
    rows = docs.select(
        *keys,
        F.col(mode).alias("mode"),
        F.lit(model).alias("model"),
        F.coalesce(F.col(instructions), default).alias("instructions"),
        content.alias("content"),
        F.lit(schema_name).alias("schema_name"),
        F.lit(schema_json).alias("schema_json"),
        F.lit(True).alias("strict"),
        F.lit(0).alias("temperature"),
    )

    def quoted(value: Column) -> Column:
        listed = F.to_json(F.array(value))
        return F.substring(listed, F.lit(2), F.length(listed) - 2)

    payload = [
        F.lit('{"model":'), quoted(F.col("model")), F.lit(',"instructions":'), quoted(F.col("instructions")),
        F.lit(',"input":[{"role":"user","content":'), F.to_json("content"),
        F.lit('}],"text":{"format":{"type":"json_schema","name":'), quoted(F.col("schema_name")),
        F.lit(f',"schema":{schema_json},"strict":true}}}},"temperature":0}}'),
    ]
    return rows.withColumn("payload", F.concat(*payload))


_JSON_TYPES = [
    (T.StringType, "string"),
    (T.BooleanType, "boolean"),
    (T.IntegralType, "integer"),
    (T.FractionalType, "number"),
]


def strict_schema(schema: T.DataType) -> str:
    """The JSON schema of a record type in strict form: every key required, no other allowed, null only where declared."""
    return json.dumps(_schema_of(schema), separators=(",", ":"), ensure_ascii=False)


def _schema_of(kind: T.DataType, nullable: bool = False) -> dict:
    if nullable:
        return {"anyOf": [_schema_of(kind), {"type": "null"}]}
    if isinstance(kind, T.StructType):
        return {
            "type": "object",
            "properties": {f.name: _schema_of(f.dataType, f.nullable) for f in kind.fields},
            "required": kind.names,
            "additionalProperties": False,
        }
    if isinstance(kind, T.ArrayType):
        return {"type": "array", "items": _schema_of(kind.elementType, kind.containsNull)}
    for spark_type, name in _JSON_TYPES:
        if isinstance(kind, spark_type):
            return {"type": name}
    raise TypeError(f"JSON has no {kind.simpleString()}")


def judge_requests(
    docs: DataFrame,
    record: Column,
    *,
    keys: Sequence[str] = ("doc_id",),
    mode: str = "mode",
    text: str = "ocr_text",
    prompts: Prompts = DEFAULT_PROMPTS,
) -> DataFrame:
    """Three rows per document: query, context (none for coherence), and the record as JSON."""
    context = F.when(F.col(mode) == MODE_DIRECT_PDF, prompts.direct_pdf_context).otherwise(F.col(text))
    return docs.select(
        *keys,
        F.explode(F.array(*[F.lit(m) for m in JUDGE_METRICS])).alias("metric"),
        context.alias("_context"),
        F.to_json(record, {"ignoreNullFields": "false"}).alias("response"),
    ).select(
        *keys,
        "metric",
        F.lit(prompts.judge_query).alias("query"),
        F.when(F.col("metric") != CONTEXT_FREE_METRIC, F.col("_context")).alias("context"),
        "response",
    )


def apply_model(
    requests: DataFrame,
    make_client: Callable[[], Callable[[str], str]],
    *,
    keys: Sequence[str] = ("doc_id",),
    request: str = "request",
) -> DataFrame:
    """Run a user function over request rows: ``keys``, ``response``, ``error``.

    ``make_client`` runs once per task and returns the function to call; a call
    that raises fills ``error`` of its own row and never fails the job.
    """
    columns = [*keys, request]

    def call_batches(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        client = make_client()

        def call(text):
            try:
                return client(text), None
            except Exception as failure:
                return None, f"{type(failure).__name__}: {failure}"

        for batch in batches:
            results = [call(text) for text in batch[request]]
            out = batch[list(keys)].copy()
            out["response"] = [r for r, _ in results]
            out["error"] = [e for _, e in results]
            yield out

    source = requests.select(*columns)
    schema = T.StructType(
        [source.schema[k] for k in keys]
        + [T.StructField("response", T.StringType()), T.StructField("error", T.StringType())]
    )
    return source.mapInPandas(call_batches, schema)


def attach_responses(
    requests: DataFrame, responses: DataFrame, keys: Sequence[str] = ("doc_id",)
) -> DataFrame:
    """Recorded responses next to their requests; a request without one keeps nulls."""
    return requests.join(responses, list(keys), "left")
