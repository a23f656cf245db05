"""Extraction quality over tables of documents, as Spark DataFrame functions."""

from inkproof.operators.grounding import (
    Field,
    Items,
    confidence_report,
    doc_confidence,
    field_scores,
    find_values,
    ground,
    line_item_scores,
    text_similarity,
)
from inkproof.operators.json_schema import check_schema, record_type, strict_form
from inkproof.operators.pages import assemble_pages, page_totals, parse_ocr_response
from inkproof.operators.quality import diagnosis, judge_by_document, overall_quality, validate
from inkproof.operators.requests import (
    Prompts,
    apply_model,
    attach_responses,
    extraction_requests,
    judge_requests,
    ocr_requests,
)
from inkproof.operators.responses import check_conformance, parse_records
from inkproof.operators.resume import ResponseStore, apply_resumable
from inkproof.plans.document_flow import document_results

__all__ = [
    "Field",
    "Items",
    "Prompts",
    "ResponseStore",
    "apply_model",
    "apply_resumable",
    "assemble_pages",
    "attach_responses",
    "check_conformance",
    "check_schema",
    "confidence_report",
    "diagnosis",
    "doc_confidence",
    "document_results",
    "extraction_requests",
    "field_scores",
    "find_values",
    "ground",
    "judge_by_document",
    "judge_requests",
    "line_item_scores",
    "ocr_requests",
    "overall_quality",
    "page_totals",
    "parse_ocr_response",
    "parse_records",
    "record_type",
    "strict_form",
    "text_similarity",
    "validate",
]
