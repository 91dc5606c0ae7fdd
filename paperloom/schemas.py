"""Table schemas, value domains, and the registries of sections and their fields."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

BBOX = "struct<x:int,y:int,width:int,height:int>"
DOCUMENTS = "document_id string, filename string, document_type string, status string, mime_type string, file_size bigint, storage_path string, summary string, created_at timestamp, updated_at timestamp"
PAGES = "document_id string, page_number int, image_path string, width int, height int, format string, file_size_bytes bigint"
TOKENS = "document_id string, page_number int, token_ord int, block_num int, par_num int, line_num int, left int, top int, width int, height int, conf string, text string"
BLOCKS = f"document_id string, page_number int, block_index int, text string, confidence double, bbox {BBOX}"
RESPONSES = "document_id string, stage string, item_key string, response_json string, error string"
CLASSIFICATIONS = "document_id string, raw_document_type string, document_type string, confidence double, evidence array<string>, below_threshold boolean"
SECTIONS = f"document_id string, section_ord int, section_id string, section_name string, page_number int, text string, confidence double, block_ids array<int>, bbox {BBOX}"
FIELDS = (
    "document_id string, document_type string, field_ord int, field_id string, section_id string, field_name string, field_value string, value_kind string, confidence double, source string, "
    "source_text string, section_name string, page_number int, normalized_value string, validation_status string, validation_message string, ocr_value string, ocr_confidence double, "
    "vision_value string, vision_confidence double, vision_source_text string, fallback_attempted boolean, fallback_reason string"
)
VISION = "document_id string, field_ord int, value string, confidence double, source_text string, reason string, error string"
ISSUES = "document_id string, issue_ord int, field_name string, status string, message string, code string, original_value string, normalized_value string"
ACTIONS = "document_id string, action_ord int, action_id string, action string, priority string, due_date date, status string, source string, reason string, created_at timestamp, updated_at timestamp"
LOGS = "document_id string, stage string, status string, message string, metadata string, created_at timestamp"

# Domains, sections and field names of the two document types.
DOCUMENT_TYPES = ["invoice", "onboarding_form", "unknown"]
STATUSES = ["uploaded", "preprocessing", "preprocessed", "ocr", "ocr_completed", "classified", "sectioned", "extracting", "extracted", "validating", "completed", "needs_review", "failed"]
FIELD_STATUSES = ["valid", "needs_review", "conflict"]
ACTION_PRIORITIES = ["low", "medium", "high"]
ACTION_STATUSES = ["pending", "in_progress", "completed", "dismissed"]
STAGES = ["upload", "preprocessing", "ocr", "classification", "section_detection", "extraction", "normalization", "validation", "vision_fallback", "summary", "action_extraction"]
SECTION_FIELDS = {
    ("invoice", "vendor_information"): ["vendor_name", "vendor_address", "vendor_email", "vendor_phone", "vendor_tax_id"],
    ("invoice", "customer_information"): ["customer_name", "customer_address", "customer_email", "customer_phone", "customer_tax_id"],
    ("invoice", "invoice_metadata"): ["invoice_number", "invoice_date", "due_date", "currency", "purchase_order_number"],
    ("invoice", "line_items"): ["description", "quantity", "unit_price", "tax_rate", "line_total"],
    ("invoice", "tax_information"): ["subtotal", "tax_amount", "tax_rate", "discount", "total"],
    ("invoice", "payment_information"): ["payment_method", "bank_name", "account_number", "ifsc", "payment_reference"],
    ("invoice", "notes"): ["notes"],
    ("onboarding_form", "personal_information"): ["full_name", "date_of_birth", "gender", "nationality"],
    ("onboarding_form", "contact_information"): ["email", "phone", "address", "city", "state", "postal_code"],
    ("onboarding_form", "employment_information"): ["employee_id", "designation", "department", "joining_date", "employment_type"],
    ("onboarding_form", "emergency_contact"): ["name", "relationship", "phone", "email"],
    ("onboarding_form", "identity_documents"): ["document_type", "document_number", "issue_date", "expiry_date"],
    ("onboarding_form", "bank_details"): ["account_holder_name", "bank_name", "account_number", "ifsc"],
    ("onboarding_form", "agreements"): ["agreement_type", "accepted", "date"],
    ("onboarding_form", "notes"): ["notes"],
}
#: Sections that hold a list: key of the list in the response, prefix of the fields.
LIST_SECTIONS = {"line_items": ("items", "line_item"), "identity_documents": ("documents", "id_doc"), "agreements": ("agreements", "agreement")}
NUMBER_FIELDS = ["quantity", "unit_price", "tax_rate", "line_total", "subtotal", "tax_amount", "discount", "total"]
REQUIRED_INVOICE = ["vendor_name", "invoice_number", "invoice_date", "total"]


def section_whitelist(spark: SparkSession) -> DataFrame:
    """document_type, section_name: a dimension of fifteen rows."""
    return spark.createDataFrame(list(SECTION_FIELDS), "document_type string, section_name string")
