"""Fixed schemas of the layers, as (name, type) pairs and DDL text."""

from __future__ import annotations


def ddl(fields: dict[str, str]) -> str:
    return ", ".join(f"`{name}` {kind}" for name, kind in fields.items())


MANIFEST = {
    "ordinal": "long", "document_id": "string", "filename": "string", "category": "string", "title": "string",
    "citation": "string", "jurisdiction": "string", "parent_act": "string", "regulator": "string",
    "company_id": "string", "source_url": "string", "document_type": "string", "topics": "array<string>",
    "implements": "array<string>", "related_acts": "array<string>", "related_regulations": "array<string>",
    "current_to": "string", "last_amended": "string", "checksum": "string", "downloaded_at": "string",
}
BRONZE_METADATA = {
    "document_id": "string", "source_file": "string", "file_size_bytes": "long", "file_hash": "string",
    "page_count": "int", "char_count": "long", "extraction_date": "string", "extraction_method": "string",
    "fallback_reason": "string",
}
SECTION = {
    "section_id": "string", "section_number": "string", "section_type": "string", "title": "string",
    "body": "string", "level": "int", "parent_id": "string", "start_char": "int", "end_char": "int",
    "citations": "array<string>",
}
SECTION_METADATA = {
    "document_id": "string", "document_type": "string", "jurisdiction": "string", "source_file": "string",
    "processed_date": "string", "category": "string", "is_toc": "boolean", "regulator": "string",
    "parent_act": "string", "company_id": "string",
}
SILVER_JSON = {**SECTION, "metadata": "struct<" + ", ".join(f"{n}: {t}" for n, t in SECTION_METADATA.items()) + ">"}
