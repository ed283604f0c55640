"""Schemas of the document-to-table flow."""

from __future__ import annotations

#: Fixed names: the text fields of an item.
ITEM_FIELDS = ["s_no", "item_code", "product_name", "description", "item_qty", "qty_unit", "unit_rate", "basic_value", "escalation", "amount", "bidding_unit", "schedule", "parent_s_no"]
ITEM_SCHEMA = "doc_id string, pass_no int, seq bigint, " + ", ".join(f"{f} string" for f in ITEM_FIELDS) + ", page_numbers array<int>, source_pos bigint"

#: Fixed names: the columns of the flat export, in order.
FLAT_COLUMNS = (
    "title tenderNo referenceNo description zone railway division status advertisedValue earnestMoney tenderDocCost periodOfCompletion validityDays closingAt publishedAt biddingStartDate pdfUrl "
    "biddingType tenderType tenderingSection contractType contractCategory expenditureType biddingStyle biddingUnit preBidRequired preBidDate jvAllowed jvMembersAllowed consortiumAllowed "
    "consortiumMembersAllowed rankingOrder signingAuthorityName signingAuthorityDesignation itemSerialNo itemCode itemDescription itemQty itemUnit itemUnitRate itemBasicValue itemAmount itemCategory "
    "itemSpecNumber itemDrawingNumber itemMakeBrand itemInspectionAgency itemWarrantyPeriod productName"
).split()

PAGE_SCHEMA = "doc_id string, page_number int, text string, char_count int, is_image_heavy boolean, width double, height double"
RAW_TABLE_SCHEMA = "doc_id string, page_number int, engine string, table_no int, cells array<array<string>>"

PDF_TYPES = ["text", "scanned", "mixed", "encrypted", "unknown"]
STATUSES = ["pending", "processing", "ocr_required", "ocr_failed", "password_required", "completed", "failed"]
#: Limits that are part of the meaning: density of a page, share of thin pages, pages of a document.
DENSE_CHARS, SCAN_RATIO, MAX_PAGES = 40, 0.55, 500
