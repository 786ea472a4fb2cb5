"""Schemas of the document model, as DDL: pages have lines and regions, lines have words, blocks and tables have cells."""

BOX = "min_x double, min_y double, max_x double, max_y double"
POINT = "x double, y double"
WORD = f"text string, confidence double, {BOX}"
PAGE_KEY = "doc_id bigint, page_number int"

LINES = f"doc_id bigint, line_index bigint, text string, confidence double, {BOX}"
WORDS = f"doc_id bigint, line_index bigint, word_index int, {WORD}"
REGIONS = f"page_id bigint, region_index bigint, label string, score double, {BOX}, class_id int, order_index int"
BLOCKS = f"doc_id bigint, page_number int, block_index int, type string, block_order int, {BOX}, text string, table_html string, latex string, score double"
MATCHES = f"doc_id bigint, line_index bigint, kind string, start int, length int, value string, normalized string, confidence double, {BOX}"
FIELDS = "doc_id bigint, key_ordinal int, key string, value string"
RELATIONS = "doc_id bigint, kind string, from_page int, from_block int, to_page int, to_block int, evidence string, requires_review boolean"
CELLS = "source string, row int, col int, row_span int, col_span int, text string"
CHARACTERS = "array<struct<token:string,probability:double,first_step:int,last_step:int>>"
PDF_CHARS = "page bigint, seq bigint, value string, left double, top double, right double, bottom double, em double"
MRZ = (
    "format string, document_type string, issuing_country string, surname string, given_names string, document_number string, nationality string, birth_date date, sex string, expiry_date date, optional_data string, "
    "check_document boolean, check_birth boolean, check_expiry boolean, check_optional boolean, check_composite boolean, score int"
)
OFFICE_BLOCKS = "path string, section int, section_name string, block int, kind string, text string, row int, col int, row_span int, col_span int, formula string, error string"
CALIBRATION = "document_id bigint, pack string, split string, raw_confidence double, correct boolean"
PAIRS = "id bigint, reference string, prediction string"
