"""Fixed values that must equal the source application's for equal results.

Everything in the first block is stated verbatim, in its natural order. The regex
classes further down are ours; they spell out Python's notion of whitespace and line
breaks so both Spark (Java regex) and DuckDB (RE2) apply one and the same rule.
"""

from __future__ import annotations

# ---------------------------------------------------------------------------
# FIXED VALUES (must match the source application)
# ---------------------------------------------------------------------------

# Balancing-authority respondent codes, in declaration order.
REGION_CODES = ["CISO", "ERCO", "PJM", "NYIS", "ISNE", "MISO", "SWPP"]

# Colloquial ISO name -> respondent code (applied after upper-casing).
NAME_TO_CODE = {
    "CAISO": "CISO",
    "ERCOT": "ERCO",
    "NYISO": "NYIS",
    "ISO-NE": "ISNE",
    "ISONE": "ISNE",
    "SPP": "SWPP",
}

# Region-data series labels.
SERIES_LABELS = {"D": "demand_mwh", "NG": "net_generation_mwh", "TI": "total_interchange_mwh"}

# Region-data type facet.
REGION_TYPES = ["D", "NG", "TI"]

# Rows per landed API page.
PAGE_LIMIT = 5000

# Token windows: size and overlap (step = size - overlap).
CHUNK_TOKENS = 800
OVERLAP_TOKENS = 100

# Retrieved chunks per question.
DEFAULT_K = 5

# Embedding width of the source application's model.
EMBED_DIM = 384

# Citation labels for known source files; others fall back to the file stem.
CITATION_ALIASES = {
    "20260604-5190_Petition for Waiver - Silver Star.pdf": "Silver Star",
    "20260615-5151_Joint Index of Exhibits DCR Transmission ER23-2309 et al (2026-06-15).pdf": (
        "ER23-2309 Index"
    ),
    "may2026.pdf": "EIA EPM May 2026",
}

# Answer refusal sentence.
REFUSAL = "I cannot answer this from the available documents."

# Citation tag as it appears in answers.
CITATION_PATTERN = r"\[[^\]]+ p\.\d+\]"

# Separator between context blocks.
CONTEXT_SEPARATOR = "\n\n---\n\n"

# Answer prompt, with {refusal}, {context} and {query} slots. Deviation: the assistant's
# product name in the first sentence is left out; the rules and layout are unchanged.
PROMPT_TEMPLATE = (
    "You are an energy-document analyst. Answer the QUESTION using ONLY "
    "the CONTEXT chunks below.\n"
    "\n"
    "Rules:\n"
    "- Use only facts found in the chunks. Do not use any outside knowledge.\n"
    "- After every factual sentence, cite the chunk(s) it came from using the exact bracketed tag shown "
    "above each chunk, e.g. [Silver Star p.4].\n"
    "- If the chunks do not contain the answer, reply with exactly this and nothing else: {refusal}\n"
    "\n"
    "CONTEXT:\n"
    "{context}\n"
    "\n"
    "QUESTION: {query}\n"
)

# Notes returned when a tool selects no rows (one per result type).
NOTE_NO_DATA_RETURNED = "no data returned for this range"
NOTE_NO_DATA = "no data for this range"

# Sign convention note of the interchange tool.
INTERCHANGE_CONVENTION = "total_interchange_mwh > 0 means net exports; < 0 means net imports"

# Frame column order of the two fact tables.
GENERATION_COLUMNS = [
    "period", "respondent", "respondent_name", "fueltype", "type_name", "value_units", "value",
]
REGION_COLUMNS = ["period", "respondent", "respondent_name", "type", "type_name", "value_units", "value"]

# ---------------------------------------------------------------------------
# Our own fixed choices
# ---------------------------------------------------------------------------

# Display names used when deriving fact tables from the test tables.
REGION_NAMES = {
    "CISO": "California Independent System Operator",
    "ERCO": "Electric Reliability Council of Texas, Inc.",
    "PJM": "PJM Interconnection, LLC",
    "NYIS": "New York Independent System Operator",
    "ISNE": "ISO New England",
    "MISO": "Midcontinent Independent System Operator, Inc.",
    "SWPP": "Southwest Power Pool",
}

# Net position when total interchange is exactly zero (the source leaves it open).
POSITION_EXPORTER = "net exporter"
POSITION_IMPORTER = "net importer"
POSITION_BALANCED = "balanced"

# Unicode whitespace as Python's str.isspace() sees it: the Unicode White_Space property
# plus \x1C-\x1F. Two spellings of the same set: Java regex (Spark) evaluates the
# property class about 8x faster than a list of ranges; RE2 (the DuckDB oracle) has no
# binary-property syntax and uses the explicit list. tests/test_text.py checks that
# both equal str.isspace() on every BMP code point.
WS_CHARS_RE2 = (
    r"\t\n\x{0B}\x{0C}\r\x{1C}-\x{1F} \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}"
    r"\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"
)
WS_CHARS = r"\p{IsWhite_Space}\x{1C}-\x{1F}"
WS = "[" + WS_CHARS + "]"
NOT_WS = "[^" + WS_CHARS + "]"
WS_RE2 = "[" + WS_CHARS_RE2 + "]"
NOT_WS_RE2 = "[^" + WS_CHARS_RE2 + "]"

# Line boundaries of Python's str.splitlines().
LINE_BREAK = r"\r\n|[\n\r\x{0B}\x{0C}\x{1C}-\x{1E}\x{85}\x{2028}\x{2029}]"

# One token: optional leading whitespace plus a run of non-whitespace. Lossless for text
# without trailing whitespace (normalised pages never end in whitespace).
TOKEN_PATTERN = WS + "*" + NOT_WS + "+"
TOKEN_PATTERN_RE2 = WS_RE2 + "*" + NOT_WS_RE2 + "+"

# Hour-grain period formats accepted by the record parser (after hour padding).
PERIOD_PATTERN = r"^\d{4}-\d{2}-\d{2}([T ]\d{2}:\d{2}(:\d{2}(\.\d+)?)?)?$"

# Sums run as decimals; a record value of this size or more is a reject.
VALUE_DECIMAL = "decimal(28,9)"
VALUE_LIMIT = 1e18

# Hashing vectoriser width (the source model's width).
HASH_DIM = EMBED_DIM
