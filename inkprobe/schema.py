"""Schemas of the engine's tables."""

from __future__ import annotations

PAPERS = (
    "paper_id string, title string, authors array<string>, journal string, year int, doi string, abstract string, introduction string, methods string, results string, discussion string, "
    "full_text string, data_file string"
)
CELLS = "file string, sheet string, row int, col int, raw string, value double"
LOCATION = "struct<page:int,figure_number:string,paragraph:string,excerpt:string>"
CHECK_RESULTS = (
    "paper_id string, check_id string, check_name string, level string, verdict string, evidence array<string>, "
    f"source_locations array<{LOCATION}>, confidence double, needs_human boolean, human_instruction string"
)
POSTS = "source string, source_id string, title string, url string, author string, date string, content string, dois array<string>, pmids array<string>, fetched_at string"
LEARNED_PATTERNS = "pattern_id long, post_id string, category string, technique string, detection_hint string, pattern string, severity string, reviewed int"
