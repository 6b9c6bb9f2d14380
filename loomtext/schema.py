"""Schemas of records, pairs, errors and sources."""

RECORDS = """
source_url string, source_type string, content string, content_sha1 string,
downloaded_files array<struct<type:string,original_url:string,original_file:string,local_path:string,sha1:string,size_bytes:bigint>>,
metadata string, categories array<string>, date_accessed string, language string, license string,
quality_score double, is_duplicate boolean, duplicate_of string, status string
"""
PAIRS = """
prompt string, completion string, task_type string, source string, tags array<string>, component_type string,
language string, conversation array<struct<role:string,content:string>>
"""
ERRORS = "source_url string, source_type string, reason string, timestamp string"
SOURCES = "url string, type string, categories array<string>, include_files array<string>, download_files boolean"
