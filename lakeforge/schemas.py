"""Explicit schemas of the stored tables and wire records."""

from __future__ import annotations

FILES = "path string, seq long, text string"
CATALOG = "package string, func_name string, file_path string, seq bigint"
FUNCTIONS = "id string, package string, func_name string, file_path string, summary string, status string, seq bigint"
DEPENDENCIES = "function_id string, dep_name string, dep_type string, pos int"
REPLY = "ok boolean, summary string, external array<struct<name:string,type:string>>"
REQUEST = "model string, prompt string, stream boolean, format string, options struct<temperature:double,num_predict:int>"
FINDINGS = "id string, file_path string, summary string, context string, raw string, clean boolean, pass int, seq bigint"

PENDING, IN_PROGRESS, EXTRACTED, AUDITED, FAILED = "PENDING", "IN_PROGRESS", "EXTRACTED", "AUDITED", "FAILED_PARSE"
