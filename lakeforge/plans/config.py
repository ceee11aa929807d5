"""Options of a run."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass
class Config:
    model: str = "qwen3-code-expert"
    state_dir: str = "audit_state"
    report_path: str = "audit_bugs_report.md"
    endpoint: str = "http://localhost:11434/api/generate"
    audit_passes: int = 1
    fail_fast: bool = False
    log_file: str = ""
    reset_audit: bool = False
    workers: int = 4
    max_depth: int = 10
    compat: bool = False  # a failed enrichment blanks the summary
    root: str = "."
