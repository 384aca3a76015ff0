"""Explicit schemas. Nothing is inferred from JSON, so columns that are null throughout stay."""

from __future__ import annotations

FEATURES = "struct<entropy:double,length:int,has_special:boolean,has_upper:boolean,has_lower:boolean,has_digit:boolean>"
RECORD = (
    "record_id string, source_file string, source_index int, context string, username string, password string, status string, "
    f"is_credentials int, distractor_type string, source_context_hash string, augmentation_parent_id string, features {FEATURES}"
)
DETECTION = "file_path string, owner string, source string, pattern_name string, matched_value string, match_line_number int, context string"
TOOL_CALL = "struct<tool:string,args:map<string,string>,observation:string>"
TRACE = f"struct<strategy:string,checks:array<string>,tool_calls:array<{TOOL_CALL}>,model:string>"
#: A decision as model text gives it: every field as the JSON text that it has.
RAW_DECISION = "is_credentials string, status string, confidence string, reasoning string, evidence string, indicators string, agent_trace string"
RATIONALE = "record_id string, reasoning string, evidence array<string>"
PROMPT_PAIR = "prompt string, completion string, record_id string, status string, is_credentials int, distractor_type string, source_context_hash string"
STATUSES = ("REAL", "FALSE_POSITIVE", "REVIEW")
