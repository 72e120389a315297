"""Table schemas, enumerations and constants of the engine."""

from __future__ import annotations

SCHEMA_VERSION = "4"

TABLES: dict[str, str] = {
    "documents": "id string, project_id string, path string, filename string, content_hash string, last_indexed_at timestamp, created_at timestamp, updated_at timestamp",
    "chunks": "id string, document_id string, chunk_index int, heading_path string, content string, content_hash string, token_count int, vector_point_id string, embedding_model string, embedding array<double>, source_type string, created_at timestamp, updated_at timestamp",
    "memory_nodes": "id string, project_id string, type string, title string, content string, status string, source_kind string, source_document_id string, source_chunk_id string, source_path string, content_hash string, created_by string, model_name string, confidence double, created_at timestamp, updated_at timestamp",
    "edges": "id string, project_id string, source_node_id string, target_node_id string, relation_type string, created_by string, confidence double, created_at timestamp",
    "retrieval_logs": "id string, project_id string, query string, top_k int, result_count int, results array<struct<title:string,content:string,source_path:string,heading_path:string,memory_type:string,status:string,score:double>>, created_at timestamp",
    "source_ledger": "source_id string, source_path_or_alias string, project_name string, source_type string, parser_version string, content_hash string, last_modified_at timestamp, last_indexed_at timestamp, status string, error_message string, chunk_count int, created_at timestamp, updated_at timestamp",
    "tasks": "task_id string, title string, type string, project string, agent_session_id string, human_outcome int, human_comment string, total_tokens long, total_duration_s double, status string, created_at timestamp, closed_at timestamp",
    "task_steps": "step_id string, task_id string, step_index int, prompt_used string, output string, brain_judgment string, tokens_used long, duration_s double, model_used string, created_at timestamp",
    "verifier_rounds": "round_id string, task_id string, step_id string, suggestion_type string, brain_accepted boolean, brain_rationale string, created_at timestamp",
    "memories": "id long, text string, metadata string, created_at timestamp",
}
KEYS = {"documents": "id", "chunks": "id", "memory_nodes": "id", "edges": "id", "retrieval_logs": "id", "source_ledger": "source_id", "tasks": "task_id", "task_steps": "step_id", "verifier_rounds": "round_id", "memories": "id"}

CATALOG = "id string, source_type string, path_or_alias string, project_name string, discovered_from array<string>, confirmation_status string, privacy_scope string, confidence double, evidence_count int"
RECORD = "project string, source_type string, source_path string, source_tool string, text string, session_id string, created_at string, last_modified timestamp, privacy_scope string, exchange_index int, session_line_count int, is_compaction boolean"

# Fixed values
MEMORY_STATUSES = ("active", "obsolete", "superseded", "conflicting", "unverified")
ACTIVE_STATUSES = ("active", "unverified")
LEDGER_STATUSES = ("active", "pending", "error", "missing", "skipped")
HIDDEN_LEDGER_STATUSES = ("missing", "skipped")
TASK_TYPES = ("bugfix", "feature", "refactor", "review", "query")
TASK_STATUSES = ("open", "closed", "unrated")
JUDGMENTS = ("ok", "needs_revision", "rejected")
CATALOG_TYPES = ("agent_root", "project_root", "document", "server_alias")
INDEXABLE_TYPES = ("project_docs", "agent_session")
PARSE_LATER_TYPES = ("agent_memory", "operations_note", "binary_document")
CURATED_TYPES = ("note", "decision", "issue", "pattern")
EMBEDDING_DIMENSIONS = 384
BM25_K1, BM25_B = 1.5, 0.75
SOURCE_BOOST = {"project_docs": 1.0, "agent_session": 0.75}
DEFAULT_BOOST = 0.85
CHUNK_CHARS, SESSION_CHUNK_CHARS = 1200, 600
CONFIDENCE = {"project_docs": 0.80, "agent_session": 0.60}
COMPACTION_CONFIDENCE, DEFAULT_CONFIDENCE = 0.75, 0.50
MIN_CANDIDATE_TOKENS, CANDIDATE_LIMIT, CANDIDATE_SOURCE_LIMIT = 8, 300, 8
CANDIDATE_EXTENSIONS = (".md", ".markdown", ".txt", ".rst")
STABILITY_SECONDS = 120
#: First word of the metadata line that ingestion puts before a text.
METADATA_MARKER = "INGESTION_METADATA"
