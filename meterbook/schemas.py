"""Explicit schemas of every JSON shape the library reads."""

from __future__ import annotations

CLAUDE = """
type string, timestamp string, slug string, cwd string, gitBranch string, uuid string,
requestId string, sessionId string, version string, entrypoint string,
message struct<id: string, role: string, model: string, content: variant,
  usage: struct<input_tokens: bigint, output_tokens: bigint,
    cache_creation_input_tokens: bigint, cache_read_input_tokens: bigint, speed: string>>
"""

CODEX_USAGE = (
    "struct<input_tokens: bigint, cached_input_tokens: bigint, cache_write_tokens: bigint, "
    "output_tokens: bigint, reasoning_output_tokens: bigint, total_tokens: bigint>"
)

CODEX = f"""
timestamp string, type string,
payload struct<type: string, id: string, session_id: string, cwd: string, model: string,
  turn_id: string, message: string, role: string,
  thread_settings: struct<model: string, service_tier: string>, git: struct<branch: string>,
  info: struct<total_token_usage: {CODEX_USAGE}, last_token_usage: {CODEX_USAGE}>,
  content: array<struct<type: string, text: string>>>
"""

_COPILOT_COUNT = "struct<tokenCount: bigint>"

COPILOT = f"""
type string, timestamp string,
data struct<sessionId: string, startTime: string,
  context: struct<cwd: string, gitRoot: string, branch: string>, content: variant,
  modelMetrics: map<string, struct<totalNanoAiu: double,
    usage: struct<inputTokens: bigint, outputTokens: bigint, cacheReadTokens: bigint,
      cacheWriteTokens: bigint>,
    tokenDetails: struct<input: {_COPILOT_COUNT}, output: {_COPILOT_COUNT},
      cache_read: {_COPILOT_COUNT}, cache_write: {_COPILOT_COUNT}>>>>
"""

OPENCODE_SESSION = (
    "id string, parent_id string, directory string, slug string, title string, cost double, "
    "tokens_input bigint, tokens_output bigint, tokens_reasoning bigint, "
    "tokens_cache_read bigint, tokens_cache_write bigint, time_created bigint, "
    "time_updated bigint"
)
OPENCODE_MESSAGE = (
    "id string, session_id string, time_created bigint, time_updated bigint, data string"
)
OPENCODE_PART = (
    "id string, message_id string, session_id string, time_created bigint, "
    "time_updated bigint, data string"
)
OPENCODE_MESSAGE_DATA = """
role string, modelID string, providerID string, cost double,
tokens struct<total: bigint, input: bigint, output: bigint, reasoning: bigint,
  cache: struct<read: bigint, write: bigint>>,
time struct<created: bigint, completed: bigint>
"""
OPENCODE_PART_DATA = "type string, text string"

# Stored records: scalars arrive as text whatever type a writer used.
_TURN = (
    "struct<turn_id: string, start_time: string, end_time: string, input_tokens: string, "
    "output_tokens: string, cache_creation_tokens: string, cache_read_tokens: string, "
    "total_tokens: string, total_cost_usd: string>"
)
_MODEL = "struct<model: string, vendor: string, total_tokens: string, total_cost_usd: string>"
LEDGER_FIELDS = [
    "timestamp", "session_slug", "session_id", "project", "branch", "cwd", "machine",
    "start_time", "end_time", "duration_seconds", "duration_human", "input_tokens",
    "output_tokens", "cache_creation_tokens", "cache_read_tokens", "total_tokens",
    "total_cost_usd", "models", "source_fingerprint", "provider",
]
LEDGER_JSON = (
    ", ".join(f"{name} string" for name in LEDGER_FIELDS)
    + f", model_breakdowns array<{_MODEL}>, turns array<{_TURN}>"
)

PRICE_FEED = (
    "map<string, struct<litellm_provider: string, mode: string, input_cost_per_token: string, "
    "output_cost_per_token: string, cache_creation_input_token_cost: string, "
    "cache_read_input_token_cost: string>>"
)

CAPTURE_RESULT = (
    "schema_version int, run_id string, capture_id string, completed_at string, "
    "hook_event_name string, provider string, session_id string, status string, project string, "
    "shard_path string, reason string, message string, total_tokens bigint, total_cost_usd double"
)
