"""The telemetry vocabulary of the supported harnesses.

Names, aliases and buckets below are data that must equal what the harnesses emit.
Alias lists are in order of precedence.
"""

# Harness names by emitting service.
HARNESS_OF_SOURCE = {
    "codex_cli_rs": "codex",
    "codex_exec": "codex",
    "codex-app-server": "codex",
    "copilot-chat": "vscode-copilot-chat",
    "vscode-copilot-chat": "vscode-copilot-chat",
}

# A body with this prefix names the event, for this source only.
BODY_NAMED_SOURCE = "claude-code"
BODY_NAME_PREFIX = "claude_code."

# Event names recognised from any signal, by family.
TOOL_RESULT_EVENTS = (
    "claude_code.tool_result",
    "claude_code.tool_decision",
    "codex.tool_result",
    "codex.tool_decision",
    "codex.tool_call",
    "opencode.tool.execute.after",
    "opencode.tool.execute.before",
)
API_REQUEST_EVENTS = ("claude_code.api_request", "codex.api_request", "opencode.api_request")
ASSISTANT_RESPONSE_EVENTS = (
    "claude_code.assistant_response",
    "codex.assistant_response",
    "opencode.assistant_response",
)
USER_PROMPT_EVENTS = ("claude_code.user_prompt", "codex.user_prompt", "opencode.user_prompt")
TURN_TTFT_EVENTS = ("claude_code.turn_ttft", "codex.turn_ttft", "opencode.turn_ttft")
WEBSOCKET_EVENTS = (
    "claude_code.websocket_request",
    "codex.websocket_request",
    "opencode.websocket_request",
)
USAGE_STREAM_EVENT = "codex.sse_event"

# Unqualified names count only as logs of their harness, so span twins are not counted twice.
LOG_TOOL_EVENTS = {"opencode": "tool_result", "vscode-copilot-chat": "copilot_chat.tool.call"}
LOG_API_EVENTS = {
    "opencode": "api_request",
    "vscode-copilot-chat": "gen_ai.client.inference.operation.details",
}

# Attribute aliases.
SESSION_KEYS = ("gen_ai.conversation.id", "session.id", "conversation.id", "session_id")
SESSION_RESOURCE_KEYS = ("session.id", "service.instance.id")
TOOL_KEYS = ("tool_name", "tool", "gen_ai.tool.name")
ENDPOINT_KEYS = ("endpoint", "request.endpoint", "url.path")
LENGTH_KEYS = ("response_length", "prompt_length", "content_length", "message_length", "body_length")
DURATION_KEYS = ("duration_ms", "latency_ms", "request_latency_ms", "ttft_ms", "duration_milliseconds")
MODEL_KEYS = ("model", "gen_ai.request.model", "gen_ai.response.model", "request.model", "model_name")
GUARD_MODEL_KEYS = ("model", "gen_ai.request.model", "gen_ai.response.model", "model_name")
PROJECT_KEYS = (
    "project",
    "project.name",
    "project_path",
    "cwd",
    "working_directory",
    "workspace.root",
)
INPUT_KEYS = ("input_tokens", "input_token_count", "gen_ai.usage.input_tokens")
OUTPUT_KEYS = ("output_tokens", "output_token_count", "gen_ai.usage.output_tokens")
CACHED_KEYS = (
    "cached_input_tokens",
    "cache_read_tokens",
    "cached_input_token_count",
    "cached_token_count",
    "gen_ai.usage.cache_read.input_tokens",
)
REASONING_KEYS = (
    "reasoning_output_tokens",
    "reasoning_output_token_count",
    "reasoning_token_count",
    "reasoning_tokens",
)
COST_KEYS = ("cost_microusd", "cost_usd_micros")
COST_USD_KEY = "cost_usd"
COUNTER_KEYS = INPUT_KEYS + OUTPUT_KEYS + CACHED_KEYS + REASONING_KEYS + COST_KEYS + (COST_USD_KEY,)
REVIEW_COUNTER_KEYS = tuple(key for key in COUNTER_KEYS if not key.startswith("gen_ai.usage."))
STREAM_COUNTER_KEYS = (
    "input_token_count",
    "output_token_count",
    "cached_input_token_count",
    "reasoning_output_token_count",
)
# The stream event counts for cost only when one of these is reported.

# Buckets of tool and endpoint names (lower case).
TOOL_BUCKETS = {
    "exec_command": "shell",
    "bash": "shell",
    "shell": "shell",
    "terminal": "shell",
    "read": "read",
    "write": "write",
    "edit": "edit",
    "grep": "search",
    "search": "search",
    "find": "search",
}
ENDPOINT_BUCKETS = {
    "/v1/responses": "responses",
    "responses": "responses",
    "/v1/chat/completions": "chat-completions",
    "chat/completions": "chat-completions",
}

# Status texts.
SUCCESS_TEXTS = ("ok", "success", "completed")
FAILURE_TEXTS = ("error", "failed", "failure")

# Latency bounds in milliseconds; counts at or below each are cumulative.
LATENCY_BOUNDS = (100, 500, 1000, 5000)

# Attributes whose presence alone is counted; their values are never copied.
IDENTITY_KEYS = ("user.email", "user.account_id", "account_id")
AUTH_KEYS = (
    "auth_mode",
    "auth.mode",
    "auth.header_attached",
    "auth.env_codex_api_key_present",
    "auth.env_openai_api_key_present",
    "auth.env_refresh_token_url_override_present",
)
PROMPT_CONTENT_KEYS = (
    "prompt",
    "user_prompt",
    "assistant_response",
    "input.value",
    "output.value",
    "gen_ai.input.messages",
    "gen_ai.output.messages",
    "copilot_chat.user_request",
)
TOOL_CONTENT_KEYS = (
    "arguments",
    "output",
    "tool_input",
    "tool_parameters",
    "tool_content",
    "full_command",
    "gen_ai.tool.arguments",
)

# Policy.
DENIED_TOOLS = ("dangerous_shell", "external_network")
DENIED_OPERATIONS = ("destructive", "network_external")
OUTSIDE_TARGET_PREFIX = "/outside/"
REDACTED = "<redacted>"
LOOP_THRESHOLD = 3
TARGET_KEYS = ("target", "file_path")
GUARD_TARGET_KEYS = ("target", "file_path", "full_command")
SUCCESS_KEYS = ("success", "tool.success")
COMMAND_KEYS = ("full_command", "command", "cmd")
ARGUMENT_KEYS = ("arguments", "tool_input", "tool_parameters", "tool_content")
FAILURE_KEYS = ("error.message", "error", "failure_reason", "message")
MODEL_CHARS = 1024
PROJECT_CHARS = 4096
DETAIL_CHARS = 8192
SESSION_PREFIX_CHARS = 12
CAPABILITIES = ("tool-observation", "target-detail", "progress-detail")
TOOL_REASONS = (
    "session identity absent",
    "session and tool identity observed",
    "tool identity absent, gated, or redacted",
)
TARGET_REASONS = ("tool target observed", "tool target absent, gated, or redacted")
PROGRESS_REASONS = (
    "progress fingerprint observed",
    "progress fingerprint absent, gated, or redacted",
)
COVERED_REASON = "required policy fields observed"
RULE_SUMMARIES = {
    "denied-tool": "Observed a denied tool",
    "denied-operation": "Observed a denied operation kind",
    "target-boundary": "Observed an out-of-bound target",
    "insufficient-telemetry": "Required policy telemetry was absent or redacted",
}

# URL ledger.
URL_VERDICTS = ("clean", "suspected", "error")
EXCLUSION_KINDS = ("host-exact", "host-suffix", "url-prefix")
BUILTIN_EXCLUSIONS = (
    ("builtin:ip-literal", "host-exact", "loopback-or-private-ip-literal"),
    ("builtin:localhost", "host-exact", "localhost"),
    ("builtin:single-label", "host-exact", "single-label-host"),
    ("builtin:local", "host-suffix", ".local"),
    ("builtin:internal", "host-suffix", ".internal"),
    ("builtin:home-arpa", "host-suffix", ".home.arpa"),
    ("builtin:test", "host-suffix", ".test"),
)
