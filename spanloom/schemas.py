"""Schemas of the captured lines and of the common wire item."""

PAIR = """
request struct<timestamp double, method string, url string, headers map<string,string>, body string>,
response struct<timestamp double, first_byte_timestamp double, status_code bigint,
                headers map<string,string>, body string, body_raw string>,
logged_at string, note string, _bad string
"""

# Every top-level request field any of the four shapes uses, read in one pass.
BODY = """
provider string, session_id string, model string, system string, instructions string,
prompt_cache_key string, input array<string>, contents array<string>, messages array<string>,
transcript array<string>, tools array<string>, tools_list array<string>,
systemInstruction string, system_instruction string
"""

ITEM = "struct<kind string, role string, text string, call_id string, name string, args string>"

HOOK = """
v int, ts string, session_id string, event string, hook_name string, duration_ms double, decision string,
stdin_digest string, stdin_preview string, stdout_preview string, outcome string, exit_code int,
payload string, _bad string
"""
