"""Captured pairs in four wire shapes -> one row per call with flat wire items.

All parsing is done by JSON and higher-order expressions on the row, without a
shuffle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import items as I, streams as R
from ..schemas import BODY

# Fragments that vary from call to call, with what replaces them.
VOLATILE_MESSAGES = [
    (r"Generated \\d{4}-\\d{2}-\\d{2} \\d{2}:\\d{2}:\\d{2}", "Generated [TIMESTAMP]"),
    (r"The user opened the file [^\\s]+ in the IDE\\.", "The user opened file in IDE."),
    (r"(?s)<system-reminder>.*?</system-reminder>", "[SYSTEM-REMINDER]"),
    (r"cch=[0-9a-f]+;?", "cch=[HASH];"),
]
VOLATILE_TRANSCRIPT = [
    (r"Today\'s date:[^\\n]*", r"Today\'s date: [DATE]"),
    (r"OS Version:[^\\n]*", "OS Version: [OS]"),
    (r"(?s)<git_status>.*?</git_status>", "[GIT_STATUS]"),
    (r"(?s)<system_info>.*?</system_info>", "[SYSTEM_INFO]"),
]


def stable(expr: str, rules: list[tuple[str, str]]) -> str:
    for pattern, to in rules:
        expr = f"regexp_replace({expr}, '{pattern}', '{to}')"
    return expr


def _key_hash(*parts: str) -> str:
    joined = ", '|', ".join(f"coalesce({p}, '')" for p in parts)
    return f"substring(sha2(concat({joined}), 256), 1, 16)"


PROVIDER = """
case when b.provider = 'devin' then 'devin'
     when b.input is not null or b.instructions is not null then 'codex'
     when b.messages is not null and not coalesce(request.url, '') rlike '/messages/count_tokens' then 'claude'
     when b.messages is null and b.contents is not null then 'gemini' end
"""


def classify(pairs: DataFrame) -> DataFrame:
    """Provider of each pair and its opened body; unknown shapes are dropped."""
    opened = pairs.withColumn("b", F.expr(I.read("request.body", " ".join(BODY.split()))))
    return opened.withColumn("provider", F.expr(PROVIDER)).where("provider is not null")


def _by_provider(claude: str, codex: str, gemini: str, devin: str) -> str:
    return (
        f"case provider when 'claude' then {claude} when 'codex' then {codex} "
        f"when 'gemini' then {gemini} else {devin} end"
    )


def _model() -> str:
    from_url = "try_url_decode(nullif(regexp_extract(coalesce(request.url, ''), '/models/([^:/?]+)', 1), ''))"
    plain = "coalesce(b.model, 'unknown')"
    return _by_provider(
        plain, plain, f"coalesce({from_url}, regexp_replace(b.model, '^models/', ''), 'unknown')", plain
    )


def _instruction_text() -> str:
    parts = I.plain_parts(I.read("si", "parts array<string>") + ".parts")
    return f"coalesce({parts}, get_json_object(si, '$.text'), if({I.is_object('si')}, null, si), '')"


def _prompt() -> str:
    texts = f"filter(transform(system_blocks, x -> {I.read('x', 'text string')}.text), x -> x is not null)"
    blocks = f"array_join(transform({texts}, x -> {stable('x', VOLATILE_MESSAGES)}), '\\n\\n')"
    return _by_provider(
        f"coalesce({blocks}, {stable('b.system', VOLATILE_MESSAGES)})",
        "b.instructions", _instruction_text(), stable("b.system", VOLATILE_TRANSCRIPT),
    )


def _session_key() -> str:
    # System blocks without their cache marks, volatile text normalised.
    fields = f"map_filter({I.read('x', 'map<string,string>')}, (k, v) -> k <> 'cache_control')"
    blocks = (
        f"to_json(transform(system_blocks, x -> transform_values({fields}, "
        f"(k, v) -> if(k = 'text', {stable('v', VOLATILE_MESSAGES)}, v))))"
    )
    system = f"coalesce({blocks}, {stable('b.system', VOLATILE_MESSAGES)})"
    entry = f"struct({I.read('x', 'role string, content string')} as e, {I.content_list('x')} as parts)"
    users = f"filter(transform(b.input, x -> {entry}), o -> o.e.role = 'user')"
    first_entry = f"get(transform(slice({users}, 1, 1), o -> {I.text_or_parts('o.e.content', 'o.parts')}), 0)"
    spoken = (
        f"transform(filter(transform(b.contents, x -> {I.read('x', 'role string, parts array<string>')}), "
        f"c -> coalesce(c.role, '') <> 'model'), c -> {I.plain_parts('c.parts')})"
    )
    first_content = f"get(filter({spoken}, x -> trim(x) <> ''), 0)"
    model = "coalesce(b.model, '?')"
    return _by_provider(
        f"concat('claude:', {_key_hash(system, model)})",
        f"if(coalesce(b.prompt_cache_key, '') <> '', concat('codex:k:', b.prompt_cache_key), "
        f"concat('codex:h:', {_key_hash(model, first_entry)}))",
        f"concat('gemini:', {_key_hash('req_model', _instruction_text(), first_content)})",
        f"if(coalesce(b.session_id, '') <> '', concat('devin:', b.session_id), "
        f"concat('devin:', {_key_hash(model, 'b.system')}))",
    )


def normalize_pairs(pairs: DataFrame) -> DataFrame:
    """One row per recognised pair: identity, model, prompt, items, usage, timing.

    ``pairs`` has source_path, block_start and row_id (the order inside the file),
    request and response.  Items of the request are ``req_items``, those of the
    answer ``resp_items``; the fields of ``usage`` are the five counters.
    """
    p = classify(pairs)
    request_items = _by_provider(
        I.message_items("b.messages"),
        I.entry_items(f"coalesce(b.input, {I.NO_TEXTS})"),
        I.content_items("b.contents"),
        I.turn_items(f"coalesce(b.transcript, {I.NO_TEXTS})"),
    )
    p = p.selectExpr(
        "*",
        f"if(instr(request.body, '\"system\":[') > 0 and b.system like '[%', {I.read('b.system', 'array<string>')}, null) as system_blocks",
        "coalesce(b.systemInstruction, b.system_instruction) as si",
        f"{_model()} as req_model",
        "response.body as rbody",
        "coalesce(response.body_raw, '') as raw",
        f"coalesce({request_items}, {I.NO_ITEMS}) as req_items",
    )
    # A raw body of shape B may be plain JSON; shape C may stream an array, one
    # object, events or JSON text.
    json_raw = "raw rlike '^\\\\s*[{\\\\[]' and instr(raw, '\\ndata:') = 0 and instr(raw, 'event:') = 0"
    answer_b = f"case when {I.is_object('rbody')} then rbody when rbody is null and {json_raw} then raw end"
    chunk_texts = (
        f"case when trim(rbody) rlike '^\\\\[' then {I.read('rbody', 'array<string>')} "
        f"when {I.is_object('rbody')} then array(rbody) "
        f"when instr(raw, 'data:') > 0 and size({R.events('raw')}) > 0 then transform({R.events('raw')}, e -> e.data) "
        f"when trim(raw) rlike '^\\\\[' then {I.read('raw', 'array<string>')} "
        f"when {I.is_object('raw')} then array(raw) end"
    )
    p = p.selectExpr(
        "*", f"{_prompt()} as prompt", f"{_session_key()} as session_id",
        f"if(provider = 'claude' and {I.is_object('rbody')}, "
        f"{I.read('rbody', f'content array<string>, usage {R.USAGE_A}, model string, stop_reason string')}, null) as ra",
        f"if(provider = 'codex', {I.read(answer_b, f'output array<string>, usage {R.USAGE_B}, model string, status string')}, null) as rb",
        f"if(provider = 'devin', {I.read('rbody', f'message string, usage {R.USAGE_D}, model string, finish_reason string')}, null) as rd",
        f"if(rbody is null and raw <> '' and provider in ('claude', 'codex'), {R.events('raw')}, null) as sse",
        f"if(provider = 'gemini', {chunk_texts}, null) as chunk_texts",
    )
    named = f"transform(transform(sse, e -> struct(e.ev as ev, {I.read('e.data', R.EVENT_B)} as j)), e -> struct(coalesce(nullif(e.ev, ''), e.j.type) as ev, e.j as j))"
    p = p.selectExpr(
        "*",
        f"if(provider = 'claude', transform(sse, e -> {I.read('e.data', R.EVENT_A)}), null) as ev_a",
        f"if(provider = 'codex' and coalesce(size(rb.output), 0) < 1 and rb.usage is null, {named}, null) as ev_b",
        f"transform(chunk_texts, x -> {I.read('x', R.CHUNK_C)}) as ev_c",
        f"{I.read('rd.message', I.TURN)} as turn",
    )
    p = p.selectExpr(
        "*", f"{R.delta_blocks('ev_a')} as blocks_a", f"{R.terminal('ev_b')} as term_b", f"{R.merged_parts('ev_c')} as parts_c"
    )
    items = _by_provider(
        f"if(ra is not null, {I.block_answer('ra.content')}, {R.delta_items('blocks_a')})",
        f"case when size(rb.output) > 0 then {I.entry_items('rb.output')} "
        f"when term_b is not null then {I.entry_items('term_b.output')} else {R.unfinished_items('ev_b')} end",
        I.kept(f"transform(parts_c, z -> {I.part_item('true', 'z')})"),
        f"if(turn is null, {I.NO_ITEMS}, {I.assistant_turn('turn')})",
    )
    usage = _by_provider(
        f"if(rbody is not null, {R.usage_a('ra.usage')}, if(raw = '', null, {R.delta_usage('ev_a')}))",
        f"coalesce({R.usage_b('rb.usage')}, {R.usage_b('term_b.usage')})",
        R.usage_c(I.last_of("ev_c", "e.usageMetadata is not null", "e.usageMetadata")),
        R.usage_d("rd.usage"),
    )
    model = _by_provider(
        f"coalesce(ra.model, {I.last_of('ev_a', 'e.message.model is not null', 'e.message.model')})",
        "coalesce(term_b.model, rb.model)",
        I.last_of("ev_c", "e.modelVersion is not null", "e.modelVersion"),
        "rd.model",
    )
    finish = "get(e.candidates, 0).finishReason"
    stop = _by_provider(
        f"coalesce(ra.stop_reason, {I.last_of('ev_a', 'e.delta.stop_reason is not null', 'e.delta.stop_reason')})",
        "coalesce(term_b.status, rb.status)",
        I.last_of("ev_c", f"{finish} is not null", finish),
        "rd.finish_reason",
    )
    return p.selectExpr(
        "source_path", "block_start", "row_id", "provider", "session_id", "req_model",
        "if(trim(coalesce(prompt, '')) = '', null, prompt) as prompt_text",
        "request.headers as headers", "coalesce(b.tools, b.tools_list) as tools", "request.body as body",
        "coalesce(request.timestamp, 0.0D) as ts", "response is not null as answered",
        "response.status_code as status_code", "response.timestamp as resp_ts",
        "response.first_byte_timestamp as first_byte_ts",
        "req_items", f"coalesce({items}, {I.NO_ITEMS}) as resp_items",
        f"{usage} as usage", f"{model} as resp_model", f"{stop} as stop_reason",
    )
