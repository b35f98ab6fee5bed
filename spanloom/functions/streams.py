"""SQL expressions that put streamed answers back together, one row at a time."""

from __future__ import annotations

from . import items as I

USAGE_A = (
    "struct<input_tokens double, output_tokens double, cache_creation_input_tokens double, "
    "cache_read_input_tokens double>"
)
USAGE_B = (
    "struct<input_tokens double, output_tokens double, input_tokens_details struct<cached_tokens double>, "
    "output_tokens_details struct<reasoning_tokens double>>"
)
USAGE_C = (
    "struct<promptTokenCount double, candidatesTokenCount double, thoughtsTokenCount double, "
    "cachedContentTokenCount double>"
)
USAGE_D = "struct<input_tokens double, output_tokens double, cache_read_tokens double, cache_creation_tokens double>"

EVENT_A = (
    f"type string, index int, message struct<model string, usage {USAGE_A}>, "
    "content_block struct<type string, text string, thinking string, data string, id string, name string, input string>, "
    "delta struct<type string, text string, partial_json string, thinking string, stop_reason string>, "
    "usage struct<output_tokens double>"
)
EVENT_B = (
    "type string, output_index int, item string, delta string, name string, "
    f"response struct<output array<string>, usage {USAGE_B}, model string, status string>"
)
CHUNK_C = (
    f"usageMetadata {USAGE_C}, modelVersion string, "
    "candidates array<struct<finishReason string, content struct<parts array<string>>>>"
)


def usage(prompt, completion, creation="0", read="0", reasoning="cast(null as bigint)") -> str:
    n = lambda x: f"coalesce(cast({x} as bigint), 0L)"
    return (
        f"named_struct('prompt_tokens', {n(prompt)}, 'completion_tokens', {n(completion)}, "
        f"'cache_creation', {n(creation)}, 'cache_read', {n(read)}, 'reasoning_tokens', {reasoning})"
    )


def _present(u: str, value: str) -> str:
    return f"if({u} is null, null, {value})"


def usage_a(u: str) -> str:
    return _present(u, usage(
        f"{u}.input_tokens", f"{u}.output_tokens", f"{u}.cache_creation_input_tokens", f"{u}.cache_read_input_tokens"
    ))


def usage_b(u: str) -> str:
    reasoning = f"coalesce(cast({u}.output_tokens_details.reasoning_tokens as bigint), 0L)"
    return _present(u, usage(
        f"{u}.input_tokens", f"{u}.output_tokens", read=f"{u}.input_tokens_details.cached_tokens", reasoning=reasoning
    ))


def usage_c(u: str) -> str:
    out = f"coalesce({u}.candidatesTokenCount, 0) + coalesce({u}.thoughtsTokenCount, 0)"
    return _present(u, usage(
        f"{u}.promptTokenCount", out, read=f"{u}.cachedContentTokenCount",
        reasoning=f"cast({u}.thoughtsTokenCount as bigint)",
    ))


def usage_d(u: str) -> str:
    return _present(u, usage(
        f"{u}.input_tokens", f"{u}.output_tokens", f"{u}.cache_creation_tokens", f"{u}.cache_read_tokens"
    ))


def events(raw: str) -> str:
    """Stream text -> array of (ev, data); the data of one event may span lines."""
    line = "split(c, '\\\\r?\\\\n')"
    name = f"trim(get(transform(filter({line}, l -> startswith(l, 'event:')), l -> substring(l, 7)), 0))"
    data = (
        f"array_join(transform(filter({line}, l -> startswith(l, 'data:')), "
        "l -> regexp_replace(substring(l, 6), '^ ', '')), '\\n')"
    )
    return (
        f"filter(transform(split({raw}, '\\\\r?\\\\n\\\\r?\\\\n'), c -> named_struct('ev', {name}, 'data', {data})), "
        "e -> e.data <> '' and e.data <> '[DONE]')"
    )


# -- block deltas -------------------------------------------------------------

def delta_blocks(ev: str) -> str:
    """One struct per block index: its start and its joined text, JSON and thoughts."""
    kinds = "e.type in ('content_block_start', 'content_block_delta')"
    index = f"array_sort(array_distinct(transform(filter({ev}, e -> {kinds}), e -> coalesce(e.index, 0))))"
    own = "coalesce(e.index, 0) = ix"
    start = I.last_of(ev, f"e.type = 'content_block_start' and {own}", "e.content_block")

    def joined(kind: str, field: str) -> str:
        mine = f"e.type = 'content_block_delta' and {own} and e.delta.type = '{kind}'"
        return f"array_join(transform(filter({ev}, e -> {mine}), e -> e.delta.{field}), '')"

    return (
        f"transform({index}, ix -> named_struct('s', {start}, 'text', {joined('text_delta', 'text')}, "
        f"'json', {joined('input_json_delta', 'partial_json')}, 'thought', {joined('thinking_delta', 'thinking')}))"
    )


def delta_items(blocks: str) -> str:
    """Items of the blocks of ``delta_blocks``."""
    thinking = (
        "if(coalesce(k.s.thinking, '') = '' and k.thought = '', k.s.thinking, "
        "concat(coalesce(k.s.thinking, ''), k.thought))"
    )
    block = (
        "named_struct('type', coalesce(k.s.type, 'text'), 'text', concat(coalesce(k.s.text, ''), k.text), "
        f"'thinking', {thinking}, 'data', k.s.data, 'id', k.s.id, 'name', k.s.name, "
        "'input', coalesce(get_json_object(nullif(k.json, ''), '$'), k.s.input, '{}'))"
    )
    return I.kept(f"transform(transform({blocks}, k -> {block}), ob -> {I.assistant_block('ob')})")


def delta_usage(ev: str) -> str:
    start = I.last_of(ev, "e.type = 'message_start'", "e.message.usage")
    late = I.last_of(ev, "e.type = 'message_delta' and e.usage.output_tokens is not null", "e.usage.output_tokens")
    counts = usage(
        "u.input_tokens", f"coalesce({late}, u.output_tokens)", "u.cache_creation_input_tokens", "u.cache_read_input_tokens"
    )
    return f"get(transform(array({start}), u -> {counts}), 0)"


# -- entry events -------------------------------------------------------------

def terminal(ev: str) -> str:
    """The response of the last completed event, else of the last failed one."""
    done = I.last_of(ev, "e.ev = 'response.completed'", "e.j.response")
    failed = I.last_of(ev, "e.ev = 'response.failed'", "e.j.response")
    return f"coalesce({done}, {failed})"


def unfinished_items(ev: str) -> str:
    """Items of a stream without a terminal event, one per output index."""
    own = "e.j.output_index = ix"

    def last_item(name: str) -> str:
        return I.last_of(ev, f"e.ev = '{name}' and {own}", "e.j.item")

    def joined(*names: str) -> str:
        wanted = ", ".join(f"'{n}'" for n in names)
        return f"array_join(transform(filter({ev}, e -> e.ev in ({wanted}) and {own}), e -> coalesce(e.j.delta, '')), '')"

    args_event = "response.function_call_arguments.delta"
    index = f"array_sort(array_distinct(filter(transform({ev}, e -> e.j.output_index), ix -> ix is not null)))"
    gathered = (
        f"transform({index}, ix -> named_struct("
        f"'done', {last_item('response.output_item.done')}, 'added', {last_item('response.output_item.added')}, "
        f"'text', {joined('response.output_text.delta')}, 'args', {joined(args_event)}, "
        f"'thought', {joined('response.reasoning_summary_text.delta', 'response.reasoning_text.delta')}, "
        f"'name', {I.last_of(ev, f'e.ev = {chr(39)}{args_event}{chr(39)} and {own}', 'e.j.name')}))"
    )
    seed = "coalesce(g.done, g.added)"
    opened = f"{I.read(seed, I.ENTRY)} as e, {I.content_list(seed)} as parts"
    seeded = f"transform(transform({gathered}, g -> struct(g, {opened})), w -> struct(w.g as g, {I.entry_item('w.e', 'w.parts')} as s))"
    grown_args = I.minified("concat(coalesce(w.s.args, ''), w.g.args)")
    keep = ("w.s.kind", "w.s.role", "w.s.text", "w.s.call_id", "w.s.name", "w.s.args")
    more = lambda extra: f"concat(coalesce(w.s.text, ''), {extra})"
    return I.kept(
        f"transform({seeded}, w -> case when w.g.done is not null then w.s "
        f"when w.s.kind = 'tool_call' then {I.item(*keep[:5], grown_args)} "
        f"when w.s.kind = 'reasoning' then {I.item(*keep[:2], more('w.g.thought'), *keep[3:])} "
        f"when w.s.kind is not null then {I.item(*keep[:2], more('w.g.text'), *keep[3:])} "
        f"when w.g.args <> '' then {I.item(I.TOOL_CALL, call=I.EMPTY, name=I.or_empty('w.g.name'), args=I.minified('w.g.args'))} "
        f"when w.g.thought <> '' then {I.item(I.REASONING, text='w.g.thought')} "
        f"when w.g.text <> '' then {I.item(I.MESSAGE, I.ASSISTANT, 'w.g.text')} end)"
    )


# -- chunk parts --------------------------------------------------------------

PART_TYPE = (
    "struct<functionCall: struct<id: string, name: string, args: string>, "
    "functionResponse: struct<id: string, name: string, response: string>, text: string, thought: boolean>"
)


def merged_parts(chunks: str) -> str:
    """Parts of all chunks in order; neighbouring texts of one kind become one part."""
    parts = (
        f"flatten(transform({chunks}, e -> transform(coalesce(get(e.candidates, 0).content.parts, {I.NO_TEXTS}), "
        f"prt -> {I.read('prt', I.PART)})))"
    )
    prev = "element_at(acc, -1)"
    same = (
        f"{prev}.text is not null and p.text is not null and {prev}.functionCall is null and p.functionCall is null "
        f"and coalesce({prev}.thought, false) = coalesce(p.thought, false)"
    )
    glued = (
        f"named_struct('functionCall', {prev}.functionCall, 'functionResponse', {prev}.functionResponse, "
        f"'text', concat({prev}.text, p.text), 'thought', {prev}.thought)"
    )
    return (
        f"aggregate({parts}, cast(array() as array<{PART_TYPE}>), (acc, p) -> if(size(acc) > 0 and {same}, "
        f"concat(slice(acc, 1, size(acc) - 1), array({glued})), concat(acc, array(p))))"
    )
