"""SQL expressions that turn message lists of the four wire shapes into flat items.

Every function takes the SQL text of its input and returns SQL text.  Nested
values stay JSON text, so key order is that of the wire.
"""

from __future__ import annotations

from ..schemas import ITEM

NO_ITEMS = f"cast(array() as array<{ITEM}>)"
NO_TEXTS = "cast(array() as array<string>)"
NULL, EMPTY = "null", "''"
MESSAGE, REASONING, TOOL_CALL, TOOL_RESULT = "'message'", "'reasoning'", "'tool_call'", "'tool_result'"
USER, ASSISTANT, SYSTEM = "'user'", "'assistant'", "'system'"

BLOCK = (
    "type string, text string, thinking string, data string, id string, name string, "
    "input string, tool_use_id string, content string"
)
ENTRY = (
    "type string, role string, content string, summary array<string>, call_id string, id string, "
    "name string, action struct<type string>, arguments string, input string, output string"
)
PART = (
    "functionCall struct<id string, name string, args string>, "
    "functionResponse struct<id string, name string, response string>, text string, thought boolean"
)
CALLS = "array<struct<id string, name string, arguments string>>"
TURN = f"role string, content string, tool_calls {CALLS}, tool_call_id string"
CONTENTS = "content array<string>"


def read(text: str, schema: str) -> str:
    return f"from_json({text}, '{schema}')"


def content_list(text: str) -> str:
    """The content of an object when it is a list, else NULL.

    Texts are compact JSON, where quotes inside strings are escaped, so the test
    spares a second reading of every object whose content is plain.
    """
    return f"if(instr({text}, '\"content\":[') > 0, {read(text, CONTENTS)}.content, null)"


def or_empty(x: str) -> str:
    return f"coalesce({x}, '')"


def item(kind, role=NULL, text=NULL, call=NULL, name=NULL, args=NULL) -> str:
    cast = lambda x: f"cast({x} as string)"
    return (
        f"named_struct('kind', {kind}, 'role', {cast(role)}, 'text', {cast(text)}, "
        f"'call_id', {cast(call)}, 'name', {cast(name)}, 'args', {cast(args)})"
    )


def kept(items: str) -> str:
    return f"filter({items}, it -> it.kind is not null)"


def looks_json(text: str) -> str:
    return f"trim({text}) rlike '^[{{\\\\[]'"


def is_object(text: str) -> str:
    return f"trim({text}) rlike '^\\\\{{'"


def minified(text: str) -> str:
    """JSON text printed compactly; any other text as it is."""
    return f"if({looks_json(text)}, coalesce(get_json_object({text}, '$'), {text}), {text})"


def last_of(events: str, where: str, value: str) -> str:
    """Value of the last event ``e`` that satisfies ``where``; NULL without one."""
    return f"get(reverse(transform(filter({events}, e -> {where}), e -> {value})), 0)"


def part_text(p: str) -> str:
    """Text of a content part; a part that is not an object is its own text."""
    o = read(p, "type string, text string, input_text string")
    image = f"if({o}.type in ('input_image', 'image'), '[image]', {p})"
    return f"if({is_object(p)}, coalesce({o}.text, {o}.input_text, {image}), {p})"


def join_parts(parts: str) -> str:
    return f"array_join(transform({parts}, prt -> {part_text('prt')}), '\\n')"


def text_or_parts(text: str, parts: str) -> str:
    return f"if({parts} is not null, {join_parts(parts)}, {or_empty(text)})"


# -- messages[] of content blocks ---------------------------------------------

def assistant_block(b: str) -> str:
    text = item(MESSAGE, ASSISTANT, or_empty(f"{b}.text"))
    thought = item(REASONING, text=f"coalesce({b}.thinking, {b}.data, '')")
    call = item(TOOL_CALL, call=or_empty(f"{b}.id"), name=f"coalesce({b}.name, 'tool')", args=f"{b}.input")
    return (
        f"case when {b}.type = 'text' then {text} "
        f"when {b}.type in ('thinking', 'redacted_thinking') then {thought} "
        f"when {b}.type = 'tool_use' then {call} end"
    )


def user_block(b: str, parts: str) -> str:
    result = item(TOOL_RESULT, text=text_or_parts(f"{b}.content", parts), call=or_empty(f"{b}.tool_use_id"))
    return (
        f"case when {b}.type = 'tool_result' then {result} "
        f"when {b}.type = 'text' then {item(MESSAGE, USER, or_empty(f'{b}.text'))} end"
    )


def block_answer(blocks: str) -> str:
    """Items of an assistant turn given as an array of block texts."""
    opened = f"transform({blocks}, blk -> {read('blk', BLOCK)})"
    return kept(f"transform({opened}, ob -> {assistant_block('ob')})")


def message_items(messages: str) -> str:
    listed = "instr(msg, '\"content\":[') > 0"
    opened = (
        f"transform({messages}, msg -> struct(if({listed}, {read('msg', 'role string, content array<string>')}, null) as l, "
        f"if({listed}, null, {read('msg', 'role string, content string')}) as h))"
    )
    plain = "array(to_json(named_struct('type', 'text', 'text', m.h.content)))"
    blocks = f"coalesce(m.l.content, if(m.h.content is null, {NO_TEXTS}, {plain}))"
    spread = (
        f"flatten(transform({opened}, m -> transform({blocks}, blk -> struct("
        f"coalesce(coalesce(m.l.role, m.h.role) = 'assistant', false) as asst, {read('blk', BLOCK)} as b, "
        f"{content_list('blk')} as parts))))"
    )
    return kept(f"transform({spread}, s -> if(s.asst, {assistant_block('s.b')}, {user_block('s.b', 's.parts')}))")


# -- input[] / output[] entries -----------------------------------------------

def entry_item(e: str, parts: str) -> str:
    kind = f"coalesce(nullif({e}.type, ''), if({e}.role is not null, 'message', 'unknown'))"
    role = f"if({e}.role in ('assistant', 'system'), {e}.role, 'user')"
    summary = (
        f"case when size({e}.summary) > 0 then {join_parts(f'{e}.summary')} "
        f"when size({parts}) > 0 then {join_parts(parts)} else '' end"
    )
    out = f"{e}.output"
    output = (
        f"coalesce(if({looks_json(out)}, coalesce(get_json_object({out}, '$.output'), "
        f"get_json_object({out}, '$'), {out}), {out}), '')"
    )
    call_id = f"coalesce({e}.call_id, {e}.id, '')"
    call = item(
        TOOL_CALL, call=call_id, name=f"coalesce({e}.name, {e}.action.type, 'tool')",
        args=minified(f"coalesce({e}.arguments, {e}.input)"),
    )
    return (
        f"case when {kind} = 'message' then {item(MESSAGE, role, text_or_parts(f'{e}.content', parts))} "
        f"when {kind} = 'reasoning' then {item(REASONING, text=summary)} "
        f"when {kind} in ('function_call', 'custom_tool_call', 'local_shell_call') then {call} "
        f"when {kind} in ('function_call_output', 'custom_tool_call_output', 'local_shell_call_output') "
        f"then {item(TOOL_RESULT, text=output, call=call_id)} end"
    )


def entry_items(entries: str) -> str:
    opened = f"transform({entries}, ent -> struct({read('ent', ENTRY)} as e, {content_list('ent')} as parts))"
    return kept(f"transform({opened}, o -> {entry_item('o.e', 'o.parts')})")


# -- contents[] of parts ------------------------------------------------------

def part_item(model: str, p: str) -> str:
    fc, fr = f"{p}.functionCall", f"{p}.functionResponse"
    r = f"{fr}.response"
    fields = ", ".join(f"get_json_object({r}, '$.{k}')" for k in ("output", "result", "content", "error"))
    call = item(
        TOOL_CALL, call=f"coalesce({fc}.id, {fc}.name, '')", name=f"coalesce({fc}.name, 'tool')",
        args=f"coalesce({fc}.args, '{{}}')",
    )
    result = item(TOOL_RESULT, text=f"coalesce({fields}, {r}, '')", call=f"coalesce({fr}.id, {fr}.name, '')")
    return (
        f"case when {fc} is not null then {call} when {fr} is not null then {result} "
        f"when {p}.text is not null and coalesce({p}.thought, false) then {item(REASONING, text=f'{p}.text')} "
        f"when {p}.text is not null then {item(MESSAGE, f'if({model}, {ASSISTANT}, {USER})', f'{p}.text')} end"
    )


def content_items(contents: str) -> str:
    opened = f"transform({contents}, cnt -> {read('cnt', 'role string, parts array<string>')})"
    spread = (
        f"flatten(transform({opened}, c -> transform(coalesce(c.parts, {NO_TEXTS}), "
        f"prt -> struct(coalesce(c.role = 'model', false) as model, {read('prt', PART)} as p))))"
    )
    return kept(f"transform({spread}, s -> {part_item('s.model', 's.p')})")


def plain_parts(parts: str) -> str:
    """Texts of the parts that are not thoughts, one per line."""
    opened = f"transform({parts}, prt -> {read('prt', 'text string, thought boolean')})"
    spoken = f"filter({opened}, q -> q.text is not null and not coalesce(q.thought, false))"
    return f"array_join(transform({spoken}, q -> q.text), '\\n')"


# -- transcript[] turns -------------------------------------------------------

def assistant_turn(t: str) -> str:
    said = f"if({or_empty(f'{t}.content')} = '', {NO_ITEMS}, array({item(MESSAGE, ASSISTANT, f'{t}.content')}))"
    call = item(TOOL_CALL, call=or_empty("tc.id"), name="coalesce(tc.name, 'tool')", args="tc.arguments")
    return f"concat({said}, transform(coalesce({t}.tool_calls, cast(array() as {CALLS})), tc -> {call}))"


def turn_items(transcript: str) -> str:
    text = or_empty("t.content")
    return (
        f"flatten(transform(transform({transcript}, trn -> {read('trn', TURN)}), t -> "
        f"case when t.role = 'user' then array({item(MESSAGE, USER, text)}) "
        f"when t.role = 'tool' then array({item(TOOL_RESULT, text=text, call=or_empty('t.tool_call_id'))}) "
        f"when t.role = 'assistant' then {assistant_turn('t')} "
        f"when t.role = 'system' then array({item(MESSAGE, SYSTEM, text)}) else {NO_ITEMS} end))"
    )
