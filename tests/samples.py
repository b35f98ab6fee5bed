"""Hand-written captured pairs in the four wire shapes."""

import json


def event(obj, name=None):
    return (f"event: {name}\n" if name else "") + "data: " + json.dumps(obj) + "\n\n"


def message_stream(text, call=None, usage=(10, 5, 7, 20), model="claude-opus-4-x"):
    tin, cc, cr, out = usage
    half = len(text) // 2
    s = event({"type": "message_start", "message": {"model": model, "usage": {
        "input_tokens": tin, "cache_creation_input_tokens": cc, "cache_read_input_tokens": cr, "output_tokens": 1}}})
    s += event({"type": "content_block_start", "index": 0, "content_block": {"type": "text", "text": ""}})
    for part in (text[:half], text[half:]):
        s += event({"type": "content_block_delta", "index": 0, "delta": {"type": "text_delta", "text": part}})
    if call:
        call_id, name, args = call
        s += event({"type": "content_block_start", "index": 1, "content_block": {"type": "tool_use", "id": call_id, "name": name, "input": {}}})
        raw = json.dumps(args)
        for part in (raw[:4], raw[4:]):
            s += event({"type": "content_block_delta", "index": 1, "delta": {"type": "input_json_delta", "partial_json": part}})
    return s + event({"type": "message_delta", "delta": {"stop_reason": "tool_use" if call else "end_turn"}, "usage": {"output_tokens": out}})


def messages_pair(ts, messages, stream=None, system="sys", model="claude-opus-4-x", tools=None, headers=None, url="https://h/v1/messages", status=200):
    body = {"model": model, "system": system, "messages": messages}
    if tools:
        body["tools"] = tools
    resp = None
    if stream is not None:
        resp = {"timestamp": ts + 1.5, "first_byte_timestamp": ts + 0.5, "status_code": status, "headers": {}, "body_raw": stream}
    return {"request": {"timestamp": ts, "method": "POST", "url": url, "headers": headers or {}, "body": body}, "response": resp}


UUID = "12345678-1234-1234-1234-123456789abc"
TURN1 = [{"role": "user", "content": "list files"}]
TURN2 = TURN1 + [
    {"role": "assistant", "content": [{"type": "text", "text": "on it"}, {"type": "tool_use", "id": "t1", "name": "Bash", "input": {"cmd": "ls"}}]},
    {"role": "user", "content": [{"type": "tool_result", "tool_use_id": "t1", "content": [{"type": "text", "text": "a.txt"}, {"type": "image"}]}]},
]
TURN3 = TURN2 + [
    {"role": "assistant", "content": "done"},
    {"role": "user", "content": [{"type": "tool_result", "tool_use_id": "lost", "content": "error: denied"}, {"type": "text", "text": "thanks"}]},
]
CLAUDE = [
    messages_pair(100.0, TURN1, message_stream("on it", ("t1", "Bash", {"cmd": "ls"})), headers={"X-Claude-Code-Session-Id": UUID}),
    messages_pair(103.0, TURN2, message_stream("done"), headers={"X-Claude-Code-Session-Id": UUID}),
    messages_pair(106.0, TURN3, None),
]
CODEX = [{
    "request": {"timestamp": 104, "url": "u", "headers": {}, "body": {
        "model": "gpt-5", "prompt_cache_key": "K", "instructions": "sysB",
        "input": [
            {"role": "user", "content": [{"type": "input_text", "text": "q"}]},
            {"type": "function_call", "call_id": "c1", "name": "sh", "arguments": "{\"cmd\": \"ls\"}"},
            {"type": "function_call_output", "call_id": "c1", "output": "{\"output\":\"done\"}"}]}},
    "response": {"status_code": 200, "body_raw": event({"type": "response.completed", "response": {
        "model": "gpt-5.1", "status": "completed",
        "usage": {"input_tokens": 3, "output_tokens": 4, "input_tokens_details": {"cached_tokens": 2}, "output_tokens_details": {"reasoning_tokens": 1}},
        "output": [{"type": "reasoning", "summary": [{"type": "summary_text", "text": "think"}]},
                   {"type": "message", "role": "assistant", "content": [{"type": "output_text", "text": "ans"}]}]}}, "response.completed")},
}]
CODEX_TORN = [{
    "request": {"timestamp": 107, "url": "u", "body": {"model": "g", "instructions": "x", "input": []}},
    "response": {"status_code": 200, "body_raw":
        event({"output_index": 0, "item": {"type": "message", "role": "assistant", "content": []}}, "response.output_item.added")
        + event({"output_index": 0, "delta": "par"}, "response.output_text.delta")
        + event({"output_index": 0, "delta": "tial"}, "response.output_text.delta")
        + event({"output_index": 1, "delta": "{\"a\":1}", "name": "f"}, "response.function_call_arguments.delta")},
}]
GEMINI = [{
    "request": {"timestamp": 105, "url": "https://g/models/gemini-2.5-pro:streamGenerateContent", "body": {
        "systemInstruction": {"parts": [{"text": "sg"}]},
        "contents": [{"role": "user", "parts": [{"text": "hey"}]},
                     {"role": "model", "parts": [{"functionCall": {"name": "ls", "args": {"p": 1}}}]},
                     {"role": "user", "parts": [{"functionResponse": {"name": "ls", "response": {"output": "files"}}}]}]}},
    "response": {"status_code": 200, "body": [
        {"candidates": [{"content": {"parts": [{"text": "a"}]}}]},
        {"candidates": [{"content": {"parts": [{"text": "b"}, {"text": "t", "thought": True}]}, "finishReason": "STOP"}],
         "usageMetadata": {"promptTokenCount": 9, "candidatesTokenCount": 2, "thoughtsTokenCount": 1}, "modelVersion": "gv"}]},
}]
DEVIN = [{
    "request": {"timestamp": 106, "url": "devin://x", "body": {
        "provider": "devin", "session_id": "S", "model": "dm", "system": "Today's date: X\nfoo",
        "transcript": [{"role": "user", "content": "do"},
                       {"role": "assistant", "content": "ok", "tool_calls": [{"id": "1", "name": "n", "arguments": {"z": 1}}]},
                       {"role": "tool", "content": "r", "tool_call_id": "1"}]}},
    "response": {"status_code": 200, "body": {
        "provider": "devin", "model": "dm2", "finish_reason": "stop", "message": {"role": "assistant", "content": "fin"},
        "usage": {"input_tokens": 1, "output_tokens": 2, "cache_read_tokens": 3, "cache_creation_tokens": 4}}},
}]


def write_log(folder, name, pairs, extra=""):
    folder.mkdir(parents=True, exist_ok=True)
    path = folder / name
    path.write_text("".join(json.dumps(p) + "\n" for p in pairs) + extra)
    return path
