"""What a session is about, from its user steps or else its tools."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .text import clip

# Openings of user steps that are harness chatter.
NOISE_PREFIXES = [
    "<system-reminder>", "<transcript>", "<command-name>", "<local-command-stdout>", "<command-message>",
    "<local-command-caveat>", "[system notification - not user input]", "## exited plan mode",
    "this session is being continued from a previous conversation", "note: ",
    "critical: respond with text only", "the task tools haven't been used recently",
    "the following is the user's claude.md configuration",
    "caveat: the messages below were generated by the user while running local commands", "<analysis>",
    "the user sent a new message while you were working", "subagent has finished and is handing back control",
    "<user-prompt-submit-hook>", "[request interrupted by user]", "[suggestion mode:", "web page content:",
]
OUTPUT_STYLE = r"^[A-Z][\w -]* output style is active\b"
HOOK_OUTPUT = r"^[A-Z][A-Za-z]+ hook (success|failed|additional context)\b"
INJECTED_FILE = r"^contents of /\S+\s*:"
TOOL_ECHO = r"^(called|result of calling) the \S+ tool\b"
INTERJECTION = (
    r"(?is)^the user sent a new message while you were working:\s*(.*?)"
    r"(?:\s*this is how claude code surfaces|$)"
)
SESSION_WRAP = r"(?is)^<(session|conversation)>(.*?)</\1>"
TITLE_CHARS, ROLE_CHARS = 120, 64


def unwrapped(raw: Column) -> Column:
    """Struct(text, is_result): the step without its one-key envelope."""
    t = F.regexp_replace(raw, r"(?U)^\s+|\s+$", "")
    wrap = F.regexp_extract(t, SESSION_WRAP, 2)
    is_wrap = t.rlike(SESSION_WRAP)
    obj = F.try_parse_json(t)
    keys = F.json_object_keys(t)
    key = F.get(keys, F.lit(0))
    value = F.get(F.map_values(F.from_json(t, "map<string,string>")), F.lit(0))
    kind = F.schema_of_variant(obj)
    dump = t.startswith('{"') & obj.isNull()
    one = t.startswith("{") & (F.size(keys) == 1) & kind.rlike(": STRING>$")
    return F.struct(
        F.when(is_wrap, F.trim(wrap)).when(dump, F.lit("")).when(one, F.trim(value)).otherwise(t).alias("text"),
        F.when(is_wrap, F.lit(False)).when(dump, F.lit(True)).when(one, key != "user").otherwise(F.lit(False)).alias("is_result"),
    )


def is_noise(u: Column) -> Column:
    """``u`` is the struct of ``unwrapped``."""
    text = u["text"]
    low = F.lower(text)
    starts = F.exists(F.array(*[F.lit(p) for p in NOISE_PREFIXES]), lambda p: F.startswith(low, p))
    return (
        u["is_result"] | low.isin("", "<transcript>", "</transcript>") | low.rlike(INJECTED_FILE) | low.rlike(TOOL_ECHO)
        | text.rlike(OUTPUT_STYLE) | text.rlike(HOOK_OUTPUT) | starts
    )


def interjection(u: Column) -> Column:
    said = F.trim(F.regexp_extract(u["text"], INTERJECTION, 1))
    return F.when(u["is_result"], F.lit("")).otherwise(said)


def ask_title(text: Column, n: int = TITLE_CHARS) -> Column:
    """A role prompt is cut to its first sentence, any other ask at n characters."""
    sentence = F.regexp_extract(text, r"(?s)^(.{12,}?[.?!])(?:\s|$)", 1)
    # The sentence ends at the first stop; one before character 12 does not count.
    first_stop = F.regexp_instr(text, F.lit(r"[.?!](?:\s|$)"))
    role = F.when(first_stop >= 13, clip(sentence, n)).otherwise(clip(text, min(n, ROLE_CHARS)))
    return F.when(text.rlike(r"(?i)^you are\b"), role).otherwise(clip(text, n))


def session_titles(steps: DataFrame, keys: list[str] = ("session_id",)) -> DataFrame:
    """First ask among all user steps, else the first interjection, else ''."""
    keys = list(keys)
    s = steps.where("role = 'user'").withColumn("u", unwrapped(F.coalesce("message", F.lit(""))))
    ask = F.when(~is_noise(F.col("u")) & (F.col("u.text") != ""), ask_title(F.col("u.text")))
    aside = F.nullif(interjection(F.col("u")), F.lit(""))
    s = s.select(*keys, "step_index", ask.alias("ask"), F.when(aside.isNotNull(), clip(aside, TITLE_CHARS)).alias("aside"))
    first_of = lambda c: F.min_by(c, F.when(F.col(c).isNotNull(), F.col("step_index")))
    return s.groupBy(*keys).agg(F.coalesce(first_of("ask"), first_of("aside"), F.lit("")).alias("title"))


def activity_title(histogram: Column, n: int = 3) -> Column:
    """``Bash ×34 · Read ×12``: the most called tools, by count then name."""
    entries = F.filter(F.map_entries(histogram), lambda e: (e["key"] != "") & (e["value"] > 0))
    ranked = F.array_sort(F.transform(entries, lambda e: F.struct((-e["value"]).alias("n"), e["key"].alias("k"))))
    return F.array_join(
        F.transform(F.slice(ranked, 1, n), lambda e: F.concat(e["k"], F.lit(" ×"), (-e["n"]).cast("string"))), " · "
    )
