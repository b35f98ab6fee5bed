"""Sub-agent calls: the marker in the prompt and the name from the parent's call."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import items as I
from ..functions.text import collapse
from ..session import written

# Needle length -> (gram length, step): a needle of that length covers ``step``
# neighbouring grams, one of which starts at a multiple of the step in the text.
GRAMS = {48: (24, 25), 12: (8, 5), 3: (2, 2), 1: (1, 1)}


def marker(system_text: Column) -> Column:
    """The ``k=v`` pairs of the header line in a system prompt, as a map."""
    line = F.regexp_extract(system_text, r"x-anthropic-billing-header:\s*([^\n]*)", 1)
    pairs = F.filter(
        F.transform(F.split(line, ";"), lambda p: F.struct(
            F.trim(F.substring_index(p, "=", 1)).alias("k"),
            F.trim(F.substring(p, F.locate("=", p) + 1, F.length(p))).alias("v"), F.locate("=", F.trim(p)).alias("at"))),
        lambda x: x["at"] > 1,
    )
    # The last of repeated keys wins.
    distinct = F.array_distinct(F.transform(pairs, lambda x: x["k"]))
    return F.map_from_entries(F.transform(distinct, lambda k: F.struct(
        k.alias("key"), F.element_at(F.filter(pairs, lambda x: x["k"] == k), -1)["v"].alias("value"))))


def is_subagent(system_text: Column) -> Column:
    return F.coalesce(marker(system_text)["cc_is_subagent"] == "true", F.lit(False))


_TEXTS = (
    "flatten(transform(filter(transform({m}, msg -> struct(from_json(msg, 'role string, content string') as h, "
    "from_json(msg, 'content array<string>').content as l)), o -> o.h.role = 'user'), o -> if(o.l is not null, "
    "transform(filter(transform(o.l, b -> from_json(b, 'type string, text string')), b -> b.type = 'text'), b -> coalesce(b.text, '')), "
    "if(o.h.content is null, cast(array() as array<string>), array(o.h.content)))))"
)


def opened(calls: DataFrame) -> DataFrame:
    """Marker, opening user text and spawned agents of each call with messages.

    The opening is all user text of the call, of whatever length.
    """
    msgs = I.read("body", "messages array<string>") + ".messages"
    system = (
        "coalesce(array_join(transform(from_json(body, 'system array<string>').system, x -> coalesce(get_json_object(x, '$.text'), '')), '\\n'), "
        "get_json_object(body, '$.system'), '')"
    )
    upto = f"array_join({_TEXTS.format(m='msgs')}, ' ')"
    calls_in = (
        "flatten(transform(msgs, msg -> filter(transform(coalesce(from_json(msg, 'content array<string>').content, cast(array() as array<string>)), "
        "b -> from_json(b, 'type string, name string, input struct<prompt string, description string, subagent_type string>')), "
        "b -> b.type = 'tool_use' and b.name in ('Agent', 'Task') and coalesce(b.input.prompt, '') <> '')))"
    )
    c = calls.selectExpr("source_path", "block_start", "row_id", "session_id", f"{msgs} as msgs", f"{system} as system_text")
    c = c.where("msgs is not null").selectExpr("*", f"{calls_in} as spawned", f"{upto} as opening")
    return c.withColumn("is_subagent", is_subagent(F.col("system_text"))).withColumn("opening", collapse(F.col("opening")))


def spawns(opened_calls: DataFrame) -> DataFrame:
    """Distinct spawn prompts per log; the latest wording of label and type wins."""
    s = opened_calls.select("source_path", "block_start", "row_id", F.posexplode("spawned").alias("pos", "s"))
    s = s.select(
        "source_path", "block_start", "row_id", "pos", collapse(F.col("s.input.prompt")).alias("prompt"),
        F.coalesce(F.nullif(F.trim(F.col("s.input.description")), F.lit("")), F.lit("(unnamed agent)")).alias("label"),
        F.nullif(F.col("s.input.subagent_type"), F.lit("")).alias("agent_type"),
    )
    at = F.struct("block_start", "row_id", "pos")
    return s.groupBy("source_path", "prompt").agg(
        F.max_by("label", at).alias("label"), F.max_by("agent_type", at).alias("agent_type"), F.min(at).alias("first_at")
    )


def contains_join(
    texts: DataFrame, needles: DataFrame, keys: list[str], text: str, needle: str,
    text_id: list[str], needle_id: list[str],
) -> DataFrame:
    """Pairs where the text contains the needle, found through a shared gram.

    A text offers its grams at every step.  Whatever place a needle occurs at, one in
    ``step`` of its own grams falls on offered places, always those of one remainder; of
    each remainder it seeks the gram that the fewest texts offer, so boilerplate joins
    nothing as long as a needle has a word of its own.  A needle with a remainder whose
    gram no text offers is not sought there at all.  Grams travel with ids alone; the texts
    of the candidate pairs are fetched afterwards and compared in full.
    """
    sized = needles.where(F.length(needle) > 0).withColumn("_class", _needle_class(F.length(needle)))
    one = [*keys, "_one"]
    sized, texts_ = sized.withColumn("_one", F.lit(1)), texts.withColumn("_one", F.lit(1))
    classes = sized.select(*one, "_class").distinct()  # four a key at most; texts of other keys are not opened
    if not keys:
        classes = F.broadcast(classes)
    offered = texts_.join(classes, one).select(
        *keys, *text_id, "_class", F.explode(_by_class(lambda n, step: F.array_distinct(_grams(text, n, step)))).alias("_gram"))
    offered = written(offered, "offered")
    at = F.posexplode(_by_class(lambda n, step: _grams(needle, n, 1))).alias("_at", "_gram")
    own = sized.select(*keys, *needle_id, "_class", at)
    gram = [*keys, "_class", "_gram"]
    often = offered.join(own.select(*gram).distinct(), gram, "left_semi").groupBy(*gram).agg(F.count(F.lit(1)).alias("_n"))
    rest = F.col("_at") % _by_class(lambda n, step: F.lit(step))
    sought = own.join(often, gram, "left").groupBy(*keys, *needle_id, "_class", rest.alias("_rest")).agg(
        F.min(F.struct(F.coalesce("_n", F.lit(0)).alias("n"), "_gram")).alias("_best"))
    sought = sought.where("_best.n > 0").select(*keys, *needle_id, "_class", F.col("_best._gram").alias("_gram"))
    pairs = offered.join(sought, gram).select(*keys, *text_id, *needle_id).distinct()
    whole = pairs.join(needles, [*keys, *needle_id]).join(texts, [*keys, *text_id])
    return whole.where(F.contains(F.col(text), F.col(needle)))


def _by_class(made) -> Column:
    """Of the expressions for the gram classes the one that ``_class`` names."""
    out = None
    for size, (n, step) in GRAMS.items():
        here = made(n, step)
        out = F.when(F.col("_class") == size, here) if out is None else out.when(F.col("_class") == size, here)
    return out


def _grams(text: str, n: int, step: int) -> Column:
    """Hashes of the stretches of n characters at every ``step`` from 0.

    Four bytes per character, so that a stretch is cut out in constant time.
    """
    ends = F.floor((F.length(text) - n) / step)
    places = F.when(ends >= 0, F.transform(F.sequence(F.lit(0), F.greatest(ends, F.lit(0))), lambda i: i * step))

    def cut(wide: Column) -> Column:
        return F.transform(places, lambda i: F.xxhash64(F.substring(wide, i.cast("int") * 4 + 1, F.lit(4 * n))))

    return F.flatten(F.transform(F.array(F.encode(F.col(text), "UTF-32")), cut))


def _needle_class(length: Column) -> Column:
    out = F.lit(1)
    for size in sorted(GRAMS)[1:]:
        out = F.when(length >= size, F.lit(size)).otherwise(out)
    return out


def name_subagents(opened_calls: DataFrame) -> DataFrame:
    """Per call: is it a sub-agent's, and the label and type of its spawn.

    The longest prompt found in the child's opening wins, then the first seen.
    A marked call whose spawn was not captured stays unnamed.
    """
    ids = ["source_path", "block_start", "row_id"]
    child = opened_calls.where("is_subagent and opening <> ''").select(*ids, "opening")
    named = spawns(opened_calls).withColumn("prompt_id", F.xxhash64("prompt"))
    hits = contains_join(
        child, named, ["source_path"], "opening", "prompt", ["block_start", "row_id"], ["prompt_id"]
    )
    rank = F.struct(-F.length("prompt"), F.col("first_at"))
    best = hits.groupBy(*ids).agg(
        F.min_by("label", rank).alias("agent_label"), F.min_by("agent_type", rank).alias("agent_type")
    )
    return opened_calls.select(*ids, "session_id", "is_subagent").join(best, ids, "left")
