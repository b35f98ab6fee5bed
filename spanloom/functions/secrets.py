"""Detection and redaction of secrets with built-in expressions."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Detector:
    """A pattern; its token is the group, kept only above the entropy gate."""

    kind: str
    pattern: str
    group: int = 0
    strict: bool = False
    min_entropy: float = 0.0
    mixed: bool = False  # token must hold lower case, upper case and a digit
    keep: str = "{}"  # replacement around the placeholder
    hints: tuple[str, ...] = ()  # every match holds one of these; spares the pattern


# The detectors, in the order they are applied.
_ENV_KEY = r"\b([A-Z][A-Z0-9_]*(?:KEY|TOKEN|SECRET|PASSWORD|PASSWD|PASS|PWD|CREDENTIAL))\s*=\s*(\"?)"
DETECTORS = [
    Detector("jwt", r"\beyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\b", hints=("eyJ",)),
    Detector("openai_key", r"\bsk-(?:proj-)?[A-Za-z0-9_-]{20,}\b", hints=("sk-",)),
    Detector("github_token", r"\bgh[pousr]_[A-Za-z0-9]{20,255}\b", hints=("ghp_", "gho_", "ghu_", "ghs_", "ghr_")),
    Detector("github_token", r"\bgithub_pat_[A-Za-z0-9_]{20,255}\b", hints=("github_pat_",)),
    Detector("slack_token", r"\bxox[baprs]-[A-Za-z0-9-]{10,}\b", hints=("xox",)),
    Detector("aws_access_key_id", r"(?<![A-Za-z0-9])(?:AKIA|ASIA)[0-9A-Z]{16}(?![0-9A-Za-z])", hints=("AKIA", "ASIA")),
    Detector("bearer_token", r"\bBearer\s+([A-Za-z0-9._~+/=-]{20,})", 1, keep="Bearer {}", hints=("Bearer",)),
    Detector(
        "aws_secret_access_key", r"(?<![A-Za-z0-9/+=])([A-Za-z0-9/+]{40})(?![A-Za-z0-9/+=])", 1,
        strict=True, min_entropy=4.0, mixed=True,
    ),
    Detector("env_secret", _ENV_KEY + r"([^\s\"';,]{12,})\2", 3, strict=True, min_entropy=3.2, keep="$1=$2{}$2"),
]
PLACEHOLDER = r"\[REDACTED:([a-z_]+)\]"
# Any text a standard detector can match holds one of these; so may one with
# escaped characters.
STANDARD_HINT = r"eyJ|sk-|gh[pousr]_|github_pat_|xox[baprs]-|AKIA|ASIA|Bearer|\\u00"


def active(mode: str, detectors: list[Detector] = DETECTORS) -> list[Detector]:
    if mode == "off":
        return []
    return [d for d in detectors if mode == "strict" or not d.strict]


def entropy(c: Column) -> Column:
    """Shannon entropy in bits per character; 0 for an empty text."""
    n = F.length(c).cast("double")
    chars = F.split(c, "")
    share = lambda ch: F.size(F.filter(chars, lambda x: x == ch)) / n
    bits = F.aggregate(F.array_sort(F.array_distinct(chars)), F.lit(0.0), lambda a, ch: a - share(ch) * F.log2(share(ch)))
    return F.when(n > 0, bits).otherwise(F.lit(0.0))


def _passes(d: Detector, t: Column) -> Column:
    ok = ~F.contains(t, F.lit("[REDACTED:"))
    if d.mixed:
        ok = ok & t.rlike("[a-z]") & t.rlike("[A-Z]") & t.rlike("[0-9]")
    if d.min_entropy:
        ok = ok & (entropy(t) > d.min_entropy)
    return ok


def _hinted(d: Detector, text: Column) -> Column:
    out = F.contains(text, F.lit(d.hints[0]))
    for h in d.hints[1:]:
        out = out | F.contains(text, F.lit(h))
    return out


def _tokens(d: Detector, text: Column) -> Column:
    """Tokens of one detector that pass its gate, repeats included."""
    found = F.filter(F.regexp_extract_all(text, F.lit(d.pattern), d.group), lambda t: _passes(d, t))
    return F.when(_hinted(d, text), found).otherwise(F.array().cast("array<string>")) if d.hints else found


def _named(d: Detector, text: Column) -> Column:
    return F.transform(_tokens(d, text), lambda t: F.struct(F.lit(d.kind).alias("kind"), t.alias("token")))


def find(text: Column, mode: str = "standard", detectors: list[Detector] = DETECTORS) -> Column:
    """Array of struct(kind, token), detectors in order."""
    found = [_named(d, text) for d in active(mode, detectors)]
    return F.concat(*found) if found else F.array().cast("array<struct<kind:string,token:string>>")


def _mask(d: Detector, text: Column) -> Column:
    mark = d.keep.format(f"[REDACTED:{d.kind}]")
    if not d.min_entropy:
        masked = F.regexp_replace(text, d.pattern, mark)
        return F.when(_hinted(d, text), masked).otherwise(text) if d.hints else masked

    def at(token: Column) -> Column:
        """Pattern of the places where this token stands alone."""
        quoted = F.regexp_replace(token, r"([^A-Za-z0-9_])", r"\\$1")
        if d.kind == "env_secret":
            return F.concat(F.lit(_ENV_KEY), quoted, F.lit(r"\2(?=[\s\"';,]|$)"))
        return F.concat(F.lit("(?<![A-Za-z0-9/+=])"), quoted, F.lit("(?![A-Za-z0-9/+=])"))

    # Gated: only the tokens that pass are replaced.
    return F.aggregate(
        F.array_distinct(_tokens(d, text)), text, lambda acc, token: F.regexp_replace(acc, at(token), F.lit(mark))
    )


def redact(text: Column, mode: str = "standard", detectors: list[Detector] = DETECTORS) -> Column:
    """Text with every secret replaced by a typed placeholder."""
    for d in active(mode, detectors):
        text = _once(text, d)
    return text


def _once(text: Column, d: Detector) -> Column:
    """Mask with the text bound to a name, so that it is computed once per detector."""
    return F.get(F.transform(F.array(text), lambda t: _mask(d, t)), F.lit(0))


def fingerprint(token: Column) -> Column:
    return F.substring(F.sha2(token, 256), 1, 12)


def last4(token: Column) -> Column:
    return F.when(F.length(token) >= 8, F.right(token, F.lit(4))).otherwise(F.lit(""))


def count_redactions(text: Column) -> Column:
    return F.size(F.regexp_extract_all(text, F.lit(PLACEHOLDER), 1))


def redaction_kinds(text: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(text, F.lit(PLACEHOLDER), 1))


# Names of headers whose values are masked.
SENSITIVE_HEADERS = [
    "authorization", "x-api-key", "x-goog-api-key", "x-auth-token", "cookie", "set-cookie", "x-session-token",
    "x-access-token", "bearer", "proxy-authorization",
]


def mask_headers(headers: Column) -> Column:
    """Sensitive header values keep 10 + 4 or 2 + 2 characters, short ones none."""
    def masked(v: Column) -> Column:
        return (
            F.when(F.length(v) > 14, F.concat(F.left(v, F.lit(10)), F.lit("..."), F.right(v, F.lit(4))))
            .when(F.length(v) > 4, F.concat(F.left(v, F.lit(2)), F.lit("..."), F.right(v, F.lit(2))))
            .otherwise(F.lit("[REDACTED]"))
        )

    hit = lambda k: F.exists(F.array(*[F.lit(s) for s in SENSITIVE_HEADERS]), lambda s: F.contains(F.lower(k), s))
    present = F.map_filter(headers, lambda k, v: v.isNotNull())
    return F.transform_values(present, lambda k, v: F.when(hit(k), masked(v)).otherwise(v))
