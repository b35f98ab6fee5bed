"""Where secrets went: findings per payload location, grouped and totalled."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.secrets import DETECTORS, STANDARD_HINT, Detector, count_redactions, find, fingerprint, last4, redact


@F.pandas_udf(T.ArrayType(T.StructType().add("location", "string").add("text", "string")))
def json_leaves(bodies: pd.Series) -> pd.Series:
    """String leaves of a JSON text with a location label: first field, its index,
    and the nearest role."""
    def walk(v, path, role, out):
        if isinstance(v, str):
            label = str(path[0]) if path else "(body)"
            if len(path) > 1 and isinstance(path[1], int):
                label += f"[{path[1]}]"
            out.append((label + (f" ({role})" if role else ""), v))
        elif isinstance(v, list):
            for i, x in enumerate(v):
                walk(x, [*path, i][:2], role, out)
        elif isinstance(v, dict):
            role = v["role"] if isinstance(v.get("role"), str) else role
            for k, x in v.items():
                walk(x, [*path, k][:2], role, out)
        return out

    def leaves(body):
        if body is None:
            return []
        try:
            value = json.loads(body)
        except ValueError:
            value = body
        return [{"location": a, "text": b} for a, b in walk(value, [], None, [])]

    return bodies.map(leaves)


def hint_of(mode: str = "standard", detectors: list[Detector] = DETECTORS) -> str | None:
    """Pattern that every body with a match holds; None when no such pattern is known.

    The standard pattern serves the detectors it was made for and no others.
    """
    return STANDARD_HINT if mode == "standard" and all(d in DETECTORS for d in detectors) else None


def payloads(pairs: DataFrame, mode: str = "standard", detectors: list[Detector] = DETECTORS) -> DataFrame:
    """(ids, direction, location, text) of every body text of the pairs.

    Where a hint for the detectors is known only bodies that hold it are opened.
    """
    hint = hint_of(mode, detectors)
    ids = ["source_path", "block_start", "row_id"]
    side = F.explode(F.array(
        F.struct(F.lit("egress").alias("direction"), F.col("request.body").alias("body"), F.lit(None).cast("string").alias("raw")),
        F.struct(F.lit("response").alias("direction"), F.col("response.body").alias("body"), F.col("response.body_raw").alias("raw")),
    )).alias("s")
    p = pairs.select(*ids, F.coalesce("request.timestamp", F.lit(0.0)).alias("ts"), side).select(*ids, "ts", "s.*")
    if hint:
        p = p.where(F.coalesce(F.col("body").rlike(hint), F.lit(False)) | F.coalesce(F.col("raw").rlike(hint), F.lit(False)))
    leaves = p.where("body is not null").select(*ids, "ts", "direction", F.explode(json_leaves("body")).alias("l"))
    raw = p.where("raw is not null").select(*ids, "ts", "direction", F.lit("response").alias("location"), F.col("raw").alias("text"))
    return leaves.select(*ids, "ts", "direction", "l.location", "l.text").unionByName(raw)


def scan(texts: DataFrame, mode: str = "standard", detectors: list[Detector] = DETECTORS) -> DataFrame:
    """Findings of a frame with a ``text`` column; the token itself is not kept."""
    keep = [c for c in texts.columns if c != "text"]
    f = texts.select(*keep, F.explode(find(F.col("text"), mode, detectors)).alias("f"))
    t = F.col("f.token")
    return f.select(
        *keep, F.col("f.kind").alias("detector"), fingerprint(t).alias("fingerprint"),
        F.length(t).alias("token_length"), last4(t).alias("last4"),
    )


def group_findings(findings: DataFrame) -> DataFrame:
    """One row per secret: counts by direction, spread, first and last known time.

    The places themselves are the rows of ``finding_places``, as a secret may
    stand in any number of them.
    """
    known = F.when(F.col("ts") > 0, F.col("ts"))
    return findings.groupBy("fingerprint", "detector").agg(
        F.min("token_length").alias("token_length"), F.min("last4").alias("last4"),
        F.count(F.when(F.col("direction") == "egress", 1)).alias("egress"),
        F.count(F.when(F.col("direction") != "egress", 1)).alias("response"),
        F.countDistinct("location").alias("locations"), F.countDistinct("source_path").alias("files"),
        F.coalesce(F.min(known), F.lit(0.0)).alias("first_ts"), F.coalesce(F.max(known), F.lit(0.0)).alias("last_ts"),
    )


def finding_places(findings: DataFrame) -> DataFrame:
    return findings.groupBy("fingerprint", "detector", "source_path", "location").agg(F.count(F.lit(1)).alias("hits"))


def audit_totals(findings: DataFrame, texts: DataFrame | None = None) -> DataFrame:
    """Totals by direction; with the texts also what each redaction would mask."""
    out = findings.agg(
        F.count(F.when(F.col("direction") == "egress", 1)).alias("egress"),
        F.count(F.when(F.col("direction") != "egress", 1)).alias("response"),
        F.countDistinct("fingerprint").alias("secrets"),
    )
    if texts is None:
        return out
    masked = lambda m: F.coalesce(F.sum(count_redactions(redact(F.col("text"), m))), F.lit(0)).alias(f"{m}_masked")
    cover = texts.agg(masked("standard"), masked("strict")).withColumn("_one", F.lit(1))
    return out.withColumn("_one", F.lit(1)).join(cover, "_one").drop("_one")


def unscanned(files: DataFrame, scans: DataFrame, mode: str, redact_check: bool = False) -> DataFrame:
    """Files whose version has no recorded scan in this mode."""
    done = scans.where((F.col("mode") == mode) & (F.col("redact_check") == redact_check))
    return files.join(done.select("source_path", "content_hash"), ["source_path", "content_hash"], "left_anti")
