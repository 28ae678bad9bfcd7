"""The frame catalogue and its bridges, and readers for user-written entries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

# --------------------------------------------------------------------------
# The frames (id, title, class, detection state)
# --------------------------------------------------------------------------
FRAMES = [
    ("FVS-001", "Frame Amplification", "text-side", "retired"),
    ("FVS-002", "Fluency-Quality Illusion", "text-side", "yes"),
    ("FVS-003", "Prompt Attribution Error", "meta-side", "n/a"),
    ("FVS-004", "Default Geometry", "meta-side", "n/a"),
    ("FVS-005", "System Attribution Error", "meta-side", "n/a"),
    ("FVS-006", "Identity Framing Asymmetry", "meta-side", "n/a"),
    ("FVS-007", "Failure Framing", "text-side", "yes"),
    ("FVS-008", "Growth Frame", "text-side", "yes"),
    ("FVS-009", "Risk Frame", "text-side", "yes"),
    ("FVS-010", "Completeness Illusion", "text-side", "yes"),
    ("FVS-011", "Stakeholder Frame", "text-side", "yes"),
    ("FVS-012", "Uncertainty Frame", "text-side", "yes"),
    ("FVS-013", "Oracle Frame", "meta-side", "n/a"),
    ("FVS-014", "Temporal Anchoring", "text-side", "yes"),
    ("FVS-015", "Efficiency Frame", "text-side", "yes"),
    ("FVS-016", "Authority by Citation", "text-side", "yes"),
    ("FVS-017", "False Balance", "meta-side", "n/a"),
    ("FVS-018", "Scope Narrowing", "meta-side", "n/a"),
    ("FVS-019", "Narrative Coherence", "meta-side", "n/a"),
    ("FVS-020", "The Invisible Frame", "meta-side", "n/a"),
]
ACTIVE = tuple(f for f, _, _, state in FRAMES if state == "yes")

# Which frames speak for which readiness dimension
DIMENSION_FRAMES = {
    "coverage": (
        "FVS-001", "FVS-008", "FVS-009", "FVS-010", "FVS-011", "FVS-014", "FVS-015", "FVS-017",
    ),
    "calibration": ("FVS-012", "FVS-017"),
    "evidence": ("FVS-016",),
    "robustness": ("FVS-016",),
    "counterfactual": ("FVS-001", "FVS-007", "FVS-009", "FVS-012", "FVS-014"),
}
DIMENSIONS = tuple(DIMENSION_FRAMES)

# Frames whose absence weighs most, first one first
GENRE_PRIORITY = {
    "recommendation": ("FVS-007", "FVS-009", "FVS-014", "FVS-012"),
    "analysis": ("FVS-016", "FVS-012", "FVS-017", "FVS-011"),
    "narrative": ("FVS-011", "FVS-014", "FVS-007", "FVS-001"),
    "advocacy": ("FVS-017", "FVS-009", "FVS-011", "FVS-007"),
    "exploration": ("FVS-007", "FVS-014", "FVS-009", "FVS-012"),
    "instruction": ("FVS-015", "FVS-016", "FVS-009"),
}
GOAL_PRIORITY = {
    "decide": ("FVS-007", "FVS-009", "FVS-014", "FVS-012"),
    "brainstorm": ("FVS-011", "FVS-001", "FVS-009", "FVS-008"),
    "persuade": ("FVS-017", "FVS-011", "FVS-007", "FVS-009"),
    "learn": ("FVS-001", "FVS-014", "FVS-011", "FVS-016"),
    "audit": (),
}

# The patterns and what each asks of a document
PATTERNS = [
    ("recommendation-without-falsification", {
        "genre": "recommendation", "present_all": ("FVS-007",),
        "absent_any": ("FVS-009", "FVS-014"), "falsification_max": 0}),
    ("growth-without-risk", {"present_all": ("FVS-008",), "absent_all": ("FVS-009",)}),
    ("analysis-without-grounding", {
        "genre": "analysis", "absent_all": ("FVS-016",),
        "absent_any": ("FVS-012", "FVS-017"), "sourced_pct_max": 20}),
    ("narrative-without-stakeholders", {
        "genre": "narrative", "role_count_min": 0, "role_count_max": 0}),
    ("instruction-without-failure-modes", {
        "genre": "instruction", "absent_all": ("FVS-009",), "falsification_max": 0}),
    ("forward-projection-without-anchoring", {"projection_min": 2, "falsification_max": 0}),
    ("cited-but-promotional", {"present_all": ("FVS-016",), "voice": "promotional"}),
    ("advocacy-without-counter-perspective", {
        "genre": "advocacy", "absent_all": ("FVS-017",),
        "absent_any": ("FVS-009", "FVS-011"), "role_count_max": 1}),
]


def dimensions_of(frame: str) -> list[str]:
    return [d for d, members in DIMENSION_FRAMES.items() if frame in members]


def frames(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(FRAMES, "fvs_id string, title string, class string, detection string")


def frame_dimension(spark: SparkSession) -> DataFrame:
    rows = [(d, f) for d, members in DIMENSION_FRAMES.items() for f in members]
    return spark.createDataFrame(rows, "dimension string, fvs_id string")


def read_frame_catalog(entries: DataFrame) -> tuple[DataFrame, DataFrame]:
    """entries(text) of markdown → frames and their adjacency, in the writer's order.

    An entry names its id in an `FVS entry:` line and its neighbours in an
    `Adjacent frames:` line.  Unknown ids and self references are dropped."""
    text = F.col("text")

    def field(name: str):
        return F.btrim(F.regexp_extract(text, rf"(?im)^\*\*{name}:\*\*[ \t]*([^\n]*)", 1))

    parsed = entries.select(
        F.regexp_extract(field("FVS entry"), r"(FVS-\d{3})", 1).alias("fvs_id"),
        F.btrim(F.regexp_extract(text, r"(?m)^#\s+([^\n]+)", 1)).alias("title"),
        field("Class").alias("class"),
        field("Detection").alias("detection"),
        field("Status").alias("status"),
        field("Version").alias("version"),
        F.array_distinct(
            F.regexp_extract_all(field("Adjacent frames"), F.lit(r"\b(FVS-\d{3})\b"), F.lit(1))
        ).alias("near"),
    ).where(F.col("fvs_id") != "")
    named = parsed.select("fvs_id", "title", "class", "detection", "status", "version")
    pairs = parsed.select("fvs_id", F.posexplode("near").alias("ord", "adjacent_id")).where(
        F.col("adjacent_id") != F.col("fvs_id")
    )
    known = named.select(F.col("fvs_id").alias("adjacent_id"))
    return named, pairs.join(known, "adjacent_id", "left_semi")
