"""Applications to candidates."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from screenforge.functions.text import resolve_role
from screenforge.operators.dedup import dedup_first, new_applications
from screenforge.operators.documents import Decoder, extract_text
from screenforge.operators.extraction import Model, build_prompts, extract_fields, fallback_chain, parse_replies
from screenforge.operators.filters import drop_nameless, valid_extractions
from screenforge.functions.experience import clean_experience, numeric_experience
from screenforge.schemas import CANDIDATE
from screenforge.session import materialize


def clean_applications(applications: DataFrame) -> DataFrame:
    """Role resolved, experience in years, rows without a name dropped."""
    cleaned = clean_experience(applications.withColumn("role", resolve_role(F.col("role_raw"))), "experience_raw")
    if "experience_number" in applications.columns:
        number = F.col("experience_number")
        cleaned = cleaned.withColumn("experience", F.when(number.isNotNull(), numeric_experience(number)).otherwise(F.col("experience")))
    return drop_nameless(valid_extractions(cleaned)).select(*CANDIDATE.fieldNames())


def register(applications: DataFrame, stored: DataFrame | None = None) -> DataFrame:
    """The applications that become candidates: cleaned, first per role and email, not stored yet.

    Against a stored table the accepted rows are written to the scratch folder first, as the comparison reads
    them more than once and files must not be decoded, nor models asked, again.
    """
    accepted = dedup_first(clean_applications(applications))
    return accepted if stored is None else new_applications(materialize(accepted, "accepted"), stored)


def read_applications(
    files: DataFrame,
    as_of: dt.date,
    models: list[tuple[str, Model]] | None = None,
    decoders: dict[str, Decoder] | None = None,
    fallbacks: dict[str, Decoder] | None = None,
) -> DataFrame:
    """Resume files with ``application_id``, ``applied_at`` and ``role_raw`` to applications.

    With ``models`` the fields come from their replies, else from the text by rule. File contents
    are dropped as soon as the text is known.
    """
    kept = ("application_id", "applied_at", "role_raw")
    texts = extract_text(files, decoders, fallbacks).select(*kept, "text")
    if models:
        fields = parse_replies(fallback_chain(build_prompts(texts, as_of), models))
    else:
        fields = extract_fields(texts, as_of)
    number = "experience_number" if models else "experience"
    return fields.select(
        *kept,
        "name",
        "email",
        "phone",
        "location",
        "skills",
        F.col("experience").cast("string").alias("experience_raw"),
        F.col(number).cast("double").alias("experience_number"),
    )
