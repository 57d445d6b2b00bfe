"""Training samples: conversations around a page image and its transcription."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _part(kind: str, text: Column | None = None, image: Column | None = None) -> Column:
    null = F.lit(None).cast("string")
    return F.struct(F.lit(kind).alias("type"), (null if text is None else text).alias("text"), (null if image is None else image).alias("image"))


def conversation(instruction: Column, image: Column, answer: Column) -> Column:
    """messages: the user gives text and image, the assistant the transcription."""
    user = F.struct(F.lit("user").alias("role"), F.array(_part("text", instruction), _part("image", image=image)).alias("content"))
    assistant = F.struct(F.lit("assistant").alias("role"), F.array(_part("text", answer)).alias("content"))
    return F.array(user, assistant)
