"""Raw view answers to (label, confidence), never failing.

Stage one reads the outermost braces as JSON, stage two takes label and confidence by pattern, stage three gives (0, 0.5).
The strict JSON stage runs in Python over Arrow batches, through which every answer goes (SQL's JSON functions accept trailing
text and duplicates); the pattern stage is a JVM expression."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The patterns of the second stage.
LABEL_PATTERN = r'"label"\s*:\s*(-?\d+)'
CONFIDENCE_PATTERN = r'"confidence"\s*:\s*([\d.]+)'


def strip_fence(raw: str, mode: str = "strict") -> str:
    """Without an opening code fence. strict: of a complete fence only what follows it is left; repair: its inside."""
    text = raw.strip()
    if not text.startswith("```"):
        return text
    pieces = text.split("```", 2)
    text = pieces[1] if mode == "repair" and len(pieces) == 3 and pieces[1].strip() else pieces[-1]
    return text[4:] if text.startswith("json") else text


def _clamp(x: float, low: float, high: float) -> float:
    return max(low, min(high, x))


def json_stage(text: str, classes: int) -> tuple[int, float] | None:
    a, b = text.find("{"), text.rfind("}")
    if not 0 <= a < b:
        return None
    try:
        found = json.loads(text[a : b + 1])
        label, confidence = found.get("label", 0), found.get("confidence", 0.5)
        if label is None or confidence is None:
            return None
        return int(_clamp(int(label), 0, classes - 1)), float(_clamp(float(confidence), 0.0, 1.0))
    except (ValueError, TypeError, KeyError, AttributeError):
        return None


def pattern_stage(text: Column, classes: int) -> tuple[Column, Column]:
    """(label, confidence) by pattern; label NULL where there is none."""
    label = F.nullif(F.regexp_extract(text, LABEL_PATTERN, 1), F.lit("")).try_cast("decimal(38,0)")
    confidence = F.coalesce(F.nullif(F.regexp_extract(text, CONFIDENCE_PATTERN, 1), F.lit("")).try_cast("double"), F.lit(0.5))
    clamped = F.greatest(F.lit(0), F.least(F.lit(classes - 1), label)).cast("int")
    return F.when(label.isNotNull(), clamped), F.greatest(F.lit(0.0), F.least(F.lit(1.0), confidence))


def parse_answers(df: DataFrame, raw: str, classes: int, fence: str = "strict") -> DataFrame:
    """df with label INT and confidence DOUBLE for every row. NULL answers, and an infinite label, give (0, 0.5)."""

    @F.pandas_udf("struct<text:string,label:int,confidence:double,failed:boolean>")
    def read(answers: pd.Series) -> pd.DataFrame:
        rows = []
        for a in answers:
            if not isinstance(a, str):
                rows.append((None, 0, 0.5, False))
                continue
            text = strip_fence(a, fence)
            try:
                got = json_stage(text, classes)
                rows.append((text, *got, False) if got else (text, None, None, False))
            except OverflowError:
                rows.append((text, 0, 0.5, True))
        out = pd.DataFrame(rows, columns=["text", "label", "confidence", "failed"])
        return out.astype({"label": "Int32", "confidence": "Float64"})

    staged = df.withColumn("__j", read(F.col(raw)))
    label, confidence = pattern_stage(F.col("__j.text"), classes)
    chosen = F.coalesce("__j.label", label, F.lit(0))
    sure = F.when(F.col("__j.label").isNotNull(), F.col("__j.confidence")).when(label.isNotNull(), confidence).otherwise(0.5)
    return staged.withColumn("label", chosen).withColumn("confidence", sure).drop("__j")
