"""Fixed values of the data model: datasets with their classes and channels, views, aliases."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

#: Class and channel names of the datasets, in the order of their indexes.
CLINICAL_CLASSES = ("normal", "cardiac_arrhythmia", "sepsis_onset", "hemodynamic_instability", "respiratory_failure", "neurological_event", "infection", "other")
CLINICAL_CHANNELS = ("HR", "SpO2", "SBP", "DBP", "MAP", "RR", "Temp", "GCS")
ALARM_CLASSES = ("asystole", "bradycardia", "tachycardia", "ventricular_tachycardia", "ventricular_fibrillation")
ALARM_CHANNELS = ("ECG_I", "ECG_II", "ABP", "PPG", "RESP")

#: Leads of a record in the order in which they may stand in for a channel, case ignored.
CHANNEL_ALIASES = {
    "ECG_I": ("I", "ECGI", "ECG-I"),
    "ECG_II": ("II", "V", "ECGII", "ECG-II"),
    "ABP": ("ABP",),
    "PPG": ("PLETH", "PPG"),
    "RESP": ("RESP", "RESPIRATION"),
}

#: First letter of a record's name and the class it stands for.
RECORD_PREFIXES = {"a": 0, "b": 1, "t": 2, "v": 3, "f": 4}

#: The parts of the twelve views.
PROMPT_VARIANTS = ("narrow", "standard", "wide")
TEMPERATURES = (0.0, 0.3, 0.7, 1.0)


@dataclass(frozen=True)
class Dataset:
    name: str
    classes: tuple[str, ...]
    channels: tuple[str, ...]
    seconds: int
    length: int


#: Name, classes, channels, seconds and length of the windows.
DATASETS = {
    d.name: d
    for d in (
        Dataset("mimic", CLINICAL_CLASSES, CLINICAL_CHANNELS, 60, 60),
        Dataset("physionet", ALARM_CLASSES, ALARM_CHANNELS, 30, 7500),
        Dataset("physionet_binary", ("false_alarm", "true_alarm"), ALARM_CHANNELS, 30, 7500),
        Dataset("yahoo", ("normal", "anomaly"), ("value",), 3600, 3600),
    )
}


def view_name(variant: str, temperature: float) -> str:
    return f"{variant}_T{float(temperature)}"


def default_views(spark: SparkSession) -> DataFrame:
    """The twelve views: every prompt variant at every temperature, view 0 being narrow at 0.0."""
    rows = [(i, v, t, view_name(v, t)) for i, (v, t) in enumerate((v, t) for v in PROMPT_VARIANTS for t in TEMPERATURES)]
    return spark.createDataFrame(rows, "view_idx int, prompt_variant string, temperature double, view string")


def classes_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(d.name, i, c) for d in DATASETS.values() for i, c in enumerate(d.classes)], "dataset string, class_idx int, class_name string")


def channels_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(d.name, i, c) for d in DATASETS.values() for i, c in enumerate(d.channels)], "dataset string, channel_idx int, channel string")
