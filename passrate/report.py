"""Results and reports: one flat row a rule, as objects, JSON, pandas or Spark frames."""

from __future__ import annotations

import json
import math
import warnings
from datetime import UTC, datetime
from typing import Any

import pandas as pd
from pydantic import Field, FieldSerializationInfo, ValidationInfo, field_serializer, field_validator
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from passrate.models import DataQualityBaseModel, DataQualityDimension, UTCDateTimeStrict

RESULT_SCHEMA = T.StructType(
    [
        *(T.StructField(n, T.StringType()) for n in ("dataset_name", "dataset_id", "measurement_sample", "lifecycle_stage")),
        T.StructField("measurement_time", T.TimestampType()),
        *(T.StructField(n, T.StringType()) for n in ("field", "data_quality_dimension")),
        T.StructField("records_evaluated", T.LongType()),
        T.StructField("pass_rate", T.DoubleType()),
        *(T.StructField(n, T.StringType()) for n in ("rule_id", "rule_description", "rule_data", "records_failed_ids", "records_failed_sample")),
    ]
)


def nan_to_none(value: Any) -> Any:
    """NaN, NaT and NA as None, in nested lists and dicts too."""
    if isinstance(value, dict):
        return {k: nan_to_none(v) for k, v in value.items()}
    if isinstance(value, (list, tuple)):
        return [nan_to_none(v) for v in value]
    if value is pd.NaT or value is pd.NA or (isinstance(value, float) and math.isnan(value)):
        return None
    return value


def shifted_ids(ids: list, shift: int) -> list:
    """Integer ids moved by `shift`; a list with anything else is left as it is."""
    whole = all(isinstance(i, int) and not isinstance(i, bool) for i in ids)
    return [i + shift for i in ids] if shift and whole else ids


class DataQualityResult(DataQualityBaseModel):
    """What one rule found.  Fields stand in the order in which tables show them."""

    dataset_name: float | str | int | None = None
    dataset_id: float | str | int | None = None
    measurement_sample: str | None = None
    lifecycle_stage: Any = None
    measurement_time: UTCDateTimeStrict = Field(default_factory=lambda: datetime.now(UTC))
    field: str
    data_quality_dimension: DataQualityDimension
    records_evaluated: int | None = None
    pass_rate: float | None = Field(ge=0, le=1)
    rule_id: Any = None
    rule_description: Any = None
    rule_data: str
    records_failed_ids: list | None = None
    records_failed_sample: list[dict] | None = None

    @field_serializer("records_failed_sample", when_used="json")
    def _sample_as_json(self, value: list[dict] | None) -> list | None:
        return nan_to_none(value)

    @field_serializer("records_failed_ids", when_used="always")
    def _ids_shifted(self, value: list | None, info: FieldSerializationInfo) -> list | None:
        return value if value is None else shifted_ids(value, (info.context or {}).get("records_failed_ids_shift", 0))

    @field_validator("records_failed_sample", "records_failed_ids", mode="before")
    @classmethod
    def _from_json(cls, value: Any, info: ValidationInfo) -> Any:
        if value is None or isinstance(value, (list, tuple)):
            return value
        try:
            return json.loads(value)
        except (json.JSONDecodeError, TypeError):
            warnings.warn(f"'{info.field_name}' is no JSON and becomes None", stacklevel=2)
            return None

    @field_validator("pass_rate", mode="before")
    @classmethod
    def _no_nan(cls, value: Any) -> Any:
        return nan_to_none(value)


def check_time_format(pattern: str) -> None:
    """A time format must give back a date."""
    try:
        pd.Timestamp(datetime(2025, 1, 1, 12).strftime(pattern))
    except Exception as error:
        raise ValueError(f"measurement_time_format {pattern!r} does not give a date, as '%Y-%m-%d %H:%M:%S' does: {error}") from error


class DataQualityReport(DataQualityBaseModel):
    """The results of a rule set over one dataset."""

    results: list[DataQualityResult] = Field(default_factory=list)

    def to_dataframe(self, decimals: int = 4, measurement_time_format: str | None = None, records_failed_ids_shift: int = 0) -> pd.DataFrame:
        """One pandas row a rule; an empty report gives an empty frame.

        decimals, 1 to 10, rounds pass rates.  records_failed_ids_shift is
        added to integer ids, as for the line numbers of a spreadsheet.
        """
        if not self.results:
            return pd.DataFrame()
        if not isinstance(decimals, int) or not 1 <= decimals <= 10:
            raise ValueError(f"decimals must be an integer from 1 to 10, not {decimals!r}")
        if measurement_time_format:
            check_time_format(measurement_time_format)
        rows = [r.model_dump(mode="python", context={"records_failed_ids_shift": records_failed_ids_shift}) for r in self.results]
        for row in rows:
            row["pass_rate"] = None if row["pass_rate"] is None else round(row["pass_rate"], decimals)
            if measurement_time_format:
                row["measurement_time"] = row["measurement_time"].strftime(measurement_time_format)
        return pd.DataFrame({n: pd.Series([nan_to_none(r[n]) for r in rows], dtype=None if n == "measurement_time" else object) for n in DataQualityResult.model_fields})

    @classmethod
    def from_dataframe(cls, frame: pd.DataFrame) -> DataQualityReport:
        return cls(results=[DataQualityResult.model_validate(nan_to_none(row)) for row in frame.to_dict("records")])

    def to_spark(self, spark: SparkSession) -> DataFrame:
        """The report as a Spark table of RESULT_SCHEMA; lists and free values as JSON text."""
        text = lambda v: v if v is None or isinstance(v, str) else json.dumps(v, default=str)
        rows = []
        for r in self.results:
            d = r.model_dump(mode="json")
            d["measurement_time"] = r.measurement_time
            rows.append(tuple(d[f.name] if isinstance(f.dataType, (T.TimestampType, T.LongType, T.DoubleType)) else text(d[f.name]) for f in RESULT_SCHEMA))
        return spark.createDataFrame(rows, RESULT_SCHEMA)
