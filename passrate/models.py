"""What rules, results and configurations share: dimensions, dates, JSON."""

from __future__ import annotations

import json
from datetime import UTC, datetime
from enum import Enum
from pathlib import Path
from typing import Annotated, Any

import pandas as pd
from pydantic import BaseModel, BeforeValidator, PlainSerializer, ValidationInfo

from passrate.functions.dates import to_utc_datetime


class DamaFramework(str, Enum):
    """The six dimensions of data quality; looked up in any case."""

    Uniqueness = "Uniqueness"
    Completeness = "Completeness"
    Validity = "Validity"
    Consistency = "Consistency"
    Accuracy = "Accuracy"
    Timeliness = "Timeliness"

    @classmethod
    def _missing_(cls, value: object) -> DamaFramework | None:
        return cls.__members__.get(value.title()) if isinstance(value, str) else None


DataQualityDimension = Annotated[DamaFramework, PlainSerializer(lambda d: d.value)]


def _date(value: Any, info: ValidationInfo) -> datetime | None:
    if value is None or (not isinstance(value, str) and pd.isna(value)):
        return None
    stamp = to_utc_datetime(value, bool(info.data.get("dayfirst", False)))
    if pd.isna(stamp):
        raise ValueError(f"{value!r} is no date")
    return stamp.to_pydatetime(warn=False)


def _iso(value: datetime | None) -> str | None:
    return None if value is None or pd.isna(value) else value.isoformat()


UTCDateTime = Annotated[datetime | None, BeforeValidator(_date), PlainSerializer(_iso, when_used="json")]
UTCDateTimeStrict = Annotated[datetime, BeforeValidator(_date), BeforeValidator(lambda v: datetime.now(UTC) if v is None else v), PlainSerializer(_iso, when_used="json")]


class DataQualityBaseModel(BaseModel):
    def to_dict(self) -> dict[str, Any]:
        """Values that JSON can hold."""
        return self.model_dump(mode="json")

    def to_json(self, path: str | Path | None = None) -> str:
        """JSON with an indent of 2, also written to `path` if there is one."""
        text = json.dumps(self.to_dict(), indent=2)
        if path is not None:
            Path(path).write_text(text, encoding="utf-8")
        return text
