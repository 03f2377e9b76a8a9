"""The eight rules as data.  `evaluate` hands a rule to the planner; a rule itself touches no rows."""

from __future__ import annotations

import math
from datetime import UTC, datetime, timedelta
from typing import Annotated, Any, Literal
from warnings import warn

from pydantic import BeforeValidator, Field, TypeAdapter, field_validator, model_validator

from passrate.functions.dates import widened_timedelta
from passrate.functions.expressions import columns_in
from passrate.models import DamaFramework, DataQualityBaseModel, DataQualityDimension, UTCDateTime

Timedelta = Annotated[timedelta | None, BeforeValidator(widened_timedelta)]


class BaseRule(DataQualityBaseModel):
    """Which rows a rule looks at, and how it is called.

    field: a column or a nested path.  na_values: markers that count as null.
    skip_if_null: rows to leave out, by nulls in any, all or (never) none of
    the columns used.
    """

    field: str
    na_values: Any = None
    skip_if_null: Literal["any", "all", "never"] = "any"
    rule_id: Any = None
    rule_description: Any = None

    def columns_used(self) -> list[str]:
        return [self.field]

    def evaluate(self, data_source: Any, index_name: str = "", query: dict | None = None, **options: Any):
        """The rule's result over a Spark or pandas DataFrame."""
        from passrate.plans.planner import measure

        return measure(data_source, [self], **options)[0]


class UniquenessRule(BaseRule):
    """Of the non-null values, distinct ones pass and repeats fail."""

    function: Literal["uniqueness"] = "uniqueness"
    data_quality_dimension: DataQualityDimension = DamaFramework.Uniqueness


class CompletenessRule(BaseRule):
    """Non-null values pass; every row is evaluated."""

    function: Literal["completeness"] = "completeness"
    data_quality_dimension: DataQualityDimension = DamaFramework.Completeness
    skip_if_null: Literal["any", "all", "never"] = Field(default="never", frozen=True)

    @field_validator("skip_if_null", mode="after")
    @classmethod
    def _always_never(cls, value: str) -> str:
        return "never"


class AccuracyRule(BaseRule):
    """Values of a list pass, or with `inverse` all others."""

    function: Literal["accuracy"] = "accuracy"
    valid_values: list
    inverse: bool = False
    data_quality_dimension: DataQualityDimension = DamaFramework.Accuracy


class ValidityRegexRule(BaseRule):
    """Values whose text matches from its start, as Python's re.match has it, pass."""

    function: Literal["validity_regex"] = "validity_regex"
    regex_pattern: str
    data_quality_dimension: DataQualityDimension = DamaFramework.Validity


class ValidityNumericalRangeRule(BaseRule):
    """Numbers from min_value to max_value, both included, pass; text is read as numbers."""

    function: Literal["validity_numerical_range"] = "validity_numerical_range"
    min_value: float = -math.inf
    max_value: float = math.inf
    data_quality_dimension: DataQualityDimension = DamaFramework.Validity

    @field_validator("min_value", mode="before")
    @classmethod
    def _open_below(cls, value: Any) -> Any:
        return -math.inf if value is None else value

    @field_validator("max_value", mode="before")
    @classmethod
    def _open_above(cls, value: Any) -> Any:
        return math.inf if value is None else value


class ConsistencyRule(BaseRule):
    """Rows for which an expression holds pass; of an if/then, rows for which `if` holds are evaluated."""

    function: Literal["consistency"] = "consistency"
    expression: str | dict[str, str]
    skip_if_null: Literal["any", "all", "never"] = "all"
    data_quality_dimension: DataQualityDimension = DamaFramework.Consistency

    @field_validator("expression", mode="after")
    @classmethod
    def _both_parts(cls, value: str | dict[str, str]) -> str | dict[str, str]:
        if isinstance(value, dict) and not {"if", "then"} <= set(value):
            raise ValueError("an expression with conditions needs both 'if' and 'then'")
        return value

    def parts(self) -> tuple[str | None, str]:
        return (self.expression["if"], self.expression["then"]) if isinstance(self.expression, dict) else (None, self.expression)

    def columns_used(self) -> list[str]:
        return list(dict.fromkeys([*columns_in({str(i): p for i, p in enumerate(self.parts()) if p is not None}), self.field]))


class _Timeliness(BaseRule):
    dayfirst: bool = False
    data_quality_dimension: DataQualityDimension = DamaFramework.Timeliness


class TimelinessStaticRule(_Timeliness):
    """Dates from start_date to end_date, both included, pass; one of the two may be open."""

    function: Literal["timeliness_static"] = "timeliness_static"
    start_date: UTCDateTime = None
    end_date: UTCDateTime = None

    @model_validator(mode="after")
    def _a_bound(self):
        if self.start_date is None and self.end_date is None:
            raise ValueError("start_date, end_date or both must be given")
        return self


class TimelinessRelativeRule(_Timeliness):
    """Dates within two timedeltas of a reference date, or of each row's reference column, pass."""

    function: Literal["timeliness_relative"] = "timeliness_relative"
    start_timedelta: Timedelta = None
    end_timedelta: Timedelta = None
    reference_date: UTCDateTime = None
    reference_column: str | None = None

    @model_validator(mode="after")
    def _one_reference(self):
        if self.reference_date is not None and self.reference_column is not None:
            raise ValueError("reference_date and reference_column exclude each other")
        if self.start_timedelta is None and self.end_timedelta is None:
            raise ValueError("start_timedelta, end_timedelta or both must be given")
        if self.reference_date is None and self.reference_column is None:
            self.reference_date = datetime.now(UTC)
            warn(f"neither reference_date nor reference_column is given; the reference is now, {self.reference_date}", stacklevel=2)
        return self

    def columns_used(self) -> list[str]:
        return [self.field, *([self.reference_column] if self.reference_column else [])]


RuleType = Annotated[
    UniquenessRule | CompletenessRule | AccuracyRule | ValidityRegexRule | ValidityNumericalRangeRule | ConsistencyRule | TimelinessStaticRule | TimelinessRelativeRule,
    Field(discriminator="function"),
]
RuleAdapter: TypeAdapter = TypeAdapter(RuleType)
