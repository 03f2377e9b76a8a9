"""passrate: declarative data-quality rules compiled to Spark plans."""

from passrate.config import DataQualityConfig
from passrate.errors import DQFunctionError
from passrate.operators.paths import flatten, flatten as flatten_spark
from passrate.options import SampleConfig
from passrate.report import DataQualityReport, DataQualityResult
from passrate.rules import (
    AccuracyRule,
    CompletenessRule,
    ConsistencyRule,
    TimelinessRelativeRule,
    TimelinessStaticRule,
    UniquenessRule,
    ValidityNumericalRangeRule,
    ValidityRegexRule,
)

__all__ = [
    "AccuracyRule",
    "CompletenessRule",
    "ConsistencyRule",
    "DQFunctionError",
    "DataQualityConfig",
    "DataQualityReport",
    "DataQualityResult",
    "SampleConfig",
    "TimelinessRelativeRule",
    "TimelinessStaticRule",
    "UniquenessRule",
    "ValidityNumericalRangeRule",
    "ValidityRegexRule",
    "flatten",
    "flatten_spark",
]
