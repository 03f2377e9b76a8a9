"""A rule set with what it says about its dataset: run, load, save, rebuild."""

from __future__ import annotations

import json
import warnings
from pathlib import Path
from typing import Any

from pydantic import BaseModel, ConfigDict, Field, ValidationError

from passrate.models import UTCDateTime
from passrate.report import DataQualityReport, DataQualityResult
from passrate.rules import RuleAdapter, RuleType
from passrate.sources import yaml_files

_ABOUT = ("dataset_name", "dataset_id", "measurement_sample", "lifecycle_stage", "measurement_time")


class DataQualityConfig(BaseModel):
    model_config = ConfigDict(extra="forbid")

    dataset_name: str | None = None
    dataset_id: str | int | float | None = None
    measurement_sample: str | None = None
    lifecycle_stage: str | None = None
    measurement_time: UTCDateTime = None
    rules: list[RuleType] = Field(default_factory=list)

    def execute(self, data_source: Any, index_name: str = "", query: dict | None = None, **options: Any) -> DataQualityReport:
        """Every rule's result, from as few passes over the data as the rules allow."""
        from passrate.plans.planner import as_spark, measure

        if not self.rules:
            as_spark(data_source)
            return DataQualityReport()
        return DataQualityReport(results=[self._stamped(r) for r in measure(data_source, self.rules, **options)])

    def _stamped(self, result: DataQualityResult) -> DataQualityResult:
        about = {k: getattr(self, k) for k in _ABOUT}
        if about["measurement_time"] is None:
            del about["measurement_time"]
        return result.model_copy(update=about)

    @classmethod
    def from_yaml(cls, file_paths: str | Path | list[str] | list[Path], regex_yaml_path: str | Path | None = None) -> DataQualityConfig:
        """One file or several: rules of all, everything else of the first; named patterns from a file of their own."""
        paths = [file_paths] if isinstance(file_paths, (str, Path)) else list(file_paths)
        if not paths:
            raise ValueError("no file to load")
        loaded = [yaml_files.read(p) for p in paths]
        if len(loaded) > 1:
            warnings.warn("only rules are taken from the second file on; everything else is the first file's", stacklevel=2)
        rules = [rule for content in loaded for rule in content.get("rules") or []]
        if regex_yaml_path is not None:
            rules = yaml_files.with_patterns(rules, yaml_files.read_patterns(regex_yaml_path))
        return cls.model_validate(loaded[0] | {"rules": rules})

    def to_yaml(self, file_path: str | Path, overwrite: bool = False) -> None:
        yaml_files.write(file_path, self.model_dump(exclude={"rules"}) | {"rules": [r.to_dict() for r in self.rules]}, overwrite)

    @classmethod
    def from_report(cls, report: DataQualityReport) -> DataQualityConfig:
        """The rule set that gave a report; entries whose rule cannot be read are left out with a warning."""
        if not report.results:
            raise ValueError("the report has no results")
        rules = []
        for result in report.results:
            if not result.rule_data:
                warnings.warn(f"no rule_data for '{result.field}'; left out", stacklevel=2)
                continue
            try:
                rules.append(RuleAdapter.validate_python(json.loads(result.rule_data)))
            except (ValidationError, json.JSONDecodeError):
                warnings.warn(f"unreadable rule_data {result.rule_data!r}; left out", stacklevel=2)
        first = report.results[0]
        for name in _ABOUT:
            if any(getattr(r, name) != getattr(first, name) for r in report.results) and name != "measurement_time":
                warnings.warn(f"'{name}' differs between results; the first result's is taken", stacklevel=2)
        text = lambda v: v if v is None or isinstance(v, str) else str(v)
        about = {n: getattr(first, n) for n in _ABOUT}
        return cls(rules=rules, **{n: v if n in ("dataset_id", "measurement_time") else text(v) for n, v in about.items()})
