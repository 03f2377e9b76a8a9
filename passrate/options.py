"""Engine options that hold for the process; read on the driver when a plan is built."""

from __future__ import annotations

from typing import ClassVar


class SampleConfig:
    """How many failing records a result shows."""

    RECORDS_FAILED_SAMPLE_SIZE: ClassVar[int] = 10
