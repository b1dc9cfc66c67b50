"""Acceptance specification of a survey."""

from __future__ import annotations

import math
from dataclasses import dataclass, fields


@dataclass(frozen=True)
class SurveySpec:
    """Limits in nT, metres, seconds, degrees and hertz. All but the azimuths must be finite and positive; spike_window must be odd."""

    line_spacing: float = 200
    tie_spacing: float = 2000
    line_azimuth: float = 0
    tie_azimuth: float = 90
    sample_rate: float = 10
    ground_speed: float = 60
    max_along_line_sep: float | None = None
    line_spacing_tol: float = 0.10
    max_deviation: float = 25
    nominal_clearance: float = 60
    clearance_tol: float = 15
    fourth_diff_tol: float = 0.05
    fourth_diff_normalize: bool = True
    spike_nsigma: float = 6
    spike_window: int = 21
    max_diurnal_dev: float = 3
    diurnal_window: float = 60
    max_crossover_rms: float = 2
    max_crossover_abs: float = 6
    max_heading_error: float = 2
    max_gap: float = 1
    max_levelled_rms: float = 1
    max_levelled_abs: float = 3

    def __post_init__(self):
        if self.max_along_line_sep is None:
            object.__setattr__(self, "max_along_line_sep", 1.5 * self.ground_speed / self.sample_rate)
        for f in fields(self):
            value = getattr(self, f.name)
            if f.name in ("line_azimuth", "tie_azimuth"):
                object.__setattr__(self, f.name, value % 360)
            elif f.name != "fourth_diff_normalize" and not (isinstance(value, (int, float)) and math.isfinite(value) and value > 0):
                raise ValueError(f"{f.name} must be one finite positive number")
        if self.spike_window % 2 == 0:
            raise ValueError("spike_window must be odd")

    def __str__(self) -> str:
        return "survey spec: " + ", ".join(f"{f.name}={getattr(self, f.name)}" for f in fields(self))
