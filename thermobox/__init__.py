"""thermobox: regional heat budgets on gridded weather data, as Spark DataFrame jobs."""

from thermobox.specs import BoxRequest, BoxSpec, SourceSpec, SurfacePolicy
from thermobox.sources.state import GridState

__all__ = ["BoxRequest", "BoxSpec", "GridState", "SourceSpec", "SurfacePolicy"]
