"""Robust flagging of gridded interferometric samples on Spark."""

from fringeworks.config import FlagConfig
from fringeworks.plans.flagging_run import FlagRun, flag_visibilities

__all__ = ["FlagConfig", "FlagRun", "flag_visibilities"]
