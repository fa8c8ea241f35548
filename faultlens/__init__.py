"""Fault analysis of cluster logs on Spark."""

from faultlens.model import LAYERS, Options
from faultlens.plans.layers import analyze_layer, dispatch_errors
from faultlens.plans.report import FaultReport, analyze_conf, analyze_directories

__all__ = [
    "LAYERS",
    "FaultReport",
    "Options",
    "analyze_conf",
    "analyze_directories",
    "analyze_layer",
    "dispatch_errors",
]
