"""Find and redact sensitive regions in large image and video collections, on Spark."""

from veilframe.model import Options

__all__ = ["Options"]
