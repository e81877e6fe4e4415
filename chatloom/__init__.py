"""Chat fine-tuning data preparation as Spark DataFrame operators."""

from .session import build_session, prepare
from .sources.datasets import load_dataset
from .sources.formats import detect_format, detect_formats, supported_formats

__all__ = ["build_session", "detect_format", "detect_formats", "load_dataset", "prepare", "supported_formats"]
