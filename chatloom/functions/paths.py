"""Path expressions on slash-separated names."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F


def file_name(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def directory(path: Column) -> Column:
    """Everything before the last slash; empty when there is none."""
    return F.left(path, F.length(path) - F.length(file_name(path)) - 1)


def suffix(path: Column) -> Column:
    """Lower-case extension without the dot; a leading dot does not start one."""
    return F.lower(F.regexp_extract(file_name(path), r"^.+\.([^.]+)$", 1))


def relative_name(path: Column, base: str) -> Column:
    """Path below ``base`` with forward slashes. Any file system prefix counts as part of the base."""
    root = re.escape(base.rstrip("/") + "/")
    return F.regexp_replace(F.translate(path, "\\", "/"), f"^.*?{root}", "")
