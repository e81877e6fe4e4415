from .jsontext import first_truthy, is_truthy, json_keys, parse_record
from .paths import directory, file_name, relative_name, suffix
from .text import concat_if, escaped_preview, human_count, human_size, preview, strip

__all__ = [
    "concat_if", "directory", "escaped_preview", "file_name", "first_truthy", "human_count",
    "human_size", "is_truthy", "json_keys", "parse_record", "preview", "relative_name", "strip",
    "suffix",
]
