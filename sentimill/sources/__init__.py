"""Sources and sinks."""

from .lines import (
    read_header_csv,
    read_lines,
    read_object_lines,
    read_training_rows,
    write_lines,
)
from .records import load_model, model_version, read_records, save_model, spread, write_records

__all__ = [
    "load_model",
    "model_version",
    "read_header_csv",
    "read_lines",
    "read_object_lines",
    "read_records",
    "read_training_rows",
    "save_model",
    "spread",
    "write_lines",
    "write_records",
]
