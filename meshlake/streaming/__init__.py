"""Record appends as streams."""

from .records import append_records, read_records

__all__ = ["append_records", "read_records"]
