"""Sources (scans, validation, the test-table adapter) and sinks."""

from basketlens.sources.adapter import logical_sources
from basketlens.sources.readers import (MissingInput, load_sources, parse_timestamp,
                                        read_coefficients, read_master, read_rfm,
                                        require_columns)
from basketlens.sources.sinks import write_table

__all__ = ["logical_sources", "MissingInput", "load_sources", "parse_timestamp",
           "read_coefficients", "read_master", "read_rfm", "require_columns", "write_table"]
