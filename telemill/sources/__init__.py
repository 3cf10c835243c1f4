"""Sources and sinks: driver tables, CSV machine logs, report text."""

from telemill.sources.events_adapter import machine_logs_from_events, load_machine_logs  # noqa: F401
from telemill.sources.csv_logs import read_logs_csv, write_logs_csv, write_enriched, write_report  # noqa: F401
