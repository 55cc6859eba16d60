"""Findings as files: rows are built by the engine, files of a report are joined on the driver."""
