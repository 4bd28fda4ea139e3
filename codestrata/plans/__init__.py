"""Assembly of reports from measurements, exports and entry points."""
