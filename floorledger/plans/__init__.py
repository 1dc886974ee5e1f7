"""The reports.  Each takes facts of a period (or a ledger) and returns a lazy frame."""
