"""Whole plans: the query layer, reconciliation with the last snapshot, verification, sinks."""
