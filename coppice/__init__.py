"""Tree-structured, event-sourced notes on Spark: search, audits, similarity, replay, reconciliation."""
