"""Document analytics on Spark: search, similarity, reconciliation and document trees as DataFrame operators."""
