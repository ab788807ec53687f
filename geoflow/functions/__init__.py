"""Row expressions and aggregates, lowered to Spark columns."""
