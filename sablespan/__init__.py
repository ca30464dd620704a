"""Finding, scoring, checking and masking personal data in text, as Spark DataFrame operations."""
