"""DataFrame operators: extraction, ensembles, matching, metrics, analysis, redaction."""
