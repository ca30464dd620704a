"""The same detection over streams."""
