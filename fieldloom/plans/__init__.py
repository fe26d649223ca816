"""Rule expressions: scanning, parsing and lowering to columns."""
