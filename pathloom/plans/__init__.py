"""Plans of the document-graph engine."""
