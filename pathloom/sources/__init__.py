"""Sources of the document-graph engine."""
