"""Table store, importers and exporters."""
