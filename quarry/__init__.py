"""quarry: web-harvest analytics as DataFrame dataflow."""
