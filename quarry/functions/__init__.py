"""Pure functions: HTML, selectors and structured data on strings, and native Column functions."""
