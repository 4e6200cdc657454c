"""Declarations that are compiled to DataFrame plans: fields, recipes, the crawl builder."""
