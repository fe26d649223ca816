"""Evaluation of rules over documents, node tables, and analytics over shelves and search hits."""
