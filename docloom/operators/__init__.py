"""Relational operators of the document-to-table flow."""
