"""Readers of captures; all give exchanges that are masked already."""
