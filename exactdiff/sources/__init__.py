"""Readers of strict delimited files and of workbooks, and the options that name them. Sources are never written."""
