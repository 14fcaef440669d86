"""Readers: parquet tables, fixture views, TSV drops, lexicon files, pages."""
