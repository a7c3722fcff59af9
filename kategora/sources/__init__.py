"""Readers and writers: article CSVs, folder corpora, zip archives."""
