"""Readers and writers of sample corpora, tensors and summaries."""
