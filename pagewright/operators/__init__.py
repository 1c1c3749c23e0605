"""Dataflow operators over pages, chunks, postings, vectors and results."""
