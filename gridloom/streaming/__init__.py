"""Mini-batches by Structured Streaming."""
