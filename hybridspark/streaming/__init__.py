"""Incremental ingestion with Structured Streaming: an extension, as the batch operators do all else."""
