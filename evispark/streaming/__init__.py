"""Event envelopes and streaming ingest."""
