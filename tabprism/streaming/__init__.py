"""Scoring of arriving rows with fitted parameters (Structured Streaming).

The reference scores one submitted record at a time over HTTP.  Here the
same fitted transforms — scalers and model scorers are row-local projections
with literal parameters — are applied to a streaming DataFrame, so rows that
land in a folder are scored micro-batch by micro-batch, with fixed parameters or
with the latest published version of them.  No state is kept: nothing grows
with the stream.
"""

from tabprism.streaming.scoring import score_stream, stream_source, write_stream, write_versioned_stream  # noqa: F401
