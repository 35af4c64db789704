"""Streams: none. Late rows are a matter of batches here: a snapshot's changed dates are found and rebuilt."""
