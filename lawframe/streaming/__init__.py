"""Polls and keyed state: `polls` for repeated deliveries, `buckets` for token buckets, `keyed` for these as a stream."""
