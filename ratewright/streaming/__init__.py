"""Filings as a stream. An extension: the batch semantics are those of the other folders."""
