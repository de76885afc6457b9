"""Column builders: byte encodings and digests."""
