"""Row-wise encoding and decoding of streams."""
