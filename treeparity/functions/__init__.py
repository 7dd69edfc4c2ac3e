"""Column expressions: text formats, the sampling plan and digests."""
