"""Column expressions: HTTP decoding, masking, path templates, domains and row classes."""
