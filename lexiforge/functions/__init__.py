"""Column expressions on text and their plain Python counterparts."""
