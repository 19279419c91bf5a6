"""Document formats, glossaries and reports: readers and writers."""
