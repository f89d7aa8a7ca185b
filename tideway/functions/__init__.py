"""Column functions: ids, entries and headers, routing, and the text formats of keys, positions and owners."""
