"""DataFrame transforms over documents, records and fields."""
