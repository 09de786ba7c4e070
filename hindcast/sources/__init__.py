"""Table readers, writers and the partition commit."""
