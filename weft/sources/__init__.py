"""Table, stream, object-store and fixture sources."""
