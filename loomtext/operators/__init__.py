"""DataFrame to DataFrame operators over documents, lines and nodes."""
