"""Writers of documents, rows and pictures."""
