"""Reading tables and landed payloads, deriving the reader's tables, writing the local copy."""
