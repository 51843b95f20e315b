"""Growing point sets: ingestion by Structured Streaming, and the server that shows what has been committed."""
