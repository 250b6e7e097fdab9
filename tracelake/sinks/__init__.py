"""Results as JSON documents and plain text."""
