"""Extension: incidents as a stream."""
