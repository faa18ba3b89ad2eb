"""Table and log readers, derived inputs, and sinks."""
