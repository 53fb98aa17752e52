"""The incremental form of the raw listing feed."""
