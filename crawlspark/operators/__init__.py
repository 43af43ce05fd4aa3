"""DataFrame -> DataFrame operators of the archive pipeline."""
