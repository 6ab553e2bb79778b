"""One function per analysis; each returns lazy tables."""
