"""Part of the content engine; see README.md."""
