"""See the package README for an overview."""
