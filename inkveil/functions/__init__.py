"""Part of inkveil."""
