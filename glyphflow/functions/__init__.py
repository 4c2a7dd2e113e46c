"""Part of glyphflow."""
