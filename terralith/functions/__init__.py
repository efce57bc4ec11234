"""Part of terralith."""
