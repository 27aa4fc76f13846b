"""Part of safesight."""
