"""Part of the analytics engine; see the README."""
