"""Part of the library; see the README."""
