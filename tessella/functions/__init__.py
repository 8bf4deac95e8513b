"""Part of tessella; see README.md."""
