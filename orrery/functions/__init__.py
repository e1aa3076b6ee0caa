"""Part of orrery; see README.md."""
