"""Part of fragweave; see README.md."""
