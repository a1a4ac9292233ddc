"""Part of tideweave: sources."""
