"""Part of tideweave: plans."""
