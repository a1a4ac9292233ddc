"""Part of tideweave: operators."""
