"""Part of tideweave: streaming."""
