"""Part of tideweave: functions."""
