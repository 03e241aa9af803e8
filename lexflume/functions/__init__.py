"""Part of lexflume."""
