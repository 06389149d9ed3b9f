"""Part of versolane."""
