"""Rule data: word lists, patterns, slot, join and blueprint rules."""
