"""From query text or builders to lazy plans."""
