"""Reading access logs and alert tables."""
