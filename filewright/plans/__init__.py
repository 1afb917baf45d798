"""Options and the five commands."""
