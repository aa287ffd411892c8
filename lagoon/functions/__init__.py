"""Native column expressions: text rules, moderation, formatting, tokens."""
