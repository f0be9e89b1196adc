"""Training-data operators: scoring, near-duplicates, packing, tokens, chat, secrets and rules."""
