"""Where tokens, fields and payloads come from, and where results go."""
