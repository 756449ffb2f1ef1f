"""Where units, edges and attestations come from, and where they go."""
