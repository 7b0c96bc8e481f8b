"""Feature specs and what is planned with them: evaluation, population, search and review."""
