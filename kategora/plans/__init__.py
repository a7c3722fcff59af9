"""Plan building blocks: staging, bounded small tables, exact ranks, skew-safe lookups."""
