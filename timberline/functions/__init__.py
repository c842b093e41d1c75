"""Column builders: line patterns, dates, priorities, tags, search predicates."""
