"""Column functions: text, links, dates, identity, quality gates, HTML fields."""
