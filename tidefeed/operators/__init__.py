"""DataFrame operators: filters, dedupe, merge, diff, notifications, reports, extraction."""
