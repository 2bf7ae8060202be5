"""tidefeed: feed-record analytics (extract, clean, dedupe, diff, notify, audit) on Spark."""

__version__ = "0.1.0"
