"""Event-centred analysis of social-media posts and news dispatches on Spark."""

__version__ = "0.1.0"
