"""Column-level helpers: null rules, text, dates and the normal distribution."""
