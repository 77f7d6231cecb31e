"""Column expressions: age bands, dates, trend statistics, fixed values."""
