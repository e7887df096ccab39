"""File sources, sinks and versioned tables."""
