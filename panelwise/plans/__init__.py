"""Complete plans: the feature table and the staged pipeline."""
