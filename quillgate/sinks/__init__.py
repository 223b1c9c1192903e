"""Publishing of finished bundles."""
