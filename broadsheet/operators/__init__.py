"""Feed and article jobs: operators."""
