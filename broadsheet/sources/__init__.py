"""Feed and article jobs: sources."""
