"""Feed and article jobs: plans."""
