"""Feed and article jobs: streaming."""
