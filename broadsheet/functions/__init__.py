"""Feed and article jobs: functions."""
