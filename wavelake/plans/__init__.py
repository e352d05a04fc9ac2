"""Jobs of many steps: descent."""
