"""Jobs of several layers."""
