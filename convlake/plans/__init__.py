"""Jobs that join several operators."""
