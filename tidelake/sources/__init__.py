"""Where frames come from and where they are written."""
