"""See the README for the modules of this part."""
