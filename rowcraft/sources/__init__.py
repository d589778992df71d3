"""Named sources, text files and generated maps."""
