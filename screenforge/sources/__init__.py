"""Tables and files that are read and written."""
