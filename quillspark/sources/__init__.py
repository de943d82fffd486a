"""What is read and written: source trees, tables, JSON artefacts."""
