"""Sources: files to parsed documents."""
