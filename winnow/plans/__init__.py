"""Ready-made queries over the star schema, event, text and page tables."""
