"""Where symbols, edges and files come from, and where they are stored."""
