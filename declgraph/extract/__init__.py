"""Source text to rows: a tolerant lexer, declarations, call sites and bindings."""
