"""TypeScript and TSX sources to rows of syntax nodes."""
