"""Column expressions: severities, identities, paths, text."""
