"""Column functions: RDF terms and text similarity."""
