"""Complete alignment runs composed of the operators."""
