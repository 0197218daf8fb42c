"""Column functions: chemistry tables and predicates, geometry."""
