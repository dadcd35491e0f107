"""Column functions: time handling and traffic-flow expressions."""
