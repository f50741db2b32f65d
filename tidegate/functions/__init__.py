"""Column functions: JSON values, SQL types, names, numbers and measurements."""
