"""Column expressions shared by the operators: dates, exact rounding, labels, deal predicates."""
