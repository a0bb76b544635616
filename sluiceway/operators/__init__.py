"""DataFrame and Column operators over the line relation and its side tables."""
